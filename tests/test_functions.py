import random
import re
from collections import Counter

from pyspark.sql import functions as F

from crawlens.functions import text as T
from crawlens.functions import words
from crawlens.functions import url as U

BASE = "https://example.com/blog/start"


def test_normalize_url(evaluate):
    cases = [
        ("/about", "https://example.com/about"),
        ("post-1", "https://example.com/blog/post-1"),
        ("../contact", "https://example.com/contact"),
        ("./x/../y/.", "https://example.com/blog/y/"),
        ("../../../up", "https://example.com/up"),
        ("https://example.com/x", "https://example.com/x"),
        ("//example.com/y", "https://example.com/y"),
        ("?page=2", "https://example.com/blog/start?page=2"),
        ("#part", None), ("mailto:a@b.com", None), ("tel:+90", None), ("javascript:void(0)", None),
        ("data:text/plain,x", None), ("", None), ("   ", None), (None, None),
        ("/a#part", "https://example.com/a"),
        ("/a?utm_source=x&id=7&fbclid=z&q=s", "https://example.com/a?id=7&q=s"),
        ("/a?utm_source=x&gclid=y", "https://example.com/a"),
        ("/a?ref=x&UTM_medium=m", "https://example.com/a?ref=x"),
        ("HTTPS://Example.COM/Path", "https://example.com/Path"),
        ("https://example.com:443/a", "https://example.com/a"),
        ("http://example.com:8080/a", "http://example.com:8080/a"),
        ("https://example.com", "https://example.com/"),
        ("/für immer", "https://example.com/f%C3%BCr%20immer"),
        ("/f%C3%BCr+1?a=[b]", "https://example.com/f%C3%BCr+1?a=[b]"),
        ("http:///nohost", None),
    ]
    got = evaluate(U.normalize_url(F.col("h"), F.lit(BASE)), [(c[0],) for c in cases], "h string")
    assert dict(zip([c[0] for c in cases], got)) == dict(cases)


def test_site_base(evaluate):
    cases = {
        "https://Example.com/": "https://example.com", "https://example.com": "https://example.com",
        "https://example.com/shop/": "https://example.com/shop", "http://example.com:8080/": "http://example.com:8080",
        "ftp://example.com": None, "example.com": None, "": None,
    }
    assert evaluate(U.normalize_site_base(F.col("u")), [(k,) for k in cases], "u string") == list(cases.values())


def test_internal_and_assets(evaluate):
    internal = {
        "https://example.com/a": True, "https://www.example.com/a": True, "http://example.com/a": True,
        "https://other.com/a": False, "https://sub.example.com/a": False,
    }
    assert evaluate(U.is_internal(F.col("u"), F.lit(BASE)), [(k,) for k in internal], "u string") == list(internal.values())
    assets = {
        "https://example.com/files/list.pdf": True, "https://example.com/up/2024/photo.JPG": True,
        "https://example.com/pack.tar.gz": True, "https://example.com/get.pdf?v=2": True,
        "https://example.com/": False, "https://example.com/blog/post": False, "https://example.com/item.html": False,
        "https://example.com/v1.2/doc": False, "https://example.com/dot.": False,
    }
    assert evaluate(U.is_likely_asset(F.col("u")), [(k,) for k in assets], "u string") == list(assets.values())


def test_segments_and_slashes(evaluate):
    assert evaluate(U.url_segments(F.col("u")), [("https://e.com//Blog/f%C3%BCr+x/%zz/?q=1",)], "u string") == [
        ["blog", "für+x", "%zz"]
    ]
    assert evaluate(U.trim_slash(F.col("u")), [("https://e.com/a//",)], "u string") == ["https://e.com/a"]
    assert evaluate(U.sitemap_key(F.col("u")), [("/",), ("https://E.com/A/",)], "u string") == ["/", "https://e.com/a"]


def test_text_functions(evaluate):
    one = lambda e, v: evaluate(e, [(v,)], "x string")[0]
    x = F.col("x")
    assert one(T.collapse_ws(x), " a\t b\n c ") == "a b c"
    assert one(T.fold_anchor(x), "  TIKLAYIN! ") == "tiklayin"
    assert one(T.fold_anchor(x), "Devamı…") == "devami"
    assert one(T.fold_headline(x), "İLETİŞİM") == "iletisim"
    assert one(T.fold_headline(x), "HAKKIMIZDA") == "hakkimizda"
    assert one(T.word_count(x), "a b  c") == 3
    assert one(T.word_count(x), "") == 0
    assert one(T.strip_emoji(x), "🎉 a  ⭐ b\n c🎉 ") == "a b\nc"
    assert one(T.clip_post(x, 10), "abc defgh ijk") == "abc defgh…"
    assert one(T.clip_caption(x, 10), "abc, defgh ijk") == "abc, defgh…"
    assert one(T.clip_post(x, 10), "abcdefghijklm") == "abcdefghi…"
    assert one(T.clip_post(x, 10), "short") == "short"
    assert one(words.keywords(x, 9), "Veri için ab1c VERİLER don't page kitap/okul") == ["kitap", "okul", "veri", "verİler"]
    assert one(words.by_frequency(x), "Okul kitap veri OKUL, the Kitap okul") == ["Okul", "kitap", "veri"] and one(words.by_frequency(x), None) == []
    assert one(T.hashtag(x), "Çağrı") == "#cagri"
    assert one(T.hashtag(x), "ABC") is None
    assert one(T.first_sentence(x, 5), "ab. cdefgh! ijklmno") == "cdefgh"
    assert one(T.first_sentence(x, 5), "abcd    . \n  de fg \t\nrest of it") == "de fg" and one(T.first_sentence(x, 5), "abcd   ") is None and one(T.first_sentence(x, 5), None) is None
    assert one(T.first_sentence(x, 5), "    \u00a0five5 \u00a0? tail") == "five5" and len(one(T.first_sentence(x, 25), "x " * 300_000)) == 599_999
    assert one(T.parse_enum(x, ["satis_odakli", "samimi"]), "Satis-Odakli") == "satis_odakli"
    assert one(T.parse_enum(x, ["samimi"]), " ") is None
    assert one(T.snake_case(x), "StructuredData") == "structured_data"
    assert one(T.snake_case(x), "I18n") == "i18n"
    assert evaluate(T.distinct_ci(F.col("x")), [(["b", "A", "a", "B", "c"],)], "x array<string>") == [["b", "A", "c"]]


def test_words_of_long_texts_are_counted_by_slices():
    rng = random.Random(3)
    text = "".join(rng.choice(["Kitap", "okul", "VERİ", "veri", "ab", "x1y2z", "ünlü", " ", ". ", "-", "\u000b", "'"]) for _ in range(5000))
    whole = words.ranked(text)
    plain = Counter(w for w in re.split(T.WORD_BREAKS, text) if len(w) >= 4)
    assert words.counted(text) == plain and all(words.ranked(text, size=n) == whole and words.counted(text, n) == plain for n in (1, 7, 100))
    groups = {}
    for w in re.split(T.WORD_BREAKS, text):
        if len(w) >= 4 and w.isalpha() and w.lower() not in T.STOP_WORDS:
            groups.setdefault(w.lower(), []).append(w)
    assert whole == [w for _, w in sorted((-len(g), g[0]) for g in groups.values())] and words.ranked(text, most=2) == whole[:2]
