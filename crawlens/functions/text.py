"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlens.functions.url import let, trim_ws

# Turkish letters and their ASCII counterparts.
_TR_LETTERS, _TR_ASCII = "çğıöşüâîû", "cgiosuaiu"
_TAG_LETTERS, _TAG_ASCII = "çğıöşüâ", "cgiosua"

# Words that never become keywords or hashtags.
STOP_WORDS = [
    "için", "ile", "veya", "ancak", "ama", "yani", "hem", "göre", "üzere", "kadar",
    "sonra", "önce", "arasında", "üzerine", "hakkında", "ayrıca", "böylece", "çünkü",
    "bunlar", "şunlar", "onlar", "bizim", "sizin", "bize", "size", "kendi", "herhangi",
    "daha", "çok", "gibi", "tüm", "bütün", "çeşitli", "farklı", "birçok", "büyük",
    "yeni", "diğer", "geniş", "gelişmiş", "akıllı", "özel", "genel", "önemli",
    "yüksek", "uygun", "hızlı", "kolay", "detaylı", "ayrıntılı", "fazla", "aşkın",
    "olan", "olarak", "olup", "iken", "sahip", "bulunan", "edilir", "edilen", "eder",
    "yapılır", "verilir", "sunulan", "sağlar", "nedir", "nasıl", "neden",
    "burada", "şimdi", "lütfen", "tıklayın", "devamı", "ilgili", "şekilde", "amacıyla",
    "tarafından", "sayfa", "sayfası", "sayfamıza", "siteyi", "sitesi", "anasayfa",
    "iletişim", "hakkımızda", "www", "http", "https", "html",
    "this", "that", "with", "from", "your", "have", "will", "about", "which", "their",
    "more", "page", "home", "contact",
]

# Characters counted as emoji.
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}\x{20E3}]"
WORD_BREAKS = r"""[ \n\r\t.,;:!?()"'\-/]+"""
SENTENCE_BREAKS = r"[.!?\n]"
MIN_KEYWORD_LENGTH = 4


def collapse_ws(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "))


def is_blank(x: Column) -> Column:
    return x.isNull() | ~x.rlike(r"(?U)\S")


def null_if_blank(x: Column) -> Column:
    return F.when(~is_blank(x), x)


def word_count(x: Column) -> Column:
    """Space-separated tokens of whitespace-normalised text; 0 for empty text."""
    return F.when(F.coalesce(F.length(x), F.lit(0)) == 0, 0).otherwise(F.size(F.split(x, " +")))


def invariant_lower(x: Column) -> Column:
    """Culture-free lower case: the dotted capital İ has no counterpart and stays."""
    kept = F.replace(F.lower(F.replace(x, F.lit("İ"), F.lit("\ue000"))), F.lit("\ue000"), F.lit("İ"))
    return F.when(F.contains(x, F.lit("İ")), kept).otherwise(F.lower(x))


def turkish_lower(x: Column) -> Column:
    return F.lower(F.translate(x, "Iİ", "ıi"))


def fold_headline(x: Column) -> Column:
    """Turkish lower case without accents, for comparing headlines with labels."""
    return F.translate(turkish_lower(x), _TR_LETTERS, _TR_ASCII)


# Letters with accents that decompose into a base letter plus marks, of all scripts
# with an alphabet. The table is built from the Unicode data.
def _accent_table() -> tuple[str, str]:
    import unicodedata

    source, target = [], []
    for code in range(0xC0, 0x20000):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        base = parts[0]
        if base != char and all(unicodedata.combining(c) for c in parts[1:]):
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTS, _PLAIN = _accent_table()


def fold_anchor(x: Column) -> Column:
    """Lower-case anchor text reduced to letters, digits and spaces (İ ends up as I)."""
    lowered = F.translate(invariant_lower(trim_ws(F.coalesce(x, F.lit("")))), "ı", "i")
    plain = F.translate(lowered, _ACCENTS, _PLAIN)
    return F.btrim(F.regexp_replace(plain, r"[^\p{L}\p{Nd} ]", ""))


def rtrim_chars(x: Column, chars: str) -> Column:
    """Remove trailing characters of a regex character class body."""
    return F.regexp_replace(x, rf"[{chars}]+$", "")


def tidy(x: Column) -> Column:
    """Collapsed text without trailing punctuation."""
    return rtrim_chars(collapse_ws(x), r".,;: …")


def _clip(x: Column, limit: int | Column, cut_at: Column) -> Column:
    limit = F.lit(limit) if isinstance(limit, int) else limit

    def shorten(cut: Column) -> Column:
        # 0-based index of the last space.
        last_space = F.length(cut) - F.locate(" ", F.reverse(cut))
        word = F.when(
            (F.locate(" ", cut) > 0) & (last_space > F.floor(limit / F.lit(2))), F.substring(cut, F.lit(1), last_space)
        ).otherwise(cut)
        return F.concat(rtrim_chars(word, r" ,.;:"), F.lit("…"))

    return F.when(F.length(x) <= limit, x).otherwise(let(F.substring(x, F.lit(1), cut_at), shorten))


def clip_post(x: Column, limit: int | Column) -> Column:
    """Cut at a word boundary so that the ellipsis still fits in ``limit``."""
    col = F.lit(limit) if isinstance(limit, int) else limit
    return _clip(x, limit, col - 1)


def clip_caption(x: Column, limit: int | Column) -> Column:
    """Cut at a word boundary; the ellipsis comes on top of ``limit``."""
    col = F.lit(limit) if isinstance(limit, int) else limit
    return _clip(x, limit, col)


def strip_emoji(x: Column) -> Column:
    """Remove emoji, then collapse the spaces of each line."""
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), EMOJI, "")
    lines = F.transform(
        F.split(bare, "\n"), lambda line: F.regexp_replace(F.regexp_replace(line, " +", " "), r"^ | $", "")
    )
    return F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")


def body_key(x: Column) -> Column:
    """Normal form under which two posts count as the same text."""
    return invariant_lower(collapse_ws(x))


def hashtag_words(x: Column) -> Column:
    """Words that may become hashtags, in their own spelling."""
    return F.filter(
        F.split(F.coalesce(x, F.lit("")), WORD_BREAKS),
        lambda w: (F.length(w) >= MIN_KEYWORD_LENGTH) & w.rlike(r"^\p{L}+$") & ~F.lower(w).isin(STOP_WORDS),
    )


def hashtag(word: Column) -> Column:
    """``#`` plus the ASCII form of a word; null when fewer than four characters remain."""
    bare = F.regexp_replace(F.translate(turkish_lower(word), _TAG_LETTERS, _TAG_ASCII), "[^a-z0-9]", "")
    return F.when(
        (F.length(word) >= MIN_KEYWORD_LENGTH) & (F.length(bare) >= MIN_KEYWORD_LENGTH), F.concat(F.lit("#"), bare)
    )


def sentences(x: Column) -> Column:
    return F.filter(F.split(F.coalesce(x, F.lit("")), SENTENCE_BREAKS), lambda s: s != "")


def first_sentence(x: Column, min_length: int) -> Column:
    """First trimmed sentence of at least ``min_length`` characters (two or more); reads no further than that."""
    first = F.regexp_extract(x, rf"(?U)(?:^|[.!?\n])\s*([^\s.!?][^.!?\n]{{{min_length - 2},}}[^\s.!?])", 1)
    return F.when(first != "", first)


def enum_key(x: Column) -> Column:
    """Spelling-insensitive key of an enum text; null for blank."""
    return null_if_blank(F.lower(F.regexp_replace(F.btrim(x), "[_-]", "")))


def parse_enum(x: Column, members: list[str]) -> Column:
    """Snake-case member named by ``x``; null for blank, an error for unknown text."""
    key = enum_key(x)
    found = F.lit(None).cast("string")
    for member in members:
        found = F.when(key == member.replace("_", ""), F.lit(member)).otherwise(found)
    return F.when(key.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("unknown value: "), x)).cast("string")).otherwise(found)


def snake_case(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1_$2"))


def distinct_ci(values: Column) -> Column:
    """Array without case-insensitive repeats; the first spelling and the order stay."""
    keyed = F.array_sort(
        F.transform(values, lambda v, i: F.struct(F.lower(v).alias("key"), i.alias("i"), v.alias("v")))
    )
    firsts = let(keyed, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["key"] != x["key"])))
    in_order = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v"))))
    return F.transform(in_order, lambda x: x["v"])
