"""Post texts against a plain Python rendering of the same rules, on a small fixture."""

import re

import pytest
from pyspark.sql import functions as F

from crawlens.functions import text as T
from crawlens.operators import brands, headlines, posts, selection

TEXT = "This is the first sentence of the page text. And here is a second one that is long enough! Short. A third sentence closes the page text nicely"
SCHEMA = (
    "crawl_id string, site_id string, page_id string, url string, h1 array<string>, title string, meta_description string, og_data string, "
    "main_text string, kind string, place int, used int, brand_id string, tone string, address_form string, emoji_usage string, "
    "banned_phrases array<string>, default_hashtags array<string>, social_handles map<string,string>"
)


def _row(key, kind, meta, brand=None, tone=None, form=None, emoji=None, banned=(), handles=None, heading="A useful heading"):
    return ("c", "s", key, f"https://e.com/{key}", [heading], None, meta, None, TEXT, kind, 1, 0, brand, tone, form, emoji, list(banned), ["#Brand"], handles or {})


ROWS = [
    _row("a", "other", "The description of the page in one sentence"),
    _row("b", "article", None, "b1", "samimi", "sen", "heavy"),
    _row("c", "other", None, "b2", "satis_odakli", "siz", "light", handles={"instagram": "acct"}),
    _row("d", "listing", "A useful heading and more", "b3", "kurumsal", "sen", "none", banned=["nedir"]),
]


def _plain(row, code, index):
    """The rules once more, in plain Python."""
    (_, _, _, url, h1, _, meta, _, text, kind, _, _, brand, tone, form, emoji, _, _, handles) = row
    angles = ["bilgilendirici", "merak_uyandiran"] if kind == "article" else (
        ["satis_odakli", "bilgilendirici", "merak_uyandiran"] if tone == "satis_odakli" else ["bilgilendirici", "merak_uyandiran", "satis_odakli"])
    angle, rnd = angles[index % len(angles)], index // len(angles)
    formal, casual, emoji = form != "sen", brand is None or tone in ("samimi", "satis_odakli"), (emoji or "none") if brand else "none"
    head = h1[0]
    parts = [s.strip() for s in re.split(r"[.!?\n]", text) if len(s.strip()) > 30]
    if rnd == 0 and meta:
        value = meta
    else:
        chunks = (len(parts) + 1) // 2
        slot = (rnd if not meta else rnd - 1) % (chunks + (1 if meta else 0))
        value = meta if slot == chunks else ". ".join(parts[slot * 2:slot * 2 + 2]) + "."
    if value.lower().startswith(head.lower()) or head.lower().startswith(value.lower()):
        value = None
    you = lambda a, b: a if formal else b
    v = rnd % 3
    if angle == "merak_uyandiran":
        hook = [f"{head} — nedir, ne işe yarar?", f"{head}: işin aslı ne?" if casual else f"Merak edenler için: {head}",
                f"Hiç düşündün{you('üz', '')} mü? {head}" if casual else f"{head}: öne çıkan noktalar"][v]
    elif angle == "satis_odakli" and v:
        hook = [None, f"{you('Aradığınız', 'Aradığın')} çözüm: {head}", f"{head} için doğru adres"][v]
    else:
        hook = [head, f"Yakından bakalım: {head}", f"Kısaca {head}"][v]
    table = next(t for a, n, f, t in posts.CTA_TEXTS if a == (kind == "article") and n in ("*", angle) and f in ("*", formal))
    verb = table[(rnd // 3) % 3]
    if code != "instagram":
        tail = f": {url}"
    else:
        tail = f" — bağlantı @{handles[code]} profilinde." if code in handles else " — bağlantı profilimizde."
    cta = ("👉 " if emoji == "heavy" else "") + verb + tail
    if emoji != "none":
        hook = posts.HOOK_EMOJI[angle] + " " + hook
    return angle, hook + "\n" + (f"\n{value}\n" if value else "") + "\n" + cta


@pytest.fixture(scope="module")
def jobs(spark):
    return posts.post_jobs(posts.page_parts(spark.createDataFrame(ROWS, SCHEMA)), ["instagram", "linkedin"])


def test_template_posts(spark, jobs):
    many = jobs.withColumn("post_index", F.explode(F.sequence(F.lit(0), F.lit(20))))
    by_key = {r[2]: r for r in ROWS}
    got = posts.template_posts(many).select("page_id", "platform_code", "post_index", "angle", "body").collect()
    assert len(got) == 4 * 2 * 21
    for r in got:
        assert (r.angle, r.body) == _plain(by_key[r.page_id], r.platform_code, r.post_index), (r.page_id, r.post_index)


def test_unique_posts(spark, jobs):
    first = posts.unique_posts(jobs, spark.createDataFrame([], "site_id string, body_key string")).cache()
    bodies = {(r.page_id, r.platform_code): r for r in first.collect()}
    assert all(not r.repeated for r in bodies.values())
    # "nedir" is banned for page d, so the hook it would start with is skipped.
    assert bodies[("d", "linkedin")].attempt == 1 and "nedir" not in bodies[("d", "linkedin")].body.lower()
    known = first.select("site_id", F.lower(F.regexp_replace("body", r"\s+", " ")).alias("body_key"))
    rounds = []
    again = {(r.page_id, r.platform_code): r for r in posts.unique_posts(jobs, known, rounds=rounds).collect()}
    assert rounds[0] == 8 and rounds == sorted(rounds, reverse=True)
    assert all(again[k].body != bodies[k].body and again[k].attempt > bodies[k].attempt for k in bodies)


def test_history_is_read_once(spark, jobs):
    """However many rounds there are, known texts are read and hashed once."""
    first = posts.unique_posts(jobs, spark.createDataFrame([], "site_id string, body_key string"))
    keys = [(r.site_id, " ".join(r.body.lower().split())) for r in first.select("site_id", "body").collect()]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    known = spark.createDataFrame(keys, "site_id string, body_key string").mapInArrow(count, "site_id string, body_key string")
    rounds = []
    posts.unique_posts(jobs, known, rounds=rounds).collect()
    assert len(rounds) > 1 and read.value == len(keys)


def test_unique_posts_against_trying_one_by_one(spark, jobs):
    """With a history of ever more rotations, against a plain search over the texts of all of them."""
    every = jobs.withColumn("start", F.col("post_index")).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("post_index", F.col("start") + F.col("n"))
    texts = brands.guard(posts.template_posts(every).withColumn("hashtags", F.array().cast("array<string>")))
    rows = texts.select("job_id", "site_id", F.col("n").alias("attempt"), "body", "passes", T.body_key(F.col("body")).alias("key")).collect()
    by_job = {}
    for r in sorted(rows, key=lambda r: r.attempt):
        by_job.setdefault(r.job_id, []).append(r)
    for used in (0, 1, 3, 8, 12):
        known = {(r.site_id, r.key) for own in by_job.values() for r in own[:used]}
        frame = spark.createDataFrame(sorted(known), "site_id string, body_key string")
        got = {r.job_id: (r.attempt, r.repeated, r.body) for r in posts.unique_posts(jobs, frame, attempts=12).collect()}
        want = {}
        for job, own in by_job.items():
            passing = [r for r in own if r.passes]
            new = [r for r in passing if (r.site_id, r.key) not in known]
            best = (new or passing or [None])[0]
            want[job] = (best.attempt, not new, best.body) if best else (None, None, None)
        assert got == want


def test_hashtags(spark, jobs):
    tags = {(r.page_id, r.platform_code): r.hashtags for r in posts.with_hashtags(jobs).collect()}
    assert tags[("a", "linkedin")] == ["#Brand", "#useful", "#heading", "#sentence", "#text"]
    assert len(tags[("a", "instagram")]) == 8


def test_guard_and_brands(spark):
    rows = spark.createDataFrame(
        [(1, "İNDİRİM  var", None, "b", "none", ["indirim var"]), (2, "indırım var", None, "b", "none", ["indirim var"]), (3, "🎉 ", None, "b", "none", []),
         (4, "🎉 x", "👉", None, None, None)],
        "id int, body string, cta string, brand_id string, emoji_usage string, banned_phrases array<string>",
    ).withColumns({"description": F.lit(None).cast("string"), "hashtags": F.array(F.lit("#IndirimVar"), F.lit("#ok"))})
    got = {r.id: r for r in brands.guard(rows).collect()}
    assert [got[i].passes for i in (1, 2, 3, 4)] == [False, True, False, True]
    assert got[4].body == "🎉 x" and got[4].hashtags == ["#IndirimVar", "#ok"] and got[2].hashtags == ["#IndirimVar", "#ok"]


def test_page_kind_and_photo(spark):
    kinds = {
        "https://e.com/blog/my-post": "article", "https://e.com/2024/05/my-post": "article", "https://e.com/blog": "listing", "https://e.com/blog/sayfa/2": "listing",
        "https://e.com/haber-detay/x": "article", "https://e.com/about": "other", "https://e.com/": "other", "https://e.com/news/12": "listing", "https://e.com/bloggers/x": "other",
    }
    rows = spark.createDataFrame([(u, [], None) for u in kinds], "url string, schema_types array<string>, og_data string")
    assert {r.url: r.k for r in rows.select("url", selection.page_kind().alias("k")).collect()} == kinds
    photos = {"https://e.com/up/a.jpg": True, "https://e.com/logos-old/2020/a.jpg": True, "https://e.com/img/logo.png": False, "https://e.com/a.svg": False,
              "ftp://e.com/a.jpg": False, "https://e.com/icons/a.jpg": False}
    rows = spark.createDataFrame([(u,) for u in photos], "url string")
    assert {r.url: r.p for r in rows.select("url", selection.looks_like_photo(F.col("url")).alias("p")).collect()} == photos


def test_headline(spark):
    rows = spark.createDataFrame(
        [(1, ["HAKKIMIZDA!", " Real  heading. "], None, None, None), (2, ["İletişim"], "Title part | Brand", None, None), (3, [], "Blog", "Short. A long enough first sentence here. x", None),
         (4, ["Galeri"], None, None, None)],
        "id int, h1 array<string>, title string, meta_description string, main_text string",
    )
    assert [r[0] for r in rows.orderBy("id").select(headlines.meaningful_headline()).collect()] == ["Real heading", "Title part", "A long enough first sentence here", None]
