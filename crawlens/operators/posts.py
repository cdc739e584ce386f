"""Posts from page texts: angle, hook, value, call to action, hashtags, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens import catalogue
from crawlens.functions import text as T
from crawlens.functions import url as U
from crawlens.functions import words
from crawlens.operators import brands
from crawlens.operators.headlines import meaningful_headline
from crawlens.scale import cut

DEFAULT_MAX_CHARS, MAX_VALUE, MAX_TAGS, FIRST_WORDS = 1000, 400, 8, 32
SHORT_HEADING, HOOKS, SENTENCES_PER_VALUE, MIN_SENTENCE = 45, 3, 2, 30
MAX_ATTEMPTS = 36

# Angles in rotation order and their texts.
ANGLES = ["bilgilendirici", "merak_uyandiran", "satis_odakli"]
ARTICLE_ANGLES = ["bilgilendirici", "merak_uyandiran"]
SALES_FIRST = ["satis_odakli", "bilgilendirici", "merak_uyandiran"]
HOOK_EMOJI = {"bilgilendirici": "📌", "merak_uyandiran": "🤔", "satis_odakli": "✨"}
CTA_EMOJI = "👉"
# {H} is the heading. Keys: angle, variant, short heading, formal, casual ("*" matches all; first match counts).
HOOK_TEXTS = [
    ("merak_uyandiran", 0, True, "*", "*", "{H} — nedir, ne işe yarar?"),
    ("merak_uyandiran", 0, False, "*", "*", "{H}"),
    ("merak_uyandiran", 1, True, "*", True, "{H}: işin aslı ne?"),
    ("merak_uyandiran", 1, "*", "*", "*", "Merak edenler için: {H}"),
    ("merak_uyandiran", 2, "*", True, True, "Hiç düşündünüz mü? {H}"),
    ("merak_uyandiran", 2, "*", False, True, "Hiç düşündün mü? {H}"),
    ("merak_uyandiran", 2, "*", "*", False, "{H}: öne çıkan noktalar"),
    ("satis_odakli", 1, "*", True, "*", "Aradığınız çözüm: {H}"),
    ("satis_odakli", 1, "*", False, "*", "Aradığın çözüm: {H}"),
    ("satis_odakli", 2, "*", "*", "*", "{H} için doğru adres"),
    ("*", 1, "*", "*", "*", "Yakından bakalım: {H}"),
    ("*", 2, "*", "*", "*", "Kısaca {H}"),
    ("*", 0, "*", "*", "*", "{H}"),
]
# Keys: article, angle, formal; three texts used in turn.
CTA_TEXTS = [
    (True, "merak_uyandiran", "*", ["Devamı yazıda", "Yazının devamı sayfamızda", "Ayrıntılar yazıda"]),
    (True, "*", True, ["Yazının tamamını okuyun", "Tüm yazıyı okuyun", "Yazının tamamı sayfamızda"]),
    (True, "*", False, ["Yazının tamamını oku", "Tüm yazıyı oku", "Yazının tamamı sayfamızda"]),
    (False, "satis_odakli", True, ["Teklif alın", "Hemen bize ulaşın", "Bilgi ve teklif için iletişime geçin"]),
    (False, "satis_odakli", False, ["Teklif al", "Hemen bize ulaş", "Bilgi ve teklif için iletişime geç"]),
    (False, "merak_uyandiran", True, ["Detayları inceleyin", "Cevabı sayfamızda bulun", "Merak ettikleriniz sayfamızda"]),
    (False, "merak_uyandiran", False, ["Detayları incele", "Cevabı sayfamızda bul", "Merak ettiklerin sayfamızda"]),
    (False, "*", True, ["Ayrıntılar için sayfamıza göz atın", "Tüm detaylar sayfamızda", "Daha fazlası için sayfamızı ziyaret edin"]),
    (False, "*", False, ["Ayrıntılar için sayfamıza göz at", "Tüm detaylar sayfamızda", "Daha fazlası için sayfamızı ziyaret et"]),
]


def _pick(rows: list[tuple], keys: list[Column], result) -> Column:
    """First table row whose keys match, as one CASE expression."""
    out = F.lit(None)
    for row in reversed(rows):
        hit = F.lit(True)
        for key, wanted in zip(keys, row[:-1]):
            if wanted != "*":
                hit = hit & (key == F.lit(wanted))
        out = F.when(hit, result(row[-1])).otherwise(out)
    return out


def page_parts(pages: DataFrame) -> DataFrame:
    """Adds what all posts of a page share: heading, meta text, value sentences, tag words by frequency.

    The whole stored text is split once for its sentences and once for its words.
    """
    meta = F.when(F.length("meta_description") > 0, T.clip_post(T.collapse_ws(F.col("meta_description")), MAX_VALUE))
    long_sentences = F.filter(
        F.transform(T.sentences(F.col("main_text")), T.collapse_ws), lambda s: F.length(s) > MIN_SENTENCE
    )
    heading = F.coalesce(T.clip_post(meaningful_headline(), MAX_VALUE), T.collapse_ws(F.col("url")))
    return pages.withColumns(
        {
            "p_heading": heading, "p_meta": meta, "p_sentences": T.distinct_ci(long_sentences),
            "p_tag_words": words.by_frequency(F.col("main_text")),
        }
    )


def _value(round_: Column) -> Column:
    """Description first, then pairs of sentences, starting over when they are used up."""
    meta, sentences = F.col("p_meta"), F.col("p_sentences")
    chunks = F.ceil(F.size(sentences) / F.lit(SENTENCES_PER_VALUE)).cast("int")
    chunk = F.when(meta.isNull(), round_).otherwise(round_ - 1)
    slots = chunks + F.when(meta.isNull(), 0).otherwise(1)
    slot = F.pmod(chunk, F.greatest(slots, F.lit(1))).cast("int")
    picked = F.concat(
        F.array_join(F.slice(sentences, slot * SENTENCES_PER_VALUE + 1, SENTENCES_PER_VALUE), ". "), F.lit(".")
    )
    return (
        F.when((round_ == 0) & meta.isNotNull(), meta)
        .when(F.size(sentences) == 0, meta)
        .when(slot == chunks, meta)
        .otherwise(T.clip_post(picked, MAX_VALUE))
    )


def template_posts(rows: DataFrame) -> DataFrame:
    """Adds angle, body, cta, description and char_count for ``post_index``.

    Rows carry ``page_parts`` columns, kind, platform columns (max_chars,
    supports_links, platform_code) and brand columns (brand_id, tone,
    address_form, emoji_usage, social_handles). Pure Column expressions.
    """
    index = F.greatest(F.col("post_index"), F.lit(0))
    article = F.col("kind") == "article"
    lists = lambda names: F.array(*[F.lit(n) for n in names])
    angles = (
        F.when(article, lists(ARTICLE_ANGLES))
        .when(F.coalesce(F.col("tone"), F.lit("")) == "satis_odakli", lists(SALES_FIRST))
        .otherwise(lists(ANGLES))
    )
    staged = rows.withColumns(
        {
            "angle": F.get(angles, F.pmod(index, F.size(angles)).cast("int")),
            "_round": F.floor(index / F.size(angles)).cast("int"),
            "_formal": F.coalesce(F.col("address_form"), F.lit("siz")) != "sen",
            "_casual": F.col("brand_id").isNull() | F.col("tone").isin("samimi", "satis_odakli"),
            "_emoji": F.when(F.col("brand_id").isNull(), F.lit("none")).otherwise(F.coalesce("emoji_usage", F.lit("none"))),
        }
    ).withColumn("_value", _value(F.col("_round")))
    heading = F.col("p_heading")
    verb = _pick(
        CTA_TEXTS, [article, F.col("angle"), F.col("_formal")],
        lambda texts: F.get(lists(texts), F.pmod(F.floor(F.col("_round") / HOOKS), F.lit(len(texts))).cast("int")),
    )
    handle = F.try_element_at(F.coalesce("social_handles", F.create_map().cast("map<string,string>")), F.col("platform_code"))
    target = (
        F.when(F.coalesce("supports_links", F.lit(False)), F.concat(F.lit(": "), "url"))
        .when(handle.isNull(), F.lit(" — bağlantı profilimizde."))
        .otherwise(F.concat(F.lit(" — bağlantı @"), handle, F.lit(" profilinde.")))
    )
    cta = F.concat(F.when(F.col("_emoji") == "heavy", F.lit(f"{CTA_EMOJI} ")).otherwise(F.lit("")), verb, target)
    low_v, low_h = F.lower("_value"), F.lower(heading)
    value = F.when(~(low_v.startswith(low_h) | low_h.startswith(low_v)), F.col("_value"))
    hook = _pick(
        HOOK_TEXTS,
        [F.col("angle"), F.pmod("_round", F.lit(HOOKS)), F.length(heading) <= SHORT_HEADING, F.col("_formal"), F.col("_casual")],
        lambda text: F.concat(*[heading if part == "{H}" else F.lit(part) for part in _split_template(text)]),
    )
    smile = F.lit("")
    for angle, emoji in HOOK_EMOJI.items():
        smile = F.when(F.col("angle") == angle, F.lit(f"{emoji} ")).otherwise(smile)
    built = staged.withColumns({"cta": cta, "_value": value}).withColumn(
        "_hook", F.concat(F.when(F.col("_emoji") != "none", smile).otherwise(F.lit("")), hook)
    )
    body = F.concat(
        "_hook", F.lit("\n"), F.when(F.length("_value") > 0, F.concat(F.lit("\n"), "_value", F.lit("\n"))).otherwise(F.lit("")),
        F.lit("\n"), "cta",
    )
    limited = T.clip_post(U.trim_ws(body), F.coalesce("max_chars", F.lit(DEFAULT_MAX_CHARS)))
    return (
        built.withColumn("body", limited)
        .withColumns({"char_count": F.length("body"), "description": F.coalesce("_value", heading)})
        .drop("_round", "_formal", "_casual", "_emoji", "_value", "_hook")
    )


def _split_template(text: str) -> list[str]:
    before, mark, after = text.partition("{H}")
    return [p for p in (before, mark, after) if p]


def with_hashtags(rows: DataFrame) -> DataFrame:
    """Adds ``hashtags``: brand defaults, heading words, then the words of the whole text by frequency.

    At most min(platform limit, 8); banned and repeated tags are left out. Most posts find theirs among the first text
    words; the others look at all of them.
    """
    limit = F.greatest(F.least(F.coalesce("max_hashtags", F.lit(MAX_TAGS)), F.lit(MAX_TAGS)), F.lit(0))
    default = F.transform(
        F.coalesce("default_hashtags", F.array().cast("array<string>")),
        lambda t: F.concat(F.lit("#"), F.replace(F.regexp_replace(U.trim_ws(t), "^#+", ""), F.lit(" "), F.lit(""))),
    )

    def tags(text_words: Column) -> Column:
        found = F.concat(T.hashtag_words(F.col("p_heading")), text_words)
        usable = F.filter(
            F.concat(default, F.transform(found, T.hashtag)),
            lambda t: t.isNotNull() & (F.length(t) > 1) & ~brands.is_banned_tag(t, F.col("banned_phrases")),
        )
        return F.slice(T.distinct_ci(usable), F.lit(1), limit)

    early = rows.withColumn("hashtags", tags(F.slice("p_tag_words", 1, FIRST_WORDS)))
    enough = (F.size("hashtags") >= limit) | (F.size("p_tag_words") <= FIRST_WORDS)
    return early.withColumn("hashtags", F.when(enough, F.col("hashtags")).otherwise(tags(F.col("p_tag_words"))))


def post_jobs(selected: DataFrame, platform_codes: list[str]) -> DataFrame:
    """Selected pages times platforms; the index rotates by place, past use and platform position.

    The platform list is an array literal exploded per page (no join).
    """
    codes = list(dict.fromkeys(c.strip().lower() for c in platform_codes if c and c.strip()))
    if not codes:
        raise ValueError("choose at least one platform")
    unknown = set(codes) - {p[0] for p in catalogue.PLATFORMS}
    if unknown:
        raise ValueError(f"unknown platforms: {sorted(unknown)}")
    code = F.col("platform_code")
    return (
        selected.select("*", F.posexplode(F.array(*[F.lit(c) for c in codes])).alias("platform_pos", "platform_code"))
        .withColumns(
            {
                "post_index": (F.col("place") - 1 + F.col("used") + F.col("platform_pos")).cast("int"),
                "job_id": F.sha2(F.concat_ws("|", "page_id", "platform_code"), 256),
                "max_chars": catalogue.platform_attribute(code, "max_chars"),
                "max_hashtags": catalogue.platform_attribute(code, "max_hashtags"),
                "supports_links": catalogue.platform_attribute(code, "supports_links"),
            }
        )
    )


def _probe(jobs: DataFrame, seen: DataFrame, low: int, high: int) -> DataFrame:
    """(job_id, fresh, passing): the first of the rotations from ``low`` to before ``high`` that the guard passes, new ones and all.

    Texts are built for their hashes only and do not leave the row.
    """
    tries = jobs.withColumn("attempt", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))).withColumn("post_index", F.col("post_index") + F.col("attempt"))
    built = brands.guard(template_posts(tries).withColumn("hashtags", F.array().cast("array<string>")))
    # Rejected texts are left out inside the aggregate: a filter would be pushed
    # below the projections and evaluate every text twice.
    hashed = built.select("job_id", "site_id", "attempt", "passes", F.sha2(T.body_key(F.col("body")), 256).alias("body_hash"))
    met = hashed.join(seen.withColumn("_known", F.lit(True)), ["site_id", "body_hash"], "left")
    return met.groupBy("job_id").agg(
        F.min(F.when(F.col("passes") & F.col("_known").isNull(), F.col("attempt"))).alias("fresh"), F.min(F.when(F.col("passes"), F.col("attempt"))).alias("passing")
    )


def unique_posts(jobs: DataFrame, known: DataFrame, attempts: int = MAX_ATTEMPTS, rounds: list[int] | None = None) -> DataFrame:
    """One post per job: the first of its rotations that passes the guard and was not posted before.

    When every passing text of ``attempts`` rotations is known the first passing one is repeated (``repeated``); jobs
    where the guard rejects everything are returned with a null body. ``known(site_id, body_key)``. Rotations are tried
    in rounds, each twice as wide as the one before and only for jobs without a post so far; a round writes three
    numbers a job. The probe key holds the text's hash, so a site with a huge history still spreads over all tasks. The
    chosen text alone is built for the result. ``rounds``, where given, gets the number of jobs in each round.
    """
    # Page texts are split once per page, before the attempts multiply the rows.
    jobs = cut(jobs.repartition(int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "job_id"), "post-jobs")
    # Hashes of the whole history are made once; every round reads them.
    seen = cut(known.select("site_id", F.sha2("body_key", 256).alias("body_hash")).distinct(), "seen")
    found, low, width, open_jobs = None, 0, 1, jobs
    while low < attempts:
        high = min(attempts, low + width)
        probed = cut(_probe(open_jobs, seen, low, high), "probed")
        found = probed if found is None else found.unionByName(probed)
        left = probed.where("fresh is null").select("job_id")
        if rounds is not None:
            rounds.append(probed.count())
        low, width = high, 2 * width
        if left.isEmpty():
            break
        open_jobs = jobs.join(left, "job_id", "left_semi")
    best = found.groupBy("job_id").agg(F.min("fresh").alias("fresh"), F.min("passing").alias("passing"))
    chosen = jobs.join(best, "job_id", "left").withColumn("attempt", F.coalesce("fresh", "passing"))
    index = F.col("post_index") + F.coalesce("attempt", F.lit(0))
    built = brands.guard(template_posts(chosen.withColumn("post_index", index)).withColumn("hashtags", F.array().cast("array<string>")))
    some = F.col("attempt").isNotNull()
    made = [F.when(some, F.col(c)).alias(c) for c in ("post_index", "angle", "body", "cta", "description", "char_count")]
    return built.select(*[c for c in jobs.columns if c not in ("post_index", "hashtags")], F.when(some, F.col("fresh").isNull()).alias("repeated"), "attempt", *made)


def with_brand(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Brand columns for jobs with ``brand_id`` (null brand stays null)."""
    columns = ["brand_id", "tone", "address_form", "emoji_usage", "banned_phrases", "default_hashtags", "social_handles"]
    return jobs.join(profiles.select(*columns, F.col("name").alias("brand_name")), "brand_id", "left")
