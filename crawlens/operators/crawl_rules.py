"""Rules over a whole crawl."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens import catalogue
from crawlens.functions import text as T
from crawlens.functions import url as U
from crawlens.scale import lookup, sample_lists

MAX_SAMPLES = 10
MAX_DEPTH = 4
POOR_LCP_MS, POOR_CLS, POOR_INP_MS = 4000, 0.25, 500

def _crawl_order() -> list[Column]:
    return [F.col("fetch_seq"), F.col("url")]


def no_index(robots_meta: Column) -> Column:
    return F.coalesce(F.lower(robots_meta).contains("noindex"), F.lit(False))


def is_indexable() -> Column:
    return F.col("status_code").between(200, 299) & ~no_index(F.col("robots_meta"))


def rule_pages(pages: DataFrame) -> DataFrame:
    """Pages the crawl rules look at: no redirecting rows, no assets."""
    return pages.where(F.col("redirect_to").isNull() & ~F.coalesce(F.col("is_asset"), F.lit(False)))


def _finding(df: DataFrame, code: str, found: Column, samples: Column | None, page_id: str = "page_id") -> DataFrame:
    category, severity, weight = catalogue.rule_constants(code)
    return df.select(
        "crawl_id", F.col(page_id).alias("page_id"), F.lit(code).alias("rule_code"),
        F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(weight).alias("weight"),
        found.alias("found"),
        (samples if samples is not None else F.array().cast("array<string>")).alias("sample_urls"),
    )


def _groups(pages: DataFrame, key: Column) -> DataFrame:
    """Groups of two or more pages: size, first member, ten sample URLs.

    The size is a hash aggregate combined map-side; first member and samples come
    from a group-limited window, so a group that holds a third of all pages is
    never gathered in one task.
    """
    keyed = pages.withColumn("_key", key)
    sizes = keyed.groupBy("crawl_id", "_key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    member = F.struct("url", "page_id", F.col("_spelling").alias("spelling"))
    heads = sample_lists(keyed, ["crawl_id", "_key"], _crawl_order(), member, MAX_SAMPLES, "heads")
    return sizes.join(heads, ["crawl_id", "_key"]).select(
        "crawl_id", "_key", "members", F.col("heads")[0].alias("first"), F.col("heads")[0]["page_id"].alias("page_id"),
        F.transform("heads", lambda m: m["url"]).alias("samples"),
    )


def duplicate_content(pages: DataFrame) -> DataFrame:
    candidates = rule_pages(pages).where(
        F.col("content_hash").isNotNull() & F.col("status_code").between(200, 299)
    ).withColumn("_spelling", F.lit(""))
    groups = _groups(candidates, F.col("content_hash"))
    return _finding(
        groups, "DUPLICATE_CONTENT",
        F.concat(F.col("members").cast("string"), F.lit(" sayfa aynı içeriğe sahip.")), F.col("samples"),
    )


def _duplicate_text(pages: DataFrame, column: str, code: str, noun: str, clip: int | None) -> DataFrame:
    text = U.trim_ws(F.col(column))
    candidates = rule_pages(pages).where(is_indexable() & ~T.is_blank(F.col(column))).withColumn("_spelling", text)
    value = F.col("first.spelling")
    if clip:
        value = F.when(F.length(value) <= clip, value).otherwise(
            F.concat(F.substring(value, 1, clip), F.lit("…"))
        )
    groups = _groups(candidates, F.lower(text))
    found = F.concat(F.col("members").cast("string"), F.lit(f' sayfa aynı {noun} kullanıyor: "'), value, F.lit('".'))
    return _finding(groups, code, found, F.col("samples"))


def duplicate_titles(pages: DataFrame) -> DataFrame:
    return _duplicate_text(pages, "title", "META_TITLE_DUPLICATE", "title'ı", None)


def duplicate_descriptions(pages: DataFrame) -> DataFrame:
    return _duplicate_text(pages, "meta_description", "META_DESC_DUPLICATE", "meta description'ı", 80)


def link_statuses(resolved: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with the status of their crawled target; null when it was not crawled.

    Only the few broken targets are joined, so popular healthy targets are
    dropped before the shuffle of the rule; see ``broken_links``.
    """
    status = pages.select("crawl_id", F.col("page_id").alias("to_page_id"), F.col("status_code").alias("target_status"))
    return lookup(resolved, status, ["crawl_id", "to_page_id"], F.xxhash64("from_page_id"), "left")


def broken_links(resolved: DataFrame, pages: DataFrame) -> DataFrame:
    bad = pages.where((F.col("status_code") == 0) | (F.col("status_code") >= 400))
    broken = link_statuses(resolved.where("is_internal and to_page_id is not null"), bad).where(
        F.col("target_status").isNotNull()
    )
    keys = ["crawl_id", "from_page_id"]
    sizes = broken.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.any_value("from_url").alias("from_url"))
    samples = sample_lists(broken, keys, [F.col("pos"), F.col("to_url")], F.col("to_url"), MAX_SAMPLES, "samples")
    found = F.concat("from_url", F.lit(" sayfasında "), F.col("n").cast("string"), F.lit(" kırık iç link var."))
    return _finding(sizes.join(samples, keys), "BROKEN_INTERNAL_LINK", found, F.col("samples"), "from_page_id")


def orphan_pages(pages: DataFrame) -> DataFrame:
    orphans = rule_pages(pages).where(is_indexable() & ~F.col("is_home") & (F.col("inlink_count") == 0))
    return _finding(orphans, "ORPHAN_PAGE", F.lit("Sayfaya hiçbir iç link işaret etmiyor."), F.array("url"))


def too_deep(pages: DataFrame) -> DataFrame:
    deep = rule_pages(pages).where(is_indexable() & (F.col("depth") > MAX_DEPTH))
    found = F.concat(
        F.lit("Sayfa kök sayfadan "), F.col("depth").cast("string"),
        F.lit(f" tıklama uzakta (en fazla {MAX_DEPTH} olmalı)."),
    )
    return _finding(deep, "TOO_DEEP", found, F.array("url"))


def sitemap_missing(homes: DataFrame, sitemap_sites: DataFrame) -> DataFrame:
    """One finding on the home page of each crawl whose site has no readable sitemap URL."""
    without = homes.join(sitemap_sites.select("site_id").distinct(), "site_id", "left_anti")
    return _finding(without, "SITEMAP_MISSING", F.lit("Sitede okunabilir bir sitemap bulunamadı."), None)


def not_in_sitemap(pages: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """Indexable pages the sitemap does not list; sites without a sitemap are left out."""
    listed = sitemap_urls.select("site_id", U.sitemap_key(F.col("url")).alias("_key")).distinct()
    with_sitemap = listed.select("site_id").distinct()
    missing = (
        lookup(rule_pages(pages).where(is_indexable()), with_sitemap, ["site_id"], F.xxhash64("page_id"), "left_semi")
        .withColumn("_key", U.sitemap_key(F.col("url")))
        .join(listed, ["site_id", "_key"], "left_anti")
    )
    return _finding(missing, "PAGE_NOT_IN_SITEMAP", F.lit("Sayfa sitemap'te listelenmiyor."), F.array("url"))


def blocked_by_robots(blocked: DataFrame, homes: DataFrame, most: int | None = None) -> DataFrame:
    """``blocked(crawl_id, url, seq)``; all are counted, ten are samples, on the home page.

    With ``most`` the message names no larger number.
    """
    counts = blocked.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n"))
    samples = sample_lists(blocked, ["crawl_id"], [F.col("seq"), F.col("url")], F.col("url"), MAX_SAMPLES, "samples")
    rows = counts.join(samples, "crawl_id").join(homes.select("crawl_id", "page_id"), "crawl_id")
    named = F.col("n") if most is None else F.least("n", F.lit(most))
    found = F.concat(F.lit("robots.txt "), named.cast("string"), F.lit(" iç adresin taranmasını engelliyor."))
    return _finding(rows, "BLOCKED_BY_ROBOTS_TXT", found, F.col("samples"))


def poor_vitals(vitals: DataFrame, homes: DataFrame) -> DataFrame:
    """``vitals(crawl_id, lcp, cls, inp)``; a metric that was not measured never fires."""
    fixed = lambda c, digits: F.format_string(f"%.{digits}f", F.round(c, digits))
    checks = [
        ("LCP_POOR", F.col("lcp") > POOR_LCP_MS,
         F.concat(F.lit("LCP "), fixed(F.col("lcp") / 1000, 1), F.lit(" sn — 4.0 sn esiginin uzerinde."))),
        ("CLS_POOR", F.col("cls") > POOR_CLS,
         F.concat(F.lit("CLS "), fixed(F.col("cls"), 3), F.lit(" — 0.25 esiginin uzerinde."))),
        ("INP_POOR", F.col("inp") > POOR_INP_MS,
         F.concat(F.lit("INP "), fixed(F.col("inp"), 0), F.lit(" ms — 500 ms esiginin uzerinde."))),
    ]
    rows = vitals.join(homes.select("crawl_id", "page_id"), "crawl_id")
    candidates = []
    for code, bad, text in checks:
        category, severity, weight = catalogue.rule_constants(code)
        candidates.append(
            F.struct(
                F.lit(code).alias("rule_code"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
                F.lit(weight).alias("weight"), F.when(bad, text).alias("found"),
            )
        )
    fired = F.filter(F.array(*candidates), lambda f: f["found"].isNotNull())
    return rows.select("crawl_id", "page_id", F.explode(fired).alias("f")).select(
        "crawl_id", "page_id", "f.*", F.array().cast("array<string>").alias("sample_urls")
    )


def home_pages(pages: DataFrame) -> DataFrame:
    """(crawl_id, site_id, page_id) of the home page: the site root, else the first fetched page."""
    first = F.struct((F.col("url") != F.concat("base_url", F.lit("/"))).alias("other"), "fetch_seq", "url", "page_id", "site_id")
    crawled = pages.where(~F.coalesce(F.col("is_asset"), F.lit(False)))
    return crawled.groupBy("crawl_id").agg(F.min(first).alias("h")).select("crawl_id", "h.site_id", "h.page_id")


def with_home_flag(pages: DataFrame, homes: DataFrame) -> DataFrame:
    flagged = homes.select("crawl_id", "page_id", F.lit(True).alias("is_home"))
    return pages.join(flagged, ["crawl_id", "page_id"], "left").withColumn("is_home", F.coalesce("is_home", F.lit(False)))


def crawl_findings(
    pages: DataFrame,
    resolved: DataFrame,
    homes: DataFrame,
    sitemap_urls: DataFrame | None = None,
    blocked: DataFrame | None = None,
    vitals: DataFrame | None = None,
    most_blocked: int | None = None,
) -> DataFrame:
    parts = [
        duplicate_content(pages), duplicate_titles(pages), duplicate_descriptions(pages),
        broken_links(resolved, pages), orphan_pages(pages), too_deep(pages),
    ]
    if sitemap_urls is not None:
        parts += [sitemap_missing(homes, sitemap_urls), not_in_sitemap(pages, sitemap_urls)]
    if blocked is not None:
        parts.append(blocked_by_robots(blocked, homes, most_blocked))
    if vitals is not None:
        parts.append(poor_vitals(vitals, homes))
    return reduce(DataFrame.unionByName, parts)
