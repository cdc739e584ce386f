"""Which URLs to fetch next, and how a crawl ended."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.functions import url as U
from crawlens.scale import cut, first_n
from crawlens.sources import robots as R



@dataclass(frozen=True)
class CrawlSettings:
    max_pages: int = 500
    max_depth: int = 5
    max_asset_checks: int = 200
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)


def usable_patterns(patterns: list[str]) -> list[str]:
    """Blank and invalid patterns are ignored, they never fail a crawl."""
    good = []
    for pattern in patterns:
        if not pattern or not pattern.strip():
            continue
        try:
            re.compile(pattern)
        except re.error:
            continue
        good.append(pattern)
    return good


def passes_patterns(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclude first; when there are include patterns, one of them has to match. Case is ignored."""
    matches = lambda patterns: [url.rlike(f"(?i){p}") for p in usable_patterns(patterns)]
    ok = F.lit(True)
    for hit in matches(exclude):
        ok = ok & ~hit
    wanted = matches(include)
    if wanted:
        any_hit = wanted[0]
        for hit in wanted[1:]:
            any_hit = any_hit | hit
        ok = ok & any_hit
    return ok


def judge_urls(candidates: DataFrame, robots: DataFrame, settings: CrawlSettings = CrawlSettings(), token: str = R.OWN_TOKEN) -> DataFrame:
    """Adds ``decision`` (accept / blocked / drop) to ``candidates(crawl_id, site_id, base_url, url)``.

    Too long or external URLs are dropped before robots.txt is asked; only an
    allowed URL meets the patterns. The home page is exempt from both filters
    but still reported when robots.txt forbids it.
    """
    home = F.col("url") == F.concat("base_url", F.lit("/"))
    eligible = U.is_internal(F.col("url"), F.col("base_url"))
    judged = R.with_verdict(candidates, robots, "url", token)
    return judged.withColumn(
        "decision",
        F.when(home, F.when(F.col("allowed"), F.lit("accept")).otherwise(F.lit("accept_blocked")))
        .when(~eligible, F.lit("drop"))
        .when(~F.col("allowed"), F.lit("blocked"))
        .when(passes_patterns(F.col("url"), settings.include_patterns, settings.exclude_patterns), F.lit("accept"))
        .otherwise(F.lit("drop")),
    ).drop("allowed")


def seeds(sites: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """Depth-0 candidates per crawl: the site root, then the sitemap URLs (``seq`` keeps that order)."""
    root = sites.select("crawl_id", "site_id", "base_url", F.concat("base_url", F.lit("/")).alias("url"), F.lit(0).alias("from_sitemap"))
    listed = sitemap_urls.join(sites.select("crawl_id", "site_id", "base_url"), "site_id").select(
        "crawl_id", "site_id", "base_url", "url", F.lit(1).alias("from_sitemap")
    )
    return root.unionByName(listed)


def candidates_from_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """URLs the fetched pages point to, each once with its first occurrence.

    Followed internal links one level deeper; redirect targets on the level of
    the page that redirected. ``first`` orders candidates as a crawl meets them.
    """
    followed = links.where(F.col("is_internal") & ~F.col("is_nofollow")).select(
        "crawl_id", "site_id", "base_url", F.col("to_url").alias("url"), (F.col("from_depth") + 1).alias("depth"),
        F.struct(F.col("from_seq").alias("seq"), F.col("pos").cast("int").alias("pos")).alias("first"),
    )
    moved = pages.where(F.col("redirect_to").isNotNull()).select(
        "crawl_id", "site_id", "base_url", U.normalize_url(F.col("redirect_to")).alias("url"), "depth",
        F.struct(F.col("fetch_seq").alias("seq"), F.lit(-1).alias("pos")).alias("first"),
    ).where(F.col("url").isNotNull())
    return (
        followed.unionByName(moved)
        .groupBy("crawl_id", "site_id", "base_url", "url")
        .agg(F.min(F.struct("first", "depth")).alias("f"))
        .select("crawl_id", "site_id", "base_url", "url", F.col("f.depth").alias("depth"), F.col("f.first").alias("first"))
    )


def next_frontier(
    candidates: DataFrame, seen: DataFrame, robots: DataFrame, settings: CrawlSettings = CrawlSettings(), token: str = R.OWN_TOKEN
) -> DataFrame:
    """Decides every new candidate: fetch, probe (asset), blocked, truncated or over the asset budget.

    ``seen(crawl_id, url)`` are URLs already fetched; they use up the page budget.
    Ranking inside a crawl is cut by a group limit before the shuffle, so the
    budget bounds what any task has to sort.
    """
    judged = cut(judge_urls(
        candidates.join(seen.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti"), robots, settings, token
    ), "judged")
    accepted = judged.where(F.col("decision").startswith("accept")).withColumn("is_asset", U.is_likely_asset(F.col("url")))
    used = seen.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("used"))
    order = [F.col("first"), F.col("url")]

    def within(rows: DataFrame, limit: int) -> DataFrame:
        return first_n(rows, ["crawl_id"], order, limit) if limit > 0 else rows.limit(0).withColumn("rn", F.lit(0))

    key = ["crawl_id", "url"]
    pages = accepted.where(~F.col("is_asset"))
    in_depth = pages.where(F.col("depth") <= settings.max_depth)
    fetch = (
        within(in_depth, settings.max_pages)
        .join(used, "crawl_id", "left")
        .where(F.col("rn") + F.coalesce("used", F.lit(0)) <= settings.max_pages)
        .select(*key)
        .withColumn("action", F.lit("fetch"))
    )
    probe = within(accepted.where("is_asset"), settings.max_asset_checks).select(*key).withColumn("action", F.lit("probe"))
    decided = accepted.join(fetch.unionByName(probe), key, "left").withColumn(
        "action",
        F.coalesce("action", F.when(F.col("is_asset"), F.lit("asset_over_budget")).otherwise(F.lit("truncated"))),
    )
    blocked = judged.where(F.col("decision") == "blocked").withColumn("action", F.lit("blocked"))
    columns = ["crawl_id", "site_id", "url", "depth", "action"]
    return decided.select(*columns).unionByName(blocked.select(*columns))


def blockable_urls(links: DataFrame, homes: DataFrame, pages: DataFrame | None = None, sitemap_urls: DataFrame | None = None) -> DataFrame:
    """(crawl_id, site_id, base_url, url, seq): every URL a crawl asks robots.txt about, once.

    ``seq`` is 0 for the home page and the sitemap, else one more than the
    fetch that brought the URL up.
    """
    key = ["crawl_id", "site_id", "base_url"]
    followed = (
        links.where(F.col("is_internal") & ~F.col("is_nofollow"))
        .groupBy(*key, F.col("to_url").alias("url"))
        .agg((F.min("from_seq") + 1).alias("seq"))
    )
    zero = F.lit(0).cast("bigint").alias("seq")
    parts = [followed, homes.select(*key, F.concat("base_url", F.lit("/")).alias("url"), zero)]
    if pages is not None:
        parts.append(
            pages.where(F.col("redirect_to").isNotNull())
            .select(*key, U.normalize_url(F.col("redirect_to")).alias("url"), (F.col("fetch_seq") + 1).alias("seq"))
            .where(F.col("url").isNotNull())
        )
    if sitemap_urls is not None:
        parts.append(homes.select(*key).join(sitemap_urls, "site_id").select(*key, "url", zero))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*key, "url").agg(F.min("seq").alias("seq"))


def blocked_urls(candidates: DataFrame, robots: DataFrame, settings: CrawlSettings = CrawlSettings(), token: str = R.OWN_TOKEN) -> DataFrame:
    """(crawl_id, url, seq) of the candidates robots.txt forbids, home page included."""
    judged = judge_urls(candidates, robots, settings, token)
    return judged.where(F.col("decision").isin("blocked", "accept_blocked")).select("crawl_id", "url", "seq")


def crawl_status(progress: DataFrame) -> DataFrame:
    """``progress(crawl_id, pages_crawled, truncated, cancelled, error)`` -> status."""
    status = (
        F.when(F.col("error").isNotNull(), F.lit("failed"))
        .when((F.col("pages_crawled") == 0) & F.col("cancelled"), F.lit("cancelled"))
        .when(F.col("pages_crawled") == 0, F.lit("failed"))
        .when(F.col("cancelled"), F.lit("cancelled"))
        .when(F.col("truncated"), F.lit("partial"))
        .otherwise(F.lit("completed"))
    )
    return progress.withColumn("status", status)
