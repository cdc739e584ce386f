"""Crawl against crawl, and the dashboard over all crawls of a tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlens.scale import first_n, lookup

RECENT_CRAWLS, RECENT_JOBS = 10, 5


def issue_keys(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues with ``key_url``: ids change between crawls, rule code and URL do not."""
    urls = pages.select("crawl_id", "page_id", F.col("url").alias("key_url"))
    return issues.join(urls, ["crawl_id", "page_id"], "left").withColumn("key_url", F.coalesce("key_url", F.lit("")))


def issue_changes(keyed: DataFrame, pairs: DataFrame) -> DataFrame:
    """New and resolved issues for ``pairs(site_id, current_id, previous_id)`` in ``change``.

    Both sides keep their duplicates; one left anti join each.
    """
    of = lambda which: lookup(
        keyed, pairs.select("site_id", F.col(which).alias("crawl_id")), ["site_id", "crawl_id"], F.xxhash64("key_url", "rule_code"), "left_semi"
    )
    current, previous = of("current_id"), of("previous_id")
    key = ["site_id", "rule_code", "key_url"]
    fresh = current.join(previous.select(*key), key, "left_anti").withColumn("change", F.lit("new"))
    gone = previous.join(current.select(*key), key, "left_anti").withColumn("change", F.lit("resolved"))
    return fresh.unionByName(gone)


def map_delta(current: Column, previous: Column, zero: Column) -> Column:
    """Difference of two maps over the union of their keys; a missing key counts as zero."""
    return F.map_zip_with(
        current, previous, lambda _, now, before: F.coalesce(now, zero) - F.coalesce(before, zero)
    )


def compare_crawls(crawls: DataFrame, pairs: DataFrame, changes: DataFrame, keyed: DataFrame) -> DataFrame:
    """One row per pair: score, page and issue deltas and the counts of changes."""
    columns = ["overall_score", "pages_crawled", "issue_counts", "category_scores"]
    side = lambda p: crawls.select(F.col("crawl_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    counts = changes.groupBy("site_id").agg(
        F.count_if(F.col("change") == "new").alias("new_issues"),
        F.count_if(F.col("change") == "resolved").alias("resolved_issues"),
    )
    total = keyed.groupBy(F.col("crawl_id").alias("current_id")).agg(F.count(F.lit(1)).alias("current_issues"))
    return (
        pairs.join(side("current"), "current_id")
        .join(side("previous"), "previous_id")
        .join(counts, "site_id", "left")
        .join(total, "current_id", "left")
        .select(
            "site_id", "current_id", "previous_id", "current_overall_score", "previous_overall_score",
            (F.col("current_overall_score") - F.col("previous_overall_score")).alias("score_delta"),
            "current_pages_crawled", "previous_pages_crawled",
            map_delta(F.col("current_issue_counts"), F.col("previous_issue_counts"), F.lit(0)).alias("issue_count_delta"),
            map_delta(
                F.col("current_category_scores"), F.col("previous_category_scores"), F.lit(0).cast("decimal(5,2)")
            ).alias("category_delta"),
            F.coalesce("new_issues", F.lit(0)).alias("new_issues"),
            F.coalesce("resolved_issues", F.lit(0)).alias("resolved_issues"),
            (F.coalesce("current_issues", F.lit(0)) - F.coalesce("new_issues", F.lit(0))).alias("unchanged_issues"),
        )
    )


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("crawl_id").desc()]


def latest_crawls(crawls: DataFrame, n: int = 2) -> DataFrame:
    """The last ``n`` crawls of each site, ``rn`` 1 being the newest."""
    return first_n(crawls, ["site_id"], _newest_first(), n)


def crawl_pairs(crawls: DataFrame) -> DataFrame:
    """(site_id, current_id, previous_id) of the two newest crawls of each site."""
    two = latest_crawls(crawls, 2).groupBy("site_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("crawl_id"))).alias("current_id"),
        F.max(F.when(F.col("rn") == 2, F.col("crawl_id"))).alias("previous_id"),
    )
    return two.where(F.col("previous_id").isNotNull())


def site_cards(sites: DataFrame, crawls: DataFrame) -> DataFrame:
    """Last crawl of every site with the change against the one before; sites without crawls stay."""
    ordered = Window.partitionBy("site_id").orderBy("rn")
    last = (
        latest_crawls(crawls, 2)
        .withColumn("previous_score", F.lead("overall_score").over(ordered))
        .where(F.col("rn") == 1)
        .select(
            "site_id", F.col("crawl_id").alias("last_crawl_id"), F.col("status").alias("last_status"),
            F.col("overall_score").alias("last_score"),
            (F.col("overall_score") - F.col("previous_score")).alias("score_delta"),
            F.coalesce("finished_at", "started_at", "created_at").alias("last_time"), "issue_counts",
        )
    )
    return sites.select("tenant_id", "site_id", "name", "base_url", "is_active").join(last, "site_id", "left")


def dashboard_totals(cards: DataFrame) -> DataFrame:
    """Per tenant: sites, average of the last scores, issue totals by severity."""
    basics = cards.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("site_count"), F.bround(F.avg("last_score"), 1).alias("average_score")
    )
    sums = (
        cards.select("tenant_id", F.explode("issue_counts").alias("severity", "n"))
        .groupBy("tenant_id", "severity").agg(F.sum("n").alias("n"))
        .groupBy("tenant_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("issue_totals"))
    )
    return basics.join(sums, "tenant_id", "left")


def recent_crawls(crawls: DataFrame, sites: DataFrame, n: int = RECENT_CRAWLS) -> DataFrame:
    """The newest crawls of each tenant."""
    owned = crawls.join(sites.select("site_id", "tenant_id"), "site_id")
    return first_n(owned, ["tenant_id"], _newest_first(), n)


def recent_jobs(jobs: DataFrame, n: int = RECENT_JOBS) -> DataFrame:
    return first_n(jobs, ["tenant_id"], [F.col("created_at").desc(), F.col("job_id").desc()], n)


def vitals_history(vitals: DataFrame, take: int = 30, url: str | None = None) -> DataFrame:
    """Newest measurements per site, at most 1..200 of them; the first one is the latest."""
    if url is not None and url.strip():
        vitals = vitals.where(F.col("url") == url)
    return first_n(vitals, ["site_id"], [F.col("collected_at").desc(), F.col("vital_id").desc()], min(max(take, 1), 200))
