"""Report tables of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlens import catalogue
from crawlens.scale import first_n, sample_lists

MAX_PRIORITIES = 5
MAX_EXAMPLES = 2
STEPS_SHOWN = 1
_DEC = "decimal(28,10)"


def report_requests(requests: DataFrame, sites: DataFrame, crawls: DataFrame) -> DataFrame:
    """Valid report requests with crawl, comparison and period filled in.

    ``requests(request_id, site_id, crawl_id, compare_crawl_id, period_start, period_end, today)``.
    No crawl means the newest one; crawls of another site make the request invalid;
    a reversed period is turned around.
    """
    newest = first_n(crawls, ["site_id"], [F.col("created_at").desc(), F.col("crawl_id").desc()], 1).select(
        "site_id", F.col("crawl_id").alias("newest_id")
    )
    own = lambda name: crawls.select(F.col("crawl_id").alias(name), F.col("site_id").alias(f"{name}_site"))
    started = crawls.select("crawl_id", F.to_date(F.coalesce("started_at", "created_at")).alias("crawl_day"))
    filled = (
        requests.join(sites.select("site_id"), "site_id")
        .join(newest, "site_id", "left")
        .withColumn("crawl_id", F.coalesce("crawl_id", "newest_id"))
        .join(own("crawl_id"), "crawl_id")
        .join(own("compare_crawl_id"), "compare_crawl_id", "left")
        .where(F.col("crawl_id_site") == F.col("site_id"))
        .where(F.col("compare_crawl_id").isNull() | (F.col("compare_crawl_id_site") == F.col("site_id")))
        .join(started, "crawl_id")
    )
    end = F.coalesce("period_end", "today")
    start = F.coalesce("period_start", "crawl_day")
    return filled.select(
        "request_id", "site_id", "crawl_id", "compare_crawl_id",
        F.least(start, end).alias("period_start"), F.greatest(start, end).alias("period_end"),
    )


def report_order() -> list[Column]:
    return [F.col("period_end").desc(), F.col("request_id").desc()]


def hero(crawls: DataFrame, issues: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Headline numbers per crawl; ``previous(crawl_id, previous_score)`` adds the signed change."""
    is_open = F.col("status") == "open"
    counts = issues.groupBy("crawl_id").agg(
        F.count_if(is_open).alias("open_count"),
        F.count_if(is_open & (F.col("severity") == "critical")).alias("critical_count"),
        F.count_if(is_open & (F.col("severity") == "high")).alias("high_count"),
        F.count_if(~is_open).alias("ignored_count"),
    )
    out = crawls.select("crawl_id", "pages_crawled", "overall_score").join(counts, "crawl_id", "left").na.fill(
        0, ["open_count", "critical_count", "high_count", "ignored_count"]
    )
    if previous is None:
        out = out.withColumn("previous_score", F.lit(None).cast("decimal(5,2)"))
    else:
        out = out.join(previous, "crawl_id", "left")
    delta = F.col("overall_score") - F.col("previous_score")
    return out.withColumns(
        {
            "score_delta": delta,
            "arrow": F.when(delta > 0, F.lit("▲")).when(delta < 0, F.lit("▼")).when(delta == 0, F.lit("=")),
        }
    )


def scorecard(crawls: DataFrame) -> DataFrame:
    """(crawl_id, place, category, score, weight), weakest category first; weight from the crawl's own snapshot."""
    flat = crawls.select("crawl_id", "scoring_snapshot", F.explode("category_scores").alias("category", "score"))
    # Eight rows per crawl at most, so the ranking is bounded by construction.
    place = F.row_number().over(Window.partitionBy("crawl_id").orderBy("score", "category"))
    weight = F.coalesce(F.try_element_at("scoring_snapshot", F.concat(F.lit("category_weight_"), "category")), F.lit(0))
    return flat.select("crawl_id", place.alias("place"), "category", "score", weight.alias("weight"))


def rule_impacts(issues: DataFrame, crawls: DataFrame, attribution: str = "page_id") -> DataFrame:
    """What each rule costs its crawl, from that crawl's snapshot; open issues only.

    ``attribution="page_id"`` treats an issue without page as site-wide, which
    is how reports are written; ``"scope"`` goes by the kind of the rule.
    """
    site_wide = F.col("page_id").isNull() if attribution == "page_id" else F.col("rule_code").isin(catalogue.CRAWL_LEVEL_CODES)
    # Counts per severity first: at most five rows per rule and crawl are shuffled on.
    counted = (
        issues.where(F.col("status") == "open")
        .groupBy("crawl_id", "rule_code", "category", "severity", "severity_rank", site_wide.alias("site_wide"))
        .agg(F.count(F.lit(1)).alias("n"), F.count("page_id").alias("n_pages"))
    )
    priced = counted.join(crawls.select("crawl_id", "pages_crawled", "scoring_snapshot"), "crawl_id").withColumn(
        "penalty", F.coalesce(F.try_element_at("scoring_snapshot", F.col("severity")), F.lit(0))
    )
    sums = priced.groupBy("crawl_id", "rule_code", "category").agg(
        F.sum("n").alias("issue_count"), F.sum("n_pages").alias("page_count"), F.max("severity_rank").alias("severity_rank"),
        F.sum(F.when(~F.col("site_wide"), F.col("n") * F.col("penalty")).otherwise(0)).alias("page_penalty"),
        F.max(F.when(F.col("site_wide"), F.col("penalty")).otherwise(0)).alias("site_penalty"),
        F.any_value("pages_crawled").alias("pages_crawled"),
        F.any_value(F.coalesce(F.try_element_at("scoring_snapshot", F.concat(F.lit("category_weight_"), "category")), F.lit(0))).alias("weight"),
    )
    pages = F.greatest(F.col("pages_crawled"), F.lit(1))
    # One division at the end: a decimal times an integer column loses digits to the column's possible size.
    total = (F.col("page_penalty") + F.col("site_penalty") * pages.cast("bigint")) * F.col("weight")
    return sums.select(
        "crawl_id", "rule_code", "severity_rank", "issue_count", "page_count", (total.cast(_DEC) / pages).alias("impact")
    )


def first_steps(how_to_fix: Column) -> tuple[Column, Column]:
    """(first step, number of further steps) of a multi-line instruction."""
    steps = F.filter(F.transform(F.split(how_to_fix, "\n"), F.btrim), lambda s: s != "")
    return (
        F.array_join(F.slice(steps, 1, STEPS_SHOWN), "\n"),
        F.greatest(F.size(steps) - STEPS_SHOWN, F.lit(0)),
    )


def priorities(impacts: DataFrame, rules: DataFrame) -> DataFrame:
    """The five costliest rules per crawl with scope and bar width relative to the first."""
    order = [F.col("impact").desc(), F.col("severity_rank").desc(), F.col("issue_count").desc(), F.col("rule_code")]
    top = first_n(impacts, ["crawl_id"], order, MAX_PRIORITIES, "place")
    highest = F.max("impact").over(Window.partitionBy("crawl_id"))
    step, more = first_steps(F.col("how_to_fix"))
    return (
        top.withColumn("top_impact", highest)
        .join(F.broadcast(rules.select("rule_code", "title", "how_to_fix", "doc_url")), "rule_code")
        .select(
            "crawl_id", "place", "rule_code", "title", "severity_rank", "issue_count", "page_count", "impact",
            F.when(F.col("page_count") > 0, F.concat(F.col("page_count").cast("string"), F.lit(" sayfa")))
            .otherwise(F.lit("site geneli")).alias("scope"),
            F.when(F.col("top_impact") <= 0, 0).otherwise(
                F.bround(F.col("impact").cast(_DEC) / F.col("top_impact").cast(_DEC) * 100, 0)
            ).cast("int").alias("bar_width"),
            step.alias("first_step"), more.alias("more_steps"), "doc_url",
        )
    )


def priority_examples(top: DataFrame, keyed_issues: DataFrame) -> DataFrame:
    """Two distinct example URLs per priority; ``keyed_issues`` carries ``key_url``."""
    urls = (
        keyed_issues.where((F.col("status") == "open") & (F.col("key_url") != ""))
        .join(top.select("crawl_id", "rule_code"), ["crawl_id", "rule_code"], "left_semi")
        .select("crawl_id", "rule_code", "key_url")
        .distinct()
    )
    return sample_lists(urls, ["crawl_id", "rule_code"], [F.col("key_url")], F.col("key_url"), MAX_EXAMPLES, "examples")


def rest_note(impacts: DataFrame, top: DataFrame) -> DataFrame:
    """Rules and issues that did not make the priority list."""
    every = impacts.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("rules"), F.sum("issue_count").alias("issues"))
    listed = top.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("l_rules"), F.sum("issue_count").alias("l_issues"))
    return every.join(listed, "crawl_id").select(
        "crawl_id", (F.col("rules") - F.col("l_rules")).alias("rest_rules"),
        (F.col("issues") - F.col("l_issues")).alias("rest_issues"),
    )


def report_documents(heroes: DataFrame, card: DataFrame, top: DataFrame, rest: DataFrame) -> DataFrame:
    """One text per crawl, assembled from the (small, bounded) report tables."""
    number = lambda c: F.format_string("%.1f", c.cast("double"))
    categories = card.groupBy("crawl_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "category", "score"))),
                                 lambda r: F.concat(r["category"], F.lit(" "), number(r["score"]))), "\n").alias("card")
    )
    tasks = top.groupBy("crawl_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title", "rule_code", "scope"))),
                                 lambda r: F.concat(r["title"], F.lit(" ["), r["rule_code"], F.lit("] "), r["scope"])), "\n").alias("tasks")
    )
    return (
        heroes.join(categories, "crawl_id", "left").join(tasks, "crawl_id", "left").join(rest, "crawl_id", "left")
        .select(
            "crawl_id",
            F.concat_ws(
                "\n",
                F.concat(F.coalesce(number(F.col("overall_score")), F.lit("—")), F.coalesce(F.concat(F.lit(" "), "arrow", F.lit(" "), number(F.abs("score_delta"))), F.lit(""))),
                F.concat(F.col("pages_crawled").cast("string"), F.lit(" sayfa tarandı · "), F.col("open_count").cast("string"), F.lit(" açık bulgu")),
                "card", F.coalesce("tasks", F.lit("Açık bulgu yok")),
                F.when(F.col("rest_rules") > 0, F.concat(F.lit("Ayrıca "), F.col("rest_rules").cast("string"), F.lit(" kural daha, toplam "), F.col("rest_issues").cast("string"), F.lit(" bulgu"))),
            ).alias("document"),
        )
    )
