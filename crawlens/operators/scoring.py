"""Findings -> page scores, category scores, overall score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens import catalogue
from crawlens.scale import lookup

_DEC = "decimal(28,10)"


def page_scores(findings: DataFrame) -> DataFrame:
    """100 minus the penalties of a page's own findings, clamped to 0..100."""
    total = F.sum(catalogue.penalty(F.col("severity")))
    return findings.groupBy("crawl_id", "page_id", "url").agg(
        F.greatest(F.lit(0), F.least(F.lit(100), 100 - total)).cast("int").alias("page_score")
    )


def _round2(value: Column, rounding: str) -> Column:
    """``half_even`` is what a live crawl uses, ``half_up`` what a stored crawl is rescored with."""
    return F.bround(value, 2) if rounding == "half_even" else F.round(value, 2)


def category_penalties(findings: DataFrame) -> DataFrame:
    """(crawl_id, category, page_penalty, crawl_penalty) from findings with ``is_crawl_level``.

    Page findings add up; a crawl-level code costs its worst penalty once. Two
    small aggregates, combined map-side: at most 35 rows per crawl leave a task.
    """
    per_code = findings.groupBy("crawl_id", "category", "rule_code", "is_crawl_level").agg(
        F.sum(catalogue.penalty(F.col("severity"))).alias("total"),
        F.max(catalogue.penalty(F.col("severity"))).alias("worst"),
    )
    return per_code.groupBy("crawl_id", "category").agg(
        F.sum(F.when(F.col("is_crawl_level"), 0).otherwise(F.col("total"))).alias("page_penalty"),
        F.sum(F.when(F.col("is_crawl_level"), F.col("worst")).otherwise(0)).alias("crawl_penalty"),
    )


def category_scores(findings: DataFrame, crawls: DataFrame, rounding: str = "half_even") -> DataFrame:
    """(crawl_id, category, score) for all eight categories of every crawl with pages.

    ``crawls(crawl_id, pages_crawled)``. The category frame is an array literal
    exploded per crawl, so clean categories appear with 100.
    """
    frame = crawls.where(F.col("pages_crawled") > 0).select(
        "crawl_id", "pages_crawled",
        F.explode(F.array(*[F.lit(c) for c in catalogue.CATEGORY_WEIGHTS])).alias("category"),
    )
    penalties = category_penalties(findings)
    spent = F.coalesce(F.col("page_penalty").cast(_DEC) / F.col("pages_crawled"), F.lit(0).cast(_DEC)) + F.coalesce(
        F.col("crawl_penalty").cast(_DEC), F.lit(0).cast(_DEC)
    )
    score = _round2((F.lit(100).cast(_DEC) - spent).cast(_DEC), rounding)
    return frame.join(penalties, ["crawl_id", "category"], "left").select(
        "crawl_id", "category",
        F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("decimal(5,2)").alias("score"),
    )


def overall_from_map(scores: Column, rounding: str = "half_even") -> Column:
    """Overall score from a category -> score map; a missing category counts as 100, an empty map as 0."""
    weights = catalogue.CATEGORY_WEIGHTS
    parts = [
        (F.lit(100) - F.coalesce(F.try_element_at(scores, F.lit(c)), F.lit(100))).cast(_DEC) * w for c, w in weights.items()
    ]
    deficit = (reduce(lambda a, b: a + b, parts).cast(_DEC) / F.lit(sum(weights.values()))).cast(_DEC)
    half = F.lit(catalogue.OVERALL_HALF_POINT).cast(_DEC)
    curve = _round2((F.lit(100).cast(_DEC) - (deficit * 100).cast(_DEC) / (deficit + half).cast(_DEC)).cast(_DEC), rounding)
    return (
        F.when(F.size(scores) <= 0, F.lit(0))
        .when(deficit <= 0, F.lit(100))
        .otherwise(F.greatest(F.lit(0), F.least(F.lit(100), curve)))
        .cast("decimal(5,2)")
    )


def crawl_scores(scores: DataFrame, rounding: str = "half_even") -> DataFrame:
    """One row per crawl: category map, overall score, scoring snapshot."""
    return (
        scores.groupBy("crawl_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "score")))).alias("category_scores"))
        .withColumn("overall_score", overall_from_map(F.col("category_scores"), rounding))
        .withColumn("scoring_snapshot", catalogue.scoring_snapshot())
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    """severity -> count map per crawl; severities without issues are absent."""
    return (
        issues.groupBy("crawl_id", "severity").agg(F.count(F.lit(1)).cast("int").alias("n"))
        .groupBy("crawl_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("issue_counts"))
    )


def rescore(crawls: DataFrame, issues: DataFrame) -> DataFrame:
    """Scores of stored crawls with today's formula; issue status is ignored, unscored crawls stay as they are."""
    scored = crawls.where(F.col("overall_score").isNotNull() & (F.col("pages_crawled") > 0))
    findings = lookup(issues, scored.select("crawl_id"), ["crawl_id"], F.xxhash64("issue_id"), "left_semi").withColumns(
        {
            "category": catalogue.rule_attribute(F.col("rule_code"), "category"),
            "is_crawl_level": F.col("rule_code").isin(catalogue.CRAWL_LEVEL_CODES),
        }
    )
    fresh = crawl_scores(category_scores(findings, scored, "half_up"), "half_up")
    keep = [c for c in crawls.columns if c not in ("category_scores", "overall_score", "scoring_snapshot")]
    old = crawls.select(
        *keep, F.col("overall_score").alias("_o"), F.col("category_scores").alias("_c"), F.col("scoring_snapshot").alias("_s")
    )
    return old.join(fresh, "crawl_id", "left").select(
        *keep,
        F.coalesce("category_scores", "_c").alias("category_scores"),
        F.coalesce("overall_score", "_o").alias("overall_score"),
        F.coalesce("scoring_snapshot", "_s").alias("scoring_snapshot"),
    )
