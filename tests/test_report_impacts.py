"""A rule's impact has the digits of the exact quotient."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from crawlens.operators import reports

ISSUES = "crawl_id string, rule_code string, category string, severity string, severity_rank int, status string, page_id string"


@pytest.mark.parametrize("count, pages, penalty, weight, site_wide", [(1335, 42735, 8, 18, 0), (7, 3, 15, 22, 1), (1, 999_983, 3, 7, 0), (0, 11, 0, 9, 1), (5, 0, 25, 20, 0)])
def test_impact_is_not_rounded_on_the_way(spark, count, pages, penalty, weight, site_wide):
    many = spark.range(count).selectExpr("'c'", "'R'", "'meta'", "'medium'", "2", "'open'", "cast(id as string)")
    one = spark.range(site_wide).selectExpr("'c'", "'R'", "'meta'", "'medium'", "2", "'open'", "cast(null as string)")
    issues = many.union(one).toDF(*[f.split()[0] for f in ISSUES.split(", ")])
    crawls = spark.createDataFrame([("c", pages, {"medium": penalty, "category_weight_meta": weight})], "crawl_id string, pages_crawled int, scoring_snapshot map<string,int>")
    impact = reports.rule_impacts(issues, crawls).select(F.col("impact").cast("string").alias("i")).collect()[0].i
    exact = (Fraction(count * penalty, max(pages, 1)) + penalty * site_wide) * weight
    assert abs(Fraction(impact) - exact) < Fraction(1, 10**16)
