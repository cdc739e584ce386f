"""Titles that end inside a character reference: whole queries give the rows of their SQL."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from check_oracle import _plain

SF = "/root/testdata/sf0.001"
# With the reference read as one character the first is shorter than 30, the third one of a group with the second.
TITLES = ["A title of 26 characters, &amp", "Shared by several pages here &amp;", "Shared by several pages here &amp", "A longer title, cut as well: x&amp;&amp"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The given pages under four titles, and the events."""
    path = str(tmp_path_factory.mktemp("cut"))
    title = F.element_at(F.array(*[F.lit(f"<title>{t}</title>") for t in TITLES]), (1 + F.floor(F.col("page_id") / 3) % 4).cast("int"))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.withColumn("html", F.regexp_replace("html", F.lit("<title>[^<]*</title>"), title)).write.parquet(f"{path}/pages.parquet")
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize(
    "name",
    [
        "dup_titles",
        "dup_descriptions",
        "crawl_summary_top_issues",
        "dashboard_totals",
        "dashboard_sites",
        "crawl_compare_summary",
        "crawl_compare_issues",
        "crawl_compare_scores",
    ],
)
def test_rows_are_those_of_the_sql(spark, tables, name):
    frame = entry_points.queries()[name](spark, tables)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in ("pages", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({entry_points.oracle_sql()[name]}) x").fetchall()
    assert len(expected) > 0
    assert Counter(tuple(_plain(r[c]) for c in columns) for r in frame.collect()) == Counter(tuple(map(_plain, r)) for r in expected)
