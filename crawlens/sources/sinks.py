"""Table and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_COLUMNS = [
    "job_id", "type", "platform_code", "page_url", "status", "created_at", "variant_index",
    "angle", "body", "hashtags", "cta", "char_count", "is_favorite",
]


def write_by_crawl(df: DataFrame, path: str, sort_by: str | None = None) -> None:
    """Replace exactly the crawls contained in ``df``; re-running a job is harmless.

    Rows are rebalanced by crawl at run time: small crawls share a task, a large one
    is written by several, and each file has about the advised partition size.
    """
    df = df.hint("rebalance", "crawl_id")
    if sort_by:
        df = df.sortWithinPartitions("crawl_id", sort_by)
    replace_partitions(df, path, ["crawl_id"])


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def export_rows(jobs: DataFrame, variants: DataFrame) -> DataFrame:
    """Jobs with their variants in the 13 export columns; a job without variants keeps one row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    joined = jobs.join(variants, "job_id", "left").withColumns(
        {
            "hashtags": F.array_join(F.coalesce("hashtags", F.array().cast("array<string>")), " "),
            "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
        }
    )
    return joined.select(*[text(c).alias(c) for c in EXPORT_COLUMNS])


def write_csv(rows: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled; one file per partition."""
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, quote='"', escape='"', emptyValue="")


def csv_with_bom(rows: DataFrame, path: str) -> None:
    """As ``write_csv``, with a UTF-8 byte-order mark in front of each file's header for spreadsheets."""
    names = [rows.columns[0], *rows.columns[1:]]
    marked = rows.select(*[F.col(c) for c in names]).toDF("﻿" + names[0], *names[1:])
    write_csv(marked, path)
