"""Issue rows, list queries, groups, ignore and reopen."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from crawlens import catalogue
from crawlens.functions import text as T
from crawlens.scale import first_n, lookup, shared_dir

DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE = 50, 200
TOP_ISSUES = 100


def issue_rows(page_findings: DataFrame, crawl_findings: DataFrame | None, crawls: DataFrame) -> DataFrame:
    """Page and crawl findings (None: of page rules alone) as one table of open issues with a deterministic id.

    ``crawls(crawl_id, site_id)`` supplies the site; it has one row per crawl.
    """
    columns = ["crawl_id", "page_id", "rule_code", "category", "severity", "weight", "found", "sample_urls", "is_crawl_level"]
    single = page_findings.withColumn("sample_urls", F.array().cast("array<string>")).withColumn(
        "is_crawl_level", F.lit(False)
    )
    both = single.select(*columns)
    if crawl_findings is not None:
        both = both.unionByName(crawl_findings.withColumn("is_crawl_level", F.lit(True)).select(*columns))
    return lookup(both, crawls.select("crawl_id", "site_id"), ["crawl_id"], F.xxhash64("page_id", "rule_code")).select(
        # A key of joins: 256 bits, of parts that can't run into each other.
        F.sha2(F.to_json(F.struct("crawl_id", "rule_code", "page_id", "found")), 256).alias("issue_id"),
        "crawl_id", "site_id", "page_id", "rule_code", "category", "severity",
        catalogue.severity_rank(F.col("severity")).alias("severity_rank"), "weight",
        F.lit("open").alias("status"),
        F.struct("found", "sample_urls").alias("evidence"), "is_crawl_level",
        F.col("crawl_id").alias("first_seen_crawl_id"),
    )


@dataclass(frozen=True)
class IssueQuery:
    severity: str | None = None
    min_severity: str | None = None
    category: str | None = None
    rule_code: str | None = None
    status: str | None = None
    page_id: str | None = None


def at_least(minimum: str) -> Column:
    """Severity threshold by rank, never by text."""
    return F.col("severity_rank") >= catalogue.SEVERITIES.index(minimum)


def filter_issues(issues: DataFrame, q: IssueQuery) -> DataFrame:
    if q.severity is not None:
        issues = issues.where(F.col("severity") == q.severity)
    if q.min_severity is not None:
        issues = issues.where(at_least(q.min_severity))
    if q.category is not None:
        issues = issues.where(F.col("category") == q.category)
    if q.rule_code is not None and q.rule_code.strip():
        issues = issues.where(F.col("rule_code") == q.rule_code.strip().upper())
    if q.status is not None:
        issues = issues.where(F.col("status") == q.status)
    if q.page_id is not None:
        issues = issues.where(F.col("page_id") == q.page_id)
    return issues


def with_rule_and_page(issues: DataFrame, rules: DataFrame, pages: DataFrame) -> DataFrame:
    """Issue with rule texts (35 rows, broadcast) and page URL (null for site-wide issues)."""
    texts = rules.select("rule_code", "title", "how_to_fix", "doc_url")
    urls = pages.select("crawl_id", "page_id", F.col("url").alias("page_url"))
    return issues.join(F.broadcast(texts), "rule_code").join(urls, ["crawl_id", "page_id"], "left")


def issue_order(*last: str) -> list[Column]:
    """Severity rank descending, rule code, then the given tie-breakers."""
    return [F.col("severity_rank").desc(), F.col("rule_code"), *[F.col(c) for c in (last or ("issue_id",))]]


def page_bounds(page: int | None, size: int | None, most: int | None = MAX_PAGE_SIZE) -> tuple[int, int]:
    """(offset, size): pages start at 1; no size, zero or less is 50, and ``most`` is the largest (None: any)."""
    size = size if size and size > 0 else DEFAULT_PAGE_SIZE
    size = size if most is None else min(size, most)
    return (max(page or 1, 1) - 1) * size, size


def paged(df: DataFrame, order: list[Column], page: int | None = None, size: int | None = None) -> DataFrame:
    """One page of a list: a distributed top-n, no full sort."""
    offset, size = page_bounds(page, size)
    return df.orderBy(*order).offset(offset).limit(size)


def page_at(df: DataFrame, order: list[Column], key: list[str], page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Any page of a list, however deep, with ``place`` (from 1).

    ``order``: values that are sorted upwards; ``key`` names the columns that identify a row. The order's values and the keys are written in ranges, with a count each; only the ranges that hold the page are
    read and sorted. Pages near the start are cheaper by ``paged``, which writes nothing.
    """
    names = [f"_o{i}" for i in range(len(order))]
    narrow = df.select(*key, *[o.alias(n) for o, n in zip(order, names)])
    # Equal rows of the order go by their key, so that places are the same ones each time.
    by = [*names, *key]
    spark, low = df.sparkSession, (max(page, 1) - 1) * max(size, 1)
    path = f"{shared_dir(spark)}/crawlens/ranges-{uuid.uuid4().hex}"
    narrow.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
    ranges = spark.read.schema(StructType([*narrow.schema, StructField("_range", IntegerType())])).parquet(path)
    wanted, before, start = [], 0, 0
    for row in ranges.groupBy("_range").count().orderBy("_range").collect():  # a row for each range
        if before < low + size and before + row["count"] > low:
            start = before if not wanted else start
            wanted.append(row["_range"])
        before += row["count"]
    found = ranges.where(F.col("_range").isin(wanted)).orderBy(*by).limit(low + size - start).offset(low - start)
    place = F.row_number().over(Window.orderBy(*by)) + low  # of one page's rows
    return df.join(F.broadcast(found.select(*key, place.alias("place"))), key)


def page_after(df: DataFrame, order: list[Column], last: Row | None, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The page that follows the row ``last`` of the page before (None: the first page): a filter and a top-n.

    ``order``: named columns that are sorted upwards, without nulls, and tell rows apart.
    """
    columns = df.columns
    named = df.withColumns({f"_o{i}": o for i, o in enumerate(order)})
    names = [f"_o{i}" for i in range(len(order))]
    if last is not None:
        at = df.sparkSession.createDataFrame([tuple(last[c] for c in columns)], df.schema).select(*[o.alias(n) for o, n in zip(order, names)]).first()
        named = named.where(F.struct(*names) > F.struct(*[F.lit(v).cast(named.schema[n].dataType).alias(n) for n, v in zip(names, at)]))
    return named.orderBy(*names).limit(size).select(*columns)


def paged_per_key(df: DataFrame, keys: list[str], order: list[Column], page: int | None = None, size: int | None = None) -> DataFrame:
    """The same page of every key's list at once (``rn`` is the position in the list)."""
    offset, size = page_bounds(page, size)
    return first_n(df, keys, order, offset + size).where(F.col("rn") > offset)


def totals(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))


@dataclass(frozen=True)
class PageQuery:
    url_contains: str | None = None
    status_code: int | None = None
    min_status_code: int | None = None
    max_status_code: int | None = None
    depth: int | None = None
    has_issues: bool | None = None


def filter_pages(pages: DataFrame, q: PageQuery, issues: DataFrame | None = None) -> DataFrame:
    if q.url_contains is not None and q.url_contains.strip():
        pages = pages.where(F.col("url").ilike(f"%{q.url_contains.strip()}%"))
    if q.status_code is not None:
        pages = pages.where(F.col("status_code") == q.status_code)
    if q.min_status_code is not None:
        pages = pages.where(F.col("status_code") >= q.min_status_code)
    if q.max_status_code is not None:
        pages = pages.where(F.col("status_code") <= q.max_status_code)
    if q.depth is not None:
        pages = pages.where(F.col("depth") == q.depth)
    if q.has_issues is not None:
        how = "left_semi" if q.has_issues else "left_anti"
        pages = pages.join(issues.select("crawl_id", "page_id"), ["crawl_id", "page_id"], how)
    return pages



def page_order() -> list[Column]:
    return [F.col("depth"), F.col("url")]


def issue_groups(issues: DataFrame, rules: DataFrame, q: IssueQuery = IssueQuery()) -> DataFrame:
    """Open and ignored counts per rule of each crawl; only severity and category filters apply."""
    picked = filter_issues(issues, IssueQuery(q.severity, q.min_severity, q.category))
    counts = picked.groupBy("crawl_id", "rule_code", "category", "severity", "severity_rank", "weight").agg(
        F.count_if(F.col("status") == "open").alias("open_count"),
        F.count_if(F.col("status") == "ignored").alias("ignored_count"),
    )
    return counts.join(F.broadcast(rules.select("rule_code", "title")), "rule_code")


def group_order() -> list[Column]:
    return [F.col("severity_rank").desc(), (F.col("open_count") + F.col("ignored_count")).desc(), F.col("rule_code")]


def page_detail(pages: DataFrame, issues: DataFrame, text_chars: int | None = None) -> DataFrame:
    """Page columns (the text's first ``text_chars`` characters, if limited) and the page's issues, worst first (bounded by the rule count)."""
    own = issues.groupBy("crawl_id", "page_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("severity_rank")).alias("o"), "rule_code", "severity", "status", "evidence"))).alias("i")
    )
    return (
        pages.join(own, ["crawl_id", "page_id"], "left")
        .withColumn("issues", F.coalesce(F.transform("i", lambda x: x.dropFields("o")),
                                         F.array().cast("array<struct<rule_code:string,severity:string,status:string,evidence:struct<found:string,sample_urls:array<string>>>>")))
        .withColumn("main_text", F.col("main_text") if text_chars is None else F.substring("main_text", 1, text_chars))
        .drop("i", "all_image_urls")
    )


def top_issues(issues: DataFrame, n: int = TOP_ISSUES, tie_break: tuple[str, ...] = ("issue_id",)) -> DataFrame:
    return first_n(issues, ["crawl_id"], issue_order(*tie_break), n)


def open_site_issues(issues: DataFrame, rule_code: str) -> DataFrame:
    return issues.where((F.col("rule_code") == rule_code) & (F.col("status") == "open"))


def tenant_guard(rows: DataFrame, sites: DataFrame, tenant_id: str) -> DataFrame:
    """Rows of one tenant only; ``rows`` carries site_id."""
    mine = sites.where(F.col("tenant_id") == tenant_id).select("site_id")
    return lookup(rows, mine, ["site_id"], F.xxhash64(*rows.columns[:8]), "left_semi").select(*rows.columns)


_IGNORE_KEY = ["site_id", "rule_code", "url_pattern"]


def ignore_issues(
    issues: DataFrame, ignores: DataFrame, requests: DataFrame, pages: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Apply a batch of ignore requests; returns the new (issues, ignores).

    ``requests(issue_id, reason, apply_to_site, created_by, created_at)``; a
    request without a reason is an error. A request silences its own issue, or,
    site-wide, every open issue of the rule in the site. The ignore row of the
    same scope is updated instead of repeated; the last request wins.
    """
    reason = F.when(
        T.is_blank(F.col("reason")), F.raise_error(F.lit("a reason is required")).cast("string")
    ).otherwise(F.btrim("reason"))
    targeted = (
        requests.withColumn("reason", reason)
        .join(issues.select("issue_id", "site_id", "crawl_id", "page_id", "rule_code"), "issue_id")
        .join(pages.select("crawl_id", "page_id", "url"), ["crawl_id", "page_id"], "left")
        .withColumn("url_pattern", F.when(~F.col("apply_to_site"), F.col("url")))
    )
    newest = targeted.groupBy(*_IGNORE_KEY).agg(F.max(F.struct("created_at", "reason", "created_by")).alias("r"))
    merged = (
        ignores.select(*_IGNORE_KEY, F.struct("created_at", "reason", "created_by").alias("old"))
        .join(newest, [ignores[k].eqNullSafe(newest[k]) for k in _IGNORE_KEY], "full")
        .select(
            *[F.coalesce(ignores[k], newest[k]).alias(k) for k in _IGNORE_KEY],
            F.coalesce("r.reason", "old.reason").alias("reason"),
            F.coalesce("old.created_by", "r.created_by").alias("created_by"),
            F.coalesce("old.created_at", "r.created_at").alias("created_at"),
        )
    )
    single = targeted.select("issue_id").distinct().withColumn("_hit", F.lit(True))
    wide = targeted.where("apply_to_site").select("site_id", "rule_code").distinct().withColumn("_wide", F.lit(True))
    hit = F.coalesce(F.col("_hit"), F.lit(False)) | (
        F.coalesce(F.col("_wide"), F.lit(False)) & (F.col("status") == "open")
    )
    updated = (
        lookup(issues.join(single, "issue_id", "left"), wide, ["site_id", "rule_code"], F.xxhash64("issue_id"), "left")
        .withColumn("status", F.when(hit, F.lit("ignored")).otherwise(F.col("status")))
        .select(*issues.columns)
    )
    return updated, merged


def reopen_issues(
    issues: DataFrame, ignores: DataFrame, requests: DataFrame, pages: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Reopen exactly the requested issues; drop their url-level and site-level ignore rows."""
    targeted = requests.select("issue_id").distinct().join(
        issues.select("issue_id", "site_id", "crawl_id", "page_id", "rule_code"), "issue_id"
    ).join(pages.select("crawl_id", "page_id", "url"), ["crawl_id", "page_id"], "left")
    dropped = targeted.select("site_id", "rule_code", F.explode(F.array(F.col("url"), F.lit(None))).alias("url_pattern")).distinct()
    kept = ignores.join(dropped, [ignores[k].eqNullSafe(dropped[k]) for k in _IGNORE_KEY], "left_anti")
    marks = targeted.select("issue_id").distinct().withColumn("_hit", F.lit(True))
    updated = (
        issues.join(marks, "issue_id", "left")
        .withColumn("status", F.when(F.col("_hit"), F.lit("open")).otherwise(F.col("status")))
        .select(*issues.columns)
    )
    return updated, kept
