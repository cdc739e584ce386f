"""URL filters by a sort-merge range join, in DataFrame operations only.

A rule is a host and a path prefix. Host and path together are no single range (subdomains come between), so a URL
stands once under each of its host's suffixes that is short enough to be a rule's. Under a suffix, a path prefix P is
the key range from P up to P followed by the byte FF, which no UTF-8 text contains. Ranges of prefixes nest or are
apart. Range starts, range ends and URLs are sorted by key and swept once: a start pushes its rule, an end pops it,
and a URL sees the stack that the last event before it left. Suffixes with much traffic are swept in several slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlens.llm.common import LOWER, UPPER, query, table
from crawlens.scale import spread_lookup

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first "://" and "/", "?", "#" or the end, A-Z lower-cased. Path: from there to "?" or "#"."""
    full = F.coalesce(url, F.lit(""))
    at = F.instr(full, "://")
    rest = F.when(at > 0, F.substr(full, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def reversed_host(host: Column) -> Column:
    """``www.example.net`` as ``net.example.www``: a host's subdomains follow it."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_events(rules: DataFrame) -> DataFrame:
    """Starts and ends of the rules' ranges: suffix, key, kind, active (the stack after the event, outermost first).

    Of rules with equal host and path, a block wins. The rules around a rule are found by its own shorter prefixes.
    """
    clean = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    )
    named = clean.withColumn("suffix", reversed_host(F.col("host"))).withColumn("rule", F.concat("host", "path"))
    entry = F.struct(F.char_length("path").alias("length"), "rule", "verdict")
    prefixes = named.select("suffix", "path", F.explode(F.transform(F.sequence(F.lit(0), F.char_length("path")), lambda n: F.left(F.col("path"), n))).alias("prefix"))
    around = (
        prefixes.join(named.select("suffix", F.col("path").alias("prefix"), entry.alias("entry")), ["suffix", "prefix"])
        .groupBy("suffix", "path").agg(F.array_sort(F.collect_list("entry")).alias("active"))
    )
    key = F.col("path").cast("binary")
    starts = around.select("suffix", key.alias("key"), F.lit(1).alias("kind"), "active")
    ends = around.select("suffix", F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("kind"), F.slice("active", 1, F.size("active") - 1).alias("active"))
    return starts.unionByName(ends)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", share: int = 64) -> DataFrame:
    """``pages`` with host, path, rule and verdict added; columns of these names are replaced.

    A rule fits its host and all subdomains of it if the path starts with the rule's path. The rule with the longest
    host and path together wins, of equally long ones the longer host. Without a rule, ``rule`` is null and the
    verdict is ``default``. A null URL or one without "://" has an empty host and path. Repeated rows stay repeated.
    A suffix with more than one in ``share`` of all rows is swept in as many slices as it holds shares.
    """
    host, path = host_and_path(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*kept).alias("_whole"), host.alias("host"), path.alias("path"))
    labels = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).scalar()
    backwards = F.reverse(F.split(F.col("host"), r"\."))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(backwards), F.col("most"))), lambda n: F.array_join(F.slice(backwards, 1, n), ".")
    )
    # Suffixes longer than any rule's host can't be a rule's.
    urls = rows.select("host", "path").distinct().withColumn("most", F.coalesce(labels, F.lit(1))).select("host", "path", F.explode(suffixes).alias("suffix"))
    events = rule_events(rules)
    # Only suffixes that have rules are swept.
    urls = urls.join(events.select("suffix").distinct(), "suffix", "left_semi")
    counts = urls.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    slices = counts.select("suffix", F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share) / total)).cast("int").alias("slices"))
    hot = slices.where("slices > 1")  # fewer than ``share`` rows
    swept_urls = (
        urls.join(F.broadcast(hot), "suffix", "left")
        .select("suffix", F.pmod(F.xxhash64("host", "path"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice"), F.col("path").cast("binary").alias("key"), F.lit(2).alias("kind"), "host", "path")
    )
    swept_rules = (
        events.join(F.broadcast(hot), "suffix", "left")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
        .drop("slices")
    )
    sweep = Window.partitionBy("suffix", "slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = (
        swept_urls.unionByName(swept_rules, allowMissingColumns=True)
        .withColumn("stack", F.last("active", ignorenulls=True).over(sweep))
        .where((F.col("kind") == 2) & (F.size("stack") > 0))
        .withColumn("top", F.element_at("stack", -1))
    )
    found = swept.groupBy("host", "path").agg(F.max(F.struct(F.char_length("top.rule").alias("length"), F.char_length("suffix").alias("wide"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))).alias("best"))
    narrow = found.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    joined = spread_lookup(rows, narrow, ["host", "path"], F.monotonically_increasing_id())
    return joined.select("_whole.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


OP4_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
f AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""


@query("op4_url_filters", OP4_SQL)
def op4_url_filters(spark, sf_dir):
    """Host, path, winning rule and verdict of every page."""
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS rules(verdict, host, path)")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
