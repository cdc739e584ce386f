"""robots.txt bodies -> directive table -> allowed / blocked URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlens.functions import url as U
from crawlens.scale import cut, spread_lookup

OWN_TOKEN = "crawlensbot"


def _lines(robots: DataFrame) -> DataFrame:
    """(site_id, n, key, value) of every meaningful line; comments are gone."""
    line = F.btrim(F.regexp_replace(F.btrim(F.col("raw"), F.lit(" \t\r\f")), r"\s*#.*$", ""))
    return (
        robots.select("site_id", F.posexplode(F.split("body", "\n")).alias("n", "raw"))
        .withColumn("line", line)
        .where(F.col("line").contains(":"))
        .select(
            "site_id", "n",
            F.lower(F.btrim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("key"),
            F.btrim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"),
        )
        .where(F.col("value") != "")
    )


def sitemap_urls(robots: DataFrame) -> DataFrame:
    """``Sitemap:`` lines, in whatever group they stand."""
    return _lines(robots).where(F.col("key") == "sitemap").select("site_id", F.col("value").alias("sitemap_url"), "n")


def directives(robots: DataFrame, token: str = OWN_TOKEN) -> DataFrame:
    """(site_id, n, allow, pattern) that apply to ``token``.

    Consecutive User-agent lines form one group header (gaps and islands over
    the lines of a file). Rules of the own token win; only a site without any
    falls back to ``*``. The windows run over the lines of a single file.
    """
    rules = _lines(robots).where(F.col("key").isin("user-agent", "allow", "disallow"))
    by_line = Window.partitionBy("site_id").orderBy("n")
    is_agent = F.col("key") == "user-agent"
    grouped = (
        rules.withColumn("opens", is_agent & F.coalesce(F.lag(~is_agent).over(by_line), F.lit(True)))
        .withColumn("grp", F.sum(F.col("opens").cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("grp") > 0)
    )
    in_group = Window.partitionBy("site_id", "grp")
    tagged = grouped.withColumn(
        "own", F.max(is_agent & (F.lower("value") == token.strip().lower())).over(in_group)
    ).withColumn("star", F.max(is_agent & (F.col("value") == "*")).over(in_group))
    found = tagged.where(~is_agent & (F.col("own") | F.col("star")))
    site = Window.partitionBy("site_id")
    return (
        found.withColumn("site_own", F.max("own").over(site))
        .where(F.when(F.col("site_own"), F.col("own")).otherwise(F.col("star")))
        .select("site_id", "n", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))
    )


def pattern_regex(pattern: Column) -> Column:
    """``*`` matches anything, a trailing ``$`` anchors the end, the rest is literal."""
    body = F.regexp_replace(pattern, r"\$$", "")
    literal = F.regexp_replace(body, r"([\\.+?()\[\]{}|^$])", r"\\$1")
    return F.concat(
        F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), F.lit("$")).otherwise(F.lit(""))
    )


def _literal(pattern: Column) -> Column:
    """What a pattern begins with before its first ``*`` or closing ``$``."""
    return F.regexp_extract(F.regexp_replace(pattern, r"\$$", ""), r"^[^*]*", 0)


INDEX = "array<struct<prefix: string, rules: array<struct<len: int, allow: boolean, rx: string>>, chain: array<int>>>"


def policies(robots: DataFrame, token: str = OWN_TOKEN) -> DataFrame:
    """(site_id, index): one row per site with its rules, sorted by the literal text they begin with.

    An entry holds the rules of one beginning (``rx`` where more than that has to match) and the places of all entries
    that its own beginning starts with, itself included. Together those are no longer than the file.
    """
    own = directives(robots, token).select("site_id", _literal(F.col("pattern")).alias("prefix"), "pattern", "allow")
    plain = F.col("prefix") == F.col("pattern")
    rule = F.struct(F.length("pattern").alias("len"), "allow", F.when(~plain, pattern_regex(F.col("pattern"))).alias("rx"))
    grouped = own.groupBy("site_id", "prefix").agg(F.collect_set(rule).alias("rules"))
    sites = grouped.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("prefix", "rules"))).alias("sorted"))
    # Entry by entry: of the chain of the one before, what the entry starts with as well, and itself.
    nothing = F.array().cast("array<int>")
    chains = F.reduce(
        "sorted", F.array().cast("array<array<int>>"),
        lambda made, e: F.concat(made, F.array(F.concat(
            F.filter(F.coalesce(F.get(made, F.size(made) - 1), nothing), lambda i: F.startswith(e["prefix"], F.get(F.col("sorted"), i)["prefix"])), F.array(F.size(made))
        ))),
    )
    whole = F.transform(F.arrays_zip(F.col("sorted").alias("e"), F.col("chains").alias("c")), lambda z: F.struct(z["e"]["prefix"].alias("prefix"), z["e"]["rules"].alias("rules"), z["c"].alias("chain")))
    return sites.withColumn("chains", chains).select("site_id", whole.cast(INDEX).alias("index"))


def verdict(index: Column, target: Column) -> Column:
    """Whether ``target`` (path and query of a URL) is allowed. Longest matching pattern wins, Allow on a tie, no match means allowed.

    Halving finds the last entry that is not after the target; whatever the target starts with is on that entry's chain. So
    few rules are looked at, however many a file has, and only patterns with more than a beginning are matched.
    """
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(index) + F.lit(1.0))).cast("int") + 1)
    middle = lambda s: F.shiftright(s["low"] + s["high"], 1)
    bounds = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    found = F.reduce(
        steps, bounds(F.lit(0), F.size(index)),
        lambda s, _: F.when(s["low"] >= s["high"], s)
        .when(F.get(index, middle(s))["prefix"] <= target, bounds(middle(s) + 1, s["high"]))
        .otherwise(bounds(s["low"], middle(s))),
    )
    above = F.get(index, found["low"] - 1)["chain"]
    starting = F.filter(F.transform(above, lambda i: F.get(index, i)), lambda e: F.startswith(target, e["prefix"]))
    matching = F.flatten(F.transform(starting, lambda e: F.filter(e["rules"], lambda r: r["rx"].isNull() | F.rlike(target, r["rx"]))))
    best = F.array_max(F.transform(matching, lambda r: F.struct(r["len"].alias("len"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def with_verdict(urls: DataFrame, robots: DataFrame, url: str = "url", token: str = OWN_TOKEN) -> DataFrame:
    """Adds ``allowed``. The rules of a site travel as one row, so every URL is matched inside its own task.

    The URLs of a site that holds a large part of all are dealt to several tasks, its row to each of them; for that
    they are counted, and written first.
    """
    asked = cut(urls.withColumn("_target", U.path_and_query(F.col(url))), "asked")
    joined = spread_lookup(asked, policies(robots, token), ["site_id"], F.xxhash64(url))
    return joined.withColumn("allowed", verdict(F.col("index"), F.col("_target"))).drop("index", "_target")
