"""Sitemap XML documents -> listed URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlens.functions import text as T
from crawlens.functions import url as U
from crawlens.scale import cut

_XML = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"


def _parsed(sitemaps: DataFrame) -> DataFrame:
    """Listed pages and listed sitemaps of each document; unreadable XML yields nothing."""
    doc = sitemaps.withColumn("doc", F.from_xml("xml", _XML, {"mode": "PERMISSIVE"}))
    names = lambda field: F.filter(
        F.transform(F.coalesce(F.col(f"doc.{field}"), F.array().cast("array<struct<loc:string>>")),
                    lambda e: F.btrim(e["loc"])),
        lambda loc: loc.isNotNull(),
    )
    return doc.select("site_id", "sitemap_url", names("url").alias("urls"), names("sitemap").alias("children"))


def listed_urls(sitemaps: DataFrame, roots: DataFrame, max_levels: int | None = None, max_urls: int | None = None) -> DataFrame:
    """(site_id, raw_url) reachable from the root sitemaps.

    ``roots(site_id, sitemap_url, n)``. An index is followed until no document is new, or for ``max_levels`` levels;
    a document listed twice, or in a circle, is read once, at its first place. ``max_urls`` limits the URLs of a root:
    it is applied to whole documents by running totals of their sizes, so single URLs are never ranked.
    """
    # Every level reads the documents again: parse them once.
    docs = cut(_parsed(sitemaps), "sitemaps")
    level = roots.select(
        "site_id", "sitemap_url", F.struct(F.col("n").alias("root"), F.array().cast("array<int>").alias("path")).alias("at")
    )
    seen, depth = None, 0
    while max_levels is None or depth <= max_levels:
        fresh = level.groupBy("site_id", "sitemap_url").agg(F.min("at").alias("at"))
        if seen is not None:
            fresh = fresh.join(seen.select("site_id", "sitemap_url"), ["site_id", "sitemap_url"], "left_anti")
        here = cut(fresh.join(docs, ["site_id", "sitemap_url"]), "sitemap-level")
        if here.isEmpty():
            break
        seen = here if seen is None else seen.unionByName(here)
        level = here.select("site_id", "at", F.posexplode("children").alias("i", "sitemap_url")).select(
            "site_id", "sitemap_url",
            F.struct(F.col("at.root").alias("root"), F.concat("at.path", F.array("i")).alias("path")).alias("at"),
        )
        depth += 1
    if seen is None:
        return docs.select("site_id", F.explode("urls").alias("raw_url")).limit(0)
    leaves = seen.where(F.size("children") == 0)
    if max_urls is None:
        return leaves.select("site_id", F.explode("urls").alias("raw_url"))
    order = Window.partitionBy("site_id", F.col("at.root")).orderBy("at.path").rowsBetween(Window.unboundedPreceding, -1)
    sized = leaves.withColumn("before", F.coalesce(F.sum(F.size("urls")).over(order), F.lit(0)))
    room = F.greatest(F.lit(max_urls) - F.col("before"), F.lit(0)).cast("int")
    return sized.select("site_id", F.explode(F.slice("urls", F.lit(1), room)).alias("raw_url"))


def sitemap_pages(sitemaps: DataFrame, roots: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, url) normalised against the site base; what cannot be normalised is dropped."""
    base = sites.select("site_id", F.concat("base_url", F.lit("/")).alias("base"))
    return (
        listed_urls(sitemaps, roots)
        .join(base, "site_id")
        .select("site_id", U.normalize_url(F.col("raw_url"), F.col("base")).alias("url"))
        .where(~T.is_blank(F.col("url")))
        .distinct()
    )
