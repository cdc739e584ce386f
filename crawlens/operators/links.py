"""Link graph: targets, redirects, counts, click depth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute known)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlens.scale import bucketed, cut, ranked, spread_lookup

#: Pages a task follows links among at a time.
BLOCK_PAGES = 50_000
#: Deeper than any page.
FAR = 1 << 30


def redirect_targets(pages: DataFrame) -> DataFrame:
    """(crawl_id, page_id, final_id) for redirecting pages: the crawled page where the chain ends.

    Each round follows twice as many hops as the one before. What still moves after as many hops as there are
    redirecting pages goes round in a circle and stays at the page that the last round led to.
    """
    moving = pages.where(F.col("redirect_to").isNotNull()).select("crawl_id", "page_id", F.col("redirect_to").alias("url"))
    step = (
        moving.join(pages.select("crawl_id", "url", F.col("page_id").alias("next_id")), ["crawl_id", "url"])
        .where(F.col("next_id") != F.col("page_id"))
        .select("crawl_id", "page_id", "next_id")
    )
    reached = cut(step.withColumnRenamed("next_id", "final_id"), "redirects")
    hops, most = 1, reached.count()
    while hops < most:
        following = reached.select("crawl_id", F.col("page_id").alias("final_id"), F.col("final_id").alias("next_id"))
        doubled = reached.join(following, ["crawl_id", "final_id"], "left")
        if doubled.where("next_id is not null and next_id <> final_id").isEmpty():
            break
        reached = cut(doubled.select("crawl_id", "page_id", F.coalesce("next_id", "final_id").alias("final_id")), "redirects")
        hops *= 2
    return reached


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``to_page_id`` (null when the target was not crawled or is external).

    Navigation targets collect most links of a site; those keys are salted.
    """
    final = redirect_targets(pages)
    targets = (
        pages.select("crawl_id", F.col("url_hash").alias("to_hash"), "page_id")
        .join(final, ["crawl_id", "page_id"], "left")
        .select("crawl_id", "to_hash", F.coalesce("final_id", "page_id").alias("_target"))
    )
    joined = spread_lookup(links, targets, ["crawl_id", "to_hash"], F.col("from_page_id"), "left")
    return joined.withColumn("to_page_id", F.when(F.col("is_internal"), F.col("_target"))).drop("_target")


def inlink_counts(resolved: DataFrame) -> DataFrame:
    """Links per resolved target; nofollow and self links count. Summed map-side first."""
    return (
        resolved.where(F.col("to_page_id").isNotNull())
        .groupBy("crawl_id", F.col("to_page_id").alias("page_id"))
        .agg(F.count(F.lit(1)).alias("inlink_count"))
    )


def outlink_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("crawl_id", F.col("from_page_id").alias("page_id")).agg(
        F.count_if("is_internal").alias("outlink_internal"), F.count_if(~F.col("is_internal")).alias("outlink_external")
    )


def _page_blocks(pages: DataFrame, edges: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """``edges`` with the block of both their ends, and the blocks (crawl_id, page_id, block) of crawls that have several.

    A crawl of up to ``size`` pages is one block. The pages of a larger one are cut by the order of their URLs: what
    links to its neighbours (listings, sections, series) mostly stands in one block with them.
    """
    large = pages.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select("crawl_id")
    whole = edges.withColumns({"block": F.lit(0).cast("long"), "next_block": F.lit(0).cast("long")})
    if large.isEmpty():
        return whole, None
    # Fewer than pages / size crawls are large.
    places = ranked(pages.join(F.broadcast(large), "crawl_id").select("crawl_id", "url", "page_id"), ["crawl_id", "url", "page_id"], "places")
    blocks = cut(places.select("crawl_id", "page_id", F.floor(F.col("rank") / size).alias("block")), "blocks")
    parts = edges.join(F.broadcast(large), "crawl_id", "left_semi")
    parts = spread_lookup(parts, blocks, ["crawl_id", "page_id"], F.col("next_id"), "inner")
    ends = blocks.select("crawl_id", F.col("page_id").alias("next_id"), F.col("block").alias("next_block"))
    parts = spread_lookup(parts, ends, ["crawl_id", "next_id"], F.col("page_id"), "inner")
    return whole.join(F.broadcast(large), "crawl_id", "left_anti").unionByName(parts), blocks


def _relax(depths: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Fewest clicks to every page by links from ``sources`` to ``targets``, where ``depths`` are known (FAR: not)."""
    order = np.argsort(sources, kind="stable")
    targets = targets[order]
    first = np.searchsorted(sources[order], np.arange(len(depths) + 1))
    depths, given = depths.copy(), set(np.unique(depths).tolist()) - {FAR}
    level, new = min(given, default=FAR), np.zeros(0, np.int64)
    while level < FAR:
        front = np.flatnonzero(depths == level) if level in given else new
        given.discard(level)
        n = first[front + 1] - first[front]
        near = targets[np.repeat(first[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        new = np.unique(near[depths[near] > level + 1])
        depths[new] = level + 1
        level = level + 1 if len(new) else min(given, default=FAR)
    return depths


def _relax_block(keys: tuple, edges: pa.Table, known: pa.Table) -> pa.Table:
    """Depths of a block's pages that ``known`` ones improve, and those of pages in other blocks that follow from them."""
    kind = known.schema.field("page_id").type
    inner = pa.compute.equal(edges.column("next_block"), keys[1].as_py())
    own, beyond = edges.filter(inner), edges.filter(pa.compute.invert(inner))
    names = pa.chunked_array([c.cast(kind) for t, k in ((edges, "page_id"), (own, "next_id"), (known, "page_id")) for c in t.column(k).chunks], kind).combine_chunks().dictionary_encode()
    codes, size = names.indices.to_numpy(), len(names.dictionary)
    sources, targets, at = np.split(codes, [len(edges), len(edges) + len(own)])
    before = np.full(size, FAR, np.int64)
    np.minimum.at(before, at, known.column("depth").to_numpy())
    fresh = np.full(size, FAR, np.int64)
    settled = known.column("settled").to_numpy(zero_copy_only=False)
    np.minimum.at(fresh, at[settled], known.column("depth").to_numpy()[settled])
    inside = inner.to_numpy()
    after = _relax(before, sources[inside], targets)
    better = np.flatnonzero(after < fresh)
    rows = [pa.table({"page_id": names.dictionary.take(pa.array(better)), "depth": after[better].astype(np.int32), "block": np.full(len(better), keys[1].as_py(), np.int64)})]
    # Links out of the block, where their page became nearer.
    out = sources[~inside]
    moved = after[out] < fresh[out]
    rows.append(pa.table({"page_id": beyond.column("next_id").filter(pa.array(moved)).cast(kind), "depth": (after[out[moved]] + 1).astype(np.int32), "block": beyond.column("next_block").filter(pa.array(moved))}))
    made = pa.concat_tables(rows).append_column("settled", pa.array([True] * len(better) + [False] * int(moved.sum()), pa.bool_()))
    return made.append_column("crawl_id", pa.array([keys[0].as_py()] * len(made), known.schema.field("crawl_id").type)).select(["crawl_id", "block", "page_id", "depth", "settled"])


def click_depths(resolved: DataFrame, pages: DataFrame, block: int = BLOCK_PAGES, rounds: list[int] | None = None) -> DataFrame:
    """(crawl_id, page_id, depth): fewest clicks from the seed pages, for all crawls at once.

    Pages are dealt to blocks of at most ``block``; a crawl that fits is one. A round takes the blocks that new depths
    came to, each in one task: it follows links inside the block as far as they lead, and hands the depths of pages
    beyond it on, merged by their minimum. So rounds grow with the borders on a way, not with its clicks: a crawl of one
    block is done after the first. Links and depths of blocks are written in the same buckets, so no round moves links;
    a lost executor repeats a round at most. ``rounds``, where given, gets the number of rounds.
    """
    edges = (
        resolved.where(F.col("to_page_id").isNotNull() & (F.col("to_page_id") != F.col("from_page_id")))
        .select("crawl_id", F.col("from_page_id").alias("page_id"), F.col("to_page_id").alias("next_id"))
        .distinct()
    )
    parted, blocks = _page_blocks(pages, edges, block)
    seeds = pages.where("is_seed").select("crawl_id", "page_id").distinct()
    seeds = seeds.withColumn("block", F.lit(0).cast("long")) if blocks is None else (
        seeds.join(blocks, ["crawl_id", "page_id"], "left").withColumn("block", F.coalesce("block", F.lit(0).cast("long")))
    )
    keys, columns = ["crawl_id", "block"], ["crawl_id", "block", "page_id", "depth", "settled"]
    fresh = seeds.select("crawl_id", "block", "page_id", F.lit(0).alias("depth"), F.lit(False).alias("settled"))
    schema = fresh.schema
    if blocks is None:  # every crawl is one block: nothing comes back to any
        if rounds is not None:
            rounds.append(1)
        found = parted.groupBy(*keys).cogroup(fresh.groupBy(*keys)).applyInArrow(_relax_block, schema)
        return cut(found.select("crawl_id", "page_id", "depth"), "depth")
    with bucketed(parted, keys, "edges") as links_:
        known, turns = cut(fresh, "depth"), 0
        while True:
            turns += 1
            active = known.where("not settled").select(*keys).distinct()
            some = known.join(active, keys, "left_semi")
            found = links_.join(active, keys, "left_semi").groupBy(*keys).cogroup(some.groupBy(*keys)).applyInArrow(_relax_block, schema)
            # Of a page's depths the smallest stays; it is open again where another block brought it.
            best = known.withColumn("settled", F.lit(True)).unionByName(cut(found, "relaxed"))
            merged = best.groupBy("crawl_id", "block", "page_id").agg(F.min(F.struct("depth", (~F.col("settled")).alias("open"))).alias("b"))
            known = cut(merged.select("crawl_id", "block", "page_id", "b.depth", (~F.col("b.open")).alias("settled")).select(*columns), "depth")
            if known.where("not settled").isEmpty():
                break
        if rounds is not None:
            rounds.append(turns)
    return known.select("crawl_id", "page_id", "depth")


def graph_pages(pages: DataFrame, resolved: DataFrame, depths: DataFrame) -> DataFrame:
    """Pages with link counts and click depth; unreachable pages keep the depth they were fetched with."""
    keys = ["crawl_id", "page_id"]
    return (
        pages.join(inlink_counts(resolved), keys, "left")
        .join(outlink_counts(resolved), keys, "left")
        .join(depths.withColumnRenamed("depth", "click_depth"), keys, "left")
        .withColumns(
            {
                "depth": F.coalesce("click_depth", "depth"),
                "inlink_count": F.coalesce("inlink_count", F.lit(0)),
                "outlink_internal": F.coalesce("outlink_internal", F.lit(0)),
                "outlink_external": F.coalesce("outlink_external", F.lit(0)),
            }
        )
        .drop("click_depth")
    )
