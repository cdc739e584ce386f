"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute known)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlens.scale import cut, lookup, spread_lookup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a worker's tasks share, by what it was made from. Only the latest is kept: operators follow each other."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()  # workers live through many stages
        _KEPT[key] = make()
    return _KEPT[key]


def query(name: str, oracle: str | None = None):
    """Register a query over the given tables, with its SQL check where there is one."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else; the plain function is quick where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_batches(batches: Iterable[pa.RecordBatch], column: str, max_chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with their texts (null: empty), so that a step holds little text at once.

    A slice ends where the bytes of its texts pass ``max_chars``; a longer single text is a slice of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for end, size in enumerate(sizes):
            if total and total + size > max_chars:
                part = batch.slice(start, end - start)
                yield part, [t or "" for t in part.column(column).to_pylist()]
                start, total = end, 0
            total += size
        part = batch.slice(start)
        yield part, [t or "" for t in part.column(column).to_pylist()]


def without(docs: DataFrame, key: Column, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not decided against; one row of a key that is decided on more than once, and for.

    ``decided`` has ``key`` (never null itself; nulls inside it equal each other) and ``kept``. A key decided on once and
    for needs no word. The keys with one are written, which tells their size: where they are small they go to the rows,
    which then stay where they are; else the rows with a hot key are split. Rows travel as one struct, so their columns
    may have any names.
    """
    told = decided.groupBy("key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1").select("key", "kept")
    told = cut(told, "told")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), key.alias("key"))
    joined = lookup(rows, told, ["key"], F.rand(7), "left")
    single = joined.where("kept is null").select("whole.*")
    if told.where("kept").isEmpty():
        return single
    # Of a repeated key any row; each task leaves one of its own before rows move.
    one = joined.where("kept").groupBy("key").agg(F.first("whole").alias("whole"))
    return single.unionByName(one.select("whole.*"))


def running_total(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = 4096, ties: Sequence[str] = ()) -> DataFrame:
    """``out``: the sum of ``value`` over earlier rows of the same keys, by the integer ``order`` and then ``ties``.

    In two levels: rows are summed per block of ``order`` first (combined before the shuffle), blocks are then added
    up, and each block adds up its own rows. No task sees all rows of a key, only one row for each of its blocks.
    Null keys and orders are values like others, a null order comes first.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    sums = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("__block"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = F.col("_block").eqNullSafe(F.col("__block"))
    for k in keys:
        same = same & local[k].eqNullSafe(bases[f"_{k}"])
    joined = local.join(bases, same, "left").withColumn(out, F.col("_base") + F.col("_local"))
    return joined.drop("_block", "__block", "_base", "_local", *[f"_{k}" for k in keys])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long): node, root, with root the smallest node reachable.

    Rounds of linking every node to the smallest node around it and then to that node's own smallest one (stars grow
    by doubling, so rounds grow with the logarithm of the longest path). Minima are combined before the shuffle and
    looked up with hot nodes split; every round is a written table. The driver sees two numbers a round.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        for up in (True, False):
            near = edges.union(edges.select(F.col("b"), F.col("a"))) if up else edges
            smallest = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
            # Large star: larger neighbours are linked to the smallest. Small star: smaller ones and the node itself.
            linked = spread_lookup(near.where("b > a") if up else near, smallest.select("a", "m"), ["a"], F.col("b"), "inner", sizes=smallest.select("a", "n"))
            pairs = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
            if not up:
                pairs = pairs.union(smallest.select("a", F.col("m").alias("b")))
            edges = cut(pairs.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
