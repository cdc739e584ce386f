"""Helpers that keep joins, samples and lineage safe when one key is huge."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key that holds more than one in so many rows is hot. There are at most so many
# hot keys, whatever the data: that bounds the list of them, which is broadcast.
HOT_SHARE = 1_000
# A looked-up table of up to so many bytes, as written, goes to every task.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only a local session
    without that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy survives lost executors, is columnar (later reads prune columns
    and push filters) and ends the lineage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/crawlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, keys: Sequence[str], name: str) -> Iterator[DataFrame]:
    """``df`` written to the shared folder in buckets of ``keys``, for rounds of joins that leave it where it is.

    The table's name is forgotten at the end; what is derived from it must be written by then.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = f"crawlens_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/crawlens/{spark.sparkContext.applicationId}/{known}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(known)
    try:
        yield spark.table(known)
    finally:
        spark.sql(f"drop table if exists {known}")


def ranked(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``rank``: the place of a row in the whole order, from 0; written.

    Ranges of the order go to tasks, each numbers its own rows; what comes before a range is one number for each task.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("_part", before.alias("_before"))  # a row for each task
    own = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn("rank", own).drop("_part", "_at", "_before")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the input came in fewer pieces (a file of one row group is one task), else as they are.

    For stages that work long on each row; a table of many files is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group.

    Spark evaluates ``row_number() <= n`` with a group limit in front of the
    shuffle, so each map task ships at most ``n`` rows of a hot key.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def sample_lists(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, n: int, out: str
) -> DataFrame:
    """One array per group with the first ``n`` values in the given order."""
    top = first_n(df.withColumn("_value", value), keys, order, n)
    return top.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("rn"), F.col("_value")))), lambda s: s["_value"]
        ).alias(out)
    )


def spread_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Column,
    how: str = "left",
    also: Sequence[str] = (),
    sizes: DataFrame | None = None,
    share: int = HOT_SHARE,
) -> DataFrame:
    """Equi-join ``facts`` with ``lookup`` with hot keys split.

    A key that holds more than one in ``share`` rows of ``facts`` gets as many
    salts as it holds shares; only its lookup rows are repeated. Fewer than
    ``share`` keys can be hot, so the broadcast list of them is bounded.
    ``sizes`` (keys and ``n``) saves counting ``facts`` where the counts are known;
    ``also`` names further columns that must be equal.
    """
    keys = list(keys)
    if sizes is None:
        sizes = facts.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    hot = sizes.where(F.col("n") * F.lit(share) > total).select(*keys, F.ceil(F.col("n") * F.lit(share) / total).cast("int").alias("_salts"))
    salted_facts = (
        facts.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_salts")), F.lit(0)).cast("int"))
        .drop("_salts")
    )
    salted_lookup = (
        lookup.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted_facts.join(salted_lookup, [*keys, *also, "_salt"], how).drop("_salt")


def lookup(
    facts: DataFrame, table: DataFrame, keys: Sequence[str], spread_by: Column, how: str = "inner", most_bytes: int | None = None
) -> DataFrame:
    """Join ``facts`` with a ``table`` that has few rows a key, whatever share of the facts one key holds.

    The table is written, which tells its size: up to ``most_bytes`` (BROADCAST_BYTES) it is broadcast and the facts stay
    where they are; above, hot keys are split as in ``spread_lookup``.
    """
    stored = cut(table, "lookup")
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= (BROADCAST_BYTES if most_bytes is None else most_bytes):
        return facts.join(F.broadcast(stored), list(keys), how)
    return spread_lookup(facts, stored, keys, spread_by, how)
