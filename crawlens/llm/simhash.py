"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a value within r bits of both. So every different fingerprint is
sent out under each value within r bits of it (for r = 1: itself and 64 neighbours); fingerprints that meet under a
value are candidates, and each is held against the smallest fingerprint there. A value's bucket holds at most as many
different fingerprints as there are values within r bits, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlens.llm.common import components, query, table, text_batches, without
from crawlens.scale import cut, spread_lookup

SEED = 42
# Byte value -> its eight bits as eight byte-wide counters of one 64-bit word, most significant bit first.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every word shingle in order, repeats included. Words end at ASCII white space; A-Z is lower-cased."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(words) - size + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, most significant bit first."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for start in range(0, len(octets), 255):  # a byte-wide counter holds 255
        total += _LANES[octets[start : start + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def fingerprint(text: str, size: int = 3) -> int:
    """Bits set in over half of the shingle hashes; 0 for a text without words. As a signed 64-bit integer."""
    return fingerprint_of(shingle_hashes(text, size))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row."""
    schema = docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            fps = pa.array([fingerprint(t, size) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), fps], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def ball(radius: int) -> list[int]:
    """All 64-bit masks with at most ``radius`` bits, as signed integers."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked_fingerprints(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between different fingerprints (``fp``) that connect all pairs within ``radius`` bits (an even number).

    All in a bucket are within ``radius`` of each other, so links to the bucket's smallest one lose no connection.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    variants = distinct.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    meeting = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).where("fp <> least")
    return meeting.select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, component_size.

    Fingerprints within ``radius`` bits link; a component is named by its smallest id. Null and empty texts and texts
    of white space alone have fingerprint zero and link like any other. Fewer words than a shingle are one shingle.
    Repeated rows are rows of the same component; a null id names a component only where it has no other (as null).
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    stored = cut(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = cut(stored.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    edges = cut(linked_fingerprints(distinct.select("fp"), radius), "links")
    if edges.isEmpty():
        named = distinct.select("fp", F.col("least").alias("component_id"), F.col("n").alias("component_size"))
    else:
        roots = cut(distinct.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
        whole = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
        named = spread_lookup(roots.select("fp", "root"), whole, ["root"], F.col("fp")).drop("root")
    found = spread_lookup(stored, named, ["fp"], F.xxhash64("doc_id"), "inner", sizes=distinct.select("fp", "n"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component, with all its columns: the smallest id's, then by text checksum; else as in ``near_duplicates``.

    A row with a null id stays only where its component has no other. Rows go by id and text together, so a row is not
    touched by the fate of others with its id or none; rows repeated with the same id and text are one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"))
    found = near_duplicates(docs.select(key.alias("key"), text.alias("text")), "key", "text", size, radius)
    return without(docs, key, found.select(F.col("doc_id").alias("key"), F.expr("doc_id <=> component_id").alias("kept")))


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
