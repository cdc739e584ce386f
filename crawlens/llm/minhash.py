"""Near-dedup of whole texts by SimHash balls, MinHash bands and exact similarity.

Texts whose SimHash fingerprints are equal or differ in two bits are held against each other, found by ball hashing as
in ``simhash``. Texts at 0.8 mostly differ in more bits than that, so MinHash finds the others: a text has BANDS values, each made of ROWS minima of its shingle hashes; texts that share a value are held against
each other by the exact Jaccard similarity of their shingle sets. Of two texts at similarity s, no value is shared with
a probability of (1 - s ** ROWS) ** BANDS: 3 in 100 000 at 0.8, less above it.

Texts of one value are first held against one of them, another one for each value. What is linked by then need not be
held against each other any more; every other pair that shares a value and can be similar is. What can not be tells a
sketch of a text's shingle set: one bit for each residue of their hashes, set where an odd number of shingles has it. Each
shingle that only one of two texts has turns one bit, so sketches differ in no more bits than the sets do in shingles. At
0.8 sets differ in at most a ninth of their sizes' sum; a pair whose sketches differ in more bits is below 0.8 for certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.llm.common import components, text_batches, without
from crawlens.llm.simhash import fingerprint_of, linked_fingerprints, shingle_hashes
from crawlens.scale import cut, spread_lookup

SIZE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
SKETCH_WORDS = 16  # of 64 bits, at least; a larger set has a sketch of at least as many bits as shingles
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIXERS = np.random.default_rng(43).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def band_values(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit value for each band, from a text's shingle hashes; a text without words has values of its own."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[start : start + 4096, None] * _FACTORS).min(axis=0))
    mixed = ((least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))) * _MIXERS).sum(axis=1, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(32))) * _FACTORS[:BANDS] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Signed 64-bit words, a power of two of them, for a set of shingle hashes. The halves' XOR is the sketch of half the words."""
    bits = 64 * SKETCH_WORDS
    while bits < len(hashes):
        bits *= 2
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def can_be_similar(size: Column, words: Column, other_size: Column, other_words: Column) -> Column:
    """False only where two sets of shingles, by their sizes and sketches, are less than 0.8 similar."""
    n = F.least(F.size(words), F.size(other_words))

    def folded(w: Column) -> Column:  # sets at 0.8 have sketches of one length, or one of twice the other's
        return F.when(F.size(w) > n, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, n + 1, n), lambda x, y: x.bitwiseXOR(y))).otherwise(w)

    short = sum((F.bit_count(words[i].bitwiseXOR(other_words[i])) for i in range(1, SKETCH_WORDS)), F.bit_count(words[0].bitwiseXOR(other_words[0])))
    differing = F.zip_with(folded(words), folded(other_words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    long = F.aggregate(differing, F.lit(0), lambda total, x: total + x)
    most = size + other_size  # nine times what may differ
    both_short = (F.size(words) == SKETCH_WORDS) & (F.size(other_words) == SKETCH_WORDS)
    return (9 * F.abs(size - other_size) <= most) & (9 * F.when(both_short, short).otherwise(long) <= most)


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the sets of five-word shingles; texts without words equal each other."""
    one, two = (np.unique(shingle_hashes(t, SIZE)) for t in (a, b))
    shared = len(np.intersect1d(one, two, assume_unique=True))
    total = len(one) + len(two) - shared
    return shared / total if total else 1.0


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, sha (of the text, null being empty), fingerprint, values, number of shingles and their sketch of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    longs = F.lit(None).cast("array<long>")
    schema = rows.select(
        "id", F.lit(b"").alias("sha"), F.lit(0).cast("long").alias("fp"), longs.alias("values"), F.lit(0).cast("long").alias("size"), longs.alias("words")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            shas = pa.array([sha256(t.encode()).digest() for t in texts], pa.binary())
            prints, values, sizes, sketches = [], [], [], []
            for text in texts:
                hashes = shingle_hashes(text, SIZE)
                prints.append(fingerprint_of(hashes))
                values.append(band_values(hashes))
                different = np.unique(hashes)
                sizes.append(len(different))
                sketches.append(sketch(different))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (values, sketches)]
            yield pa.RecordBatch.from_arrays([part.column("id"), shas, pa.array(prints, pa.int64()), lists[0], pa.array(sizes, pa.int64()), lists[1]], schema.names)

    return rows.mapInArrow(run, schema)


def _sha(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Those of the pairs of nodes (a, b) whose texts are similar."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "sha"), "node")
    texts = docs.select(_sha(text_col).alias("sha"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(wanted, "sha")
    texts = cut(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    both = spread_lookup(pairs, texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), ["a"], F.col("b"), "inner")
    both = spread_lookup(both, texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), ["b"], F.col("a"), "inner", sizes=pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text_a"):
            near = pa.array([similarity(x, y) >= SIMILARITY for x, y in zip(texts, part.column("text_b").to_pylist())], pa.bool_())
            yield part.select(["a", "b"]).filter(near)

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _roots(edges: DataFrame) -> DataFrame:
    return cut(components(edges), "roots")


def close_prints(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes (a, b): each with the first one of its fingerprint, and first ones whose fingerprints link."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    same = spread_lookup(nodes.select("fp", "node"), first.where("n > 1").select("fp", "first"), ["fp"], F.col("node"), "inner", sizes=first.select("fp", "n"))
    named = lambda side: first.select(F.col("fp").alias(side), F.col("first").alias(f"_{side}"))
    linked = linked_fingerprints(first.select("fp")).join(named("a"), "a").join(named("b"), "b")
    return same.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).union(
        linked.select(F.least("_a", "_b"), F.greatest("_a", "_b")))


def linked_texts(bands: DataFrame, nodes: DataFrame, sketches: DataFrame, docs: DataFrame, text_col: str) -> DataFrame | None:
    """node, root of all nodes with a similar one; None where there is none.

    ``bands``: node, value; ``nodes``: node, sha, fp; ``sketches``: node, size, words.
    """
    # Another one of a value's texts for each value, so that a text apart from one of them meets others.
    first = bands.groupBy("value").agg(F.min(F.struct(F.xxhash64("node", "value").alias("o"), "node"))["node"].alias("first"), F.count(F.lit(1)).alias("n"))
    first = cut(first.where("n > 1"), "values")
    met = cut(spread_lookup(bands, first.select("value", "first"), ["value"], F.col("node"), "inner", sizes=first.select("value", "n")), "met")
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    seen = cut(met.where("node <> first").select(*ordered("node", "first")).union(close_prints(nodes)).distinct(), "pairs")
    if seen.isEmpty():
        return None
    edges = cut(_similar(seen, nodes, docs, text_col), "similar")
    roots = None if edges.isEmpty() else _roots(edges)
    rooted = met.select("value", "node").withColumn("root", F.col("node")) if roots is None else (
        spread_lookup(met.select("value", "node"), roots, ["node"], F.col("value")).withColumn("root", F.coalesce("root", "node"))
    )
    rooted = cut(rooted, "rooted")
    # A value's largest component is the one the others are held against; its own texts need not meet again.
    sizes = rooted.groupBy("value", "root").agg(F.count(F.lit(1)).alias("n"))
    major = sizes.groupBy("value").agg(F.max(F.struct("n", "root"))["root"].alias("major"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    major = cut(major, "major")
    apart = spread_lookup(rooted, major.select("value", "major"), ["value"], F.col("node"), "inner", sizes=major.select("value", "n"))
    apart = cut(apart.join(sketches, "node"), "apart")  # a node has a row for each of its few values
    minor = apart.where("root <> major").select("value", *[F.col(c).alias(f"other{a}") for c, a in [("node", ""), ("root", "_root"), ("size", "_size"), ("words", "_words")]])
    across = spread_lookup(apart, minor, ["value"], F.col("node"), "inner", sizes=major.select("value", "n"))
    across = across.where("root <> other_root and (root = major or node < other)").where(can_be_similar(*map(F.col, ("size", "words", "other_size", "other_words"))))
    across = across.select(*ordered("node", "other")).distinct()
    rest = cut(across.join(seen, ["a", "b"], "left_anti"), "pairs")
    if rest.isEmpty():
        return roots
    more = cut(_similar(rest, nodes, docs, text_col), "similar")
    if more.isEmpty():
        return roots
    return _roots(edges.union(more))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts, with all its columns: the one with the smallest id, then text checksum.

    Texts link when the sets of their five-word shingles are at least 0.8 similar (Jaccard); a group is all that is
    linked, directly or through others. Words end at ASCII white space, A-Z is lower-cased; fewer words than a shingle
    are one shingle. Null texts, empty ones and those of white space alone are one group. A null id is larger than any
    other. Rows go by id and text together, so what shares an id (or has none) with another text is not touched by
    its fate; rows repeated with the same id and text are one. An empty table gives an empty result. Other columns come back as they
    are, whatever their names.
    """
    stored = cut(_signatures(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "signatures")
    nodes = cut(stored.groupBy("sha").agg(F.min("row").alias("node"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n")), "nodes")
    bands = stored.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), F.explode("values").alias("value"))
    sketches = stored.select(F.col("row").alias("node"), "size", "words")
    roots = linked_texts(cut(bands, "bands"), nodes.select("node", "sha", "fp"), sketches, docs, text_col)
    named = nodes.withColumn("root", F.col("node")) if roots is None else nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = cut(spread_lookup(stored.select("id", "sha"), named.select("sha", "root"), ["sha"], F.xxhash64("id"), "inner", sizes=nodes.select("sha", "n")), "rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha")).alias("best"), F.count(F.lit(1)).alias("n"))
    best = cut(best.where("n > 1"), "groups")
    marked = spread_lookup(rows, best.select("root", "best"), ["root"], F.xxhash64("id", "sha"), "inner", sizes=best.select("root", "n"))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("sha") == F.col("best.sha"))
    decided = marked.select(F.struct("id", "sha").alias("key"), stays.alias("kept"))
    return without(docs, F.struct(F.col(id_col).alias("id"), _sha(text_col).alias("sha")), decided)
