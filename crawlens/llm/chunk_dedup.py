"""Exact dedup by recipes of content-defined chunks, in DataFrame operations only.

A text is cut where its own characters say so, so an equal passage gives equal chunks wherever it stands. Each
different chunk moves once, combined before the shuffle, to be verified: a 64-bit identifier that stands for two
different chunks is found by comparing their characters. From then on a document is the ordered list of its chunk
identifiers; documents are compared by these lists and no text moves again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlens.llm.common import ascii_lower, query, table, without
from crawlens.scale import cut, spread_lookup

MIN_CHARS, MAX_CHARS = 1024, 8192
# A chunk may end after a vowel, white space and one of these letters: rare enough to skip
# short chunks, frequent enough that few texts reach MAX_CHARS without one.
ANCHOR = r"(?<=[aeiouy]\s[b-hm-w])"


def chunks(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """The text as an array of chunks; joined they are the text. An empty text has none."""
    pattern = rf"(?s).{{{min_chars},{max_chars - 1}}}?(?:{ANCHOR}|\z)|.{{1,{max_chars}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_dictionary(chunked: DataFrame, identify) -> DataFrame:
    """Every different chunk once: id, chunk. ``chunked`` has the array ``chunks``."""
    return chunked.select(F.explode("chunks").alias("chunk")).select(identify(F.col("chunk")).alias("id"), "chunk").distinct()


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify=F.xxhash64) -> DataFrame:
    """One row per document: row, doc_id, recipe (ordered chunk ids), variants, text_sha256.

    ``variants`` is empty unless some id stands for several chunks; it then numbers, chunk by chunk, which of them is
    meant. ``identify`` maps a chunk to its id (a weak one is for tests). A null text is empty and has the recipe [].
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    chunked = texts.select("doc_id", chunks(F.col("text")).alias("chunks"), F.sha2("text", 256).alias("text_sha256"))
    plain = cut(
        chunked.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.transform("chunks", lambda c: identify(c)).alias("recipe"), "text_sha256"
        ),
        "recipes",
    )
    shared = cut(chunk_dictionary(chunked, identify).groupBy("id").count().where("count > 1").select("id"), "shared-ids")
    if shared.isEmpty():
        return plain.withColumn("variants", F.array().cast("array<int>"))
    # Some ids stand for several chunks: number these chunks by their characters.
    numbered = (
        chunk_dictionary(chunked, identify).join(shared, "id", "left_semi")
        .withColumn("variant", F.row_number().over(Window.partitionBy("id").orderBy("chunk")))
    )
    places = chunked.select("text_sha256", F.posexplode("chunks").alias("pos", "chunk")).withColumn("id", identify(F.col("chunk"))).distinct()
    variants = (
        places.join(numbered, ["id", "chunk"], "left")
        .groupBy("text_sha256")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("variant", F.lit(0)).alias("variant")))).alias("variants"))
        .select("text_sha256", F.transform("variants", lambda v: v["variant"]).alias("variants"))
    )
    return plain.join(variants, "text_sha256", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<int>")))


def _groups(listed: DataFrame) -> DataFrame:
    """One row per different recipe: its members, the row that stays and how many rows share its doc_id."""
    return (
        listed.groupBy("key", "recipe", "variants", "doc_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("row"))
        .groupBy("key", "recipe", "variants")
        .agg(F.sum("n").alias("group_size"), F.max(F.struct("doc_id", "row", "n")).alias("top"))
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id stays; of repeated rows with
    that id and text exactly one is marked as kept. A null id is smaller than any other and stays only where no row
    of the group has one (keep_id is then null). Null texts count as empty, empty texts equal each other. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    listed = recipes(docs, id_col, text_col, identify).withColumn("key", F.xxhash64("recipe", "variants"))
    groups = _groups(listed)
    found = spread_lookup(
        listed, groups, ["key"], F.col("row"), "inner", also=["recipe", "variants"], sizes=groups.groupBy("key").agg(F.sum("group_size").alias("n"))
    )
    return found.select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns; cases as in ``exact_duplicates``.

    Rows repeated with the same id and text are reduced to one of them, whatever stands in other columns.
    Other columns come back as they are, whatever their names.
    """
    result = cut(exact_duplicates(docs, id_col, text_col).select(F.struct("doc_id", F.col("text_sha256").alias("sha")).alias("key"), "kept"), "exact")
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    return without(docs, F.struct(F.col(id_col).alias("doc_id"), sha.alias("sha")), result)


OP2_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""


@query("op2_exact_dedup", OP2_SQL)
def op2_exact_dedup(spark, sf_dir):
    """Every document with the one of its group that stays."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chunks")
