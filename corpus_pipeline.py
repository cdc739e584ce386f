"""Documents to training sequences: the stages in order, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and gives documents with the columns they came with; the last one gives the
pieces of the packed sequences. ``run`` writes what a stage gives to the shared folder and reads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlens.llm import chunk_dedup, decontaminate, minhash, packing, toxicity
from crawlens.llm.common import table
from crawlens.scale import cut
from crawlens.session import tune


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the toxicity model, learned from their labels, scores one half or more."""
    labels = table(tune(spark), sf_dir, "labels")  # small Arrow batches: whole documents pass through the tasks
    return toxicity.keep_harmless(docs, toxicity.fit(docs, labels))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id."""
    return chunk_dedup.keep_unique(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are 0.8 similar, directly or through others, the one with the smallest id."""
    tune(spark)
    return minhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return decontaminate.keep_clean(docs, table(tune(spark), sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences, each with its ids and their checksum."""
    tune(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("toxicity", harmless), ("exact_dedup", unique), ("near_dedup", distinct), ("decontamination", decontaminated), ("packing", packed)]
#: Neither the model's scores nor linked components can be said in SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
