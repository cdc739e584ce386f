"""Structured Streaming jobs over arriving fetches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crawlens.functions import url as U
from crawlens.operators import page_rules
from crawlens.scale import cut
from crawlens.sources import fetches as FS
from crawlens.sources import sinks

#: Fetches and, with ``event`` "end" and else a crawl_id only, the ends of crawls.
END = "end"
EVENT_SCHEMA = f"{FS.FETCH_SCHEMA}, event string"


def read_fetches(spark: SparkSession, path: str, schema: str = FS.FETCH_SCHEMA, files_per_trigger: int = 200) -> DataFrame:
    """Parquet files appended to ``path``; the trigger limit bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique_fetches(fetches: DataFrame) -> DataFrame:
    """First arrival of each URL of a crawl, however late it is.

    The state is one key per URL of the crawls that this stream reads, so a stream runs over a set of crawls and ends
    with them; a state store on disk (RocksDB) holds large ones. A watermark would forget keys sooner, but would also
    drop URLs that arrive behind it for the first time.
    """
    return fetches.withColumn("url_hash", U.url_hash(F.col("url"))).dropDuplicates(["crawl_id", "url_hash"]).drop("url_hash")


def until_end(events: DataFrame, parts: int = 64) -> DataFrame:
    """First arrival of each URL of a crawl until the crawl's end, then the end itself; the state goes with it.

    The URLs of a crawl are dealt to ``parts`` keys, so a large crawl has its state in many tasks; an end reaches all of
    them, and one passes it on. What arrives with the end in one micro-batch still belongs before it. What arrives later
    is kept as well and waits for another end: the audit that follows then covers both.
    """
    ends = F.coalesce(F.col("event") == END, F.lit(False))
    own = F.array(F.pmod(F.xxhash64("url"), F.lit(parts)).cast("int"))
    # A row goes through Python as one value: with a column each, the columns of a few rows a key cost more than the rows.
    dealt = events.select(
        F.struct(*events.columns).alias("row"), "crawl_id", U.url_hash(F.col("url")).alias("_hash"), ends.alias("_ends"),
        F.explode(F.when(ends, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(own)).alias("_part"),
    )

    def arrivals(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        end = None
        for frame in frames:
            new = []
            for i, (url, closing) in enumerate(zip(frame["_hash"], frame["_ends"])):
                if closing:
                    end = frame[["row"]].iloc[[i]]
                elif url not in seen:
                    seen.add(url)
                    new.append(i)
            if new:
                yield frame[["row"]].iloc[new]
        if end is None:
            state.update((list(seen),))
            return
        if state.exists:
            state.remove()
        if key[1] == 0:
            yield end

    arrived = dealt.groupBy("crawl_id", "_part").applyInPandasWithState(arrivals, dealt.select("row").schema, "seen array<string>", "append", GroupStateTimeout.NoTimeout)
    return arrived.select("row.*")


def audit_on_end(
    events: DataFrame, path: str, checkpoint: str, run: Callable[[DataFrame, DataFrame], DataFrame], parts: int = 64, **trigger
) -> StreamingQuery:
    """Store the facts of arriving documents; when a crawl ends, audit it once.

    ``run(ended, facts)`` gets the ids of the crawls that ended in a micro-batch and all their facts, and gives rows
    with a crawl_id, which replace those crawls under ``path``/audited. Facts stand under ``path``/facts by batch, so
    files grow with tasks and not with crawls; an audit reads the batches that its crawls arrived in. It runs in the
    session of ``events``: a stream with state has one of its own, where plans do not adapt to sizes. A replayed batch
    replaces what it wrote before, so facts and audits are there once.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        facts = FS.page_facts(FS.extract(batch)).withColumn("batch_id", F.lit(batch_id))
        sinks.replace_partitions(facts, f"{path}/facts", ["batch_id"])
        stored = spark.read.schema(facts.schema).parquet(f"{path}/facts")
        ends = stored.where(F.col("event") == END)
        ended = cut(ends.where(F.col("batch_id") == batch_id).select("crawl_id").distinct(), "ended")
        if ended.isEmpty():
            return
        own = stored.join(ended, "crawl_id", "left_semi")
        batches = [r.batch_id for r in own.select("batch_id").distinct().collect()]
        whole = own.where(F.col("batch_id").isin(batches) & F.col("event").isNull()).drop("batch_id", "event")
        if not ends.where(F.col("batch_id") < batch_id).join(ended, "crawl_id", "left_semi").isEmpty():
            # A URL that came again after an earlier end of its crawl counts once.
            whole = cut(whole.dropDuplicates(["crawl_id", "url_hash"]), "facts")
        audit_finished(ended, lambda crawls: run(crawls, whole), f"{path}/audited")

    return until_end(events, parts).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_pages(fetches: DataFrame) -> DataFrame:
    """Stateless page rows (append mode)."""
    return FS.page_rows(FS.page_facts(FS.extract(fetches))).withColumn("is_asset", F.lit(False))


def stream_findings(fetches: DataFrame, rules=page_rules.DEFAULT_RULES, image_sizes: DataFrame | None = None) -> DataFrame:
    """Page findings of each document on arrival; anchors come from the page itself, so no join is needed.

    With ``image_sizes`` (measured when a page arrives) ``fetches`` is a micro-batch: images meet their sizes in it.
    """
    facts = FS.page_facts(FS.extract(fetches))
    if image_sizes is not None:
        facts = cut(facts, "arrived")
    anchors = F.transform(
        F.filter(
            F.transform(
                "links",
                lambda l: F.struct(U.normalize_url(l["href"], F.col("link_base")).alias("url"), l["text"].alias("text")),
            ),
            lambda l: F.coalesce(U.is_internal(l["url"], F.col("base_url")), F.lit(False)),
        ),
        lambda l: l["text"],
    )
    rows = FS.page_rows(facts.withColumn("internal_anchor_texts", anchors), keep=["internal_anchor_texts"])
    if image_sizes is not None:
        rows = FS.measured_images(rows, image_sizes)
    return page_rules.page_findings(page_rules.rule_input(rows), rules)


def progress(pages: DataFrame) -> DataFrame:
    """Running number of pages per crawl (update mode)."""
    return pages.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("pages_crawled"))


def running_issue_counts(findings: DataFrame) -> DataFrame:
    """Running issue counts per crawl and severity (update mode)."""
    return findings.groupBy("crawl_id", "severity").agg(F.count(F.lit(1)).alias("issues"))


def persist_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", made: Callable[[DataFrame], DataFrame] | None = None, **trigger
) -> StreamingQuery:
    """Write each micro-batch under its own batch id, so a replayed batch replaces itself.

    ``made`` turns a micro-batch into what is written. Running counts go in ``mode`` "update"; of a key's rows, the one
    with the largest batch id counts (``latest``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if made is None else made(batch)
        sinks.replace_partitions(rows.withColumn("batch_id", F.lit(batch_id)), path, ["batch_id"])

    return (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key among batches written in update mode."""
    values = [c for c in written.columns if c not in (*keys, "batch_id")]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select(*keys, "v.*")


def audit_finished(finished: DataFrame, run: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Run the set-level audit for the crawls in ``finished`` and replace their partitions."""
    sinks.write_by_crawl(run(finished), path)
