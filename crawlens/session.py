"""Session settings the jobs are written for; every value can be overridden."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HTML rows are fat: small input splits keep one extraction task well inside
    # executor memory and spread a hot file over many tasks.
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # No Python call site per expression: building wide plans gets several times faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # Top-n per key is cut before the shuffle for budgets and pages of this size too.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "crawlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the settings that can change at run time; values set there are kept."""
    for key in ("spark.sql.optimizer.windowGroupLimitThreshold", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, DEFAULTS[key])
    return spark
