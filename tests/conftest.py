import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crawlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "crawlens-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate a Column expression over literal rows: evaluate(fn, [(...), ...], 'a string, ...')."""

    def run(expression, rows, schema):
        frame = spark.createDataFrame(rows, schema).coalesce(1)
        return [r[0] for r in frame.select(expression.alias("out")).collect()]

    return run
