"""Page-speed result JSON -> vitals columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(json: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json), path, "double")


def _audit(json: Column, name: str) -> Column:
    return _number(json, f"$.lighthouseResult.audits['{name}'].numericValue")


def vitals_from_results(results: DataFrame) -> DataFrame:
    """Adds the measured columns to rows that carry ``result`` (JSON text).

    Interaction latency prefers the field measurement over the lab one. Whole
    milliseconds and the 0-100 score round half to even.
    """
    json = F.col("result")
    inp = F.coalesce(
        _number(json, "$.loadingExperience.metrics.INTERACTION_TO_NEXT_PAINT.percentile"),
        _audit(json, "interaction-to-next-paint"),
    )
    whole = lambda c: F.bround(c).cast("int")
    return results.withColumns(
        {
            "lcp": _audit(json, "largest-contentful-paint"),
            "cls": _audit(json, "cumulative-layout-shift"),
            "inp": inp,
            "lcp_ms": whole(_audit(json, "largest-contentful-paint")),
            "inp_ms": whole(inp),
            "ttfb_ms": whole(_audit(json, "server-response-time")),
            "fcp_ms": whole(_audit(json, "first-contentful-paint")),
            "perf_score": F.bround(_number(json, "$.lighthouseResult.categories.performance.score") * 100).cast("int"),
            "device": F.lit("mobile"),
            "source": F.lit("psi_lab"),
        }
    ).drop("result")
