"""Scoring of streams: evidence and decisions are generated expressions without state, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskloom.functions.scalars import decision, sigmoid
from riskloom.operators.explain import linear_margin
from riskloom.operators.woe import WoeModel


def score_stream(rows: DataFrame, model: WoeModel, coefficients: dict[str, float], intercept: float, threshold: float) -> DataFrame:
    """rows (a stream or a table) with p and the decision, by a linear model over evidence."""
    evidence = model.transform(rows, "_woe")
    margin = linear_margin({f"{f}_woe": b for f, b in coefficients.items()}, intercept)
    scored = evidence.withColumn("p", sigmoid(margin))
    return scored.withColumn("alarm", decision(scored["p"], threshold)).select(*rows.columns, "p", "alarm")
