"""Scalar column functions of the risk-scoring vocabulary. All stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bound (exclusive) and name of each band of information value.
IV_BANDS = [(0.02, "unpredictive"), (0.10, "weak"), (0.30, "medium"), (0.50, "strong"), (math.inf, "suspicious")]


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column, edge: float = 1e-12) -> Column:
    clipped = F.greatest(F.least(p, F.lit(1 - edge)), F.lit(edge))
    return F.ln(clipped / (1 - clipped))


def log1p_clipped(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def iv_band(iv: Column) -> Column:
    """The first band whose bound is above iv; exactly 0.02 is weak."""
    chain = None
    for bound, name in IV_BANDS[:-1]:
        chain = F.when(iv < bound, name) if chain is None else chain.when(iv < bound, name)
    return chain.otherwise(IV_BANDS[-1][1])


def decision(p: Column, threshold: float) -> Column:
    return (p >= threshold).cast("int")


def direction(phi: Column) -> Column:
    return F.when(phi > 0, "towards positive").otherwise("towards negative")


def state_of(x: Column) -> Column:
    """missing, zero or positive; a negative value has no state."""
    return F.when(x.isNull(), "missing").when(x == 0, "zero").when(x > 0, "positive")


def minutes_to_days(x: Column) -> Column:
    return x / 60 / 24


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def percent(x: Column, digits: int = 2) -> Column:
    return F.round(100 * x, digits)


def shortened(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def interval_label(lo: Column, hi: Column) -> Column:
    """(lo, hi] for display; plans keep the numbers."""
    return F.format_string("(%s, %s]", F.coalesce(lo.cast("string"), F.lit("-inf")), F.coalesce(hi.cast("string"), F.lit("inf")))


def interval_left_bound(label: Column) -> Column:
    """Sort key of a displayed bin: zero's is 0, missing's is last."""
    bound = F.regexp_extract(label, r"^[(\[]([^,]+),", 1)
    number = F.when(bound == "-inf", F.lit(-math.inf)).otherwise(bound.try_cast("double"))
    return F.when(label == "zero", F.lit(0.0)).when(label == "missing", F.lit(math.inf)).otherwise(number)


def steps(value: Column, bounds: list[float], inclusive: bool) -> Column:
    """How many of the rising bounds a value reaches (inclusive) or passes: a balanced tree of CASE, so some log2(n) comparisons a row. A null value reaches none."""
    if not bounds:
        return F.lit(0)

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        reached = value >= F.lit(bounds[middle]) if inclusive else value > F.lit(bounds[middle])
        return F.when(reached, tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(bounds))
