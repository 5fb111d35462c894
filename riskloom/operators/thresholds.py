"""Decisions: threshold sweep, costs, capacity. One pass over the scores; everything else runs on a row per threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import ratio, steps
from riskloom.operators.metrics import with_rates

COST_RATIOS = [1, 5, 10, 20, 50]


def linspace(count: int = 99, first: float = 0.01, last: float = 0.99) -> list[float]:
    return [first + i * ((last - first) / (count - 1)) for i in range(count - 1)] + [last]


def sweep(scores: DataFrame, p: str = "p", y: str = "y", thresholds: list[float] | None = None) -> DataFrame:
    """Confusion and rates per threshold (p >= threshold alarms). A score counts once, under the number of thresholds it reaches; sums from above give the rest."""
    values = sorted(thresholds or linspace())
    spark = scores.sparkSession
    reached = steps(F.col(p), values, inclusive=True)
    counts = scores.groupBy(reached.alias("reached")).agg(F.sum(F.col(y)).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg"))
    table = spark.createDataFrame([(i, t) for i, t in enumerate([0.0, *values])], "reached int, t double").join(counts, "reached", "left")
    onward = Window.orderBy("reached").rowsBetween(0, Window.unboundedFollowing)  # a row per threshold
    all_ = Window.partitionBy()
    pos, neg = F.coalesce("pos", F.lit(0)), F.coalesce("neg", F.lit(0))
    t = table.select("reached", "t", F.sum(pos).over(onward).alias("tp"), F.sum(neg).over(onward).alias("fp"), F.sum(pos).over(all_).alias("all_pos"), F.sum(neg).over(all_).alias("all_neg")).where("reached > 0")
    t = t.withColumn("fn", F.col("all_pos") - F.col("tp")).withColumn("tn", F.col("all_neg") - F.col("fp"))
    return with_rates(t).select(
        F.round("t", 3).alias("threshold"), "tp", "fp", "fn", "tn", "precision", "recall", "f1",
        ratio(F.col("tp") + F.col("fp"), F.col("all_pos") + F.col("all_neg")).alias("alert_rate"), ratio(F.col("fn"), F.col("all_pos")).alias("miss_rate"), ratio(F.col("fp"), F.col("all_neg")).alias("false_alarm_rate"),
    )


def with_cost(table: DataFrame, missed: Column | float, false_alarm: Column | float) -> DataFrame:
    cost = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return table.withColumn("cost", F.col("fn") * cost(missed) + F.col("fp") * cost(false_alarm))


def normalized_cost(table: DataFrame) -> DataFrame:
    return table.withColumn("relative_cost", ratio(F.col("cost"), F.max("cost").over(Window.partitionBy())))


def first_by(table: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row per group: the first in order; ties go to the lowest threshold."""
    w = Window.partitionBy(*by).orderBy(*order, "threshold")
    return table.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def min_cost(table: DataFrame, missed: float, false_alarm: float) -> DataFrame:
    if false_alarm == 0:
        raise ValueError("a false alarm must cost something")
    best = first_by(with_cost(table, missed, false_alarm), [], F.col("cost"))
    return best.withColumn("ratio", F.lit(f"{missed / false_alarm:.0f} : 1"))


def cost_ratios(table: DataFrame, false_alarm: float = 1.0, ratios: list[int] = COST_RATIOS) -> DataFrame:
    grid = table.withColumn("cost_ratio", F.explode(F.array(*map(F.lit, ratios))))
    return first_by(with_cost(grid, F.col("cost_ratio") * false_alarm, false_alarm), ["cost_ratio"], F.col("cost"))


def reference_thresholds(table: DataFrame, default: float = 0.5) -> DataFrame:
    t = table.withColumn("ks", F.col("recall") - F.col("false_alarm_rate"))
    pick = lambda name, order: first_by(t, [], order).withColumn("criterion", F.lit(name))
    return pick("max f1", F.desc("f1")).unionByName(pick("max ks", F.desc("ks"))).unionByName(pick("nearest default", F.abs(F.col("threshold") - default)))


def nearest(table: DataFrame, wanted: list[float]) -> DataFrame:
    """The row nearest to each wanted threshold."""
    grid = table.withColumn("wanted", F.explode(F.array(*map(F.lit, wanted))))
    return first_by(grid, ["wanted"], F.abs(F.col("threshold") - F.col("wanted")))


def capacity(table: DataFrame, caps: list[float]) -> DataFrame:
    """Per cap on the alert rate the lowest threshold that keeps it; caps that none keeps stay, as infeasible."""
    spark = table.sparkSession
    all_caps = spark.createDataFrame([(c,) for c in caps], "cap double")
    kept = table.withColumn("cap", F.explode(F.array(*map(F.lit, caps)))).where("alert_rate <= cap")
    best = all_caps.join(first_by(kept, ["cap"]), "cap", "left")
    reason = F.when(F.col("threshold").isNull(), F.format_string("no threshold keeps the alert rate at %.1f %%", F.col("cap") * 100))
    return best.withColumn("feasible", F.col("threshold").isNotNull()).withColumn("reason", reason)


def money_scenarios(table: DataFrame, losses: list[float], false_alarm: float = 50_000.0, default: float = 0.5) -> DataFrame:
    """Per loss of a missed case the cheapest threshold, and what it saves against the default threshold."""
    grid = with_cost(table.withColumn("loss", F.explode(F.array(*(F.lit(float(x)) for x in losses)))), F.col("loss"), false_alarm)
    usual = first_by(grid, ["loss"], F.abs(F.col("threshold") - default)).select("loss", F.col("cost").alias("default_cost"))
    return first_by(grid, ["loss"], F.col("cost")).join(usual, "loss").withColumn("saving", F.col("default_cost") - F.col("cost"))
