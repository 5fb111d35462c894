"""Exact ranking metrics. Scores are counted per distinct value; running totals go slice by slice, never over one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ordering import running_totals
from riskloom.functions.scalars import ratio, steps

CALIBRATION_EDGES = [0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0]


def score_groups(scores: DataFrame, p: str = "p", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """Per distinct score: pos, neg, pos_before, neg_before (strictly lower scores) and the group's totals. Equal scores are counted first; slices of the rest follow
    the scores, however these crowd."""
    counts = scores.groupBy(*by, F.col(p).alias("p")).agg(F.sum(F.col(y)).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg"))
    return running_totals(counts, "p", ["pos", "neg"], list(by))


def _auc() -> Column:
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    return F.try_divide(wins, F.max("pos_total").cast("double") * F.max("neg_total")).alias("auc")


def _ks() -> Column:
    caught = F.try_divide((F.col("pos_total") - F.col("pos_before")).cast("double"), F.col("pos_total"))
    false = F.try_divide((F.col("neg_total") - F.col("neg_before")).cast("double"), F.col("neg_total"))
    return F.greatest(F.max(caught - false), F.lit(0.0)).alias("ks")


def auc(scores: DataFrame, p: str = "p", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """Share of positive-negative pairs in the right order, ties half; null with one class only."""
    return score_groups(scores, p, y, by).groupBy(*by).agg(_auc())


def ks(scores: DataFrame, p: str = "p", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """Largest signed difference of true and false alarm rate over all cuts; the cut above all scores gives 0."""
    return score_groups(scores, p, y, by).groupBy(*by).agg(_ks())


def with_rates(t: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 to tp, fp, fn."""
    t = t.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(scores: DataFrame, threshold: float = 0.5, p: str = "p", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    return with_rates(scores.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn")))


def evaluate(scores: DataFrame, threshold: float = 0.5, p: str = "p", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """auc, ks, f1, precision, recall; one row, or one per group. All of them from the counts of distinct scores."""
    g = score_groups(scores, p, y, by)
    hit = F.col("p") >= threshold
    counted = {"tp": F.sum(F.when(hit, F.col("pos")).otherwise(0)), "fp": F.sum(F.when(hit, F.col("neg")).otherwise(0)), "fn": F.sum(F.when(hit, 0).otherwise(F.col("pos")))}
    t = g.groupBy(*by).agg(_auc(), _ks(), *(c.alias(n) for n, c in counted.items()))
    return with_rates(t).select(*by, "auc", "ks", "f1", "precision", "recall")


def calibration(scores: DataFrame, p: str = "p", y: str = "y", edges: list[float] = CALIBRATION_EDGES) -> DataFrame:
    """Right-closed bins, the first with its left edge."""
    number = steps(F.col(p), edges[1:-1], inclusive=False)
    return scores.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("observed"), F.avg(p).alias("mean_p")).orderBy("bin")


def fold_summary(folds: DataFrame, metrics: tuple[str, ...] = ("auc", "ks", "f1", "precision", "recall"), by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean, sample deviation and text per model and metric."""
    long = folds.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("r")).select(*by, "r.*")
    t = long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("deviation"))
    return t.withColumn("text", F.format_string("%.4f ± %.4f", F.col("mean"), F.coalesce("deviation", F.lit(0.0))))


def track_difference(left: DataFrame, right: DataFrame, digits: int = 4) -> DataFrame:
    """Two fold summaries, side by side."""
    a, b = left.select("model", "metric", F.col("mean").alias("left")), right.select("model", "metric", F.col("mean").alias("right"))
    return a.join(b, ["model", "metric"]).withColumn("difference", F.bround(F.col("left") - F.col("right"), digits))
