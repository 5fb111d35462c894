"""Additive explanations: linear ones as plain columns, those of tree models as an Arrow-batched walk over broadcast trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, product
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.ordering import running_totals
from riskloom.functions.scalars import direction, logit, sigmoid
from riskloom.operators import grown


def linear_margin(coefficients: dict[str, float], intercept: float) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(b) * F.col(f) for f, b in coefficients.items()), F.lit(intercept))


def linear_shap(df: DataFrame, row_id: str, coefficients: dict[str, float]) -> DataFrame:
    """row_id, feature, value, phi: coefficient x (value - mean). Means are one row, joined to all."""
    means = df.agg(*(F.avg(f).alias(f"_m_{f}") for f in coefficients))
    each = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), (F.lit(b) * (F.col(f) - F.col(f"_m_{f}"))).alias("phi")) for f, b in coefficients.items()]
    return df.crossJoin(F.broadcast(means)).select(row_id, F.explode(F.array(*each)).alias("r")).select(row_id, "r.*")  # a single row


def linear_base(df: DataFrame, coefficients: dict[str, float], intercept: float) -> DataFrame:
    return df.agg(F.avg(linear_margin(coefficients, intercept)).alias("base"))


def additivity(phi: DataFrame, base: DataFrame, scores: DataFrame, row_id: str, p: str = "p", tolerance: float = 1e-6) -> DataFrame:
    """Largest and mean |base + sum of phi - logit of p|, and whether all is within tolerance."""
    total = phi.groupBy(row_id).agg(F.sum("phi").alias("total"))
    gap = F.abs(F.col("base") + F.col("total") - logit(F.col(p)))
    t = total.join(scores.select(row_id, p), row_id).crossJoin(F.broadcast(base))
    return t.agg(F.max(gap).alias("max_error"), F.avg(gap).alias("mean_error")).withColumn("passed", F.col("max_error") < tolerance)


def global_importance(phi: DataFrame, top: int | None = None) -> DataFrame:
    t = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean"))
    ranked = t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")))  # a row per feature
    return ranked.where(F.col("rank") <= top) if top else ranked


def local_explanation(phi: DataFrame, row_id: str, wanted: int, top: int = 10) -> DataFrame:
    mine = phi.where(F.col(row_id) == wanted).withColumn("direction", direction(F.col("phi")))
    return mine.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("phi")), "feature"))).where(F.col("place") <= top)


def local_summary(phi: DataFrame, base: DataFrame, row_id: str, wanted: int) -> DataFrame:
    t = phi.where(F.col(row_id) == wanted).agg(F.sum("phi").alias("total")).crossJoin(base)
    return t.select("base", "total", (F.col("base") + F.col("total")).alias("margin"), sigmoid(F.col("base") + F.col("total")).alias("p"))


def with_value_rank(phi: DataFrame) -> DataFrame:
    """Adds value_rank, the share of a feature's other rows with a lower value: what colours the points of a swarm. Equal values are counted first."""
    counts = phi.groupBy("feature", "value").agg(F.count("*").alias("_n"))
    placed = running_totals(counts.where(F.col("value").isNotNull()), "value", ["_n"], ["feature"])
    rank = placed.select("feature", "value", F.when(F.col("_n_total") > 1, F.col("_n_before") / (F.col("_n_total") - 1)).otherwise(0.0).alias("value_rank"))
    # a value may hold any share of the rows: joined by a struct, both sides get exchanges that Spark can split
    rank = rank.select(F.struct("feature", "value").alias("_at"), "value_rank")
    return phi.withColumn("_at", F.struct("feature", "value")).join(rank, "_at", "left").drop("_at")


def representative_rows(scores: DataFrame, row_id: str, p: str = "p", y: str = "y") -> DataFrame:
    """Per class the row of that class scored most surely right; ties to the lowest identifier."""
    order = F.struct(F.when(F.col(y) == 1, -F.col(p)).otherwise(F.col(p)), F.col(row_id))
    return scores.groupBy(F.col(y).alias("label")).agg(F.min_by(F.struct(row_id, F.col(p).alias("p")), order).alias("r")).select("label", "r.*")


def conditional_importance(phi: DataFrame, marked: DataFrame, row_id: str, top: int = 8) -> DataFrame:
    """Mean phi over marked rows against all rows, largest marked mean first."""
    t = phi.join(marked.select(row_id).distinct().withColumn("marked", F.lit(True)), row_id, "left")
    t = t.groupBy("feature").agg(F.avg(F.when(F.col("marked"), F.col("phi"))).alias("mean_marked"), F.avg("phi").alias("mean_all"))
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("mean_marked")), "feature"))).where(F.col("place") <= top)


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray


def trees_of(spark: SparkSession, model: GBTClassificationModel | RandomForestClassificationModel, path: str) -> list[Tree]:
    """A tree model's trees, read from the model saved at `path`. Bounded by the model's size. A boosted tree's leaves hold its part of the margin, a forest's its part of
    the probability of class 1: the class share of the rows that reached them, over the number of trees."""
    model.write().overwrite().save(path)
    forest = isinstance(model, RandomForestClassificationModel)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    trees: dict[int, list] = {}
    for r in nodes:
        trees.setdefault(r.treeID, []).append(r)

    def value(r, weight: float) -> float:
        return r.impurityStats[1] / sum(r.impurityStats) / len(trees) if forest else weight * r.prediction

    def cover(r) -> float:
        return float(sum(r.impurityStats)) if forest else float(r.rawCount)

    out = []
    for k in sorted(trees):
        weight = 1.0 if forest else model.treeWeights[k]
        inner = [r.leftChild >= 0 for r in trees[k]]
        rows = [(r.split.featureIndex if i else -1, r.split.leftCategoriesOrThreshold[0] if i else 0.0, r.leftChild, r.rightChild, value(r, weight), cover(r)) for r, i in zip(trees[k], inner)]
        out.append(Tree(*(np.array(x) for x in zip(*rows))))
    return out


def tree_values(tree: Tree, x: np.ndarray, n_features: int) -> np.ndarray:
    """Shapley values of one tree for many rows (n x features).

    For a leaf, the features on its path play the game "is the path followed", whose worth is a product of one factor per feature: 1 or 0 if it is known, its share
    of the cover if not. A feature's value is (known - unknown) times the integral over t from 0 to 1 of the product of the others' t known + (1 - t) unknown,
    a polynomial in t, which Gauss and Legendre's rule sums exactly at half as many fixed nodes as features. The products at these nodes are carried down the
    tree, so a leaf costs one term per feature of its path, however deep it is.
    """
    out = np.zeros((len(x), n_features))
    used = len(set(tree.feature[tree.feature >= 0].tolist()))
    if not used:
        return out
    at, weight = np.polynomial.legendre.leggauss(-(-used // 2))
    at, weight = (at[:, None] + 1) / 2, weight / 2
    stack = [(0, {}, np.ones((len(at), len(x))))]
    while stack:
        node, path, product = stack.pop()
        f = int(tree.feature[node])
        if f < 0:
            for g, (known, unknown, factor) in path.items():
                out[:, g] += (weight @ (product / factor)) * (known - unknown) * tree.value[node]
            continue
        goes_left = x[:, f] <= tree.threshold[node]
        known, unknown, before = path.get(f, (np.ones(len(x)), 1.0, 1.0))
        for child, follows in ((tree.left[node], goes_left), (tree.right[node], ~goes_left)):
            on, off = known * follows, unknown * tree.cover[child] / tree.cover[node]
            factor = at * on + (1 - at) * off  # above 0, as t is below 1 and covers are above 0
            stack.append((child, path | {f: (on, off, factor)}, product / before * factor))
    return out


def cell_values(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Shapley values of all trees, summed. Rows that no tree tells apart lie in one cell between thresholds and are explained once."""
    n_features = x.shape[1]
    asked = [np.unique(np.concatenate([t.threshold[t.feature == f] for t in trees])) for f in range(n_features)]
    cells = np.stack([np.searchsorted(a, x[:, f], side="left") for f, a in enumerate(asked)], axis=1)
    _, first, of_row = np.unique(cells, axis=0, return_index=True, return_inverse=True)
    met = x[first]
    return sum((tree_values(t, met, n_features) for t in trees), np.zeros((len(met), n_features)))[of_row.ravel()]


def tree_base(trees: list[Tree]) -> float:
    """The expected margin (or, of a forest, probability) over the training rows' covers."""
    total = 0.0
    for t in trees:
        leaves = t.feature < 0
        total += float((t.value[leaves] * t.cover[leaves]).sum() / t.cover[0])
    return total


def tree_shap(df: DataFrame, row_id: str, features: list[str], trees: list[Tree], scale: float = 2.0) -> DataFrame:
    """row_id, feature, value, phi on the logit scale (MLlib's boosted margin is half a logit); with scale 1, on the scale of the trees' own values, for forests."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def work(batches):
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(f).to_pylist(), float) for f in features]) if batch.num_rows else np.zeros((0, len(features)))
            phi = scale * cell_values(shared.value, x)
            ids = batch.column(row_id).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(features)), pa.int64()), pa.array(features * len(ids), pa.string()), pa.array(x.ravel()), pa.array(phi.ravel())], names=[row_id, "feature", "value", "phi"])

    rows = df.select(F.col(row_id).cast("long").alias(row_id), *(F.col(f"`{f}`").cast("double").alias(f) for f in features))
    return rows.repartition(df.sparkSession.sparkContext.defaultParallelism).mapInArrow(work, f"`{row_id}` long, feature string, value double, phi double")


# ---- forests over few cells

#: Cells between all cuts of all features, at most; a table holds a number for each.
CELLS = 1 << 22
#: Leaves whose boxes are added to the tables at once.
LEAVES = 200_000


def leaf_boxes(tree: Tree, sizes: list[int]) -> tuple[np.ndarray, ...]:
    """Of a tree whose thresholds are bin numbers: each leaf's value, first and last bin by feature, and the product of cover shares along its path by feature."""
    m, n = len(sizes), len(tree.feature)
    low, high, share = np.zeros((n, m), np.int64), np.tile(np.array(sizes, np.int64) - 1, (n, 1)), np.ones((n, m))
    at = np.zeros(1, np.int64)
    while len(at := at[tree.feature[at] >= 0]):
        f, cut = tree.feature[at], tree.threshold[at].astype(np.int64)
        for child in (tree.left[at], tree.right[at]):
            low[child], high[child], share[child] = low[at], high[at], share[at]
            share[child, f] *= tree.cover[child] / tree.cover[at]
        high[tree.left[at], f] = cut  # cuts lie inside of the parent's box
        low[tree.right[at], f] = cut + 1
        at = np.concatenate([tree.left[at], tree.right[at]])
    leaf = tree.feature < 0
    return tree.value[leaf], low[leaf], high[leaf], share[leaf]


def known_sets(m: int) -> list[tuple[int, ...]]:
    return [s for k in range(m + 1) for s in combinations(range(m), k)]


def add_boxes(tables: list[np.ndarray], boxes: list[tuple[np.ndarray, ...]]) -> None:
    """Adds leaves to a table of differences for each set of known features: at the corners of a leaf's box in these features stands its value times the cover shares of the
    others, with changing signs, so that running sums along all axes give what the trees expect of a row of which just these features are known."""
    value, low, high, share = (np.concatenate(x) for x in zip(*boxes))
    m = low.shape[1]
    for table, known in zip(tables, known_sets(m)):
        worth = value * np.prod(share[:, [f for f in range(m) if f not in known]], axis=1)
        for ends in product((0, 1), repeat=len(known)):
            corner = np.zeros(len(value), np.int64)
            for f, end, size in zip(known, ends, table.shape):
                corner = corner * size + (high[:, f] + 1 if end else low[:, f])
            table += np.bincount(corner, -worth if sum(ends) % 2 else worth, table.size).reshape(table.shape)


def expectations(tables: list[np.ndarray]) -> list[np.ndarray]:
    """The running sums of these tables."""
    for k, table in enumerate(tables):
        for axis in range(table.ndim):
            table = np.cumsum(table, axis=axis)
        tables[k] = table[tuple(slice(0, -1) for _ in range(table.ndim))].ravel()
    return tables


def shapley_of_bins(expected: list[np.ndarray], sizes: list[int], bins: np.ndarray) -> np.ndarray:
    """Shapley values of rows given by their bins: what each set of known features makes the trees expect, weighted as the definition says."""
    m = len(sizes)
    out = np.zeros((len(bins), m))
    weight = [factorial(a) * factorial(m - a - 1) / factorial(m) for a in range(m)]
    for table, known in zip(expected, known_sets(m)):
        at = np.zeros(len(bins), np.int64)
        for f in known:
            at = at * sizes[f] + bins[:, f]
        worth = table[at]
        for g in range(m):
            out[:, g] += worth * weight[len(known) - 1] if g in known else -worth * weight[len(known)]
    return out


def tree_means(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The value of each row's leaf."""
    node, at = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(at := at[tree.feature[node[at]] >= 0]):
        here = node[at]
        node[at] = np.where(x[at, tree.feature[here]] <= tree.threshold[here], tree.left[here], tree.right[here])
    return tree.value[node]


def forest_rows(df: DataFrame, row_id: str, features: list[str], label: str, trees: int = 300, depth: int = 30, seed: int = 42) -> DataFrame:
    """row_id, feature, value, phi, p, gap of every row: a random forest (Gini, at least two rows a leaf, the root of the number of features asked a node, rows drawn with
    replacement) and its attributions on the scale of probabilities; gap is how far base and sum lie from p, the mean of the row's leaves.

    Bins are at most 32 a feature, so rows meet in cells, and rows of a cell and label differ in nothing that a tree could ask: they are counted once, and how often they are
    drawn is one Poisson number. A tree is grown from these counts by one task, and its leaves' boxes are added up in tables over the bins. Neither trees nor rows pass through
    the driver; it gets the counts and the tables, whose size the rows play no part in. Attributions are then looked up in one pass over the rows.
    """
    spark, m = df.sparkSession, len(features)
    context = spark.sparkContext
    cuts = grown.split_points(df.withColumn("fold", F.lit(1)), features, 2)[0]  # no row is of fold 0
    sizes = [len(c) + 1 for c in cuts]
    if np.prod([s + 1.0 for s in sizes]) > CELLS:
        raise ValueError(f"{features} have too many cells for tables; use tree_shap")
    bins, n, pos = grown.counted_cells(df, features, label, cuts)
    cells = context.broadcast((bins, n, pos))

    def explained(numbers: Iterator[int]) -> Iterator[list[np.ndarray]]:
        bins, n, pos = cells.value
        both, y = np.concatenate([bins, bins]), np.repeat([0, 1], len(bins))
        tables, p, held, size = [np.zeros([sizes[f] + 1 for f in known]) for known in known_sets(m)], np.zeros(len(bins)), [], 0
        for t in numbers:
            w = np.random.default_rng([seed, t]).poisson(np.concatenate([n - pos, pos]))
            met = np.flatnonzero(w)
            feature, cut, left, right, share, cover = grown.whole_tree(both[met], y[met], w[met], t, seed, depth)
            tree = Tree(feature, cut, left, right, share / trees, cover)
            p += tree_means(tree, bins)
            held.append(leaf_boxes(tree, sizes))
            size += len(held[-1][0])
            if size >= LEAVES:
                add_boxes(tables, held)
                held, size = [], 0
        if held:
            add_boxes(tables, held)
        yield [*tables, p]

    tasks = max(1, min(trees, context.defaultParallelism))
    *tables, p = context.parallelize(range(trees), tasks).mapPartitions(explained).treeReduce(lambda a, b: [x + y for x, y in zip(a, b)])
    order = np.ravel_multi_index(tuple(bins.T.astype(np.int64)), sizes) if len(bins) else np.zeros(0, np.int64)
    shared = context.broadcast((cuts, expectations(tables), order, p))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, expected, order, p = shared.value
        for batch in batches:
            cell = grown.cells_of(batch, cuts)
            met, of_row = np.unique(cell, return_inverse=True)
            own = shapley_of_bins(expected, sizes, np.stack(np.unravel_index(met, sizes), axis=1))
            score = p[np.searchsorted(order, met)]
            gap = np.abs(float(expected[0][0]) + own.sum(axis=1) - score)
            ids = batch.column(row_id).take(pa.array(np.repeat(np.arange(batch.num_rows), m)))
            x = np.stack([np.asarray(batch.column(f"_x{j}").to_numpy(zero_copy_only=False), float) for j in range(m)], axis=1)
            columns = [ids, pa.array(features * batch.num_rows, pa.string()), pa.array(x.ravel()), pa.array(own[of_row].ravel()), pa.array(np.repeat(score[of_row], m)), pa.array(np.repeat(gap[of_row], m))]
            yield pa.RecordBatch.from_arrays(columns, names=[row_id, "feature", "value", "phi", "p", "gap"])

    return grown.binned_input(df, features, [F.col(f"`{row_id}`").cast("long").alias(row_id)]).mapInArrow(work, f"`{row_id}` long, feature string, value double, phi double, p double, gap double")
