"""Gradient boosting with pinball and Huber loss on Spark ML's regression trees.

Each round fits one tree to the loss gradient, then sets its leaves anew: exact
order statistics of the residuals of each leaf, found by counting (no sort, no
collected rows). Fitted trees are flat arrays of bounded size, which Arrow
batches are scored with anywhere.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.scale import order_statistics
from stockweave.session import cut_lineage

SPLIT = re.compile(r"(If|Else) \(feature (\d+) (?:<=|>) (\S+)\)|Predict: (\S+)|Tree \d+ \(weight (\S+)\)")


@dataclass
class Trees:
    """Trees as arrays; a leaf is its own child. The prediction is ``start`` plus one leaf value of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float = 0.0

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf node of each row in each tree."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while True:
            down = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            if (down == at).all():
                return at
            at = down

    def predict(self, x: np.ndarray, rows: int = 8192) -> np.ndarray:
        parts = [self.value[self.leaves(x[i : i + rows])].sum(axis=1) for i in range(0, len(x), rows)]
        return self.start + np.concatenate(parts or [np.zeros(0)])

    def column(self, features: str = "features") -> Column:
        """The prediction for a vector column, in Arrow batches."""
        trees = self

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(trees.predict(np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))))

        return score(vector_to_array(features))


def flatten(model) -> Trees:
    """Trees of a fitted Spark ML tree model, from its printed form, with the weights of an ensemble."""
    nodes, roots, weight = [], [], 1.0
    open_splits: list[tuple[int, int]] = []  # node and its children seen so far

    def attach(no: int) -> None:
        if not open_splits:
            roots.append(no)
            return
        parent, seen = open_splits.pop()
        nodes[parent][2 + seen] = no
        if not seen:
            open_splits.append((parent, 1))

    for m in SPLIT.finditer(model.toDebugString):
        word, feature, threshold, leaf, tree_weight = m.groups()
        if tree_weight is not None:
            weight = float(tree_weight)
        elif word == "If":
            no = len(nodes)
            nodes.append([int(feature), float(threshold), 0, 0, 0.0])
            attach(no)
            open_splits.append((no, 0))
        elif leaf is not None:
            no = len(nodes)
            nodes.append([0, 0.0, no, no, weight * float(leaf)])
            attach(no)
    columns = list(zip(*nodes))
    kinds = (np.int32, np.float64, np.int32, np.int32, np.float64)
    return Trees(*[np.array(c, k) for c, k in zip(columns, kinds)], np.array(roots, np.int32))


def joined(trees: list[Trees], start: float) -> Trees:
    """One model of several."""
    at = np.cumsum([0, *[len(t.value) for t in trees]])
    if not trees:
        return Trees(*[np.zeros(1, k) for k in (np.int32, float, np.int32, np.int32, float)], np.zeros(1, np.int32), start)
    cat = lambda name, shift=False: np.concatenate([getattr(t, name) + (a if shift else 0) for t, a in zip(trees, at)])
    return Trees(
        cat("feature"), cat("threshold"), cat("left", True), cat("right", True), cat("value"), cat("roots", True), start
    )


def quantile_rank(p: float):
    return lambda n: [max(1, math.ceil(p * n - 1e-9))]


class Pinball:
    """Loss of the ``q`` quantile: leaves hold that quantile of their residuals."""

    def __init__(self, q: float):
        self.q = q

    def start(self, rows: DataFrame) -> float:
        return _one(order_statistics(rows.select(F.lit(0).alias("key"), F.col("_y").alias("v")), quantile_rank(self.q)))

    def prepare(self, rows: DataFrame) -> None:
        """Nothing depends on the round."""

    def gradient(self, r: Column) -> Column:
        return F.lit(self.q) - (r < 0).cast("double")

    def loss(self, r: Column) -> Column:
        return F.greatest(r * self.q, r * (self.q - 1))

    def leaf_values(self, rows: DataFrame) -> dict[int, float]:
        got = order_statistics(rows.select("key", F.col("_r").alias("v")), quantile_rank(self.q))
        return {k: next(iter(v.values())) for k, v in got.items()}


class Huber:
    """Squared loss near zero, absolute beyond the ``alpha`` quantile of absolute residuals, taken anew each round."""

    def __init__(self, alpha: float = 0.9):
        self.alpha, self.delta = alpha, 0.0

    def start(self, rows: DataFrame) -> float:
        return _one(order_statistics(rows.select(F.lit(0).alias("key"), F.col("_y").alias("v")), quantile_rank(0.5)))

    def prepare(self, rows: DataFrame) -> None:
        size = rows.select(F.lit(0).alias("key"), F.abs("_r").alias("v"))
        self.delta = _one(order_statistics(size, quantile_rank(self.alpha)))

    def _clip(self, r: Column) -> Column:
        return F.greatest(F.least(r, F.lit(self.delta)), F.lit(-self.delta))

    def gradient(self, r: Column) -> Column:
        return self._clip(r)

    def loss(self, r: Column) -> Column:
        return F.abs(r)  # of one scale in all rounds, unlike the loss itself

    def leaf_values(self, rows: DataFrame) -> dict[int, float]:
        got = order_statistics(rows.select("key", F.col("_r").alias("v")), quantile_rank(0.5))
        middle = {k: next(iter(v.values())) for k, v in got.items()}
        m = leaf_column(middle, F.col("key"))
        steps = rows.groupBy("key").agg(F.avg(self._clip(F.col("_r") - m)).alias("s")).collect()
        return {r["key"]: middle[r["key"]] + r["s"] for r in steps}


def _one(got: dict) -> float:
    return next(iter(got[0].values())) if got else 0.0


def leaf_column(values: dict[int, float], leaf: Column) -> Column:
    """Value of a leaf by its number; leaves without rows have 0."""
    table = [float(values.get(k, 0.0)) for k in range(max(values, default=0) + 1)]
    return F.coalesce(F.get(F.lit(table), leaf.cast("int")), F.lit(0.0))


def boost(
    rows: DataFrame,
    loss,
    label: Column,
    *,
    rounds: int = 40,
    depth: int = 4,
    step: float = 0.1,
    min_rows: int = 10,
    patience: int = 8,
    look: int = 4,
    tune: str | None = "is_tune",
    seed: int = 7,
    cut_every: int = 10,
) -> Trees:
    """Trees fitted round by round on ``features`` of the rows that are not flagged ``tune``.

    Rows flagged ``tune`` stop the fit: their loss is taken every ``look``
    rounds, and after ``patience`` rounds without a lower one the best number of
    trees is kept. Without flagged rows all rounds
    run. Rows without a label are ignored; no rows give a constant 0.
    """
    flag = F.coalesce(F.col(tune), F.lit(False)) if tune else F.lit(False)
    state = rows.select("features", label.cast("double").alias("_y"), flag.alias("_tune")).filter("_y is not null")
    state = cut_lineage(state)
    start = loss.start(state.filter("not _tune"))
    state = state.withColumn("_r", F.col("_y") - start)
    learner = DecisionTreeRegressor(
        featuresCol="features", labelCol="_g", predictionCol="_p", leafCol="_leaf", maxDepth=depth,
        minInstancesPerNode=min_rows, seed=seed,
    )
    def tuning_loss(df):
        return df.filter("_tune").agg(F.avg(loss.loss(F.col("_r")))).first()[0]

    found: list[Trees] = []
    first = tuning_loss(state)
    best, best_loss = 0, first
    if state.filter("not _tune").isEmpty():
        return joined([], start)
    for i in range(1, rounds + 1):
        train = state.filter("not _tune")
        loss.prepare(train)
        model = learner.fit(train.withColumn("_g", loss.gradient(F.col("_r"))))
        placed = model.transform(state).drop("_p")
        values = loss.leaf_values(placed.filter("not _tune").withColumn("key", F.col("_leaf").cast("int")))
        values = {k: step * v for k, v in values.items()}
        tree = flatten(model)
        leaves = np.flatnonzero(tree.left == np.arange(len(tree.left)))  # in the order Spark numbers them
        tree.value[leaves] = [values.get(k, 0.0) for k in range(len(leaves))]
        found.append(tree)
        new = placed.withColumn("_r", F.col("_r") - leaf_column(values, F.col("_leaf"))).drop("_leaf")
        new = cut_lineage(new) if i % cut_every == 0 else new.persist()
        if first is not None and (i % look == 0 or i == rounds):
            now = tuning_loss(new)
            if now < best_loss:
                best, best_loss = i, now
        state.unpersist()
        state = new
        if first is not None and i - best >= patience:
            break
    state.unpersist()
    keep = len(found) if first is None else best
    return joined(found[:keep], start)
