"""Checks of fitted models against their own definition.

* ``logreg_certificate``: the penalised log loss is convex, so a fit is right if
  its gradient vanishes.  Gradient and curvature are sums over the encoded rows,
  partial per task, then added up (one number per pair of features); the
  Newton step from them bounds how far the coefficients are from the optimum.
* ``node_table``: a saved forest as rows (tree, node, test, children, counts).
* ``route``: every task takes its rows down all trees, level by level, by lookups in
  the node table; the leaves' class shares average to the score.
* ``importance_from_nodes``: impurity gains times rows, by feature, per tree, summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiprisk.ml.features import ID, feature_names, with_known_levels
from shiprisk.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from shiprisk.session import work_dir


def loss_sums(encoded: DataFrame, weights: np.ndarray, intercept: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, gradient and curvature of the summed log loss (the intercept last)."""
    p = len(weights) + 1
    w = np.append(weights, intercept)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, g, h = 0, np.zeros(p), np.zeros((p, p))
        for batch in filter(len, batches):
            x = np.column_stack([np.stack(batch["x"].to_numpy()), np.ones(len(batch))])
            share = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
            n += len(x)
            g += x.T @ (share - batch["label"].to_numpy(float))
            h += (x * (share * (1 - share))[:, None]).T @ x
        if n:
            values = np.concatenate([[n], g, h[np.triu_indices(p)]])
            yield pd.DataFrame({"at": np.arange(len(values)), "value": values})

    rows = encoded.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    parts = rows.mapInPandas(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    values = np.zeros(1 + p + p * (p + 1) // 2)
    for r in parts.collect():  # a number a pair of features
        values[r["at"]] = r["value"]
    h = np.zeros((p, p))
    h[np.triu_indices(p)] = values[1 + p:]
    return int(values[0]), values[1:1 + p], h + np.triu(h, 1).T


def logreg_certificate(encoded: DataFrame, weights: np.ndarray, intercept: float, penalty: float
                       ) -> tuple[int, float, float]:
    """Rows, largest entry of the mean penalised gradient, largest entry of the Newton step."""
    n, g, h = loss_sums(encoded, weights, intercept)
    free = np.append(np.full(len(weights), penalty), 0.0)  # the intercept isn't penalised
    gradient = g / max(n, 1) + free * np.append(weights, intercept)
    curvature = h / max(n, 1) + np.diag(free)
    step = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
    return n, float(np.abs(gradient).max()), float(np.abs(step).max())


def node_table(model: PipelineModel, encoder: PipelineModel, spark: SparkSession) -> DataFrame:
    """tree, node, slot, column, level, threshold, values, left, right, gain, n_rows, late_share of the saved forest.

    A test on a number goes left up to ``threshold``, one on a one-hot slot (given
    by its column and level) if the slot is one of ``values``; leaves have no column.
    """
    path = work_dir(spark, "forest")
    model.stages[-1].save(path)
    kind = "slot int, column string, level string"
    slots = spark.createDataFrame([(i, c, level) for i, (c, level) in enumerate(_slots(encoder))], kind)  # a row a feature
    total = F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda a, x: a + x)
    leaf, listed = F.col("nodeData.leftChild") < 0, F.col("nodeData.split.numCategories") >= 0
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"),
        F.when(~leaf, F.col("nodeData.split.featureIndex")).alias("slot"),
        F.when(~leaf & ~listed, F.element_at("nodeData.split.leftCategoriesOrThreshold", 1)).alias("threshold"),
        F.when(~leaf & listed, F.col("nodeData.split.leftCategoriesOrThreshold")).alias("values"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.gain").alias("gain"), total.alias("n_rows"),
        (F.element_at("nodeData.impurityStats", 2) / total).alias("late_share"))
    return nodes.join(F.broadcast(slots), "slot", "left")


def _slots(encoder: PipelineModel) -> list[tuple[str, str | None]]:
    """Column, and level for one-hot slots, of each entry of the feature vector."""
    out: list[tuple[str, str | None]] = [(c, None) for c in NUMERIC_FEATURES]
    for name in feature_names(encoder)[len(NUMERIC_FEATURES):]:
        column = next(c for c in sorted(CATEGORICAL_FEATURES, key=len, reverse=True) if name.startswith(f"{c}_"))
        out.append((column, name[len(column) + 1:]))
    return out


class Forest:
    """The node table as arrays, in the order (tree, node), and the feature slots that its tests name.

    It holds what the fitted model holds on the driver, so its size goes with the
    trees, not with the rows.  A leaf's children are the leaf itself.
    """

    def __init__(self, nodes: DataFrame):
        names = ["tree", "node", "column", "level", "threshold", "values", "left", "right", "late_share"]
        table = nodes.select(*names).toArrow().combine_chunks()
        number = lambda c: table[c].fill_null(-1).to_numpy().astype(np.int64)
        key = (number("tree") << 32) + number("node")
        order = np.argsort(key)
        key, table = key[order], table.take(order)
        tests = list(zip(table["column"].to_pylist(), table["level"].to_pylist()))
        inner = np.array([c is not None for c, _ in tests], bool)

        def child(side: str) -> np.ndarray:
            wanted = np.where(inner, (number("tree") << 32) + number(side), key)
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            if (key[at] != wanted).any():
                raise ValueError(f"the node table lacks a {side} child")
            return at.astype(np.int32)

        self.left, self.right = child("left"), child("right")
        self.roots = np.searchsorted(key, np.unique(number("tree")) << 32).astype(np.int32)
        self.slots = sorted({t for t in tests if t[0] is not None}, key=lambda t: (t[0], t[1] or ""))
        at_slot = {t: i for i, t in enumerate(self.slots)}
        self.slot = np.array([at_slot.get(t, 0) for t in tests], np.int32)
        self.threshold = table["threshold"].fill_null(np.nan).to_numpy()
        listed = [(i, int(v)) for i, values in enumerate(table["values"].to_pylist()) for v in values or []]
        self.listed = np.array([v is not None for v in table["values"].to_pylist()], bool)
        self.member = np.zeros((len(key), 1 + max((v for _, v in listed), default=0)), bool)  # classes that go left
        for i, v in listed:
            self.member[i, v] = True
        self.share = table["late_share"].to_numpy()

    def values(self, rows: pd.DataFrame) -> np.ndarray:
        """Each slot's value in every row; NaN where the column is null."""
        out = np.empty((max(len(self.slots), 1), len(rows)))
        for i, (column, level) in enumerate(self.slots):
            if level is None:
                out[i] = rows[column].to_numpy(float, na_value=np.nan)
            else:
                out[i] = np.where(rows[column].isna(), np.nan, rows[column] == level)
        return out

    def scores(self, rows: pd.DataFrame, depth: int) -> np.ndarray:
        x, every, total = self.values(rows), np.arange(len(rows)), np.zeros(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root, np.int32)
            for _ in range(depth):
                value = x[self.slot[at], every]
                left = value <= self.threshold[at]
                listed = np.flatnonzero(self.listed[at] & (value >= 0) & (value < self.member.shape[1]))
                left[listed] = self.member[at[listed], value[listed].astype(int)]
                at = np.where(left, self.left[at], self.right[at])
            total += self.share[at]
        return total / len(self.roots)


def route(rows: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """ID and score of raw feature rows; no row is copied per tree or shuffled on its way down."""
    inputs = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
    forest = rows.sparkSession.sparkContext.broadcast(Forest(nodes))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({ID: batch[ID], "score": forest.value.scores(batch, depth)})

    kind = rows.schema[ID].dataType.simpleString()
    return rows.select(ID, *inputs).mapInPandas(walk, f"{ID} {kind}, score double").groupBy(ID).agg(
        F.sum("score").alias("score"))


def rescored(model: PipelineModel, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Scores of raw rows through the node table; levels unknown to the encoder count as the base level."""
    return route(with_known_levels(rows, model), nodes, model.stages[-1].getOrDefault("maxDepth"))


def importance_from_nodes(nodes: DataFrame) -> DataFrame:
    """slot, importance: gain times rows of a tree's tests by slot, as shares of the tree, summed and normalised."""
    inner = nodes.where("column is not null").groupBy("tree", "slot").agg(
        F.sum(F.col("gain") * F.col("n_rows")).alias("gained"))
    per_tree = inner.groupBy("tree").agg(F.sum("gained").alias("of_tree")).where("of_tree > 0")
    by_slot = inner.join(per_tree, "tree").groupBy("slot").agg(F.sum(F.col("gained") / F.col("of_tree")).alias("part"))
    everything = by_slot.agg(F.sum("part").alias("whole"), F.lit(1).alias("one"))
    return by_slot.withColumn("one", F.lit(1)).join(F.broadcast(everything), "one").select(  # one row
        "slot", (F.col("part") / F.col("whole")).alias("importance"))
