"""Scores of ensembles: flat arrays in Arrow batches; of a single tree: a SQL expression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.plans.tree import Tree


def flat(tree: Tree) -> tuple[np.ndarray, ...]:
    """(feature, threshold, left, right, value); a leaf is its own child."""
    ids = range(len(tree.nodes))
    pick = lambda f, t: np.array([f(n, i) for n, i in zip(tree.nodes, ids, strict=True)], t)
    return (
        pick(lambda n, i: max(n.feature, 0), np.int32), pick(lambda n, i: n.threshold, float), pick(lambda n, i: i if n.is_leaf else n.left, np.int32),
        pick(lambda n, i: i if n.is_leaf else n.right, np.int32), pick(lambda n, i: n.value, float),
    )


def routed(x: np.ndarray, tree: tuple[np.ndarray, ...], depth: int) -> np.ndarray:
    """Leaf values of the rows of x; NaN goes left."""
    feature, threshold, left, right, value = tree
    at, rows = np.zeros(len(x), np.int32), np.arange(len(x))
    for _ in range(depth):
        v = x[rows, feature[at]]
        at = np.where(np.isnan(v) | (v <= threshold[at]), left[at], right[at])
    return value[at]


def raw_scores(df: DataFrame, trees: list[list[Tree]], init: list[float], rates: list[float]) -> DataFrame:
    """df (with column x) plus raw array<double>: init + sum of rate x leaf value, a place per class. Works on streams too."""
    model = [[(flat(t), t.max_depth) for t in row] for row in trees]
    schema = T.StructType([*df.schema.fields, T.StructField("raw", T.ArrayType(T.DoubleType()))])
    at = df.schema.fieldNames().index("x")

    def run(batches):
        for b in batches:
            n = b.num_rows
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
            out = np.tile(np.array(init, float), (n, 1))
            for rate, row in zip(rates, model, strict=True):
                for k, (tree, depth) in enumerate(row):
                    out[:, k] += rate * routed(x, tree, depth)
            raw = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(init)).astype(np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, raw], schema.fieldNames())

    return df.mapInArrow(run, schema)


def advanced(df: DataFrame, rounds: list[tuple[list[Tree], float]]) -> DataFrame:
    """df (with columns x and pred) with the trees of some rounds, each with its rate, added to pred, a place per class."""
    if not rounds:
        return df
    model = [([(flat(t), t.max_depth) for t in trees], rate) for trees, rate in rounds]
    at, to = (df.schema.fieldNames().index(c) for c in ("x", "pred"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, out = (b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for k in (at, to))
                for trees, rate in model:
                    out = out + rate * np.stack([routed(x, tree, depth) for tree, depth in trees], 1)
                pred = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]).astype(np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:to], pred, *b.columns[to + 1 :]], b.schema.names)

    return df.mapInArrow(run, df.schema)
