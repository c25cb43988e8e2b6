"""Best splits of tree nodes, from histograms over bins or over distinct values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What a bin's and a denominator's hessian is raised by.
BIN_EPS, EPS = 1e-6, 1e-10
#: Histograms of a node's feature that one task adds up and searches, at least.
GROUPS = 256


@dataclass(frozen=True)
class Rules:
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    min_data: int = 1
    min_hessian: float = 1e-3


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    threshold: float
    left: tuple[float, float, int]  # gradient, hessian, rows
    right: tuple[float, float, int]


def soft(g, l1: float):
    """G shrunk towards 0 by l1."""
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(g: float, h: float, r: Rules) -> float:
    return float(-soft(g, r.lambda_l1) / (max(h, r.min_hessian) + r.lambda_l2 + EPS))


def node_score(g: float, h: float, r: Rules) -> float:
    return float(soft(g, r.lambda_l1) ** 2 / (max(h, r.min_hessian) + r.lambda_l2 + EPS))


def soft_column(g: Column, l1: float) -> Column:
    return F.when(g > l1, g - l1).when(g < -l1, g + l1).otherwise(F.lit(0.0))


def gain_column(gl: Column, hl: Column, g: Column, h: Column, r: Rules) -> Column:
    """Gain of a cut: score left + score right - score of the node, without a factor of one half."""
    def part(a, b):
        t = soft_column(a, r.lambda_l1)
        return t * t / (F.greatest(b, F.lit(r.min_hessian)) + r.lambda_l2)

    t = soft_column(g, r.lambda_l1)
    return part(gl, hl) + part(g - gl, h - hl) - t * t / (F.greatest(h, F.lit(r.min_hessian)) + r.lambda_l2 + EPS)


def histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, code, G, H, n of rows with columns keys, codes, g, h. Partial sums come before the shuffle, so what is
    shuffled is tasks x nodes x features x bins however many rows there are."""
    cells = df.select(*keys, "g", "h", F.posexplode("codes").alias("feature", "code"))
    return cells.groupBy(*keys, "feature", "code").agg(F.sum("g").alias("G"), F.sum("h").alias("H"), F.count("*").alias("n"))


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, r: Rules) -> tuple[float, int, float, float, int] | None:
    """The best cut of one node's feature: (gain, cut, G, H and rows on the left). g, h, n have a place for NaN, which goes left,
    and one for each bin; of equal gains the lowest cut."""
    hs = h.copy()
    hs[1:] += BIN_EPS
    gl, hl, nl, true_h = (np.cumsum(v)[1:-1] for v in (g, hs, n, h))
    gt, ht, nt = g.sum(), hs.sum(), n.sum()
    ok = (nl >= r.min_data) & (nt - nl >= r.min_data) & (hl >= r.min_hessian) & (ht - hl >= r.min_hessian)
    if not ok.any():
        return None
    score = soft(gl, r.lambda_l1) ** 2 / (np.maximum(hl, r.min_hessian) + r.lambda_l2) + soft(gt - gl, r.lambda_l1) ** 2 / (np.maximum(ht - hl, r.min_hessian) + r.lambda_l2)
    gain = np.where(ok, score - node_score(gt, h.sum(), r), -np.inf)
    k = int(gain.argmax())
    return float(gain[k]), k, float(gl[k]), float(true_h[k]), int(nl[k])


def routed_codes(codes: np.ndarray, route: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """The slot of each row, -1 for none. route: places (feature, cut, left, right, slot) from the root on, feature -1 at an end;
    codes up to the cut, NaN's -1 among them, go left."""
    feature, cut, left, right, slot = (np.array(v, np.int32) for v in zip(*route, strict=True))
    at, rows = np.zeros(len(codes), np.int32), np.arange(len(codes))
    while (open_ := feature[at] >= 0).any():
        i = rows[open_]
        here = at[i]
        at[i] = np.where(codes[i, feature[here]] <= cut[here], left[here], right[here])
    return slot[at]


def blocks(df: DataFrame, n_features: int, n_trees: int) -> DataFrame:
    """Rows of df (codes, g and h with an entry per tree, v a number) as blocks: n rows as byte strings of their codes, g and h, and
    the sum of v. A pass over blocks costs no conversion of rows."""
    most = max(1, (4 << 20) // (2 * n_features + 16 * n_trees))

    def pack(batches):
        for b in batches:
            codes, g, h = (b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for k in range(3)) if b.num_rows else (np.zeros((0, 1)),) * 3
            v = b.column(3).to_numpy(zero_copy_only=False)
            at = range(0, b.num_rows, most)
            cols = [pa.array([len(v[i : i + most]) for i in at], pa.int32()), *(pa.array([x[i : i + most].tobytes() for i in at], pa.binary()) for x in (codes, g, h)), pa.array([float(v[i : i + most].sum()) for i in at], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["n", "codes", "g", "h", "v"])

    return df.select(F.col("codes").cast("array<smallint>").alias("codes"), "g", "h", F.col("v").cast("double").alias("v")).mapInArrow(pack, "n int, codes binary, g binary, h binary, v double")


def totals(df: DataFrame, n_trees: int) -> tuple[tuple, float]:
    """Of blocks(): (rows, then G and H of each tree), and the mean of v."""

    def add(batches):
        for b in batches:
            if b.num_rows:
                sums = [np.sum([np.frombuffer(x).reshape(-1, n_trees).sum(0) for x in b.column(c).to_pylist()], 0) for c in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([sum(b.column(0).to_pylist())], pa.int64()), pa.array([np.stack(sums, 1).ravel()], pa.list_(pa.float64())), pa.array([sum(b.column(3).to_pylist())])], ["n", "s", "v"])

    got = df.select("n", "g", "h", "v").mapInArrow(add, "n long, s array<double>, v double").agg(F.sum("n"), F.sum("v"), *(F.sum(F.get("s", F.lit(k))) for k in range(2 * n_trees))).first()
    return (got[0], *got[2:]), got[1] / got[0]


def best_binned(df: DataFrame, routes: dict[int, list[tuple[int, int, int, int, int]]], edges: list[list[float]], features: list[int], r: Rules) -> DataFrame:
    """tree, slot, gain, feature, cut, GL, HL, nl, G, H, n: the best split of each wanted node that has one.

    df has blocks(); routes tell the nodes of each tree that are wanted. Each task sums up its rows' histograms and sends a record a node and feature, which are added and searched where the feature's records meet;
    one row a node is left. A task holds 24 bytes x nodes x features x bins. Of equal gains the feature that comes first in
    `features` wins.
    """
    width, n_features = {f: len(edges[f]) + 2 for f in features if len(edges[f])}, len(edges)

    def rows(batches):
        for b in batches:
            for n, codes, g, h in zip(b.column(0).to_pylist(), *(b.column(k).to_pylist() for k in range(1, 4)), strict=True):
                yield np.frombuffer(codes, np.int16).reshape(n, n_features), np.frombuffer(g).reshape(n, -1), np.frombuffer(h).reshape(n, -1)

    def count(batches):
        held: dict[int, list[np.ndarray]] = {}
        for codes, g, h in rows(batches):
            for k, route in routes.items():
                slot = routed_codes(codes, route)
                some = np.flatnonzero(slot >= 0)
                if not len(some):
                    continue
                n_slots = 1 + max(x[4] for x in route)
                own = codes[some].astype(np.int64)
                for f, w in width.items():
                    at, size = slot[some] * w + own[:, f] + 1, n_slots * w
                    new = np.stack([np.bincount(at, g[some, k], size), np.bincount(at, h[some, k], size), np.bincount(at, minlength=size)])
                    old = held.get((k, f))
                    held[k, f] = new if old is None else old + new
        for (k, f), sums in held.items():
            sums = sums.reshape(3, -1, width[f])
            slots = np.flatnonzero(sums[2].any(1))
            cols = [pa.array(np.full(len(slots), k, np.int32)), pa.array(slots.astype(np.int32)), pa.array(np.full(len(slots), f, np.int32)), pa.array([np.ascontiguousarray(sums[:, s]).tobytes() for s in slots], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["tree", "slot", "feature", "sums"])

    place = {f: i for i, f in enumerate(features)}
    names = ["tree", "slot", "feature", "place", "gain", "cut", "GL", "HL", "nl", "G", "H", "n"]

    def search(pdf):
        g, h, n = np.sum([np.frombuffer(x).reshape(3, -1) for x in pdf["sums"]], 0)
        tree, slot, f = (int(pdf[c].iloc[0]) for c in names[:3])
        best = best_cut(g, h, n, r)
        return pd.DataFrame([(tree, slot, f, place[f], *best, g.sum(), h.sum(), int(n.sum()))] if best else [], columns=names)

    found = df.select("n", "codes", "g", "h").mapInArrow(count, "tree int, slot int, feature int, sums binary")
    # The number of groups is known, so a few of them don't take a task each; in one partition the last step needs no shuffle.
    groups = len(width) * sum(1 + max(x[4] for x in route) for route in routes.values())
    n_parts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // GROUPS))
    found = found.repartition(n_parts, *names[:3]).groupBy(*names[:3]).applyInPandas(search, "tree int, slot int, feature int, place int, gain double, cut int, GL double, HL double, nl long, G double, H double, n long")
    return found.groupBy("tree", "slot").agg(F.max_by(F.struct("gain", "feature", *names[5:]), F.struct("gain", -F.col("place"))).alias("b")).select("tree", "slot", "b.*")


def best_exact(df: DataFrame, keys: list[str], features: list[int], r: Rules) -> DataFrame:
    """Best split over all distinct values: keys, gain, feature, threshold, GL, HL, nl, G, H, n; one row per node with one.

    Rows have columns keys, x, g, h. Values are aggregated before the window, whose partition is a node's feature. NaN goes
    left. The threshold is the middle between neighbouring values.
    """
    order = F.create_map(*(F.lit(v) for i, f in enumerate(features) for v in (f, i)))
    cells = df.select(*keys, "g", "h", F.posexplode("x").alias("feature", "v")).where(F.col("feature").isin(features))
    cells = cells.withColumn("v", F.when(F.isnan("v"), F.lit(float("-inf"))).otherwise(F.col("v")))
    cells = cells.groupBy(*keys, "feature", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("c"))
    w = W.partitionBy(*keys, "feature").orderBy("v")
    up, all_ = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*keys, "feature")
    s = cells.select(*keys, "feature", "v", F.lead("v").over(w).alias("next"), *(F.sum(c).over(up).alias(a) for c, a in (("g", "GL"), ("h", "HL"), ("c", "nl"))), *(F.sum(c).over(all_).alias(a) for c, a in (("g", "G"), ("h", "H"), ("c", "n"))))
    ok = F.col("next").isNotNull() & (F.col("v") > float("-inf")) & (F.col("nl") >= r.min_data) & (F.col("n") - F.col("nl") >= r.min_data) & (F.col("HL") >= r.min_hessian) & (F.col("H") - F.col("HL") >= r.min_hessian)
    s = s.where(ok).withColumn("gain", gain_column(F.col("GL"), F.col("HL"), F.col("G"), F.col("H"), r)).withColumn("threshold", (F.col("v") + F.col("next")) / 2)
    top = F.max_by(F.struct("gain", "feature", "threshold", "GL", "HL", "nl", "G", "H", "n"), F.struct("gain", -order[F.col("feature")], -F.col("threshold")))
    return s.groupBy(*keys).agg(top.alias("b")).select(*keys, "b.*")
