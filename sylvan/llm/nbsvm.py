"""Linear hinge-loss models over indicator features scaled by naive Bayes log-count ratios.

A feature's indicator is multiplied by r = log((p + a) / |p + a|) - log((q + a) / |q + a|), with p and q the feature's
counts in the classes (Wang and Manning 2012); the weights are fitted by dual coordinate descent (Hsieh et al. 2008).
Features are hashed into a fixed number of cells, so a fitted model has a fixed size and can be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import parts


@dataclass(frozen=True)
class LinearModel:
    """weights: of each cell, the log-count ratio already in them. slope, offset: from margin to log-odds."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, cells: np.ndarray) -> float:
        return float(self.weights[cells].sum()) + self.bias

    def score(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(margin, float) + self.offset, -60, 60)))


def log_count_ratio(rows: list[np.ndarray], label: np.ndarray, cells: int, alpha: float) -> np.ndarray:
    n = np.zeros((2, cells), np.int64)
    for kind in (0, 1):
        own = [x for x, one in zip(rows, label == 1, strict=True) if one == kind]
        for i, j in parts([len(x) for x in own], 1 << 18):
            n[kind] += np.bincount(np.concatenate(own[i:j]), minlength=cells)
    q, p = alpha + n
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float64)


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Minimise (|w|^2 + bias^2) / 2 + sum cost_i max(0, 1 - y_i (w.x_i + bias)); x_i has values[c] at its cells c.

    The dual's variables lie between 0 and cost_i; one that sits at a bound with its gradient pointing outwards is passed over.
    """
    w, bias = np.zeros(len(values)), 0.0
    small = values.astype(np.float32)
    x = [small[r] for r in rows]
    alpha, q = np.zeros(len(rows)), np.array([float(v @ v) for v in x]) + 1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (x[i] @ w[rows[i]] + bias) - 1
            if (alpha[i] == 0 and g >= 0) or (alpha[i] == cost[i] and g <= 0):
                continue
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            most = max(most, abs(g))
            if step:
                w[rows[i]] += step * x[i]
                bias += step
                alpha[i] = new
        if most < 1e-2:
            break
    return w, bias


def calibrate(margin: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (margin, label), by damped Newton steps with smoothed targets."""
    pos, neg = (label == 1).sum(), (label != 1).sum()
    t = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    s, o = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(s * margin + o, -60, 60)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * margin).sum() + 1e-3 * (s - 1), (p - t).sum()])
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        s, o = s - np.clip(step[0], -2, 2), o - np.clip(step[1], -2, 2)
    return max(float(s), 1e-3), float(o)


def fit(rows: list[np.ndarray], label: np.ndarray, cells: int, alpha: float = 1.0, cost: float = 0.1, epochs: int = 20, folds: int = 3) -> LinearModel:
    """A model of indicator rows (each row's distinct cells). Margins for the calibration come from held-out folds.

    With no rows, or one class only, the model has no weights and scores by the smoothed frequency of label 1.
    """
    label = np.asarray(label)
    pos = int((label == 1).sum())
    if pos < folds or len(label) - pos < folds:
        rate = (pos + 1) / (len(label) + 2)
        return LinearModel(np.zeros(cells), 0.0, 1.0, float(np.log(rate / (1 - rate))))
    y = np.where(label == 1, 1.0, -1.0)
    weight = np.where(label == 1, len(label) / (2 * pos), len(label) / (2 * (len(label) - pos)))

    def train(use):
        own = [rows[i] for i in use]
        r = log_count_ratio(own, label[use], cells, alpha)
        w, bias = dual_descent(own, r, y[use], cost * weight[use], epochs)
        return w * r, bias

    margin = np.zeros(len(rows))
    fold = np.random.default_rng(1).permutation(len(rows)) % folds
    for k in range(folds):
        w, bias = train(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            margin[i] = w[rows[i]].sum() + bias
    slope, offset = calibrate(margin, label)
    w, bias = train(np.arange(len(rows)))
    return LinearModel(w.astype(np.float32), float(bias), slope, offset)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, most_chars: int) -> tuple[list[str], np.ndarray]:
    """Text and label of a bounded sample of the labelled rows that may be learnt from (crc32(doc_id) mod 3 is not 1).

    The share kept is set so that about most_rows rows and about most_chars characters are expected; rows are chosen by a
    hash of doc_id. Null labels are left out, null text is empty, labels other than 0 and 1 are left out. Texts of more than
    a twentieth of most_chars are not learnt from, so that a few long ones do not displace the others.
    """
    y = F.col(label)
    may = labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    share = min(1.0, most_rows / max(may.count(), 1))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = may.where(place < int(share * (1 << 30))).groupBy("doc_id").agg(F.max(y).cast("int").alias("__y"))
    # About most_rows rows, so fit to be sent to every task: the texts are not shuffled.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.char_length("text") <= most_chars // 20).join(F.broadcast(sample), "doc_id")
    size = sorted((r[1], r[0], r[2]) for r in rows.groupBy("doc_id").agg(F.first(place), F.max(F.char_length("text"))).collect())
    chars = np.cumsum([x[2] for x in size])
    below = size[int(np.searchsorted(chars, most_chars, side="right"))][0] if len(size) and chars[-1] > most_chars else 1 << 30
    got = rows.where(place < below).groupBy("doc_id").agg(F.max("text"), F.max("__y")).toArrow()
    order = np.argsort(got.column(0).to_numpy(), kind="stable")
    text, y = got.column(1).to_pylist(), got.column(2).to_numpy()
    return [text[i] for i in order], y[order]
