"""Losses as column expressions: Spark plans them, nothing runs in Python.

value, gradient and hessian take the label column y and the raw score column f (an array column for the multiclass loss);
init takes a DataFrame and gives the initial raw score.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Loss:
    name = "loss"

    def value(self, y: Column, f: Column) -> Column:
        raise NotImplementedError

    def gradient(self, y: Column, f: Column) -> Column:
        raise NotImplementedError

    def hessian(self, y: Column, f: Column) -> Column:
        return F.lit(1.0)

    def gradient_hessian(self, y: Column, f: Column) -> tuple[Column, Column]:
        return self.gradient(y, f), self.hessian(y, f)

    def init(self, df: DataFrame, label: str) -> float:
        return float(df.agg(F.avg(label)).first()[0])

    def mean(self, df: DataFrame, label: str, score: str) -> float:
        return float(df.agg(F.avg(self.value(F.col(label), F.col(score)))).first()[0])

    def state(self) -> dict:
        return {"objective": self.name}


class MSELoss(Loss):
    name = "mse"

    def value(self, y, f):
        return 0.5 * (y - f) * (y - f)

    def gradient(self, y, f):
        return f - y


class MAELoss(Loss):
    name = "mae"

    def value(self, y, f):
        return F.abs(y - f)

    def gradient(self, y, f):
        return F.signum(f - y)

    def init(self, df, label):
        return float(df.agg(F.median(label)).first()[0])


class HuberLoss(Loss):
    name = "huber"

    def __init__(self, delta: float = 1.0):
        self.delta = float(delta)

    def value(self, y, f):
        r = F.abs(y - f)
        return F.when(r <= self.delta, 0.5 * r * r).otherwise(self.delta * (r - 0.5 * self.delta))

    def gradient(self, y, f):
        r = f - y
        return F.when(F.abs(r) <= self.delta, r).otherwise(self.delta * F.signum(r))

    def hessian(self, y, f):
        r = F.abs(y - f)
        return F.greatest(F.when(r <= self.delta, F.lit(1.0)).otherwise(self.delta / F.greatest(r, F.lit(self.delta))), F.lit(1e-3))

    def state(self):
        return {"objective": self.name, "delta": self.delta}


class QuantileLoss(Loss):
    name = "quantile"

    def __init__(self, quantile: float = 0.5):
        if not 0 < quantile < 1:
            raise ValueError("quantile must be in (0, 1)")
        self.quantile = float(quantile)

    def value(self, y, f):
        r = y - f
        return F.when(r >= 0, self.quantile * r).otherwise((self.quantile - 1) * r)

    def gradient(self, y, f):
        return F.when(y - f >= 0, F.lit(-self.quantile)).otherwise(F.lit(1 - self.quantile))

    def init(self, df, label):
        return float(df.agg(F.percentile(label, F.lit(self.quantile))).first()[0])

    def state(self):
        return {"objective": self.name, "quantile": self.quantile}


def sigmoid(f: Column, most: float = 709.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(f, F.lit(most)), F.lit(-most))))


def clipped(p: Column, eps: float) -> Column:
    return F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))


class BinaryCrossEntropyLoss(Loss):
    name = "binary"

    def __init__(self, eps: float = 1e-15):
        self.eps = eps

    def value(self, y, f):
        p = clipped(sigmoid(f), self.eps)
        return -(y * F.log(p) + (1 - y) * F.log(1 - p))

    def gradient(self, y, f):
        return sigmoid(f) - y

    def hessian(self, y, f):
        p = sigmoid(f)
        return clipped(p * (1 - p), self.eps)

    def init(self, df, label):
        p = min(max(float(df.agg(F.avg(label)).first()[0]), self.eps), 1 - self.eps)
        return math.log(p / (1 - p))


def softmax(f: Column) -> Column:
    top = F.array_max(f)
    e = F.transform(f, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


class MultiClassCrossEntropyLoss(Loss):
    """f is an array of raw scores, y the class's number."""

    name = "multiclass"

    def __init__(self, n_classes: int, eps: float = 1e-15):
        self.n_classes, self.eps = n_classes, eps

    def value(self, y, f):
        top = F.array_max(f)
        total = F.aggregate(F.transform(f, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, v: s + v)
        return -F.least(F.greatest(F.get(f, y.cast("int")) - top - F.log(total), F.lit(-1e9)), F.lit(-self.eps))

    def gradient(self, y, f):
        return F.transform(softmax(f), lambda p, k: p - (y == k).cast("double"))

    def hessian(self, y, f):
        return F.transform(softmax(f), lambda p: clipped(p * (1 - p), self.eps))

    def init(self, df, label):
        n = {int(r[0]): r[1] for r in df.groupBy(label).count().collect()}
        total = sum(n.values())
        return [math.log(min(max(n.get(k, 0) / total, self.eps), 1 - self.eps)) for k in range(self.n_classes)]


def get_loss_function(objective: str, *, n_classes: int = 2, **options) -> Loss:
    name = objective.lower().replace("-", "_")
    known = {
        MSELoss: ("mse", "l2", "mean_squared_error"), MAELoss: ("mae", "l1", "mean_absolute_error"), HuberLoss: ("huber",), QuantileLoss: ("quantile",),
        BinaryCrossEntropyLoss: ("binary_crossentropy", "binary", "logloss"),
    }
    if name in ("multiclass_crossentropy", "multiclass", "softmax"):
        return MultiClassCrossEntropyLoss(n_classes, **options)
    for kind, names in known.items():
        if name in names:
            return kind(**options)
    raise ValueError(f"unknown objective {objective!r}")
