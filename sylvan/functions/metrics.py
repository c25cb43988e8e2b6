"""Metrics: each a column expression to aggregate, and a function on a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.functions.losses import clipped


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def mse(y: Column, f: Column) -> Column:
    return F.avg((y - f) * (y - f))


def mae(y: Column, f: Column) -> Column:
    return F.avg(F.abs(y - f))


def r2(y: Column, f: Column) -> Column:
    """0 if y is constant."""
    total = F.var_pop(y) * F.count(y)
    return F.when(total == 0, F.lit(0.0)).otherwise(1 - F.sum((y - f) * (y - f)) / total)


def binary_log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    p = clipped(p, eps)
    return F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))


def multiclass_log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    return F.avg(-F.log(clipped(F.get(p, y.cast("int")), eps)))


def _on(expression):
    def metric(df: DataFrame, y: str = "label", prediction: str = "prediction") -> float:
        return float(df.agg(expression(F.col(y), F.col(prediction))).first()[0])

    return metric


accuracy_score, mean_squared_error, mean_absolute_error, r2_score = map(_on, (accuracy, mse, mae, r2))


def log_loss(df: DataFrame, y: str = "label", prediction: str = "probability", *, eps: float = 1e-15) -> float:
    many = df.schema[prediction].dataType.typeName() == "array"
    return float(df.agg((multiclass_log_loss if many else binary_log_loss)(F.col(y), F.col(prediction), eps)).first()[0])
