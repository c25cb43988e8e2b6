"""From any table or array to the training layout: row_id, x (array of doubles, NaN for missing), label, weight."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """df written to the folder that driver and executors share, and read back; survives lost executors."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sylvan-"))
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def from_arrays(spark: SparkSession, x, y=None, weight=None) -> DataFrame:
    """A DataFrame with row_id, f_0.., and label and weight if given, of array-likes; 1-D x is one column."""
    x = np.asarray(getattr(x, "values", x), float)
    x = x[:, None] if x.ndim == 1 else x
    cols = {"row_id": np.arange(len(x))} | {f"f_{i}": x[:, i] for i in range(x.shape[1])}
    for name, v in (("label", y), ("weight", weight)):
        if v is not None:
            v = np.asarray(getattr(v, "values", v), float)
            v = v[:, 0] if v.ndim == 2 and v.shape[1] == 1 else v
            if v.ndim != 1:
                raise ValueError(f"{name} must have one dimension")
            if len(v) != len(x):
                raise ValueError(f"x has {len(x)} rows, {name} {len(v)}")
            cols[name] = v
    schema = T.StructType([T.StructField(c, T.LongType() if c == "row_id" else T.DoubleType()) for c in cols])
    rows = [tuple(r) for r in zip(*(v.tolist() for v in cols.values()), strict=True)]
    return spark.createDataFrame(rows, schema)


def check_frame(df: DataFrame, features: list[str], label: str | None = None, weight: str | None = None, *, allow_nan: bool = True) -> int:
    """Number of rows; ValueError for an empty table, infinities, missing values where they are not allowed, negative weights.

    One aggregation over one pass.
    """
    def some(condition):
        return F.coalesce(F.max(condition.cast("int")), F.lit(0))

    d = {c: F.col(c).cast("double") for c in [*features, *filter(None, (label, weight))]}
    infinite, missing = F.lit(False), F.lit(False)
    for c in features:
        infinite = infinite | (F.abs(d[c]) == float("inf"))
        missing = missing | d[c].isNull() | F.isnan(d[c])
    bad_label = d[label].isNull() | F.isnan(d[label]) | (F.abs(d[label]) == float("inf")) if label else F.lit(False)
    bad_weight = d[weight].isNull() | F.isnan(d[weight]) | (d[weight] < 0) if weight else F.lit(False)
    n, inf, nan, y, w = df.agg(F.count("*"), some(infinite), some(missing), some(bad_label), some(bad_weight)).first()
    for bad, what in ((not n, "the table is empty"), (inf, "features hold infinite values"), (nan and not allow_nan, "features hold missing values"), (y, "the label holds missing or infinite values"), (w, "weights must be numbers that are not negative")):
        if bad:
            raise ValueError(what)
    return n


def layout(df: DataFrame, features: list[str], label: str | None = None, weight: str | None = None, row_id: str = "row_id") -> DataFrame:
    """row_id, x, and label and weight if given. Without a row_id column one is made and written at once, so it stays."""
    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features)).alias("x")
    more = [F.col(c).cast("double").alias(n) for c, n in ((label, "label"), (weight, "weight")) if c]
    if row_id in df.columns:
        return df.select(F.col(row_id).cast("long").alias("row_id"), x, *more)
    return cut(df.select(F.monotonically_increasing_id().alias("row_id"), x, *more), "rows")
