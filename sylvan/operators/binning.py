"""Quantile cut points and bin codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bin_edges(df: DataFrame, n_features: int, max_bins: int = 255) -> list[list[float]]:
    """Inner edges of each feature of column x; NaN is left out.

    A feature of up to max_bins distinct values has a bin for each, cut in the middle between neighbours; others are cut by
    max_bins exact quantiles, of which equal ones count once.
    """
    value = [F.when(~F.isnan(F.get("x", F.lit(i))), F.get("x", F.lit(i))) for i in range(n_features)]
    quantiles = F.array(*(F.lit(q) for q in np.linspace(0, 1, max_bins + 1).tolist()))
    out: list[list[float]] = []
    for at in range(0, n_features, 32):
        some = value[at : at + 32]
        counts = df.agg(*(F.count_distinct(v) for v in some)).first()
        exprs = [(F.percentile(v, quantiles) if n > max_bins else F.collect_set(v)).alias(f"q{i}") for i, (v, n) in enumerate(zip(some, counts, strict=True)) if n > 1]
        got = df.agg(*exprs).first().asDict() if exprs else {}
        for i, n in enumerate(counts):
            v = np.unique(got.get(f"q{i}", []))
            out.append((v[1:-1] if n > max_bins else middles(v)).tolist())
    return out


def middles(v: np.ndarray) -> np.ndarray:
    """Middles between neighbours of sorted distinct values; the lower one where no double lies between."""
    low, high = v[:-1], v[1:]
    mid = low / 2 + high / 2
    return np.where((low <= mid) & (mid < high), mid, low)


def code(value: Column, edges: list[float], rule: str = "right_closed") -> Column:
    """Bin of a value: -1 for NaN, else the number of inner edges below it (rule "left_closed": not above it)."""
    cuts = F.array(*(F.lit(float(e)) for e in edges)).cast("array<double>")
    below = (lambda e: e < value) if rule == "right_closed" else (lambda e: e <= value)
    return F.when(F.isnan(value), F.lit(-1)).otherwise(F.size(F.filter(cuts, below)))


def coded(df: DataFrame, edges: list[list[float]]) -> DataFrame:
    """df with column codes, the bin of each feature of x; vectorised search in Arrow batches."""
    sent = df.sparkSession.sparkContext.broadcast([np.array(e) for e in edges])
    schema = df.schema
    at = schema.fieldNames().index("x")

    def run(batches):
        cuts = sent.value
        for b in batches:
            x = np.asarray(b.column(at).flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, len(cuts))
            c = np.stack([np.where(np.isnan(v), -1, np.searchsorted(e, v, side="left")) for e, v in zip(cuts, x.T, strict=True)], 1).astype(np.int16)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, len(cuts)).astype(np.int32)), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, codes], [*schema.fieldNames(), "codes"])

    return df.mapInArrow(run, T.StructType([*schema.fields, T.StructField("codes", T.ArrayType(T.ShortType()))]))
