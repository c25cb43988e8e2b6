"""Sampling by hash order, so that the same rows are drawn however the data are partitioned.

Exact sizes come from a rank in hash order. The rank's cut-off value is found by an aggregate over a narrowing range of
hashes, so no task sorts all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def order_key(row_id: str, seed: int, turn: int = 0) -> Column:
    return F.xxhash64(F.col(row_id), F.lit(seed), F.lit(turn))


def smallest(df: DataFrame, key: Column, n: int) -> Column:
    """Condition that holds for the n rows of smallest key (ties beyond n hold too; the keys here are 64-bit hashes)."""
    if n <= 0:
        return F.lit(False)
    low, high, rest, d = -(1 << 63), (1 << 63) - 1, n, df.select(key.alias("k"))
    while True:
        step = max(1, -(-(high - low + 1) // 1024))
        cell = F.floor((F.col("k").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(step).cast("decimal(20,0)"))
        counts = sorted((int(r[0]), r[1]) for r in d.where(F.col("k").between(low, high)).groupBy(cell.alias("c")).count().collect())
        for c, m in counts:
            if rest <= m:
                if step == 1 or rest == m:
                    return key <= min(low + (c + 1) * step - 1, (1 << 63) - 1)
                low, high = low + c * step, min(low + (c + 1) * step - 1, (1 << 63) - 1)
                break
            rest -= m
        else:
            return F.lit(True)


def goss_sizes(n: int, top_rate: float, other_rate: float) -> tuple[int, int]:
    top = max(1, int(n * top_rate))
    return top, min(max(1, int(n * other_rate)), n - top)


class GOSS:
    """Gradient-based one-side sampling: all rows of large gradient, a sample of the others weighted up."""

    def __init__(self, top_rate: float = 0.2, other_rate: float = 0.1, random_state: int | None = None):
        if not (0 < top_rate < 1 and 0 < other_rate < 1):
            raise ValueError("top_rate and other_rate must be in (0, 1)")
        if top_rate + other_rate >= 1:
            raise ValueError("top_rate + other_rate must be below 1")
        self.top_rate, self.other_rate, self.random_state = top_rate, other_rate, random_state
        self.factor = (1 - top_rate) / other_rate

    def __repr__(self) -> str:
        return f"GOSS(top_rate={self.top_rate}, other_rate={self.other_rate}, random_state={self.random_state})"

    def sample(self, df: DataFrame, gradient: str = "g", row_id: str = "row_id", turn: int = 0) -> DataFrame:
        """The sampled rows with column goss_weight: 1 for rows of large gradient, else the factor."""
        size = df.count()
        top, other = goss_sizes(size, self.top_rate, self.other_rate)
        cut = df.select(F.abs(gradient).alias("a")).agg(F.percentile("a", F.lit(1 - top / size))).first()[0] if size else 0.0
        # Rows above the cut, then of those at it as many as are missing, by hash.
        above = df.where(F.abs(gradient) > cut).count()
        key = order_key(row_id, self.random_state or 0, turn)
        at = df.where(F.abs(gradient) <= cut).select(F.abs(gradient).alias("a"), row_id)
        if above < top:
            level = at.agg(F.max("a")).first()[0]
            tie = smallest(at.where(F.col("a") == level), key, top - above)
            is_top = (F.abs(gradient) > cut) | ((F.abs(gradient) == level) & tie)
        else:
            is_top = F.abs(gradient) > cut
        marked = df.withColumn("__top", is_top)
        drawn = smallest(marked.where(~F.col("__top")), key, other)
        return marked.where(F.col("__top") | drawn).withColumn("goss_weight", F.when(F.col("__top"), 1.0).otherwise(self.factor)).drop("__top")

    def sample_data(self, df: DataFrame, gradient: str = "g", hessian: str = "h", row_id: str = "row_id") -> DataFrame:
        s = self.sample(df, gradient, row_id)
        return s.withColumn(gradient, F.col(gradient) * F.col("goss_weight")).withColumn(hessian, F.col(hessian) * F.col("goss_weight"))


def apply_goss(df: DataFrame, gradient: str = "g", hessian: str = "h", *, top_rate: float = 0.2, other_rate: float = 0.1, random_state: int | None = None) -> DataFrame:
    return GOSS(top_rate, other_rate, random_state).sample_data(df, gradient, hessian)


def bagging(df: DataFrame, fraction: float, row_id: str = "row_id", seed: int = 0, turn: int = 0) -> DataFrame:
    key = order_key(row_id, seed, turn)
    return df.where(smallest(df, key, max(1, int(df.count() * fraction))))


def train_test_split(df: DataFrame, *, test_size: float = 0.2, random_state: int | None = None, shuffle: bool = True, stratify: str | None = None, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(train, test). Stratified: of each class of n rows, max(1, int(n * test_size)) go to test."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be in (0, 1)")
    key = order_key(row_id, random_state or 0) if shuffle or stratify else F.col(row_id).cast("long")
    if stratify:
        rank = F.row_number().over(W.partitionBy(stratify).orderBy(key.desc(), row_id))
        n = F.count("*").over(W.partitionBy(stratify))
        d = df.withColumn("__test", rank <= F.greatest(F.lit(1), F.floor(n * test_size)))
    else:
        n = df.count()
        d = df.withColumn("__test", ~F.coalesce(smallest(df, key, n - int(n * test_size)), F.lit(False)))
    return d.where("NOT __test").drop("__test"), d.where("__test").drop("__test")
