"""Exclusive feature bundling: features that are rarely non-zero together become one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many features all pairs are counted in one aggregate; beyond, by exploding the non-zeros of each row.
DIRECT = 50


def conflicts(df: DataFrame, n_features: int) -> tuple[int, dict[tuple[int, int], int]]:
    """Rows, and for each pair of features in how many rows both are not zero (NaN is not zero)."""
    x = [F.get("x", F.lit(i)) != 0 for i in range(n_features)]
    if n_features <= DIRECT:
        pairs = [(i, j) for i in range(n_features) for j in range(i + 1, n_features)]
        row = df.agg(F.count("*"), *(F.count_if(x[i] & x[j]) for i, j in pairs)).first()
        return row[0], {p: c for p, c in zip(pairs, row[1:], strict=True) if c}
    on = F.filter(F.transform("x", lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    both = df.select(F.explode(F.flatten(F.transform(on, lambda i: F.transform(F.filter(on, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j"))))).alias("p")))
    return df.count(), {(r["i"], r["j"]): r["count"] for r in both.groupBy("p.i", "p.j").count().collect()}


class FeatureBundler:
    """max_conflict_rate: share of rows in which two features of a bundle may both be non-zero. At max_bundles bundles the
    remaining features stand alone."""

    def __init__(self, max_conflict_rate: float = 0.0, max_bundles: int | None = None):
        if not 0 <= max_conflict_rate <= 1:
            raise ValueError("max_conflict_rate must be in [0, 1]")
        self.max_conflict_rate, self.max_bundles = max_conflict_rate, max_bundles
        self.bundles_: list[list[int]] = []
        self.offsets_: list[list[float]] = []

    def fit(self, df: DataFrame, n_features: int) -> FeatureBundler:
        n, both = conflicts(df, n_features)
        bound = self.max_conflict_rate * n
        bundles: list[list[int]] = []
        placed: set[int] = set()
        for i in range(n_features):
            if i in placed:
                continue
            bundle = [i]
            if self.max_bundles is None or len(bundles) < self.max_bundles:
                for j in range(i + 1, n_features):
                    if j not in placed and all(both.get((k, j), 0) <= bound for k in bundle):
                        bundle.append(j)
            placed.update(bundle)
            bundles.append(bundle)
        x = [F.get("x", F.lit(i)) for i in range(n_features)]
        most = df.agg(*(F.max(F.abs(F.when(~F.isnan(v), v))) for v in x)).first()
        top = [v if v is not None and v < float("inf") else 1.0 for v in most]
        self.bundles_ = bundles
        self.offsets_ = [[sum(top[f] + 1 for f in b[:k]) for k in range(len(b))] for b in bundles]
        return self

    def columns(self) -> Column:
        if not self.bundles_:
            raise RuntimeError("the bundler is not fitted")

        def one(f: int, offset: float) -> Column:
            v = F.get("x", F.lit(f))
            return F.when(v != 0, v + offset).otherwise(F.lit(0.0))

        out = []
        for b, o in zip(self.bundles_, self.offsets_, strict=True):
            total = one(b[0], o[0])
            for f, off in zip(b[1:], o[1:], strict=True):
                total = total + one(f, off)
            out.append(total)
        return F.array(*out)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("x", self.columns())

    def fit_transform(self, df: DataFrame, n_features: int) -> DataFrame:
        return self.fit(df, n_features).transform(df)

    def get_bundle_info(self) -> dict:
        return {"n_bundles": len(self.bundles_), "bundles": self.bundles_, "offsets": self.offsets_, "n_features": sum(map(len, self.bundles_))}

    def to_dict(self) -> dict:
        return {"rate": self.max_conflict_rate, "most": self.max_bundles, "bundles": self.bundles_, "offsets": self.offsets_}

    @classmethod
    def from_dict(cls, d: dict) -> FeatureBundler:
        b = cls(d["rate"], d["most"])
        b.bundles_, b.offsets_ = d["bundles"], d["offsets"]
        return b

    def __repr__(self) -> str:
        return f"FeatureBundler(max_conflict_rate={self.max_conflict_rate}, max_bundles={self.max_bundles})"


def bundle_features(df: DataFrame, n_features: int, *, max_conflict_rate: float = 0.0) -> tuple[DataFrame, FeatureBundler]:
    b = FeatureBundler(max_conflict_rate).fit(df, n_features)
    return b.transform(df), b
