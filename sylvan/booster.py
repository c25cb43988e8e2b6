"""Estimators: gradient-boosted trees for regression and classification on DataFrames."""

from __future__ import annotations

import json
import random
from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import metrics
from sylvan.functions.losses import Loss, get_loss_function, sigmoid, softmax
from sylvan.operators.binning import bin_edges, coded
from sylvan.operators.bundling import FeatureBundler
from sylvan.operators.sampling import GOSS, bagging
from sylvan.operators.split import Rules, blocks, totals
from sylvan.params import ALIASES, BoosterParams, check_is_fitted
from sylvan.plans.scoring import advanced, raw_scores
from sylvan.plans.tree import Tree, grow
from sylvan.sources.ingest import check_frame, cut, from_arrays, layout


class Callback(ABC):
    @abstractmethod
    def on_iteration_end(self, iteration: int, model, train_loss: float, val_loss: float | None = None) -> bool:
        """True stops the training after this round."""


class EarlyStoppingCallback(Callback):
    """Stops after `patience` rounds without an improvement of more than min_delta of the validation loss, or without an
    eval set of the training loss. Its state lasts over fits."""

    def __init__(self, patience: int = 10, min_delta: float = 0.0):
        self.patience, self.min_delta, self.best, self.waited = patience, min_delta, float("inf"), 0

    def on_iteration_end(self, iteration, model, train_loss, val_loss=None):
        loss = train_loss if val_loss is None else val_loss
        if loss < self.best - self.min_delta:
            self.best, self.waited = loss, 0
        else:
            self.waited += 1
        return self.waited >= self.patience


def log_message(message: str, *, verbose: int = 0) -> None:
    if verbose > 0:
        print(f"[Sylvan] {message}")


def log_training_progress(iteration: int, total: int, value: float, *, verbose: int = 0, metric_name: str = "loss") -> None:
    log_message(f"Iter {iteration}/{total} ({100 * iteration / total:.1f}%) - {metric_name}: {value:.6f}", verbose=verbose)


class BoostedModel(ABC):
    """Rows are given as a DataFrame with the feature columns (all numeric ones but label, weight and row_id, if not named),
    or as arrays. Predictions come as a DataFrame with further columns, or for arrays as an array."""

    def __init__(self, objective=None, *, feature_cols: list[str] | None = None, label_col: str = "label", weight_col: str | None = None, row_id: str = "row_id", cut_every: int = 8, compat: bool = True, **params):
        params = {ALIASES.get(k, k): v for k, v in params.items()}
        unknown = set(params) - set(BoosterParams().to_dict())
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        self.params = BoosterParams(**params).validate()
        self.objective, self.feature_cols, self.label_col, self.weight_col, self.row_id, self.cut_every, self.compat = objective, feature_cols, label_col, weight_col, row_id, cut_every, compat
        self._reset()

    def _reset(self) -> None:
        self.is_fitted_, self.trees_, self.init_, self.history_ = False, [], [], {"train_loss": [], "val_loss": []}
        self.bundler_, self.best_iteration_, self.classes_ = None, None, None

    num_iterations, learning_rate, max_depth, num_leaves, verbose, random_state = (property(lambda self, n=n: getattr(self.params, n)) for n in ("num_iterations", "learning_rate", "max_depth", "num_leaves", "verbose", "random_state"))

    def get_params(self) -> dict:
        return self.params.to_dict() | {"objective": self.objective}

    def set_params(self, **values):
        for k, v in values.items():
            k = ALIASES.get(k, k)
            if k == "objective":
                self.objective = v
            elif k in self.params.to_dict():
                setattr(self.params, k, v)
            else:
                raise ValueError(f"unknown parameter {k}")
        self.params.validate()
        return self

    def __repr__(self) -> str:
        return f"{type(self).__name__}(" + ", ".join(f"{k}={v!r}" for k, v in self.get_params().items()) + ")"

    # Rows

    def _spark(self) -> SparkSession:
        return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def _rows(self, x, y=None, weight=None) -> DataFrame:
        if isinstance(x, DataFrame):
            return x
        return from_arrays(self._spark(), x, y, weight)

    def _names(self, df: DataFrame) -> list[str]:
        other = {self.label_col, self.weight_col, self.row_id, "weight"}
        return self.feature_cols or [c for c, t in df.dtypes if c not in other and (t in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean") or t.startswith("decimal"))]

    @abstractmethod
    def _prepare(self, rows: DataFrame) -> DataFrame: ...

    @abstractmethod
    def _loss(self) -> Loss: ...

    def _gradients(self, loss: Loss, many: bool):
        y, p = F.col("label"), F.col("pred")
        g, h = loss.gradient_hessian(y, p if many else F.get("pred", F.lit(0)))
        return (g, h) if many else (F.array(g), F.array(h))

    def fit(self, x, y=None, *, eval_set=None, sample_weight=None, callbacks: list[Callback] | None = None):
        p = self.params.validate()
        keep = p.warm_start and self.is_fitted_
        old = (self.trees_, self.init_, self.history_, self.bundler_, self.classes_) if keep else None
        self._reset()
        df = self._rows(x, y, sample_weight)
        weight = self.weight_col or ("weight" if sample_weight is not None else None)
        names = self._names(df)
        check_frame(df, names, self.label_col, weight, allow_nan=p.allow_nan)
        self.names_ = names
        rows = layout(df, names, self.label_col, weight, self.row_id)
        if old:
            self.classes_ = old[4]
        rows = self._prepare(rows)
        loss = self._loss()
        many = loss.name == "multiclass"
        n_classes = getattr(loss, "n_classes", 1)
        if old:
            self.trees_, self.init_, self.history_, self.bundler_ = old[:4]
        else:
            init = loss.init(rows, "label")
            self.init_ = list(init) if many else [init]
            if p.use_efb:
                self.bundler_ = FeatureBundler().fit(rows, len(names))
        if self.bundler_:
            rows = self.bundler_.transform(rows)
        self.n_features_ = len(self.bundler_.bundles_) if self.bundler_ else len(names)
        valid = None
        if eval_set is not None:
            v = self._rows(*eval_set) if isinstance(eval_set, tuple) else eval_set
            valid = self._prepare(layout(v, names, self.label_col, None, self.row_id))
            valid = self.bundler_.transform(valid) if self.bundler_ else valid
        self._boost(rows, valid, loss, many, n_classes, callbacks or [])
        self.is_fitted_ = True
        return self

    def _rate(self, k: int) -> float:
        return self.params.learning_rate * self.params.lr_decay**k

    def _start(self, rows: DataFrame) -> DataFrame:
        if not self.trees_:
            return rows.withColumn("pred", F.array(*(F.lit(float(v)) for v in self.init_)))
        return raw_scores(rows, self.trees_, self.init_, self._rates()).withColumnRenamed("raw", "pred")

    def _rates(self) -> list[float]:
        return [self.params.learning_rate if self.compat else row[0].shrinkage for row in self.trees_]

    def _boost(self, rows, valid, loss, many, n_classes, callbacks) -> None:
        p = self.params
        sampled = p.enable_goss or (p.bagging_freq > 0 and p.bagging_fraction < 1)
        edges = None
        if p.use_histogram and not sampled:
            edges = bin_edges(rows, self.n_features_, p.max_bins)
            rows = coded(rows, edges)
        rows = cut(self._start(rows), "train")
        valid = cut(self._start(valid), "valid") if valid is not None else None
        rules = Rules(p.lambda_l1, p.lambda_l2, p.min_data_in_leaf, p.min_sum_hessian_in_leaf)
        g, h = self._gradients(loss, many)
        value = loss.value(F.col("label"), F.col("pred") if many else F.get("pred", F.lit(0)))
        seed, first, best, waited = p.random_state or 0, len(self.trees_), float("inf"), 0
        pending, held = [], None  # rounds since rows were last written; blocks and sums of the next round

        def graded(d):
            d = d.withColumns({"g": g, "h": h})
            return d.withColumns({c: F.transform(c, lambda v: v * F.col("weight")) for c in ("g", "h")}) if "weight" in d.columns else d

        def packed(d):
            """Blocks of the rows with their gradients; rows, sums of g and h, and mean loss."""
            b = cut(blocks(graded(d).withColumn("v", value), self.n_features_, n_classes), "blocks")
            return b, totals(b, n_classes)

        fast = edges is not None
        if fast:
            held = packed(rows)
        for k in range(first, first + p.num_iterations):
            d = graded(advanced(rows, pending)) if not fast else None
            if p.enable_goss:
                d = d.withColumn("size", F.aggregate(F.transform("g", lambda v: F.abs(v)), F.lit(0.0), lambda s, v: s + v))
                d = GOSS(p.goss_top_rate, p.goss_other_rate, seed).sample(d, "size", turn=k)
                d = d.withColumns({c: F.transform(c, lambda v: v * F.col("goss_weight")) for c in ("g", "h")})
            if p.bagging_freq > 0 and p.bagging_fraction < 1 and k % p.bagging_freq == 0:
                d = bagging(d, p.bagging_fraction, seed=seed, turn=k)
            own = edges
            if sampled:
                d = cut(d, "sample")
                if p.use_histogram:
                    own = bin_edges(d, self.n_features_, p.max_bins)
                    d = coded(d, own)
            rng = random.Random(seed if self.compat and p.random_state is not None else f"{p.random_state}/{k}")
            some = rng.sample(range(self.n_features_), max(1, int(self.n_features_ * p.feature_fraction))) if p.feature_fraction < 1 else None
            d, sums = (held[0], held[1][0]) if fast else (d, None)
            trees = grow(d, n_classes, self.n_features_, rules, edges=own, features=some, num_leaves=p.num_leaves, max_depth=p.max_depth, min_gain=p.min_gain_to_split, sums=sums)
            rate = self._rate(k)
            for t in trees:
                t.shrinkage = rate
            self.trees_.append(trees)
            pending.append((trees, rate))
            if len(pending) >= self.cut_every:
                rows = cut(advanced(rows, pending), "train")
                valid = cut(advanced(valid, pending), "valid") if valid is not None else None
                pending = []
            if fast:
                held = packed(advanced(rows, pending))
            train_loss = held[1][1] if fast else float(advanced(rows, pending).agg(F.avg(value)).first()[0])
            val_loss = float(advanced(valid, pending).agg(F.avg(value)).first()[0]) if valid is not None else None
            self.history_["train_loss"].append(train_loss)
            if val_loss is not None:
                self.history_["val_loss"].append(val_loss)
            log_training_progress(k + 1, first + p.num_iterations, train_loss if val_loss is None else val_loss, verbose=p.verbose, metric_name="loss" if val_loss is None else "val_loss")
            stops = [c.on_iteration_end(k, self, train_loss, val_loss) for c in callbacks]
            if val_loss is not None:
                waited = 0 if val_loss < best else waited + 1
                if val_loss < best:
                    best, self.best_iteration_ = val_loss, k
            if any(stops) or (val_loss is not None and p.early_stopping_rounds and waited >= p.early_stopping_rounds):
                break
        self.n_iter_ = len(self.trees_)

    # Predictions

    def raw(self, x) -> DataFrame:
        """The rows with column raw, the raw score of each class."""
        check_is_fitted(self)
        df = self._rows(x)
        names = self.names_ if all(c in df.columns for c in self.names_) else self._names(df)
        if len(names) != len(self.names_):
            raise ValueError(f"the model has {len(self.names_)} features, the rows {len(names)}")
        vector = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names))
        d = df.withColumn("x", vector)
        if self.bundler_:
            d = self.bundler_.transform(d)
        return raw_scores(d, self.trees_, self.init_, self._rates()).drop("x")

    def _given(self, x, out: DataFrame, column: str):
        if isinstance(x, DataFrame):
            return out
        return np.array([r[0] for r in out.orderBy("row_id").select(column).collect()])

    @property
    def feature_importances_(self) -> np.ndarray:
        """Shares of gain, averaged over trees; of bundles if features were bundled."""
        check_is_fitted(self)
        total = np.sum([t.feature_importances(self.n_features_) for row in self.trees_ for t in row], 0)
        return total / total.sum() if total.sum() > 0 else total

    def trees_frame(self) -> DataFrame:
        """The model as a table: a row per node."""
        rows = [(i, i, k, n.node_id, n.left, n.right, n.is_leaf, n.feature, n.threshold, n.value, n.gain, n.n_samples, n.depth, t.shrinkage) for i, row in enumerate(self.trees_) for k, t in enumerate(row) for n in t.nodes]
        return self._spark().createDataFrame(rows, "tree_id int, round int, class_id int, node_id int, left_id int, right_id int, is_leaf boolean, feature_idx int, threshold double, value double, gain double, n_samples long, depth int, shrinkage double")

    def to_dict(self) -> dict:
        check_is_fitted(self)
        loss = self._loss()
        return {"kind": type(self).__name__, "params": self.params.to_dict(), "loss": loss.state(), "init": [float(v) for v in self.init_], "names": self.names_, "n_features": self.n_features_, "classes": self.classes_, "compat": self.compat, "history": self.history_, "bundler": self.bundler_.to_dict() if self.bundler_ else None, "trees": [[t.to_dict() for t in row] for row in self.trees_]}

    def save_model(self, path: str) -> None:
        """One JSON file, written whole or not at all."""
        import os

        text = json.dumps(self.to_dict())
        with open(f"{path}.part", "w") as f:
            f.write(text)
        os.replace(f"{path}.part", path)

    def load_model(self, path: str):
        with open(path) as f:
            d = json.load(f)
        self._reset()
        self.params = BoosterParams.from_dict(d["params"])
        self.objective, self.init_, self.names_, self.n_features_, self.classes_, self.compat, self.history_ = d["loss"]["objective"], d["init"], d["names"], d["n_features"], d["classes"], d["compat"], d["history"]
        self._options = {k: v for k, v in d["loss"].items() if k != "objective"}
        self.bundler_ = FeatureBundler.from_dict(d["bundler"]) if d["bundler"] else None
        self.trees_ = [[Tree.from_dict(t) for t in row] for row in d["trees"]]
        self.is_fitted_, self.n_iter_ = True, len(self.trees_)
        return self


class BoostedRegressor(BoostedModel):
    """objective: a name of functions.losses or a Loss."""

    def __init__(self, objective: str | Loss = "mse", *, delta: float | None = None, quantile: float | None = None, **kw):
        self._options = {k: v for k, v in (("delta", delta), ("quantile", quantile)) if v is not None}
        super().__init__(objective, **kw)

    def _prepare(self, rows):
        return rows

    def _loss(self):
        return self.objective if isinstance(self.objective, Loss) else get_loss_function(self.objective, **self._options)

    def predict(self, x):
        return self._given(x, self.raw(x).withColumn("prediction", F.get("raw", F.lit(0))).drop("raw"), "prediction")

    def score(self, x, y=None) -> float:
        df = self._rows(x, y)
        return metrics.r2_score(self.predict(df), self.label_col)


class BoostedClassifier(BoostedModel):
    """Two classes: logistic loss; more: softmax. Labels are numbers."""

    def _prepare(self, rows):
        if self.classes_ is None:
            self.classes_ = sorted(r[0] for r in rows.select("label").distinct().collect())
        known = F.array(*(F.lit(float(c)) for c in self.classes_))
        # A label that training did not have counts as the first class.
        return rows.withColumn("label", F.greatest(F.coalesce(F.array_position(known, F.col("label")), F.lit(0)) - 1, F.lit(0)).cast("double"))

    def _loss(self):
        return get_loss_function("binary") if len(self.classes_) <= 2 else get_loss_function("multiclass", n_classes=len(self.classes_))

    def predict_proba(self, x):
        p = sigmoid(F.get("raw", F.lit(0)), 500.0)
        p = F.array(1 - p, p) if len(self.classes_) <= 2 else softmax(F.col("raw"))
        return self._given(x, self.raw(x).withColumn("probability", p).drop("raw"), "probability")

    def predict(self, x):
        df = self.predict_proba(self._rows(x))
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        labels = F.array(*(F.lit(float(c)) for c in (self.classes_ if len(self.classes_) > 1 else self.classes_ * 2)))
        return self._given(x, df.withColumn("prediction", F.element_at(labels, best)), "prediction")

    def score(self, x, y=None) -> float:
        return metrics.accuracy_score(self.predict(self._rows(x, y)), self.label_col)
