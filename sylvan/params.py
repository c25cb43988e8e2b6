"""Hyperparameters of boosting, with their checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

#: Other names under which estimators take a parameter.
ALIASES = {"n_estimators": "num_iterations", "min_samples_leaf": "min_data_in_leaf", "reg_alpha": "lambda_l1", "reg_lambda": "lambda_l2"}


@dataclass
class BoosterParams:
    num_iterations: int = 100
    learning_rate: float = 0.1
    max_depth: int = -1
    num_leaves: int = 31
    min_data_in_leaf: int = 20
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    min_gain_to_split: float = 0.0
    feature_fraction: float = 1.0
    bagging_fraction: float = 1.0
    bagging_freq: int = 0
    early_stopping_rounds: int | None = None
    enable_goss: bool = False
    goss_top_rate: float = 0.2
    goss_other_rate: float = 0.1
    use_histogram: bool = False
    max_bins: int = 255
    use_efb: bool = False
    allow_nan: bool = True
    min_sum_hessian_in_leaf: float = 1e-3
    lr_decay: float = 1.0
    warm_start: bool = False
    verbose: int = 0
    random_state: int | None = None

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> BoosterParams:
        """Unknown keys are left out."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    def validate(self) -> BoosterParams:
        rules = [
            ("num_iterations", self.num_iterations >= 1, "at least 1"),
            ("learning_rate", self.learning_rate > 0, "positive"),
            ("max_depth", self.max_depth == -1 or self.max_depth >= 1, "-1 or at least 1"),
            ("num_leaves", self.num_leaves >= 2, "at least 2"),
            ("min_data_in_leaf", self.min_data_in_leaf >= 0, "not negative"),
            ("lambda_l1", self.lambda_l1 >= 0, "not negative"),
            ("lambda_l2", self.lambda_l2 >= 0, "not negative"),
            ("min_gain_to_split", self.min_gain_to_split >= 0, "not negative"),
            ("feature_fraction", 0 < self.feature_fraction <= 1, "in (0, 1]"),
            ("bagging_fraction", 0 < self.bagging_fraction <= 1, "in (0, 1]"),
            ("max_bins", self.max_bins >= 2, "at least 2"),
            ("min_sum_hessian_in_leaf", self.min_sum_hessian_in_leaf > 0, "positive"),
            ("lr_decay", 0 < self.lr_decay <= 1, "in (0, 1]"),
            ("goss_top_rate", 0 < self.goss_top_rate < 1, "in (0, 1)"),
            ("goss_other_rate", 0 < self.goss_other_rate < 1, "in (0, 1)"),
            ("goss_top_rate + goss_other_rate", self.goss_top_rate + self.goss_other_rate < 1, "below 1"),
        ]
        for name, ok, what in rules:
            if not ok:
                raise ValueError(f"{name} must be {what}")
        return self


def validate_hyperparameters(*, num_iterations: int, learning_rate: float, max_depth: int, num_leaves: int, min_data_in_leaf: int) -> None:
    BoosterParams(num_iterations=num_iterations, learning_rate=learning_rate, max_depth=max_depth, num_leaves=num_leaves, min_data_in_leaf=min_data_in_leaf).validate()


class NotFittedError(ValueError):
    """An estimator was used before fit()."""


def check_is_fitted(estimator, attributes: list[str] | None = None) -> None:
    names = attributes or ["is_fitted_"]
    if not all(getattr(estimator, a, None) for a in names):
        raise NotFittedError(f"this {type(estimator).__name__} is not fitted; call fit() first")
