import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.booster import BoostedClassifier, BoostedRegressor, EarlyStoppingCallback
from sylvan.functions.losses import BinaryCrossEntropyLoss, HuberLoss, MSELoss, QuantileLoss, get_loss_function
from sylvan.operators import sampling
from sylvan.operators.bundling import FeatureBundler
from sylvan.operators.split import Rules, leaf_value
from sylvan.params import BoosterParams, NotFittedError
from sylvan.sources.ingest import check_frame, from_arrays


def column(spark, expression, **values):
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*values.values(), strict=True)], list(values))
    return [r[0] for r in df.select(expression.alias("v")).collect()]


def test_losses(spark):
    y, f = F.col("y"), F.col("f")
    assert np.allclose(column(spark, MSELoss().gradient(y, f), y=[1, 2, 3], f=[1.5, 1.8, 3.2]), [0.5, -0.2, 0.2])
    p = 1 / (1 + np.exp(-np.array([-1, 2, 0.5])))
    assert np.allclose(column(spark, BinaryCrossEntropyLoss().gradient(y, f), y=[0, 1, 1], f=[-1, 2, 0.5]), p - [0, 1, 1])
    assert np.allclose(column(spark, HuberLoss(1.0).gradient(y, f), y=[0, 0], f=[0.5, 3]), [0.5, 1])
    assert np.allclose(column(spark, QuantileLoss(0.8).value(y, f), y=[2, 0], f=[0, 1]), [1.6, 0.2])
    with pytest.raises(ValueError):
        get_loss_function("nope")
    with pytest.raises(ValueError):
        QuantileLoss(1.0)


def test_leaf_value():
    assert leaf_value(-1.0, 3.0, Rules()) == pytest.approx(1 / 3)
    assert leaf_value(-1.0, 3.0, Rules(lambda_l2=1.0)) == pytest.approx(0.25)
    assert leaf_value(-1.0, 3.0, Rules(lambda_l1=2.0)) == 0


def test_params():
    assert BoosterParams.from_dict({"num_leaves": 7, "other": 1}).num_leaves == 7
    with pytest.raises(ValueError):
        BoosterParams(learning_rate=0).validate()
    assert BoostedRegressor(n_estimators=3).num_iterations == 3


def test_checks(spark):
    with pytest.raises(ValueError):
        check_frame(from_arrays(spark, [[np.inf]], [1]), ["f_0"], "label")
    with pytest.raises(ValueError):
        check_frame(from_arrays(spark, [[1.0]], [1], [-1]), ["f_0"], "label", "weight")
    with pytest.raises(NotFittedError):
        BoostedRegressor().predict(from_arrays(spark, [[1.0]]))


@pytest.mark.parametrize("histogram", [True, False])
def test_regressor(spark, tmp_path, histogram):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = 3 * x[:, 0] + 2 * x[:, 1]
    x[0, 0] = np.nan
    m = BoostedRegressor(num_iterations=4, learning_rate=0.5, use_histogram=histogram, min_data_in_leaf=5, num_leaves=8).fit(x, y)
    loss = m.history_["train_loss"]
    assert loss == sorted(loss, reverse=True) and m.score(x, y) > 0.8
    assert m.feature_importances_.sum() == pytest.approx(1)
    m.save_model(str(tmp_path / "m.json"))
    assert np.allclose(BoostedRegressor().load_model(str(tmp_path / "m.json")).predict(x), m.predict(x))


def test_classifier_and_early_stop(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 2))
    y = np.digitize(x[:, 0], [-0.5, 0.5]).astype(float) + 1
    m = BoostedClassifier(num_iterations=3, learning_rate=0.5, use_histogram=True, min_data_in_leaf=5, num_leaves=5).fit(x, y, eval_set=(x, y), callbacks=[EarlyStoppingCallback(1, 100.0)])
    assert m.n_iter_ == 2 and m.score(x, y) > 0.9
    assert np.allclose(m.predict_proba(x).sum(1), 1) and set(m.predict(x)) <= {1.0, 2.0, 3.0}


def test_sampling_holds_over_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 37).cast("double").alias("g"), F.lit(1.0).alias("h"))
    a = sampling.GOSS(0.2, 0.1, 3).sample(df)
    rows = {(r.row_id, r.goss_weight) for r in a.collect()}
    assert rows == {(r.row_id, r.goss_weight) for r in sampling.GOSS(0.2, 0.1, 3).sample(df.repartition(5)).collect()}
    assert sorted(w for _, w in rows) == [1.0] * 200 + [8.0] * 100
    train, test = sampling.train_test_split(df, test_size=0.2, random_state=1, stratify="h")
    assert (train.count(), test.count()) == (800, 200)


def test_bundles(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0],), ([0.0, 2.0, 1.0],), ([0.0, 0.0, 3.0],)], "x array<double>")
    b = FeatureBundler().fit(df, 3)
    assert b.bundles_ == [[0, 1], [2]] and b.offsets_ == [[0, 2.0], [0]]
    assert [r.x for r in b.transform(df).collect()] == [[1.0, 0.0], [4.0, 1.0], [0.0, 3.0]]
