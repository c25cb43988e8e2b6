"""Bins of features with few distinct values, and the rounds that are trained on them."""

import numpy as np
import pytest

from sylvan import queries
from sylvan.operators.binning import bin_edges, middles

duckdb = pytest.importorskip("duckdb")


def edges(spark, values, max_bins=255):
    return bin_edges(spark.createDataFrame([([float(v)],) for v in values], "x array<double>"), 1, max_bins)[0]


def test_each_of_few_values_has_a_bin(spark):
    # The quantiles of these are 0, 0, 2, 3, 4, 4: as edges they join 0 with 1.
    values = np.repeat([0, 1, 2, 3, 4], [21, 18, 20, 20, 21])
    assert edges(spark, [*values, np.nan]) == [0.5, 1.5, 2.5, 3.5]
    assert edges(spark, [0] * 99 + [1]) == [0.5]
    assert edges(spark, [3, 3]) == [] and edges(spark, [np.nan]) == []
    assert edges(spark, range(9), 4) == [2, 4, 6]  # more values than bins: quantiles, as before


def test_middles_lie_below_the_upper_neighbour():
    v = np.array([-1.7e308, 1.0, np.nextafter(1.0, 2), np.nextafter(np.nextafter(1.0, 2), 2), 1.7e308])
    assert ((v[:-1] <= middles(v)) & (middles(v) < v[1:])).all()


@pytest.fixture(scope="module")
def uneven(spark, tmp_path_factory):
    """lineitem with most rows in the first and the last fifth of l_quantity and a price that jumps behind the second one."""
    q = np.repeat([5, 15, 25, 35, 45], [105, 90, 100, 100, 105]).tolist()
    rows = [(i, 1, float(v), 1000.0 * (v > 20) + i % 7, 0.05, 0.01 * (i % 3), "R" if v > 20 and i % 3 else "N") for i, v in enumerate(q)]
    folder = tmp_path_factory.mktemp("uneven")
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def holds(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, folder)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_classifier_rounds_cut_at_each_value(spark, uneven):
    holds(spark, uneven, "classifier_rounds")


def test_regressor_rounds_cut_at_each_value(spark, uneven):
    holds(spark, uneven, "regressor_rounds")
