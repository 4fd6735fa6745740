"""Order statistics by counting, flat trees, pinball and Huber boosting."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from stockweave.functions import scale
from stockweave.operators import boosting as bo


def frame(spark, x, y, tune=None):
    rows = [(r.tolist(), float(v), bool(t)) for r, v, t in zip(x, y, tune if tune is not None else np.zeros(len(y), bool))]
    df = spark.createDataFrame(rows, "x array<double>, y double, is_tune boolean")
    return df.select(array_to_vector("x").alias("features"), "y", "is_tune").cache()


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(0)
    data = {0: rng.standard_normal(3000), 1: rng.integers(0, 4, 500).astype(float), 2: np.array([7.0]), 3: np.geomspace(1e-300, 1e300, 701),
            4: np.array([-1.7e308, 1.7e308, 0.0]), 5: np.repeat([1.0, 1.0 + 2**-52], [30, 20])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [(0, None), (6, float("nan")), (1, None)]
    df = spark.createDataFrame(rows, "key int, v double").repartition(4)
    for few in (0, 40, 10**6):
        got = scale.order_statistics(df, lambda n: [1, max(1, n // 3), (n + 1) // 2, n], few=few)
        assert set(got) == set(data)
        for k, vs in data.items():
            s = np.sort(vs)
            assert got[k] == {r: s[r - 1] for r in got[k]}


def test_percentiles_of_many_columns_and_no_sort(spark):
    rng = np.random.default_rng(1)
    a, b = rng.gamma(2, 10, 800), rng.integers(0, 9, 800).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, c double")
    got = scale.percentiles(df, {"a": [0.25, 0.5, 0.99], "b": [0.5], "c": [0.5]})
    assert got["a"] == pytest.approx(np.percentile(a, [25, 50, 99]).tolist()) and got["b"] == [np.percentile(b, 50)] and got["c"] == [None]


def test_flat_trees_score_like_the_models(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 5))
    df = frame(spark, x, (x[:, 0] * x[:, 1] > 0).astype(float))
    reg = GBTRegressor(featuresCol="features", labelCol="y", maxIter=6, maxDepth=4, seed=1).fit(df)
    want = [r[0] for r in reg.transform(df).select("prediction").collect()]
    assert np.allclose(bo.flatten(reg).predict(x), want, atol=1e-12, rtol=0)
    clf = GBTClassifier(featuresCol="features", labelCol="y", maxIter=5, maxDepth=3, seed=1).fit(df)
    want = [r[0] for r in clf.transform(df).select(vector_to_array("probability")[1]).collect()]
    assert np.allclose(1 / (1 + np.exp(-2 * bo.flatten(clf).predict(x))), want, atol=1e-12, rtol=0)


def test_pinball_boosting_follows_the_spread(spark):
    """Where noise grows with x, the band must: lower pinball loss than one constant band, right coverage."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (4000, 3))
    y = 2 * x[:, 0] + (0.1 + 2 * x[:, 1]) * rng.standard_normal(4000)
    test, tune = np.arange(4000) >= 2800, (np.arange(4000) % 5 == 0)
    df = frame(spark, x[~test], y[~test], tune[~test])
    loss = lambda q, r: np.maximum(q * r, (q - 1) * r).mean()
    band = {}
    for q in (0.1, 0.9):
        band[q] = bo.boost(df, bo.Pinball(q), F.col("y"), rounds=8, depth=3, step=0.4).predict(x[test])
        constant = 2 * x[test][:, 0] + np.quantile((y - 2 * x[:, 0])[~test], q)
        assert loss(q, y[test] - band[q]) < loss(q, y[test] - constant)
    inside = (band[0.1] <= y[test]) & (y[test] <= band[0.9])
    assert 0.74 < inside.mean() < 0.86
    wide = band[0.9] - band[0.1]
    assert wide[x[test][:, 1] > 0.8].mean() > 2 * wide[x[test][:, 1] < 0.2].mean()


def test_huber_boosting_bears_outliers(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (3000, 3))
    clean = 10 + 8 * x[:, 0] + 4 * (x[:, 1] > 0.5)
    y = clean + rng.standard_normal(3000)
    y[:2000][rng.random(2000) < 0.05] += 400.0
    df = frame(spark, x[:2000], y[:2000])
    huber = bo.boost(df, bo.Huber(), F.col("y"), rounds=8, depth=3, step=0.4).predict(x[2000:])
    squared = bo.flatten(GBTRegressor(featuresCol="features", labelCol="y", maxIter=8, maxDepth=3, stepSize=0.4, seed=1).fit(df))
    wape = lambda f: np.abs(f - clean[2000:]).sum() / clean[2000:].sum()
    assert wape(huber) < 0.5 * wape(squared.predict(x[2000:])) and wape(huber) < 0.1


def test_no_rows_and_no_tuning_rows(spark):
    empty = frame(spark, np.zeros((0, 2)), [])
    assert bo.boost(empty, bo.Pinball(0.5), F.col("y"), rounds=2).predict(np.zeros((3, 2))).tolist() == [0.0] * 3
    one = frame(spark, np.zeros((20, 2)), np.arange(20.0))
    assert bo.boost(one, bo.Pinball(0.5), F.col("y"), rounds=2).predict(np.zeros((1, 2)))[0] == pytest.approx(9.0)
