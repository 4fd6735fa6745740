import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.operators import metrics as mt
from stockweave.schema import SKU, WEEK


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, actual double, forecast double")


def test_perfect_forecast(spark):
    df = frame(spark, [("a", 0.0, 0.0), ("a", 3.0, 3.0), ("a", 8.0, 8.0)])
    r = mt.metric_suite(df, ["g"]).first()
    for m in ("smape", "wape", "active_wape", "bias", "pinball_50", "mae", "rmse"):
        assert r[m] == 0.0
    assert r["slp"] == 1.0 and r["demand_f1"] == 1.0


def test_hand_values_and_cleaning(spark):
    nan, inf = float("nan"), float("inf")
    df = frame(spark, [("a", 10.0, 6.0), ("a", 0.0, -2.0), ("a", 4.0, nan), ("a", 0.0, inf), ("b", 0.0, 1.0)])
    got = {r["g"]: r for r in mt.metric_suite(df, ["g"]).collect()}
    a = got["a"]
    assert a["mae"] == pytest.approx(2.0) and a["wape"] == pytest.approx(8 / 14 * 100)
    assert a["active_wape"] == pytest.approx(8 / 14 * 100) and a["slp"] == pytest.approx(0.5)
    assert a["demand_f1"] == pytest.approx(2 / 3) and a["rmse"] == pytest.approx(np.sqrt((16 + 16) / 4))
    assert got["b"]["wape"] == 0.0 and got["b"]["bias"] == 0.0 and got["b"]["demand_f1"] == 0.0


def test_diff_scale_walks_series_in_hash_order(spark):
    rng = random.Random(1)
    rows = [(f"c{i}", f"m{j}", w, float(rng.randrange(20))) for i in range(30) for j in range(3) for w in range(4)]
    df = spark.createDataFrame(rows, "Channel string, `Material Description` string, year_week int, actual double").withColumn("g", F.lit(1))
    key = lambda r: (hashlib.md5(f"{r[0]}|{r[1]}".encode()).hexdigest(), r[2])
    walk = [r[3] for r in sorted(rows, key=key)]
    assert mt.diff_scale(df, ["g"]).first()["scale"] == pytest.approx(np.abs(np.diff(walk)).mean(), abs=1e-12)
    single = df.filter("Channel = 'c0' and `Material Description` = 'm0' and year_week = 0")
    assert mt.diff_scale(single, ["g"]).first()["scale"] == pytest.approx(abs(rows[0][3]) + 1e-9)


def test_auc_and_youden_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(800)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert mt.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(auc, abs=1e-12)
    j = {t: sum(p >= t for p in pos) / len(pos) - sum(n >= t for n in neg) / len(neg) for t in {s for s, _ in rows}}
    best = max(j, key=lambda t: (round(j[t], 12), t))
    r = mt.youden_threshold(df, "s", "y").first()
    assert r["threshold"] == pytest.approx(min(max(best, 0.01), 0.95)) and r["youden_j"] == pytest.approx(j[best])


def test_auc_with_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert mt.roc_auc(df, "s", "y").first()["auc"] is None


def test_seasonal_mase(spark):
    from tests.helpers import weekly

    train = weekly(spark, {("c", "m"): [1] * 52 + [3] * 8})
    rows = spark.createDataFrame([("c", "m", 5.0, 4.0), ("c", "m", 5.0, 2.0)], "Channel string, `Material Description` string, actual double, forecast double")
    r = mt.mase_seasonal(rows, train, SKU, "quantity").first()
    assert r["scale"] == 2.0 and r["mase_seasonal"] == pytest.approx(1.0)
