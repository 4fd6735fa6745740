import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.functions import scale


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; heavy ties."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", float(rng.choice([0, 1, 1, 2, rng.gauss(0, 50)]))) for _ in range(5000)]
    return rows, spark.createDataFrame(rows, "g string, x double")


def test_exact_percentiles_match_numpy(skewed):
    rows, df = skewed
    probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = scale.exact_percentiles(df, "x", probs).first().asDict()
    xs = [x for _, x in rows]
    for k, p in probs.items():
        assert got[k] == pytest.approx(np.quantile(xs, p), abs=1e-9)
    for r in scale.exact_percentiles(df, "x", probs, ["g"]).collect():
        xs = [x for g, x in rows if g == r["g"]]
        for k, p in probs.items():
            assert r[k] == pytest.approx(np.quantile(xs, p), abs=1e-9)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = random.Random(5)
    rows = [(float(v), rng.randrange(10)) for v in rng.sample(range(10_000), 3000)]
    df = spark.createDataFrame(rows, "o double, v long")
    got = {r["o"]: (r["cum_v"], r["all_v"]) for r in scale.running_totals(df, "o", ["v"], descending=descending).collect()}
    total, run = sum(v for _, v in rows), 0
    for o, v in sorted(rows, reverse=descending):
        run += v
        assert got[o] == (run, total)


def test_join_stats_above_the_limit_does_not_broadcast(spark, monkeypatch):
    stats = spark.range(50).select(F.col("id").cast("string").alias("g"), (F.col("id") * 2).alias("s"))
    assert "broadcast" in scale.broadcast_if_small(stats, 50)._jdf.queryExecution().toString().lower()
    big = scale.broadcast_if_small(stats, 10)
    assert "hint" not in big._jdf.queryExecution().logical().toString().lower()
    df = spark.createDataFrame([("1",), ("49",), ("99",)], "g string")
    got = {r["g"]: r["s"] for r in df.join(big, "g", "left").collect()}
    assert got == {"1": 2, "49": 98, "99": None}


def test_all_equal_values(spark):
    df = spark.createDataFrame([(3.0,)] * 20, "x double")
    assert scale.exact_percentiles(df, "x", {"m": 0.5}).first()["m"] == 3.0
