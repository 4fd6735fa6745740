import pytest
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.operators import aggregates as ag
from stockweave.operators import blending as bd
from stockweave.operators import churn as ch
from stockweave.operators import demand_patterns as dp
from stockweave.operators import hierarchy as hi
from stockweave.operators import inventory as iv
from stockweave.operators import monitoring as mo
from stockweave.operators import quality as ql
from stockweave.operators import stock_planning as sp
from stockweave.operators import tracking as tk
from stockweave.schema import CHURN_TIERS, RISK_LEVELS
from tests.helpers import weekly

SKU_COLS = "Channel string, `Material Description` string"


def forecast(spark, rows):
    return spark.createDataFrame(rows, f"{SKU_COLS}, year_week int, forecast_q50 double")


@pytest.mark.parametrize("inv,week", [(10.0, 200002), (15.0, 200003), (16.0, None)])
def test_stockout_week(spark, inv, week):
    inventory = spark.createDataFrame([("c", "m", inv)], f"{SKU_COLS}, current_inventory double")
    fc = forecast(spark, [("c", "m", 200003, 5.0), ("c", "m", 200001, 5.0), ("c", "m", 200002, 5.0)])
    assert iv.stockout_weeks(inventory, fc).first()["stockout_week"] == week


@pytest.mark.parametrize("weeks,level", [(0.0, "CRITICAL"), (1.99, "CRITICAL"), (2.0, "HIGH"), (4.0, "MEDIUM"), (8.0, "LOW")])
def test_risk_levels(spark, weeks, level):
    df = spark.createDataFrame([(weeks,)], "w double")
    assert df.select(iv.risk_level("w")).first()[0] == level


def test_risk_needs_inventory_and_forecast(spark):
    inv = weekly(spark, {("c", "both"): [3, 0], ("c", "no_fc"): [4, 4], ("c", "zero"): [0, 0]}, category="Channel Inv.")
    fc = forecast(spark, [("c", "both", 200003, 1.0), ("c", "no_inv", 200003, 1.0)])
    rows = iv.risk_table(inv, fc, horizon=13).collect()
    assert [r["Material Description"] for r in rows] == ["both"]
    r = rows[0]
    assert r["current_inventory"] == 3.0 and r["last_inv_week"] == 200001
    assert r["avg_weekly_demand"] == pytest.approx(1 / 13)  # over the horizon, not over stored rows
    assert r["stockout_week"] is None and r["risk_level"] == "LOW"


def test_level_counts_fill_unused_levels(spark):
    df = spark.createDataFrame([("LOW",), ("LOW",)], "risk_level string")
    got = {r["risk_level"]: r["n"] for r in iv.level_counts(df, "risk_level", RISK_LEVELS).collect()}
    assert got == {"CRITICAL": 0, "HIGH": 0, "MEDIUM": 0, "LOW": 2}


@pytest.mark.parametrize("idle,tier", [(13, "ACTIVO"), (14, "MEDIO"), (26, "MEDIO"), (27, "ALTO")])
def test_churn_tier_borders(spark, idle, tier):
    n = 60
    # flat sales up to the last purchase; another customer keeps all weeks observed
    data = {("idle", "m"): [1] * (n - idle) + [0] * idle, ("busy", "m"): [5] * n}
    reference = wk.week_add(200001, n - 1)
    got = {r["Channel"]: r for r in ch.churn_table(weekly(spark, data), reference).collect()}
    last = wk.week_add(200001, n - idle - 1)
    flat = (reference // 100 - last // 100) * 52 + reference % 100 - last % 100
    assert got["idle"]["weeks_since_last_purchase"] == flat == idle
    assert got["idle"]["churn_risk"] == tier and got["busy"]["churn_risk"] == "ACTIVO"


def test_churn_trend_and_change_on_sparse_rows(spark):
    import numpy as np

    y = [0, 9, 0, 7, 7, 0, 3] * 6
    data = {("c", "m"): y, ("busy", "m"): [1] * len(y)}
    dense = ch.churn_table(weekly(spark, data), 200152).filter("Channel = 'c'").first()
    sparse = ch.churn_table(weekly(spark, data, keep_zero=False), 200152).filter("Channel = 'c'").first()
    slope = np.polyfit(range(26), y[-26:], 1)[0]
    change = (np.mean(y[-13:]) - np.mean(y[-26:-13])) / np.mean(y[-26:-13]) * 100
    for r in (dense, sparse):
        assert r["trend_slope"] == pytest.approx(slope) and r["volume_change_pct"] == pytest.approx(change)
        assert r["avg_weekly_volume"] == pytest.approx(np.mean(y))


def test_never_bought_and_new_customer(spark):
    data = {("never", "m"): [0] * 30, ("new", "m"): [0] * 29 + [4]}
    df = weekly(spark, data)
    ref = wk.week_add(200001, 29)
    assert [r["Channel"] for r in ch.never_bought(df, ref).collect()] == ["never"]
    rows = ch.churn_table(df, ref).collect()
    assert [(r["Channel"], r["volume_change_pct"]) for r in rows] == [("new", 100.0)]
    assert ch.churn_summary(ch.churn_table(df, ref)).first()["n_customers"] == 1
    assert len(CHURN_TIERS) == 4


def test_one_row_group_is_no_outlier(spark):
    df = weekly(spark, {("c", "m"): [5]})
    r = ql.with_zscore(df).first()
    assert r["z"] is None and ql.outlier_summary(df).first()["anomaly_count"] == 0


def test_duplicates_and_null_keys(spark):
    df = weekly(spark, {("c", "m"): [1, 2]})
    twice = df.unionByName(df)
    r = ql.duplicates(twice).first()
    assert (r["total_rows"], r["unique_key_rows"], r["duplicate_rows"]) == (4, 2, 2)
    from stockweave.operators.reshape import duplicate_report

    null_key = spark.createDataFrame([(None, "m", "Sell-in", 200001, 1.0)], df.schema)
    r = duplicate_report(twice.unionByName(null_key)).first()
    assert (r["rows_before"], r["rows_after"], r["null_key_rows"], r["duplicates_removed"]) == (5, 2, 1, 2)


def test_leakage_check_catches_wrong_lags(spark):
    from stockweave.operators.features import with_lags

    good = with_lags(weekly(spark, {("c", "m"): [1, 2, 3]}), (1,))
    assert ql.leakage(good).first()["lag_mismatches"] == 0
    bad = good.withColumn("lag_1", F.col("quantity"))
    assert ql.leakage(bad).first()["lag_mismatches"] == 3


def test_bias_factors_fall_back_to_global(spark):
    rows = [("c", "m", 10.0, 5.0, 0.9)] * 25 + [("c", "m", 100.0, 5.0, 0.1)] * 3
    df = spark.createDataFrame(rows, f"{SKU_COLS}, quantity_actual double, forecast_q50 double, demand_prob double")
    r = bd.bias_factors(df).first()
    assert r["regular"] == pytest.approx(2.0) and r["sparse"] == r["global"]
    assert r["global"] == pytest.approx((250 + 300) / 28 / 5)


def test_blend_prefers_model_and_keeps_early_weeks(spark):
    naive = spark.createDataFrame([("c", "m", 200005, 10.0), ("c", "n", 200005, 10.0)], f"{SKU_COLS}, year_week int, forecast_naive double")
    model = spark.createDataFrame(
        [("c", "m", 200005, 1.0, 2.0, 3.0), ("c", "m", 200004, 4.0, 5.0, 6.0), ("c", "x", 200005, 9.0, 9.0, 9.0)],
        f"{SKU_COLS}, year_week int, forecast_q10 double, forecast_q50 double, forecast_q90 double",
    )
    for start in (None, 200005):
        got = {(r["Material Description"], r["year_week"]): (r["forecast_q10"], r["forecast_q50"], r["forecast_q90"], r["source"]) for r in bd.blend(naive, model, naive_start=start).collect()}
        assert got == {
            ("m", 200005): (1.0, 2.0, 3.0, "model"), ("m", 200004): (4.0, 5.0, 6.0, "model"),
            ("n", 200005): (4.5, 10.0, 16.0, "seasonal_naive"),
        }


def test_projection_equals_recursion(spark):
    import random

    rng = random.Random(2)
    rows, want = [], {}
    for i in range(20):
        inv, start = float(rng.randrange(20)), None
        start = inv
        for w in range(15):
            a, b = float(rng.randrange(12)), float(rng.randrange(14))
            rows.append(("c", f"m{i}", 200001 + w, start, a, b))
            inv = max(0.0, inv + a - b)
            want[(f"m{i}", 200001 + w)] = inv
    df = spark.createDataFrame(rows, f"{SKU_COLS}, year_week int, s double, a double, b double")
    for r in sp.project_inventory(df, "s", "a", "b").collect():
        assert r["projected_inv"] == pytest.approx(want[(r["Material Description"], r["year_week"])])


@pytest.mark.parametrize(
    "ys,quad,segment",
    [([1] * 52, "smooth", "regular"), ([0, 0, 5] * 17 + [0], "intermittent", "intermittent"), ([0] * 52, "dead", "dead"),
     ([0] * 50 + [3, 3], "rare", "rare"), ([0, 1, 0, 100] * 13, "lumpy", "intermittent"), ([1, 40] * 26, "erratic", "intermittent")],
)
def test_demand_classes(spark, ys, quad, segment):
    df = weekly(spark, {("c", "m"): ys})
    r = dp.series_registry(df, wk.week_add(200001, 51)).first()
    assert (r["quadrant"], r["segment"]) == (quad, segment)


def test_quantiles_are_put_in_order(spark):
    df = spark.createDataFrame([(5.0, 3.0, 4.0), (1.0, 2.0, 3.0)], "a double, b double, c double")
    assert sorted(tuple(r) for r in hi.ordered_quantiles(df, ["a", "b", "c"]).collect()) == [(1.0, 2.0, 3.0), (5.0, 5.0, 5.0)]
    got = {r["pair"]: r["violations"] for r in hi.quantile_violations(df, ["a", "b", "c"]).collect()}
    assert got == {"a>b": 1, "b>c": 0}


def test_shares_add_up(spark, sf):
    from stockweave.sources import tables as tb

    p = hi.proportions(tb.sell_in(spark, sf, "fine"), 200144)
    sums = p.groupBy("product_family", "Channel").agg(F.sum("normalized_proportion").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) or r["s"] == 0.0 for r in sums) and any(r["s"] > 0 for r in sums)


def test_stability_index_is_zero_for_equal_samples(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"), F.lit("a").alias("s"))
    both = df.unionByName(df.withColumn("s", F.lit("b")))
    r = mo.stability_index(both, ["x"], F.col("s") == "a", F.col("s") == "b").first()
    assert r["psi"] == pytest.approx(0.0, abs=1e-12) and r["status"] == "green"


def test_promotion_gates(spark):
    df = spark.createDataFrame(
        [("old", 50.0, 10.0, 1), ("good", 40.0, 12.0, 1), ("small", 49.0, 1.0, 1), ("biased", 40.0, 30.0, 1), ("leaky", 40.0, 1.0, 0)],
        "model string, smape double, bias double, leakage_ok int",
    )
    got = {r["model"]: r["failed_gates"] for r in mo.promotion(df, "old").collect()}
    assert got == {"good": "", "small": "smape", "biased": "bias", "leaky": "leakage"}


def test_best_run_modes(spark):
    runs = spark.createDataFrame([("a", "e", "r1", 1), ("b", "e", "r2", 2), ("c", "x", "r3", 3)], "run_id string, experiment string, run_name string, start_time int")
    metrics = spark.createDataFrame([("a", "mae", 2.0), ("b", "mae", 1.0), ("c", "mae", 0.0)], "run_id string, key string, value double")
    assert tk.best_run(runs, metrics, "e", "mae").first()["run_id"] == "b"
    assert tk.best_run(runs, metrics, "e", "mae", "max").first()["run_id"] == "a"
    assert [r["run_id"] for r in tk.runs_with_metrics(runs, metrics, "e", ["mae"]).collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        tk.best_run(runs, metrics, "e", "mae", "median")


def test_clipped_trend_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x, y = rng.gamma(1, 10, 400), rng.gamma(1, 5, 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = ag.clipped_trends(df, [("x", "y")]).first()
    cx, cy = np.clip(x, 0, np.quantile(x, 0.95)), np.clip(y, 0, np.quantile(y, 0.95))
    slope, intercept = np.polyfit(cx, cy, 1)
    assert (r["slope"], r["intercept"], r["r"]) == pytest.approx((slope, intercept, np.corrcoef(cx, cy)[0, 1]))
