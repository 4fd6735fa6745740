import pytest
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.operators import features as ft
from stockweave.operators.reshape import densify, sum_duplicates
from stockweave.schema import SERIES, SKU, WEEK
from stockweave.sources import tables as tb
from tests.helpers import by_week, weekly

Y = [0, 5, 0, 0, 3, 0, 7]


def test_hand_series(spark):
    df = ft.series_features(weekly(spark, {("c", "m"): Y}))
    got = by_week(df, "lag_1", "rolling_std_12", "weeks_since_last_sale", "intermittent_flag")
    std = [None, None, 3.5355339059, 2.8867513459, 2.5, 2.3021728866, 2.1602468995]
    assert [g[0] for g in got] == [None, 0, 5, 0, 0, 3, 0]
    assert [g[1] if g[1] is None else pytest.approx(g[1], abs=1e-9) for g in got] == std
    assert [g[2] for g in got] == [0, 1, 0, 1, 2, 0, 1]
    assert [g[3] for g in got] == [0, 1, 0, 1, 1, 1, 1]


def test_zero_series_counts_up(spark):
    df = ft.with_recency(weekly(spark, {("c", "m"): [0] * 6}))
    assert [g[0] for g in by_week(df, "weeks_since_last_sale")] == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("n", [51, 52, 53])
def test_lag_52_needs_53_weeks(spark, n):
    df = ft.with_lags(weekly(spark, {("c", "m"): list(range(1, n + 1))}))
    got = [g[0] for g in by_week(df, "lag_52")]
    assert got == [None] * min(n, 52) + [1.0] * max(0, n - 52)


def test_future_rows_do_not_change_the_past(spark):
    a = weekly(spark, {("c", "m"): Y, ("d", "m"): Y[::-1]})
    b = weekly(spark, {("c", "m"): Y + [9, 1, 0], ("d", "m"): Y[::-1] + [4, 4, 4]})
    last = wk.week_add(200001, len(Y) - 1)
    cols = [*SERIES, WEEK, *ft.LAG_FEATURES, *ft.ROLLING_FEATURES, "weeks_since_last_sale", "intermittent_flag"]
    x = ft.series_features(a).select(cols)
    y = ft.series_features(b).filter(F.col(WEEK) <= last).select(cols)
    assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))


def test_row_order_does_not_matter(spark):
    df = weekly(spark, {("c", "m"): Y, ("d", "n"): Y})
    a = ft.series_features(df).collect()
    b = ft.series_features(df.orderBy(F.rand(1)).repartition(5)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_densify_fills_every_week_once(spark):
    df = weekly(spark, {("c", "m"): [0, 0, 4, 0, 6], ("d", "m"): [1]}, keep_zero=False)
    out = densify(df, SERIES, 200001, 200010, cluster=SKU)
    got = {k: [] for k in "cd"}
    for r in sorted(out.collect(), key=lambda r: (r["Channel"], r[WEEK])):
        got[r["Channel"]].append(r["quantity"])
    assert got == {"c": [0, 0, 4, 0, 6, 0, 0, 0, 0, 0], "d": [1] + [0] * 9}
    assert out.select(*SERIES, WEEK).distinct().count() == out.count()


def test_dense_rows_are_not_shuffled(spark, sf):
    plan = ft.gold(tb.dense_table(spark, sf, "coarse"))._jdf.queryExecution().executedPlan().toString()
    head = plan[: plan.index("Generate")]
    assert "Exchange" not in head, "windows after gap filling must reuse its partitioning"


def test_null_keys_are_dropped(spark):
    rows = [(None, "m", "Sell-in", 200001, 1.0), ("c", "m", "Sell-in", 200001, 2.0), ("c", "m", "Sell-in", 200001, 3.0)]
    df = spark.createDataFrame(rows, "Channel string, `Material Description` string, Category string, year_week int, quantity double")
    assert [r["quantity"] for r in sum_duplicates(df).collect()] == [5.0]


def test_invariants_over_all_series(spark, sf):
    df = ft.gold(tb.dense_table(spark, sf, "coarse")).cache()
    first = df.groupBy(*SERIES).agg(F.min(WEEK).alias("_f"))
    at_first = df.join(first, SERIES).filter(F.col(WEEK) == F.col("_f"))
    assert at_first.filter("lag_1 is not null or lag_52 is not null or rolling_mean_4 is not null").count() == 0
    assert df.filter("quantity < 0 or weeks_since_last_sale < 0").count() == 0
    assert df.filter("intermittent_flag not in (0.0, 1.0)").count() == 0
    assert df.select(*SERIES, WEEK).distinct().count() == df.count()
    assert not [c for c in df.columns if "future" in c.lower()]
    df.unpersist()


def test_history_array_and_its_features_match_windows(spark):
    ys = [0, 3, 0, 0, 2, 5, 0] * 20
    df = weekly(spark, {("c", "m"): ys, ("d", "m"): [4] + [0] * 139}, keep_zero=False)
    last = wk.week_add(200001, len(ys) - 1)
    hist = {r["Channel"]: r["hist"] for r in ft.latest_history(df, last).collect()}
    assert hist["c"] == [float(y) for y in ys[-104:]] and hist["d"] == [0.0] * 104
    week = wk.week_add(last, 1)
    got = ft.latest_history(df, last).select("Channel", *[c.alias(k) for k, c in ft.array_features("hist", F.lit(week)).items()])
    dense = densify(df, SERIES, 200001, week)
    want = ft.series_features(dense).filter(F.col(WEEK) == week)
    g = {r["Channel"]: r for r in got.collect()}["c"]
    w = {r["Channel"]: r for r in want.collect()}["c"]
    for k in [*ft.LAG_FEATURES, *ft.ROLLING_FEATURES, "weeks_since_last_sale", "intermittent_flag", "week_sin", "week_cos"]:
        assert g[k] == pytest.approx(w[k], abs=1e-9)


def test_days_of_supply(spark):
    sold = weekly(spark, {("c", "m"): [7, 0]})
    inv = weekly(spark, {("c", "m"): [14, 5]}, category="Channel Inv.")
    got = by_week(ft.with_days_of_supply(sold.unionByName(inv)), "year_week", "inventory_days_of_supply")
    assert got == [(200001, 14.0), (200001, 14.0), (200002, None), (200002, None)]


def test_series_ids_are_dense(spark, sf):
    ids = [r["series_id"] for r in ft.series_ids(tb.long_table(spark, sf, "fine")).collect()]
    assert sorted(ids) == list(range(len(ids)))
