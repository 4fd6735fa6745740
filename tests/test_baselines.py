import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.operators import baselines as bl
from stockweave.operators import evaluate as ev
from stockweave.schema import SKU
from tests.helpers import weekly

FIRST = 199601


def recursion(y, h):
    """Plain per-series versions of the models, for comparison."""
    n = len(y)
    sold = [i for i in range(n) if y[i] > 0]
    out = {}
    out["seasonal_naive"] = [y[n - 52 + i % 52] if n >= 52 else y[-1] for i in range(h)]
    recent = float(np.mean(y[-12:]))
    out["rolling_average"] = [recent] * h
    blend = []
    for i in range(h):
        same = [y[p] for p in range(n) if (n + i - p) % 52 == 0]
        blend.append(0.5 * (np.mean(same) if same else recent) + 0.5 * recent)
    out["rolling_seasonal_mean"] = blend
    if not sold:
        c = t = 0.0
    else:
        size, gap, level, prob = y[sold[0]], sold[0] + 1.0, y[sold[0]], 1.0 / (sold[0] + 1)
        for a, b in zip(sold, sold[1:]):
            size, gap = 0.9 * size + 0.1 * y[b], 0.9 * gap + 0.1 * (b - a)
        for i in range(sold[0] + 1, n):
            prob = 0.9 * prob + (0.1 if y[i] > 0 else 0.0)
            level = 0.9 * level + 0.1 * y[i] if y[i] > 0 else level
        c = size / gap
        if len(sold) == 1:
            c = y[sold[0]] / sold[0] if sold[0] else y[sold[0]]
        t = prob * level
    out["croston"], out["sba"], out["tsb"] = [c] * h, [0.95 * c] * h, [t] * h
    return out


def cases(n):
    rng = np.random.default_rng(n)
    out = {("z", "zero"): [0] * n, ("z", "first"): [7] + [0] * (n - 1), ("z", "third"): [0, 0, 7] + [0] * (n - 3), ("z", "last"): [0] * (n - 1) + [5]}
    for i in range(25):
        share = rng.choice([0.02, 0.1, 0.5, 0.95])
        out[("r", f"s{i}")] = [int(v) for v in rng.integers(1, 60, n) * (rng.random(n) < share)]
    return out


@pytest.mark.parametrize("n", [26, 51, 52, 53, 130])
def test_closed_forms_equal_recursions(spark, n):
    data = cases(n)
    # every series needs one row to be known, zero rows stay for the all-zero ones
    df = weekly(spark, data, FIRST)
    sparse = df.filter((F.col("quantity") > 0) | (F.col("year_week") == FIRST))
    h = 60
    got = bl.run_models(sparse, FIRST, wk.week_add(FIRST, n - 1), h).collect()
    assert len(got) == len(data) * h * len(bl.MODELS)
    want = {k: recursion([float(v) for v in y], h) for k, y in data.items()}
    for r in got:
        exp = want[(r["Channel"], r["Material Description"])][r["model"]][r["step"] - 1]
        assert r["yhat"] == pytest.approx(exp, abs=1e-9), (r, exp)


def test_unknown_model_is_refused(spark):
    with pytest.raises(ValueError, match="unknown models"):
        bl.run_models(weekly(spark, {("a", "b"): [1]}), FIRST, FIRST, 1, ["nope"])


def test_forward_forecast_ignores_placeholder_weeks(spark):
    y = [(i % 52) + 1 for i in range(104)] + [0] * 19
    df = weekly(spark, {("c", "m"): y}, FIRST)
    cut = bl.last_sales_week(df)
    assert cut == wk.week_add(FIRST, 103)
    got = sorted(bl.naive_forecast(df, FIRST, cut, 13).collect(), key=lambda r: r["horizon_step"])
    assert [r["forecast_naive"] for r in got] == [float(i + 1) for i in range(13)]
    assert [r["year_week"] for r in got] == [wk.week_add(cut, i + 1) for i in range(13)]


def test_short_history_is_skipped(spark):
    df = weekly(spark, {("c", "m"): [1] * 25}, FIRST)
    assert bl.naive_forecast(df, FIRST, wk.week_add(FIRST, 24), 3).count() == 0


def test_user_model_pads_and_cleans(spark):
    df = weekly(spark, {("c", "m"): [1, 2, 3]}, FIRST)
    got = bl.user_model(df, FIRST, wk.week_add(FIRST, 2), 4, lambda y, h: [np.nan, -1.0, y.sum()])
    assert [r["yhat"] for r in sorted(got.collect(), key=lambda r: r["step"])] == [0.0, 0.0, 6.0, 0.0]


def test_folds_that_leak_are_refused(spark):
    df = weekly(spark, {("c", "m"): [1] * 60}, FIRST)
    with pytest.raises(ValueError, match="leaks"):
        ev.assign_folds(df, [(1, 199640, 199640, 199645)])


def test_walk_forward_equals_loop(spark):
    n, h = 100, 13
    data = cases(n + h)
    df = weekly(spark, data, FIRST)
    end = wk.week_add(FIRST, n - 1)
    folds = [(1, wk.week_add(end, -h), wk.week_add(end, 1 - h), end), (2, end, wk.week_add(end, 1), wk.week_add(end, h))]
    cv = {(r["fold"], r["model"]): r for r in ev.walk_forward(df, FIRST, folds).collect()}
    assert len(cv) == 10
    for fold, cut in ((1, n - h), (2, n)):
        for m in bl.SUITE:
            a, f = [], []
            for y in data.values():
                y = [float(v) for v in y]
                a += y[cut : cut + h]
                f += recursion(y[:cut], h)[m]
            a, f = np.array(a), np.array(f)
            r = cv[(fold, m)]
            assert r["mae"] == pytest.approx(np.abs(a - f).mean(), abs=1e-9)
            assert r["wape"] == pytest.approx(np.abs(a - f).sum() / a.sum() * 100, abs=1e-6)
            assert r["n_skus"] == len(data)


def test_skewed_channel(spark):
    """A third of all rows in one channel gives the same numbers per series."""
    data = {("hot", f"m{i}"): [i % 5, 0, 3] * 20 for i in range(40)} | {(f"c{i}", "m0"): [1, 0, 2] * 20 for i in range(80)}
    df = weekly(spark, data, FIRST)
    got = bl.run_models(df, FIRST, wk.week_add(FIRST, 59), 2, ["croston", "tsb"])
    for r in got.collect():
        exp = recursion([float(v) for v in data[(r["Channel"], r["Material Description"])]], 2)
        assert r["yhat"] == pytest.approx(exp[r["model"]][0], abs=1e-9)
