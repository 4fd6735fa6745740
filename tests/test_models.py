import pytest
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.operators import boosting as bo
from stockweave.operators import models as md
from stockweave.operators import recursion as rc
from stockweave.plans import model_queries as mq
from stockweave.schema import QTY, SKU, WEEK
from stockweave.sources import tables as tb


@pytest.fixture(scope="module")
def split(spark, sf):
    return mq._split(spark, sf)


@pytest.fixture(scope="module")
def fitted(split):
    return md.fit_two_stage(split[0], calibrate=True, segmented=True)


def test_tuning_block_is_the_end_of_training(split):
    rows, val = split
    r = rows.groupBy("is_tune").agg(F.min(WEEK).alias("a"), F.max(WEEK).alias("b")).collect()
    got = {x["is_tune"]: (x["a"], x["b"]) for x in r}
    assert got[True] == (wk.week_add(tb.CUTOFF_WEEK, -12), tb.CUTOFF_WEEK) and got[False][1] < got[True][0]
    assert val.agg(F.min(WEEK)).first()[0] > tb.CUTOFF_WEEK


def test_band_is_ordered_and_finite(split, fitted):
    out = md.interval_rows(md.score(split[1], fitted))
    bad = out.filter(
        "forecast_q10 > forecast_q50 or forecast_q50 > forecast_q90 or forecast_q10 < 0 or isnan(forecast_q50) or demand_prob not between 0 and 1"
    )
    assert out.count() == split[1].count() and bad.count() == 0


def test_calibration_is_monotone(split, fitted):
    rows = md.with_probability(split[1], fitted.classifier, fitted.calibrator).select("raw_prob", "demand_prob").distinct().collect()
    probs = [r["demand_prob"] for r in sorted(rows, key=lambda r: r["raw_prob"])]
    assert probs == sorted(probs)


def test_segment_falls_back_to_the_other(split):
    rows = split[0]
    only = md.segment_regressors(rows.filter(md.segment() == "sparse"))
    assert set(only) == {"sparse"}
    assert md.with_quantity(split[1], only).filter("log_qty is null").count() == 0
    assert md.segment_regressors(rows, min_rows=10**9) == {}


def test_importances_sum_to_one(split):
    pairs = md.importances(md.quantity_regressor(split[0]), n=100)
    assert sum(v for _, v in pairs) == pytest.approx(1.0)


def test_recursive_forecast_covers_every_series_and_week(spark, sf, fitted):
    state = mq._state(spark, sf)
    n = state.count()
    out = md.recursive_forecast(state, tb.CUTOFF_WEEK, 5, md.two_stage_predict(fitted), cut_every=2)
    assert out.count() == n * 5 and out.select(*SKU, WEEK).distinct().count() == n * 5
    assert sorted(r[0] for r in out.select(WEEK).distinct().collect()) == [200101, 200102, 200103, 200104, 200105]
    assert out.filter("forecast_q50 is null or forecast_q50 < 0 or forecast_q10 > forecast_q90").count() == 0


def test_one_pass_recursion_equals_the_step_by_step_one(spark, sf, split, fitted):
    fitted.bands, fitted.offsets = md.quantile_bands(split[0], {"rounds": 3, "depth": 3, "step": 0.3})
    state = md.stored(mq._state(spark, sf))
    slow = md.recursive_forecast(state, tb.CUTOFF_WEEK, 6, md.two_stage_predict(fitted), cut_every=3)
    df = rc.recursive_forecast(state, tb.CUTOFF_WEEK, 6, fitted.flat(), series=7)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r[SKU[0]], r[SKU[1]], r[WEEK])
    want, got = ({key(r): [r[b] for b in rc.BANDS] for r in x.collect()} for x in (slow, df))
    assert set(want) == set(got) and len(got) == state.count() * 6
    assert max(abs(a - b) / max(1, abs(a)) for k in want for a, b in zip(want[k], got[k])) < 1e-9
    one = md.one_stage(split[0], {**md.FULL, "maxIter": 4})
    slow = md.recursive_forecast(state, tb.CUTOFF_WEEK, 3, md.one_stage_predict(one))
    fast = rc.recursive_forecast(state, tb.CUTOFF_WEEK, 3, rc.FlatOneStage(bo.flatten(one)))
    want, got = ({key(r): r["forecast_q50"] for r in x.collect()} for x in (slow, fast))
    assert set(want) == set(got) and max(abs(want[k] - got[k]) / max(1, abs(want[k])) for k in want) < 1e-9


def test_bands_cover_the_tuning_rows(split):
    bands, offsets = md.quantile_bands(split[0], {"rounds": 2, "depth": 2, "step": 0.5})
    tune = split[0].filter("is_tune").filter(F.col(QTY) > 0)
    y = F.log1p(QTY)
    wide = F.when(md.segment() == "regular", offsets["regular"][1]).otherwise(offsets["sparse"][1])
    got = tune.groupBy(md.segment()).agg(F.avg(y.between(bands["lo"].column() - wide, bands["hi"].column() + wide).cast("int")), F.count("*")).collect()
    assert all(share >= 0.8 and share <= 0.8 + 1 / n + 1e-9 or n < 20 for _, share, n in got)


def test_recursion_feeds_its_own_forecast_back(spark, sf):
    """A stand-in predictor that echoes lag_1 + 1 must climb by one a week."""
    state = mq._state(spark, sf)

    def predict(df):
        q = F.col("lag_1") + 1.0
        return df.withColumns({f"forecast_q{p}": q for p in (10, 50, 90)})

    out = md.recursive_forecast(state, tb.CUTOFF_WEEK, 4, predict, cut_every=2)
    first = out.filter(F.col(WEEK) == 200101).select(*SKU, F.col("forecast_q50").alias("a"))
    last = out.filter(F.col(WEEK) == 200104).select(*SKU, F.col("forecast_q50").alias("b"))
    assert first.join(last, SKU).filter("b - a <> 3").count() == 0


def test_model_inputs_do_not_see_their_own_week(spark):
    """Changing a week's sale leaves every input of that week unchanged."""
    from tests.helpers import weekly

    y = [i % 4 for i in range(60)]
    inv = weekly(spark, {("c", "m"): [5] * 60}, category="Channel Inv.")
    last = wk.week_add(200001, 59)
    cols = [c for c in md.ft.MODEL_FEATURES if c not in ("zscore_vs_channel", "channel_nonzero_avg")]

    def inputs(series):
        base = md.base_frame(weekly(spark, {("c", "m"): series}).unionByName(inv))
        frame = md.ft.training_rows(md.ft.model_features(base, md.ft.channel_stats(base, F.col(WEEK) < last)))
        return frame.filter(F.col(WEEK) == last).select(*md.ft.MODEL_FEATURES).first()

    a, b = inputs(y), inputs(y[:-1] + [999])
    assert [a[c] for c in cols] == [b[c] for c in cols] and a == b
    assert QTY not in md.ft.MODEL_FEATURES


def test_no_segment_model_means_no_quantity(split):
    out = md.with_quantity(split[1], {})
    assert out.filter("log_qty <> 0").count() == 0


def test_segment_without_tuning_rows_is_trained(split):
    sparse = split[0].filter(md.segment() == "sparse")
    assert md.segment_regressors(sparse.filter("not is_tune"))["sparse"] is not None
    assert md.segment_regressors(sparse.filter("is_tune")) == {}


def test_short_folds_are_reported(spark, sf):
    folds = [(1, 199505, 199506, 199510), (2, 199506, 199507, 199512)]
    cv, rows = md.cross_validate(mq._base(spark, sf), folds, min_rows=10**6)
    assert sorted((r["fold"], r["skipped"], r["mae"]) for r in cv.collect()) == [(1, 1, None), (2, 1, None)]
    assert md.interval_rows(rows).count() == 0


def test_settings_are_seeded():
    assert md.sample_settings(5) == md.sample_settings(5) != md.sample_settings(5, seed=1)
