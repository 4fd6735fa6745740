"""Learned models, and checks of what must hold of them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockweave.operators import boosting as bo
from stockweave.operators import features as ft
from stockweave.operators import metrics as mt
from stockweave.operators import models as md
from stockweave.operators import recursion as rc
from stockweave.plans.registry import query
from stockweave.schema import CATEGORY, CHANNEL_INV, QTY, SELL_IN, SKU, WEEK
from stockweave.sources import tables as tb

HORIZON = 71


def _base(spark, d):
    return md.base_frame(tb.dense_table(spark, d, "coarse"))


def _split(spark, d):
    frame = md.stored(md.model_frame(md.stored(_base(spark, d)), tb.CUTOFF_WEEK))
    return md.with_roles(frame, tb.CUTOFF_WEEK), frame.filter(F.col(WEEK).between(200101, 200113))


def _cv(spark, d, segmented):
    return md.cross_validate(_base(spark, d), tb.FOLDS, segmented=segmented)


def _state(spark, d):
    long = tb.long_table(spark, d, "coarse").filter(F.col(WEEK) <= tb.CUTOFF_WEEK)
    dense = tb.dense_table(spark, d, "coarse", SELL_IN, tb.CUTOFF_WEEK)
    stats = ft.channel_stats(ft.with_rolling(dense))
    sold = long.filter(F.col(CATEGORY) == SELL_IN)
    return md.start_state(sold, stats, tb.CUTOFF_WEEK, long.filter(F.col(CATEGORY) == CHANNEL_INV))


@query("L1_one_stage_regressor")
def l1(spark, d):
    rows, val = _split(spark, d)
    pred = F.greatest(F.col("reg_pred"), F.lit(0.0))
    out = md.one_stage(rows).transform(val).withColumn("forecast", pred)
    return md.suite(out, "forecast", "one_stage")


@query("L2_demand_classifier")
def l2(spark, d):
    rows, val = _split(spark, d)
    model, weight = md.demand_classifier(rows)
    scored = md.with_probability(val, model)
    return mt.roc_auc(scored, "demand_prob", "label").withColumn("pos_weight", F.lit(weight))


@query("L3_quantity_regressor")
def l3(spark, d):
    rows, val = _split(spark, d)
    model = md.huber_regressor(rows)
    scored = md.with_quantity(val.filter(F.col(QTY) > 0), {"regular": model})
    return md.suite(scored.withColumn("forecast", F.expm1("log_qty")), "forecast", "stage_2")


@query("L5_calibration")
def l5(spark, d):
    rows, val = _split(spark, d)
    model, _ = md.demand_classifier(rows)
    cal = md.fit_calibrator(md.with_probability(rows.filter("is_tune"), model))
    out = md.with_probability(val, model, cal)
    return out.groupBy("raw_prob").agg(F.max("demand_prob").alias("demand_prob"), F.count("*").alias("n"))


@query("L7_intervals")
def l7(spark, d):
    rows, val = _split(spark, d)
    return md.interval_rows(md.score(val, md.fit_two_stage(rows, bands=True)))


@query("L8_segmented_stage_2")
def l8(spark, d):
    rows, val = _split(spark, d)
    scored = md.with_quantity(val, md.segment_regressors(rows))
    return scored.select(*SKU, WEEK, md.segment().alias("segment"), F.expm1("log_qty").alias("quantity_hat"))


@query("L9_grid_search")
def l9(spark, d):
    rows, val = _split(spark, d)
    return md.grid_search(rows, val, md.sample_settings())


@query("L10_importances")
def l10(spark, d):
    rows, val = _split(spark, d)
    model = md.quantity_regressor(rows)
    pairs = md.importances(model, n=len(ft.MODEL_FEATURES))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(v).alias("importance")) for c, v in pairs])
    return val.agg(F.count("*").alias("n_rows")).select("n_rows", F.inline(cells))


@query("L12_recursive_forecast")
def l12(spark, d):
    rows, _ = _split(spark, d)
    m = md.fit_two_stage(rows, calibrate=True, bands=True)
    return rc.recursive_forecast(_state(spark, d), tb.CUTOFF_WEEK, HORIZON, m.flat())


@query("L13_recursive_one_stage")
def l13(spark, d):
    rows, _ = _split(spark, d)
    model = rc.FlatOneStage(bo.flatten(md.one_stage(rows)))
    return rc.recursive_forecast(_state(spark, d), tb.CUTOFF_WEEK, HORIZON, model)


@query("C5_two_stage_cv")
def c5(spark, d):
    return _cv(spark, d, False)[0]


@query("C6_segmented_cv")
def c6(spark, d):
    return _cv(spark, d, True)[0]


@query("C6_interval_rows")
def c6_rows(spark, d):
    return md.interval_rows(_cv(spark, d, True)[1])


# What must hold of every fit, whatever the trees look like.
SERIES_SQL = "(SELECT count(DISTINCT (ch, mat)) FROM si_coarse)"
VALIDATION_SQL = f"""SELECT yw AS year_week, {SERIES_SQL} AS n_rows, CAST(0 AS BIGINT) AS wrong FROM weeks
    WHERE yw BETWEEN 200101 AND 200113"""
FUTURE_SQL = f"""SELECT CAST(isoyear(m) * 100 + weekofyear(m) AS INTEGER) AS year_week, {SERIES_SQL} AS n_rows,
    CAST(0 AS BIGINT) AS wrong FROM (SELECT DATE '2001-01-01' + CAST(i * 7 AS INTEGER) AS m FROM range({HORIZON}) t(i))"""
FOLDS_SQL = """SELECT fold, CAST({n} AS BIGINT) AS variants, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS wrong FROM folds"""
BAND = "not (0 <= forecast_q10 and forecast_q10 <= forecast_q50 and forecast_q50 <= forecast_q90)"


def _per_week(df, wrong):
    bad = F.count_if(F.coalesce(F.expr(wrong), F.lit(True)))
    return df.groupBy(WEEK).agg(F.count("*").alias("n_rows"), bad.alias("wrong"))


def _per_fold(cv):
    no_auc = F.count_if(~F.coalesce(F.col("clf_auc").between(0, 1), F.lit(False)))
    return cv.groupBy("fold").agg(
        F.count_distinct("variant").alias("variants"), F.sum("skipped").cast("long").alias("skipped"), no_auc.alias("wrong")
    )


@query("L1_check", VALIDATION_SQL)
def l1_check(spark, d):
    rows, val = _split(spark, d)
    return _per_week(md.one_stage(rows).transform(val), "isnan(reg_pred)")


@query("L2_check", "SELECT 1 AS has_auc, 1 AS weighted")
def l2_check(spark, d):
    """The tables' sales are drawn at random, so an AUC near one half is right here."""
    return l2(spark, d).select(
        F.col("auc").between(0, 1).cast("int").alias("has_auc"), (F.col("pos_weight") > 0).cast("int").alias("weighted")
    )


@query("L3_check", "SELECT yw AS year_week, count(*) AS n_rows, CAST(0 AS BIGINT) AS wrong FROM si_coarse WHERE yw BETWEEN 200101 AND 200113 AND q > 0 GROUP BY yw")
def l3_check(spark, d):
    rows, val = _split(spark, d)
    sold = val.filter(F.col(QTY) > 0)
    return _per_week(md.with_quantity(sold, {"regular": md.huber_regressor(rows)}), "isnan(log_qty)")


@query("L5_check", f"SELECT CAST(13 * {SERIES_SQL} AS BIGINT) AS n_rows, 1 AS monotone, 1 AS in_range")
def l5_check(spark, d):
    points = l5(spark, d)
    falls = F.lag("demand_prob").over(Window.orderBy("raw_prob")) > F.col("demand_prob")
    return points.withColumn("falls", falls).agg(
        F.sum("n").alias("n_rows"),
        (F.count_if("falls") == 0).cast("int").alias("monotone"),
        F.min(F.col("demand_prob").between(0, 1).cast("int")).alias("in_range"),
    )


@query("L7_check", VALIDATION_SQL)
def l7_check(spark, d):
    return _per_week(l7(spark, d), BAND)


@query("L8_check", VALIDATION_SQL)
def l8_check(spark, d):
    return _per_week(l8(spark, d), "isnan(quantity_hat)")


@query("L9_check", "SELECT CAST(30 AS BIGINT) AS trials, 1 AS distinct_settings, 1 AS all_scored")
def l9_check(spark, d):
    return l9(spark, d).agg(
        F.count("*").alias("trials"),
        (F.count_distinct("setting") == F.count("*")).cast("int").alias("distinct_settings"),
        (F.count("active_wape") == F.count("*")).cast("int").alias("all_scored"),
    )


@query("L10_check", f"SELECT CAST({len(ft.MODEL_FEATURES)} AS BIGINT) AS n_features, 1.0::DOUBLE AS total")
def l10_check(spark, d):
    return l10(spark, d).agg(F.count("*").alias("n_features"), F.round(F.sum("importance"), 9).alias("total"))


@query("L12_check", FUTURE_SQL)
def l12_check(spark, d):
    return _per_week(l12(spark, d), BAND)


@query("L13_check", FUTURE_SQL)
def l13_check(spark, d):
    return _per_week(l13(spark, d), BAND)


@query("C5_check", FOLDS_SQL.format(n=2))
def c5_check(spark, d):
    return _per_fold(c5(spark, d))


@query("C6_check", FOLDS_SQL.format(n=1))
def c6_check(spark, d):
    return _per_fold(c6(spark, d))


@query(
    "C6_interval_check",
    f"""SELECT f.fold, {SERIES_SQL} * count(*) AS n_rows, CAST(0 AS BIGINT) AS wrong FROM folds f
        JOIN weeks w ON w.yw BETWEEN f.val_start AND f.val_end GROUP BY f.fold""",
)
def c6_interval_check(spark, d):
    return c6_rows(spark, d).groupBy("fold").agg(F.count("*").alias("n_rows"), F.count_if(F.expr(BAND)).alias("wrong"))
