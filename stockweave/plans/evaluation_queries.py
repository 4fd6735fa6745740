"""Baselines, metrics, walk-forward validation."""

from pyspark.sql import functions as F

from stockweave.functions.scalars import r6
from stockweave.functions import weeks as wk
from stockweave.operators import baselines as bl
from stockweave.operators import evaluate as ev
from stockweave.operators import metrics as mt
from stockweave.plans.registry import KEY2, define, query
from stockweave.schema import QTY, SKU, WEEK
from stockweave.sources import tables as tb

H = 13

# ---- statements: every model as a plain recursion or lookup ----------------
# hist: history of each fold's series; fold 5 ends at the general cut-off.
define("hist", "SELECT f.fold, s.ch, s.mat, s.pos, s.q FROM si_coarse s JOIN folds f ON s.yw <= f.train_end")
define("fold_n", "SELECT fold, ch, mat, max(pos) + 1 AS n FROM hist GROUP BY ALL")
define(
    "recent",
    """SELECT h.fold, h.ch, h.mat, avg(q) AS recent_mean FROM hist h JOIN fold_n USING (fold, ch, mat)
       WHERE pos >= n - 12 GROUP BY ALL""",
)
define("steps", "SELECT CAST(i AS INTEGER) AS h FROM range(13) t(i)")
define(
    "m_naive",
    """SELECT n.fold, n.ch, n.mat, s.h, x.q AS yhat FROM fold_n n CROSS JOIN steps s
       JOIN hist x ON x.fold = n.fold AND x.ch = n.ch AND x.mat = n.mat AND x.pos = n.n - 52 + s.h % 52""",
)
define(
    "m_seasonal",
    """SELECT n.fold, n.ch, n.mat, s.h, 0.5::DOUBLE * avg(x.q) + 0.5::DOUBLE * any_value(r.recent_mean) AS yhat
       FROM fold_n n CROSS JOIN steps s
       JOIN hist x ON x.fold = n.fold AND x.ch = n.ch AND x.mat = n.mat AND (n.n + s.h - x.pos) % 52 = 0
       JOIN recent r ON r.fold = n.fold AND r.ch = n.ch AND r.mat = n.mat
       GROUP BY n.fold, n.ch, n.mat, s.h""",
)
define(
    "sales",
    """SELECT fold, ch, mat, pos, q, row_number() OVER (PARTITION BY fold, ch, mat ORDER BY pos) AS k,
       count(*) OVER (PARTITION BY fold, ch, mat) AS total FROM hist WHERE q > 0""",
)
define(
    "croston_rec",
    """SELECT fold, ch, mat, k, total, pos, q AS z, CAST(pos + 1 AS DOUBLE) AS p,
         CASE WHEN pos > 0 THEN q / pos ELSE q END AS single FROM sales WHERE k = 1
       UNION ALL
       SELECT s.fold, s.ch, s.mat, s.k, s.total, s.pos, 0.1::DOUBLE * s.q + 0.9::DOUBLE * r.z,
         0.1::DOUBLE * (s.pos - r.pos) + 0.9::DOUBLE * r.p, r.single
       FROM croston_rec r JOIN sales s ON s.fold = r.fold AND s.ch = r.ch AND s.mat = r.mat AND s.k = r.k + 1""",
)
define(
    "m_croston",
    """SELECT n.fold, n.ch, n.mat, coalesce(CASE WHEN c.total = 1 THEN c.single ELSE c.z / c.p END, 0.0) AS yhat
       FROM fold_n n LEFT JOIN (SELECT * FROM croston_rec WHERE k = total) c
         ON c.fold = n.fold AND c.ch = n.ch AND c.mat = n.mat""",
)
define(
    "tsb_rec",
    """SELECT h.fold, h.ch, h.mat, h.pos, h.q AS d,
         CASE WHEN h.pos > 0 THEN 1.0::DOUBLE / (h.pos + 1) ELSE 1.0::DOUBLE END AS p
       FROM hist h JOIN sales s ON s.fold = h.fold AND s.ch = h.ch AND s.mat = h.mat AND s.pos = h.pos WHERE s.k = 1
       UNION ALL
       SELECT h.fold, h.ch, h.mat, h.pos, CASE WHEN h.q > 0 THEN 0.9::DOUBLE * r.d + 0.1::DOUBLE * h.q ELSE r.d END,
         0.9::DOUBLE * r.p + CASE WHEN h.q > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
       FROM tsb_rec r JOIN hist h ON h.fold = r.fold AND h.ch = r.ch AND h.mat = r.mat AND h.pos = r.pos + 1""",
)
define(
    "m_tsb",
    """SELECT n.fold, n.ch, n.mat, coalesce(t.p * t.d, 0.0) AS yhat FROM fold_n n
       LEFT JOIN tsb_rec t ON t.fold = n.fold AND t.ch = n.ch AND t.mat = n.mat AND t.pos = n.n - 1""",
)
define(
    "model_rows",
    """SELECT 'seasonal_naive' AS model, fold, ch, mat, h, yhat FROM m_naive
       UNION ALL SELECT 'rolling_seasonal_mean', fold, ch, mat, h, yhat FROM m_seasonal
       UNION ALL SELECT 'croston', fold, ch, mat, h, yhat FROM m_croston CROSS JOIN steps
       UNION ALL SELECT 'sba', fold, ch, mat, h, yhat * 0.95::DOUBLE FROM m_croston CROSS JOIN steps
       UNION ALL SELECT 'tsb', fold, ch, mat, h, yhat FROM m_tsb CROSS JOIN steps""",
)
define(
    "cv_rows",
    """SELECT m.model, m.fold, m.ch, m.mat, m.h, s.q AS a, greatest(m.yhat, 0.0) AS f
       FROM model_rows m JOIN folds d ON d.fold = m.fold
       JOIN fold_n n ON n.fold = m.fold AND n.ch = m.ch AND n.mat = m.mat
       JOIN si_coarse s ON s.ch = m.ch AND s.mat = m.mat AND s.pos = n.n + m.h""",
)
SUITE_SQL = """
  avg(2.0::DOUBLE * abs(a - f) / (abs(a) + abs(f) + 1e-9::DOUBLE)) * 100 AS smape,
  CASE WHEN sum(abs(a)) >= 1e-9 THEN sum(abs(a - f)) / sum(abs(a)) * 100 ELSE 0.0::DOUBLE END AS wape,
  coalesce(sum(abs(a - f)) FILTER (a > 0) / sum(a) FILTER (a > 0) * 100, 0.0::DOUBLE) AS active_wape,
  CASE WHEN avg(abs(a)) >= 1e-9 THEN avg(f - a) / avg(abs(a)) * 100 ELSE 0.0::DOUBLE END AS bias,
  avg(CASE WHEN f >= a THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS slp,
  coalesce(2.0::DOUBLE * count(*) FILTER (a > 0 AND f > 0.5) / nullif(2 * count(*) FILTER (a > 0 AND f > 0.5)
    + count(*) FILTER (a <= 0 AND f > 0.5) + count(*) FILTER (a > 0 AND f <= 0.5), 0), 0.0::DOUBLE) AS demand_f1,
  avg(CASE WHEN a >= f THEN 0.5::DOUBLE * (a - f) ELSE -0.5::DOUBLE * (a - f) END) AS pinball_50,
  avg(abs(a - f)) AS mae, sqrt(avg((a - f) * (a - f))) AS rmse"""
define(
    "cv_scale",
    """SELECT fold, avg(step) AS scale FROM (
         SELECT fold, abs(a - lag(a) OVER (PARTITION BY fold ORDER BY md5(ch || '|' || mat), ch, mat, h)) AS step
         FROM cv_rows WHERE model = 'tsb') GROUP BY fold""",
)
define(
    "cv_metrics",
    f"""SELECT x.*, x.mae / (s.scale + 1e-9::DOUBLE) AS mase FROM (
          SELECT fold, model, {SUITE_SQL}, count(*) AS n_obs, count(DISTINCT ch || '|' || mat) AS n_skus
          FROM cv_rows GROUP BY fold, model) x JOIN cv_scale s USING (fold)""",
)


def _r(*cols):
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


def _forecasts(spark, d, models, horizon=H):
    state = bl.series_state(
        bl.positioned(tb.sell_in(spark, d), tb.FIRST_WEEK, tb.CUTOFF_WEEK), SKU
    )
    return bl.forecast(state, SKU, horizon, models)


def _one(spark, d, model):
    return _forecasts(spark, d, [model]).select(*SKU, "step", r6(model).alias("yhat"))


def _one_sql(cte, expr="yhat", steps=False):
    join = " CROSS JOIN steps" if steps else ""
    return f"SELECT {KEY2}, h + 1 AS step, round({expr}, 6) + 0.0 AS yhat FROM {cte}{join} WHERE fold = 5"


@query("B1_seasonal_naive", _one_sql("m_naive"))
def b1(spark, d):
    return _one(spark, d, "seasonal_naive")


@query("B2_rolling_seasonal_mean", _one_sql("m_seasonal"))
def b2(spark, d):
    return _one(spark, d, "rolling_seasonal_mean")


@query("B3_croston", _one_sql("m_croston", steps=True))
def b3(spark, d):
    return _one(spark, d, "croston")


@query("B4_sba", _one_sql("m_croston", "yhat * 0.95::DOUBLE", True))
def b4(spark, d):
    return _one(spark, d, "sba")


@query("B5_tsb", _one_sql("m_tsb", steps=True))
def b5(spark, d):
    return _one(spark, d, "tsb")


@query("B6_rolling_average", _one_sql("recent", "recent_mean", True))
def b6(spark, d):
    return _one(spark, d, "rolling_average")


@query(
    "B7_all_models",
    f"""SELECT {KEY2}, model, h + 1 AS step, round(yhat, 6) + 0.0 AS yhat FROM (
        SELECT * FROM model_rows UNION ALL
        SELECT 'rolling_average', fold, ch, mat, h, recent_mean FROM recent CROSS JOIN steps) WHERE fold = 5""",
)
def b7(spark, d):
    df = bl.run_models(tb.sell_in(spark, d), tb.FIRST_WEEK, tb.CUTOFF_WEEK, H)
    return df.select(*SKU, "model", "step", r6("yhat").alias("yhat"))


define(
    "fc_forward",
    """SELECT ch, mat, CAST(s.i + 1 AS INTEGER) AS step, x.q AS yhat,
         CAST(isoyear(DATE '2001-10-29' + CAST((s.i + 1) * 7 AS INTEGER)) * 100
              + weekofyear(DATE '2001-10-29' + CAST((s.i + 1) * 7 AS INTEGER)) AS INTEGER) AS yw
       FROM range(71) s(i) JOIN si_coarse x ON x.pos = 357 - 52 + s.i % 52""",
)


@query(
    "B8_forward_forecast",
    f"""SELECT {KEY2}, yw AS year_week, step AS horizon_step, yhat AS forecast_naive,
        CAST(yw % 100 AS INTEGER) AS week_num, CAST(yw // 100 AS INTEGER) AS year FROM fc_forward""",
)
def b8(spark, d):
    df = tb.sell_in(spark, d)
    return bl.naive_forecast(df, tb.FIRST_WEEK, bl.last_sales_week(df), 71)


@query(
    "B8_forward_top_skus",
    f"SELECT {KEY2}, sum(yhat) AS total_forecast FROM fc_forward GROUP BY ch, mat ORDER BY total_forecast DESC, ch, mat LIMIT 10",
)
def b8_top(spark, d):
    df = b8(spark, d).groupBy(*SKU).agg(F.sum("forecast_naive").alias("total_forecast"))
    return df.orderBy(F.desc("total_forecast"), *SKU).limit(10)


# ---- metrics ---------------------------------------------------------------
def _cv_rows(spark, d, models=bl.SUITE):
    wide = ev.fold_rows(tb.sell_in(spark, d), tb.FIRST_WEEK, tb.FOLDS, models)
    return wide.unpivot(["fold", *SKU, "step", "actual"], models, "model", "forecast")


def _metric(name, *cols):
    @query(name, f"SELECT fold, model, {_r(*cols)} FROM cv_metrics")
    def run(spark, d):
        df = mt.metric_suite(_cv_rows(spark, d), ["fold", "model"])
        return df.select("fold", "model", *[r6(c).alias(c) for c in cols])

    return run


_metric("M1_smape", "smape")
_metric("M2_wape", "wape")
_metric("M3_active_wape", "active_wape")
_metric("M5_bias", "bias")
_metric("M6_service_level", "slp")
_metric("M7_mae_rmse", "mae", "rmse")
_metric("M8_demand_f1", "demand_f1")


@query("M4_mase_diff", f"SELECT fold, {_r('scale')} FROM cv_scale")
def m4_diff(spark, d):
    wide = ev.fold_rows(tb.sell_in(spark, d), tb.FIRST_WEEK, tb.FOLDS, ["tsb"])
    return mt.diff_scale(wide, ["fold"], SKU, "step").select("fold", r6("scale").alias("scale"))


@query(
    "M4_mase_seasonal",
    f"""SELECT fold, {KEY2}, round(mae, 6) + 0.0 AS mae, round(scale, 6) + 0.0 AS scale,
          round(mae / (scale + 1e-9::DOUBLE), 6) + 0.0 AS mase_seasonal
        FROM (SELECT fold, ch, mat, avg(abs(a - f)) AS mae FROM cv_rows WHERE model = 'tsb' GROUP BY fold, ch, mat)
        JOIN (SELECT x.fold, x.ch, x.mat, avg(abs(x.q - y.q)) AS scale FROM hist x
              JOIN hist y ON x.fold = y.fold AND x.ch = y.ch AND x.mat = y.mat AND y.pos = x.pos - 52
              GROUP BY x.fold, x.ch, x.mat) USING (fold, ch, mat)""",
)
def m4_seasonal(spark, d):
    ends = F.array(*[F.struct(F.lit(f[0]).alias("fold"), F.lit(f[1]).alias("train_end")) for f in tb.FOLDS])
    dense = tb.dense_table(spark, d, "coarse", "Sell-in", tb.CUTOFF_WEEK)
    train = dense.select("*", F.inline(ends)).filter(F.col(WEEK) <= F.col("train_end"))
    out = mt.mase_seasonal(_cv_rows(spark, d, ["tsb"]), train, ["fold", *SKU], QTY)
    return out.select("fold", *SKU, *[r6(c).alias(c) for c in ("mae", "scale", "mase_seasonal")])


@query(
    "M9_pinball",
    """SELECT fold, model,
         round(avg(CASE WHEN a >= f THEN 0.1::DOUBLE * (a - f) ELSE -0.9::DOUBLE * (a - f) END), 6) + 0.0 AS pinball_10,
         round(avg(CASE WHEN a >= f THEN 0.5::DOUBLE * (a - f) ELSE -0.5::DOUBLE * (a - f) END), 6) + 0.0 AS pinball_50,
         round(avg(CASE WHEN a >= f THEN 0.9::DOUBLE * (a - f) ELSE -0.1::DOUBLE * (a - f) END), 6) + 0.0 AS pinball_90
       FROM cv_rows GROUP BY fold, model""",
)
def m9(spark, d):
    return _cv_rows(spark, d).groupBy("fold", "model").agg(
        *[r6(mt.pinball(q / 100)).alias(f"pinball_{q}") for q in (10, 50, 90)]
    )


@query("M10_metric_suite", f"SELECT fold, model, {_r(*mt.SUITE)}, n_obs FROM cv_metrics")
def m10(spark, d):
    df = mt.metric_suite(_cv_rows(spark, d), ["fold", "model"])
    return df.select("fold", "model", *[r6(c).alias(c) for c in mt.SUITE], "n_obs")


@query(
    "M11_per_sku_metrics",
    f"""SELECT fold, {KEY2}, {_r(*mt.SUITE)}, n_obs, actual_sum, round(forecast_sum, 6) + 0.0 AS forecast_sum FROM (
        SELECT fold, ch, mat, {SUITE_SQL}, count(*) AS n_obs, sum(a) AS actual_sum, sum(f) AS forecast_sum
        FROM cv_rows WHERE model = 'tsb' GROUP BY fold, ch, mat)""",
)
def m11(spark, d):
    df = mt.per_sku(_cv_rows(spark, d, ["tsb"]), ["fold", *SKU])
    return df.select(
        "fold", *SKU, *[r6(c).alias(c) for c in mt.SUITE], "n_obs", "actual_sum", r6("forecast_sum").alias("forecast_sum")
    )


_ACTIVE_SQL = """
  SELECT {fold} model, round(avg(mae), 6) + 0.0 AS mae, round(avg(rmse), 6) + 0.0 AS rmse, round(avg(mape), 6) + 0.0 AS mape,
    round(avg(bias), 6) + 0.0 AS bias, count(*) AS n_series FROM (
    SELECT {fold} model, ch, mat, coalesce(avg(abs(a - f)) FILTER (a > 0), 0) AS mae,
      sqrt(coalesce(avg((a - f) * (a - f)) FILTER (a > 0), 0)) AS rmse,
      coalesce(avg(abs((a - f) / a)) FILTER (a > 0), 0) * 100 AS mape,
      coalesce(avg(a - f) FILTER (a > 0), 0) AS bias FROM {src} GROUP BY {fold} model, ch, mat) GROUP BY {fold} model"""


@query("M12_active_errors", _ACTIVE_SQL.format(src="cv_rows", fold="fold,"))
def m12(spark, d):
    df = mt.active_errors(_cv_rows(spark, d), ["fold", "model"])
    return df.select("fold", "model", *[r6(c).alias(c) for c in ("mae", "rmse", "mape", "bias")], "n_series")


# scored rows: Sell-in of fold 5, B2 as point forecast, share of sold weeks of the past 12
define(
    "scored",
    """SELECT r.ch, r.mat, CAST(200101 + r.h AS INTEGER) AS yw, r.a AS quantity_actual, r.f AS forecast_q50,
         p.demand_prob FROM cv_rows r JOIN (
           SELECT ch, mat, yw, avg(CASE WHEN q > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY ch, mat
             ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS demand_prob FROM si_coarse) p
         ON p.ch = r.ch AND p.mat = r.mat AND p.yw = 200101 + r.h
       WHERE r.fold = 5 AND r.model = 'rolling_seasonal_mean'""",
)


def scored(spark, d):
    from stockweave.operators import features as ft

    rows = ev.fold_rows(
        tb.sell_in(spark, d), tb.FIRST_WEEK, tb.FOLDS[4:], ["rolling_seasonal_mean"]
    ).select(
        *SKU, (F.lit(200100) + F.col("step")).cast("int").alias(WEEK),
        F.col("actual").alias("quantity_actual"),
        F.col("rolling_seasonal_mean").alias("forecast_q50"),
    )
    dense = tb.dense_table(spark, d, "coarse", "Sell-in", 200113)
    prob = ft.with_true_demand_rate(dense, SKU).select(
        *SKU, WEEK, F.col("prob_nonzero_12").alias("demand_prob")
    )
    return rows.join(prob, [*SKU, WEEK])


def _labelled(spark, d):
    return scored(spark, d).withColumn("label", (F.col("quantity_actual") > 0).cast("int"))


@query(
    "M13_roc_auc",
    """SELECT round((sum(r) FILTER (y = 1) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0), 6) + 0.0 AS auc FROM (
         SELECT y, (rank() OVER (ORDER BY demand_prob) + (count(*) OVER (PARTITION BY demand_prob) - 1) / 2.0::DOUBLE) AS r,
           sum(y) OVER () AS n1, sum(1 - y) OVER () AS n0
         FROM (SELECT demand_prob, CASE WHEN quantity_actual > 0 THEN 1 ELSE 0 END AS y FROM scored))
       GROUP BY n1, n0""",
)
def m13(spark, d):
    return mt.roc_auc(_labelled(spark, d), "demand_prob", "label").select(r6("auc").alias("auc"))


@query(
    "M14_youden_threshold",
    """SELECT round(j, 6) + 0.0 AS youden_j, round(least(greatest(s, 0.01::DOUBLE), 0.95::DOUBLE), 6) + 0.0 AS threshold FROM (
         SELECT t.s, count(*) FILTER (y = 1 AND demand_prob >= t.s) / sum(y)::DOUBLE
             - count(*) FILTER (y = 0 AND demand_prob >= t.s) / sum(1 - y)::DOUBLE AS j
         FROM (SELECT demand_prob, CASE WHEN quantity_actual > 0 THEN 1 ELSE 0 END AS y FROM scored)
         CROSS JOIN (SELECT DISTINCT demand_prob AS s FROM scored) t GROUP BY t.s)
       ORDER BY round(j, 12) DESC, s DESC LIMIT 1""",
)
def m14(spark, d):
    df = mt.youden_threshold(_labelled(spark, d), "demand_prob", "label")
    return df.select(r6("youden_j").alias("youden_j"), r6("threshold").alias("threshold"))


# ---- walk-forward ----------------------------------------------------------
def _cv(spark, d):
    return ev.walk_forward(tb.sell_in(spark, d), tb.FIRST_WEEK, tb.FOLDS)


_CV_COLS = [*mt.SUITE, "mase"]


@query(
    "C1_walk_forward",
    f"SELECT fold, model, train_end, val_start, n_skus, {_r(*_CV_COLS)} FROM cv_metrics JOIN folds USING (fold)",
)
def c1(spark, d):
    return _cv(spark, d).select(
        "fold", "model", "train_end", "val_start", "n_skus", *[r6(c).alias(c) for c in _CV_COLS]
    )


define(
    "tail_n",
    "SELECT ch, mat, pos, q FROM si_coarse WHERE pos <= 356",
)


@query(
    "C2_holdout",
    _ACTIVE_SQL.format(
        fold="",
        src="""(SELECT 'seasonal_naive' AS model, t.ch, t.mat, t.q AS a, y.q AS f FROM tail_n t
                  JOIN tail_n y ON y.ch = t.ch AND y.mat = t.mat AND y.pos = t.pos - 52 WHERE t.pos > 343
                UNION ALL SELECT 'rolling_average', t.ch, t.mat, t.q, r.m FROM tail_n t
                  JOIN (SELECT ch, mat, avg(q) AS m FROM tail_n WHERE pos BETWEEN 332 AND 343 GROUP BY ch, mat) r
                    USING (ch, mat) WHERE t.pos > 343)"""
    ),
)
def c2(spark, d):
    df = ev.holdout(tb.sell_in(spark, d), tb.FIRST_WEEK, tb.LAST_SALES_WEEK)
    return df.select("model", *[r6(c).alias(c) for c in ("mae", "rmse", "mape", "bias")], "n_series")


_BENCH_COLS = ["smape", "wape", "mase", "bias", "slp", "mae", "rmse"]
define("cv_mean", "SELECT model, " + ", ".join(f"avg({c}) AS {c}" for c in _BENCH_COLS) + " FROM cv_metrics GROUP BY model")


@query(
    "C3_benchmark",
    f"""SELECT model, {_r(*_BENCH_COLS)}, CAST(row_number() OVER (ORDER BY smape, model) AS INTEGER) AS model_rank,
        CASE WHEN row_number() OVER (ORDER BY smape, model) = 1 THEN 1 ELSE 0 END AS is_best FROM cv_mean""",
)
def c3(spark, d):
    df = ev.benchmark(_cv(spark, d))
    return df.select("model", *[r6(c).alias(c) for c in _BENCH_COLS], "model_rank", "is_best")


@query(
    "C4_fold_aggregate",
    f"""SELECT model, metric, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std,
        round(min(value), 6) + 0.0 AS min, round(max(value), 6) + 0.0 AS max
        FROM (SELECT fold, model, {', '.join(_CV_COLS)} FROM cv_metrics)
        UNPIVOT (value FOR metric IN ({', '.join(_CV_COLS)})) GROUP BY model, metric""",
)
def c4(spark, d):
    df = ev.fold_aggregate(_cv(spark, d), _CV_COLS)
    return df.select("model", "metric", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


define(
    "cv_mean_tall",
    f"SELECT * FROM cv_mean UNPIVOT (value FOR metric IN ({', '.join(_BENCH_COLS)}))",
)


@query(
    "C7_improvement",
    """SELECT t.model, metric, round(t.value, 6) + 0.0 AS value, round(o.value, 6) + 0.0 AS reference_value,
       round((o.value - t.value) / nullif(o.value, 0) * 100, 6) + 0.0 AS improvement_pct
       FROM cv_mean_tall t JOIN (SELECT metric, value FROM cv_mean_tall WHERE model = 'seasonal_naive') o USING (metric)""",
)
def c7(spark, d):
    mean = ev.benchmark(_cv(spark, d)).drop("model_rank", "is_best")
    df = ev.improvement(mean, "seasonal_naive", _BENCH_COLS)
    return df.select("model", "metric", *[r6(c).alias(c) for c in ("value", "reference_value", "improvement_pct")])


@query(
    "J5_fold_assignment",
    f"""SELECT f.fold, CASE WHEN yw <= train_end THEN 'train' ELSE 'val' END AS role, count(*) AS n_rows, sum(q) AS quantity
        FROM long_fine JOIN folds f ON yw <= train_end OR yw BETWEEN val_start AND val_end
        WHERE cat = 'Sell-in' GROUP BY ALL""",
)
def j5(spark, d):
    df = ev.assign_folds(tb.sell_in(spark, d, "fine"), tb.FOLDS)
    return df.groupBy("fold", "role").agg(F.count("*").alias("n_rows"), F.sum(QTY).alias(QTY))


@query(
    "V16_fold_guard",
    """SELECT fold, max(yw) FILTER (yw <= train_end) AS last_train_week,
         min(yw) FILTER (yw BETWEEN val_start AND val_end) AS first_val_week,
         CASE WHEN max(yw) FILTER (yw <= train_end) < min(yw) FILTER (yw BETWEEN val_start AND val_end) THEN 1 ELSE 0 END AS ok
       FROM long_fine CROSS JOIN folds WHERE cat = 'Sell-in' GROUP BY fold""",
)
def v16(spark, d):
    return ev.leakage_guard(tb.sell_in(spark, d, "fine"), tb.FOLDS)


@query(
    "A25_common_skus",
    """SELECT fold, ch AS "Channel", mat AS "Material Description" FROM (
         SELECT fold, ch, mat FROM long_fine JOIN folds ON yw <= train_end WHERE cat = 'Sell-in'
         INTERSECT
         SELECT fold, ch, mat FROM long_fine JOIN folds ON yw BETWEEN val_start AND val_end WHERE cat = 'Sell-in')""",
)
def a25(spark, d):
    return ev.common_skus(tb.sell_in(spark, d, "fine"), tb.FOLDS)
