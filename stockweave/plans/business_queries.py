"""Risk, churn, blending, runs."""

from pyspark.sql import functions as F

from stockweave.functions.scalars import r6
from stockweave.operators import baselines as bl
from stockweave.operators import blending as bd
from stockweave.operators import churn as ch
from stockweave.operators import evaluate as ev
from stockweave.operators import features as ft
from stockweave.operators import inventory as iv
from stockweave.operators import quality as ql
from stockweave.operators import tracking as tk
from stockweave.plans.evaluation_queries import scored
from stockweave.plans.registry import KEY2, KEY3, define, query
from stockweave.schema import CATEGORY, CHANNEL, CHURN_TIERS, MATERIAL, QTY, RISK_LEVELS, SELL_IN, SERIES, SKU, WEEK
from stockweave.sources import tables as tb

H = 13


def _r(*cols):
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


# ---- forecasts that stand for the naive and the model side -----------------
define("fc_naive", "SELECT ch, mat, CAST(200101 + h AS INTEGER) AS yw, yhat AS naive FROM m_naive WHERE fold = 5")
define(
    "fc_alt",
    """SELECT ch, mat, CAST(200101 + h AS INTEGER) AS yw, 0.8::DOUBLE * yhat AS q10, yhat AS q50, 1.3::DOUBLE * yhat AS q90
       FROM m_seasonal WHERE fold = 5 AND mat IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6',
         'Brand#7', 'Brand#8', 'Brand#9')""",
)
define(
    "blended",
    """SELECT n.ch, n.mat, n.yw, coalesce(a.q10, 0.45::DOUBLE * n.naive) AS q10, coalesce(a.q50, n.naive) AS q50,
         coalesce(a.q90, 1.6::DOUBLE * n.naive) AS q90, CASE WHEN a.q50 IS NULL THEN 'seasonal_naive' ELSE 'model' END AS source
       FROM fc_naive n LEFT JOIN fc_alt a ON a.ch = n.ch AND a.mat = n.mat AND a.yw = n.yw""",
)
define(
    "inv_now",
    """SELECT ch, mat, arg_max(q, yw) AS inv, max(yw) AS inv_week FROM long_coarse
       WHERE cat = 'Channel Inv.' AND q > 0 AND yw <= 200052 GROUP BY ch, mat""",
)
define(
    "fc_totals",
    """SELECT ch, mat, sum(q50) AS forecast_total, sum(q90) AS forecast_q90_total, sum(q50) / 13 AS avg_weekly_demand,
         sum(q90) / 13 AS avg_weekly_demand_q90, min(yw) AS forecast_start, max(yw) AS forecast_end, count(*) AS n_weeks
       FROM blended GROUP BY ch, mat""",
)
define(
    "risk",
    """SELECT *, inv / (forecast_total + 1e-6::DOUBLE) AS coverage_ratio, inv / (avg_weekly_demand + 1e-6::DOUBLE) AS weeks_of_supply,
         inv / (avg_weekly_demand_q90 + 1e-6::DOUBLE) AS weeks_of_supply_conservative,
         CASE WHEN inv / (avg_weekly_demand_q90 + 1e-6::DOUBLE) < 2 THEN 'CRITICAL' WHEN inv / (avg_weekly_demand_q90 + 1e-6::DOUBLE) < 4 THEN 'HIGH'
           WHEN inv / (avg_weekly_demand_q90 + 1e-6::DOUBLE) < 8 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
       FROM inv_now JOIN fc_totals USING (ch, mat)""",
)
define(
    "stockout",
    """SELECT ch, mat, min(yw) AS stockout_week FROM (
         SELECT b.ch, b.mat, b.yw, i.inv, sum(x.q50) AS used FROM blended b JOIN blended x ON x.ch = b.ch AND x.mat = b.mat AND x.yw <= b.yw
         JOIN inv_now i ON i.ch = b.ch AND i.mat = b.mat GROUP BY b.ch, b.mat, b.yw, i.inv) WHERE used >= inv GROUP BY ch, mat""",
)


def fc_naive(spark, d):
    return bl.naive_forecast(tb.sell_in(spark, d), tb.FIRST_WEEK, tb.CUTOFF_WEEK, H)


def fc_alt(spark, d):
    df = tb.sell_in(spark, d).filter(F.col(MATERIAL).isin([f"Brand#{i}" for i in range(1, 10)]))
    state = bl.series_state(bl.positioned(df, tb.FIRST_WEEK, tb.CUTOFF_WEEK), SKU)
    q = F.col("rolling_seasonal_mean")
    return bl.forecast(state, SKU, H, ["rolling_seasonal_mean"]).select(
        *SKU, (F.lit(200100) + F.col("step")).cast("int").alias(WEEK),
        (q * 0.8).alias("forecast_q10"), q.alias("forecast_q50"), (q * 1.3).alias("forecast_q90"),
    )


def blended(spark, d):
    return bd.blend(fc_naive(spark, d), fc_alt(spark, d), naive_start=200101)


def risk(spark, d):
    weekly = tb.long_table(spark, d, "coarse").filter(F.col(WEEK) <= tb.CUTOFF_WEEK)
    return iv.risk_table(weekly, blended(spark, d), upper="forecast_q90", horizon=H)


# ---- risk ------------------------------------------------------------------
@query("R1_current_inventory", f"SELECT {KEY2}, inv AS current_inventory, inv_week AS last_inv_week FROM inv_now")
def r1(spark, d):
    return iv.current_inventory(tb.long_table(spark, d, "coarse").filter(F.col(WEEK) <= tb.CUTOFF_WEEK))


_TOTALS = ["forecast_total", "forecast_q90_total", "avg_weekly_demand", "avg_weekly_demand_q90"]


@query("R2_forecast_totals", f"SELECT {KEY2}, {_r(*_TOTALS)}, forecast_start, forecast_end, n_weeks FROM fc_totals")
def r2(spark, d):
    return rounded(iv.forecast_totals(blended(spark, d), upper="forecast_q90", horizon=H), *_TOTALS)


_COVER = ["coverage_ratio", "weeks_of_supply", "weeks_of_supply_conservative"]


@query("R3_coverage", f"SELECT {KEY2}, {_r(*_COVER)} FROM risk")
def r3(spark, d):
    return rounded(risk(spark, d), *_COVER).select(*SKU, *_COVER)


@query("R4_risk_level", f"SELECT {KEY2}, risk_level FROM risk")
def r4(spark, d):
    return risk(spark, d).select(*SKU, "risk_level")


@query(
    "R5_stockout_week",
    f"""SELECT {KEY2}, inv AS current_inventory, stockout_week FROM inv_now LEFT JOIN stockout USING (ch, mat)""",
)
def r5(spark, d):
    inv = iv.current_inventory(tb.long_table(spark, d, "coarse").filter(F.col(WEEK) <= tb.CUTOFF_WEEK))
    return iv.stockout_weeks(inv, blended(spark, d))


@query(
    "R6_risk_table",
    f"""SELECT {KEY2}, inv AS current_inventory, inv_week AS last_inv_week, {_r(*_TOTALS)}, forecast_start, forecast_end, n_weeks,
        {_r(*_COVER)}, risk_level, stockout_week FROM risk LEFT JOIN stockout USING (ch, mat)""",
)
def r6_table(spark, d):
    return iv.report_order(rounded(risk(spark, d), *_TOTALS, *_COVER))


@query(
    "R6_risk_summary",
    """SELECT count(*) AS n_skus, count(*) FILTER (risk_level = 'CRITICAL') AS critical, count(*) FILTER (risk_level = 'HIGH') AS high,
         count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low,
         min(forecast_start) AS forecast_start, max(forecast_end) AS forecast_end,
         round(count(*) FILTER (risk_level IN ('CRITICAL', 'HIGH')) * 100.0::DOUBLE / count(*), 6) + 0.0 AS pct_at_risk FROM risk""",
)
def r6_summary(spark, d):
    return rounded(iv.risk_summary(risk(spark, d)), "pct_at_risk")


@query(
    "R6_top_critical",
    f"""SELECT {KEY2}, inv AS current_inventory, round(forecast_total, 6) + 0.0 AS forecast_total,
          round(weeks_of_supply, 6) + 0.0 AS weeks_of_supply, stockout_week FROM risk LEFT JOIN stockout USING (ch, mat)
        WHERE risk_level = 'CRITICAL' ORDER BY weeks_of_supply, ch, mat LIMIT 20""",
)
def r6_top(spark, d):
    return rounded(iv.top_critical(risk(spark, d)), "forecast_total", "weeks_of_supply")


# ---- churn -----------------------------------------------------------------
define("cw", "SELECT ch, yw, sum(q) AS q FROM long_customer WHERE cat = 'Sell-in' AND yw <= 200133 GROUP BY ch, yw")
define("cal", "SELECT yw, row_number() OVER (ORDER BY yw) - 1 AS x, count(*) OVER () AS n FROM (SELECT DISTINCT yw FROM cw)")
define(
    "cdense",
    """SELECT k.ch, c.yw, c.x, c.n, coalesce(w.q, 0.0) AS q FROM (SELECT ch FROM cw GROUP BY ch HAVING max(q) > 0) k
       CROSS JOIN cal c LEFT JOIN cw w ON w.ch = k.ch AND w.yw = c.yw""",
)
define(
    "cmetrics",
    """SELECT ch, max(yw) FILTER (q > 0) AS last_purchase_week,
         CAST((2001 * 52 + 33) - (max(yw) FILTER (q > 0) // 100 * 52 + max(yw) FILTER (q > 0) % 100) AS INTEGER) AS weeks_since_last_purchase,
         avg(CASE WHEN q > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS active_weeks_pct,
         regr_slope(q, x) FILTER (x >= n - 26) AS trend_slope, avg(q) AS avg_weekly_volume,
         avg(q) FILTER (x >= n - 13) AS last_13w_avg, avg(q) FILTER (x >= n - 26 AND x < n - 13) AS prev
       FROM cdense GROUP BY ch""",
)
define(
    "churned",
    """SELECT *, CASE WHEN weeks_since_last_purchase > 26 THEN 'ALTO' WHEN weeks_since_last_purchase > 13 THEN 'MEDIO'
         WHEN trend_slope < -0.5 AND volume_change_pct < -40 THEN 'MEDIO' ELSE 'ACTIVO' END AS churn_risk FROM (
         SELECT *, CASE WHEN prev > 0 THEN (last_13w_avg - prev) / prev * 100 WHEN last_13w_avg > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS volume_change_pct
         FROM cmetrics)""",
)


def _weekly(spark, d):
    return tb.long_table(spark, d, "customer")


def _churn(spark, d):
    return ch.churn_table(_weekly(spark, d), tb.REFERENCE_WEEK)


@query(
    "K1_client_weeks",
    """SELECT k.ch AS "Channel", c.yw AS year_week, coalesce(w.q, 0.0) AS quantity
       FROM (SELECT DISTINCT ch FROM long_fine WHERE cat = 'Sell-in' AND yw <= 200133) k
       CROSS JOIN (SELECT DISTINCT yw FROM long_fine WHERE cat = 'Sell-in' AND yw <= 200133) c
       LEFT JOIN (SELECT ch, yw, sum(q) AS q FROM long_fine WHERE cat = 'Sell-in' GROUP BY ch, yw) w ON w.ch = k.ch AND w.yw = c.yw""",
)
def k1(spark, d):
    return ch.dense_client_weeks(ch.client_weeks(tb.long_table(spark, d, "fine"), tb.REFERENCE_WEEK))


@query("K2_recency", 'SELECT ch AS "Channel", last_purchase_week, weeks_since_last_purchase FROM churned')
def k2(spark, d):
    return _churn(spark, d).select(CHANNEL, "last_purchase_week", "weeks_since_last_purchase")


@query("K3_activity", f'SELECT ch AS "Channel", {_r("active_weeks_pct", "avg_weekly_volume")} FROM churned')
def k3(spark, d):
    cols = ["active_weeks_pct", "avg_weekly_volume"]
    return rounded(_churn(spark, d), *cols).select(CHANNEL, *cols)


@query("K4_trend_slope", f'SELECT ch AS "Channel", {_r("trend_slope")} FROM churned')
def k4(spark, d):
    return rounded(_churn(spark, d), "trend_slope").select(CHANNEL, "trend_slope")


@query("K5_volume_change", f'SELECT ch AS "Channel", {_r("last_13w_avg", "volume_change_pct")} FROM churned')
def k5(spark, d):
    cols = ["last_13w_avg", "volume_change_pct"]
    return rounded(_churn(spark, d), *cols).select(CHANNEL, *cols)


@query("K6_churn_tier", 'SELECT ch AS "Channel", churn_risk FROM churned')
def k6(spark, d):
    return _churn(spark, d).select(CHANNEL, "churn_risk")


_K = ["active_weeks_pct", "trend_slope", "avg_weekly_volume", "last_13w_avg", "volume_change_pct"]


@query(
    "K7_churn_table",
    f'SELECT ch AS "Channel", last_purchase_week, weeks_since_last_purchase, {_r(*_K)}, churn_risk FROM churned',
)
def k7(spark, d):
    return ch.report_order(rounded(_churn(spark, d), *_K))


@query(
    "K7_churn_summary",
    """SELECT count(*) AS n_customers, count(*) FILTER (churn_risk = 'ALTO') AS alto, count(*) FILTER (churn_risk = 'MEDIO') AS medio,
         count(*) FILTER (churn_risk = 'BAJO') AS bajo, count(*) FILTER (churn_risk = 'ACTIVO') AS activo,
         round(count(*) FILTER (churn_risk = 'ALTO') * 100.0::DOUBLE / count(*), 6) + 0.0 AS pct_high FROM churned""",
)
def k7_summary(spark, d):
    return rounded(ch.churn_summary(_churn(spark, d)), "pct_high")


@query(
    "A26_never_bought",
    """SELECT DISTINCT ch AS "Channel" FROM long_customer WHERE cat = 'Sell-in' AND ch NOT IN
       (SELECT ch FROM long_customer WHERE cat = 'Sell-in' AND q > 0 AND yw <= 199652)""",
)
def a26(spark, d):
    return ch.never_bought(_weekly(spark, d), 199652)


# ---- blending and bias -----------------------------------------------------
@query(
    "L4_combine",
    f"""SELECT {KEY2}, yw AS year_week, round(demand_prob * forecast_q50, 6) + 0.0 AS product_forecast,
        round(CASE WHEN demand_prob >= 0.3 THEN forecast_q50 ELSE 0.0 END, 6) + 0.0 AS gated_forecast FROM scored""",
)
def l4(spark, d):
    df = scored(spark, d)
    return df.select(
        *SKU, WEEK,
        r6(bd.product_forecast(qty="forecast_q50")).alias("product_forecast"),
        r6(bd.gated_forecast(0.3, qty="forecast_q50")).alias("gated_forecast"),
    )


@query(
    "L6_log_target",
    f"""SELECT {KEY3}, yw AS year_week, round(ln(1 + q), 6) + 0.0 AS log_quantity,
        round(greatest(exp(ln(1 + q)) - 1, 0.0), 6) + 0.0 AS quantity FROM long_coarse""",
)
def l6(spark, d):
    df = tb.long_table(spark, d, "coarse").withColumn("log_quantity", bd.to_log(QTY))
    return df.select(*SERIES, WEEK, r6("log_quantity").alias("log_quantity"), r6(bd.from_log("log_quantity")).alias(QTY))


@query(
    "L11_bias_factors",
    """SELECT round(g, 6) + 0.0 AS "global", round(CASE WHEN nr >= 20 THEN r ELSE g END, 6) + 0.0 AS regular,
         round(CASE WHEN ns >= 20 THEN s ELSE g END, 6) + 0.0 AS sparse FROM (
       SELECT least(greatest(avg(quantity_actual) / (avg(forecast_q50) + 1e-9), 0.8), 5.0) AS g,
         count(*) FILTER (demand_prob > 0.3) AS nr, count(*) FILTER (demand_prob <= 0.3) AS ns,
         least(greatest(avg(quantity_actual) FILTER (demand_prob > 0.3) / (avg(forecast_q50) FILTER (demand_prob > 0.3) + 1e-9), 0.8), 5.0) AS r,
         least(greatest(avg(quantity_actual) FILTER (demand_prob <= 0.3) / (avg(forecast_q50) FILTER (demand_prob <= 0.3) + 1e-9), 0.8), 5.0) AS s
       FROM scored WHERE quantity_actual > 0)""",
)
def l11(spark, d):
    return rounded(bd.bias_factors(scored(spark, d)), "global", "regular", "sparse")


_Q = ["forecast_q10", "forecast_q50", "forecast_q90"]
define(
    "blended_late",
    """SELECT * FROM blended WHERE yw >= 200104
       UNION ALL SELECT ch, mat, yw, q10, q50, q90, 'model' FROM fc_alt WHERE yw < 200104""",
)
_QSQL = "round(q10, 6) + 0.0 AS forecast_q10, round(q50, 6) + 0.0 AS forecast_q50, round(q90, 6) + 0.0 AS forecast_q90"


@query("L14_blend", f"SELECT {KEY2}, yw AS year_week, {_QSQL}, source FROM blended_late")
def l14(spark, d):
    naive = fc_naive(spark, d).filter(F.col(WEEK) >= 200104)
    return rounded(bd.blend(naive, fc_alt(spark, d)), *_Q)


@query(
    "L14_blend_summary",
    """SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(m) AS BIGINT) AS model_rows, count(*) AS n_weeks, min(yw) AS first_week, max(yw) AS last_week,
         round(sum(q50), 6) + 0.0 AS total_q50, round(sum(q90), 6) + 0.0 AS total_q90, round(avg(q50), 6) + 0.0 AS avg_weekly_q50,
         round(avg(q90), 6) + 0.0 AS avg_weekly_q90, (SELECT count(DISTINCT (ch, mat)) FROM blended) AS n_skus
       FROM (SELECT yw, sum(q50) AS q50, sum(q90) AS q90, count(*) AS n, count(*) FILTER (source = 'model') AS m FROM blended GROUP BY yw)""",
)
def l14_summary(spark, d):
    return rounded(
        bd.blend_summary(blended(spark, d)), "total_q50", "total_q90", "avg_weekly_q50", "avg_weekly_q90"
    )


# ---- joins -----------------------------------------------------------------
@query(
    "J1_inventory_forecast_join",
    f"SELECT {KEY2}, inv AS current_inventory, round(forecast_total, 6) + 0.0 AS forecast_total FROM inv_now JOIN fc_totals USING (ch, mat)",
)
def j1(spark, d):
    inv = iv.current_inventory(tb.long_table(spark, d, "coarse").filter(F.col(WEEK) <= tb.CUTOFF_WEEK))
    out = inv.join(iv.forecast_totals(blended(spark, d)), SKU)
    return rounded(out.select(*SKU, "current_inventory", "forecast_total"), "forecast_total")


@query("J2_override_join", f"SELECT {KEY2}, yw AS year_week, {_QSQL}, source FROM blended")
def j2(spark, d):
    return rounded(blended(spark, d), *_Q)


@query(
    "J3_channel_stats_join",
    f"""SELECT {KEY2}, yw AS year_week, q AS quantity, round(m, 6) + 0.0 AS channel_mean FROM long_fine
        JOIN (SELECT ch, avg(q) AS m FROM long_fine WHERE cat = 'Sell-in' GROUP BY ch) USING (ch) WHERE cat = 'Sell-in'""",
)
def j3(spark, d):
    from stockweave.functions.scale import join_stats

    df = tb.sell_in(spark, d, "fine")
    stats = df.groupBy(CHANNEL).agg(F.avg(QTY).alias("m"))
    return join_stats(df, stats, [CHANNEL]).select(*SKU, WEEK, QTY, r6("m").alias("channel_mean"))


@query("J4_zscore_join", f"SELECT {KEY3}, yw AS year_week, q AS quantity, round(z, 6) + 0.0 AS z FROM zscores")
def j4(spark, d):
    return ql.with_zscore(tb.long_table(spark, d)).select(*SERIES, WEEK, QTY, r6("z").alias("z"))


@query(
    "J7_semi_join",
    f"""SELECT {KEY2}, yw AS year_week, q AS quantity FROM long_fine l WHERE cat = 'Sell-in' AND EXISTS (
        SELECT 1 FROM long_fine i WHERE i.cat = 'Channel Inv.' AND i.ch = l.ch AND i.mat = l.mat AND i.yw > 200052)""",
)
def j7_semi(spark, d):
    df = tb.long_table(spark, d)
    stocked = df.filter((F.col(CATEGORY) == "Channel Inv.") & (F.col(WEEK) > tb.CUTOFF_WEEK))
    sold = df.filter(F.col(CATEGORY) == SELL_IN)
    return sold.join(stocked.select(*SKU), SKU, "left_semi").select(*SKU, WEEK, QTY)


@query(
    "J7_anti_join",
    f"""SELECT {KEY2}, yw AS year_week, q AS quantity FROM long_fine l WHERE cat = 'Sell-in' AND NOT EXISTS (
        SELECT 1 FROM long_fine i WHERE i.cat = 'Channel Inv.' AND i.ch = l.ch AND i.mat = l.mat AND i.yw > 200052)""",
)
def j7_anti(spark, d):
    df = tb.long_table(spark, d)
    stocked = df.filter((F.col(CATEGORY) == "Channel Inv.") & (F.col(WEEK) > tb.CUTOFF_WEEK))
    sold = df.filter(F.col(CATEGORY) == SELL_IN)
    return sold.join(stocked.select(*SKU), SKU, "left_anti").select(*SKU, WEEK, QTY)


# ---- runs ------------------------------------------------------------------
define(
    "runs",
    """SELECT substring(sha256('walk_forward:fold' || fold || '_' || model || ':{"fold": ' || fold || ', "model": "' || model || '"}'), 1, 16) AS run_id,
         'walk_forward' AS experiment, 'fold' || fold || '_' || model AS run_name, train_end AS start_time, smape, wape, mae
       FROM cv_metrics JOIN folds USING (fold)""",
)


def _runs(spark, d):
    cv = ev.walk_forward(tb.sell_in(spark, d), tb.FIRST_WEEK, tb.FOLDS)
    name = F.format_string("fold%d_%s", "fold", "model")
    params = F.format_string('{"fold": %d, "model": "%s"}', "fold", "model")
    df = cv.select(
        tk.run_id(F.lit("walk_forward"), name, params).alias("run_id"),
        F.lit("walk_forward").alias("experiment"), name.alias("run_name"),
        F.col("train_end").alias("start_time"), "smape", "wape", "mae",
    )
    return df.drop("smape", "wape", "mae"), tk.metric_rows(df, ["run_id"], ["smape", "wape", "mae"])


@query("U1_runs", f"SELECT run_id, experiment, run_name, start_time, {_r('smape', 'wape', 'mae')} FROM runs")
def u1(spark, d):
    runs, metrics = _runs(spark, d)
    return rounded(tk.runs_with_metrics(runs, metrics, "walk_forward", ["smape", "wape", "mae"]), "smape", "wape", "mae")


@query(
    "U2_best_run",
    """SELECT run_id, experiment, run_name, start_time, 'smape' AS key, round(smape, 6) + 0.0 AS value FROM runs
       ORDER BY smape, run_id LIMIT 1""",
)
def u2(spark, d):
    runs, metrics = _runs(spark, d)
    return rounded(tk.best_run(runs, metrics, "walk_forward", "smape"), "value")


@query("U3_run_ids", "SELECT run_id, run_name FROM runs")
def u3(spark, d):
    return _runs(spark, d)[0].select("run_id", "run_name")


def last_twelve_mean(y, horizon):
    """Example of a user model: mean of the last 12 weeks."""
    import numpy as np

    return np.full(horizon, y[-12:].mean())


@query("U4_user_model", f"SELECT {KEY2}, h + 1 AS step, round(recent_mean, 6) + 0.0 AS yhat FROM recent CROSS JOIN steps WHERE fold = 5")
def u4(spark, d):
    out = bl.user_model(tb.sell_in(spark, d), tb.FIRST_WEEK, tb.CUTOFF_WEEK, H, last_twelve_mean)
    return rounded(out, "yhat")
