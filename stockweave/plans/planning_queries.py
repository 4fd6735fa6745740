"""Feature store, stock planning, monitoring, hierarchy."""

from pyspark.sql import functions as F

from stockweave.functions.scalars import r6
from stockweave.operators import baselines as bl
from stockweave.operators import demand_patterns as dp
from stockweave.operators import evaluate as ev
from stockweave.operators import feature_store as fs
from stockweave.operators import hierarchy as hi
from stockweave.operators import metrics as mt
from stockweave.operators import monitoring as mo
from stockweave.operators import stock_planning as sp
from stockweave.operators.reshape import densify, pivot_categories
from stockweave.plans.business_queries import _r, blended, fc_naive, rounded
from stockweave.plans.evaluation_queries import _CV_COLS, _cv
from stockweave.plans.registry import KEY2, KEY3, define, query
from stockweave.schema import CHANNEL, MATERIAL, QTY, SERIES, SKU, WEEK
from stockweave.session import scratch_path
from stockweave.sources import tables as tb
from stockweave.streaming import arrivals

MEASURES = ["sell_in", "cust_sales", "channel_inv"]
NOW = 200144


def wide(spark, d, grain="coarse"):
    df = pivot_categories(tb.long_table(spark, d, grain))
    return densify(df, SKU, tb.FIRST_WEEK, tb.LAST_WEEK, MEASURES)


def store(spark, d):
    return fs.feature_store(wide(spark, d))


for _g in ("coarse", "fine"):
    define(
        f"wide_{_g}",
        f"""SELECT k.ch, k.mat, w.pos, w.yw, coalesce(sum(l.q) FILTER (l.cat = 'Sell-in'), 0.0) AS si,
              coalesce(sum(l.q) FILTER (l.cat = 'Cust. Sales'), 0.0) AS cs, coalesce(sum(l.q) FILTER (l.cat = 'Channel Inv.'), 0.0) AS ci
            FROM (SELECT DISTINCT ch, mat FROM long_{_g}) k CROSS JOIN weeks w
            LEFT JOIN long_{_g} l ON l.ch = k.ch AND l.mat = k.mat AND l.yw = w.yw GROUP BY k.ch, k.mat, w.pos, w.yw""",
    )

_S = {"sell_in": "si", "sales": "cs", "inv": "ci"}
_LAGS = ", ".join(f"lag({_S[m]}, {n}) OVER s AS {m}_lag_{n}" for m, lags in fs.LAGS.items() for n in lags)
_MAS = ", ".join(
    f"CASE WHEN pos >= {n} THEN avg({c}) OVER (s ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS {m}_ma{n}"
    for m, c in _S.items() for n in fs.ROLLING
)
_STDS = ", ".join(
    f"CASE WHEN pos >= {n} THEN stddev_samp({c}) OVER (s ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS {m}_std{n}"
    for m, c in _S.items() if m != "inv" for n in fs.ROLLING
)
define(
    "store_base",
    f"""SELECT ch, mat, pos, yw, si, cs, ci, {_LAGS}, {_MAS}, {_STDS},
          sum(si - cs) OVER (s ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS cumulative_gap_4w
        FROM wide_coarse WINDOW s AS (PARTITION BY ch, mat ORDER BY pos)""",
)
define(
    "store",
    """SELECT *, inv_lag_1 / greatest(sales_ma4 / 7, 0.01) AS days_of_supply_x,
         CASE WHEN sales_ma4 IS NOT NULL THEN inv_lag_1 / greatest(sales_ma4 / 7, 0.01) END AS days_of_supply,
         CASE WHEN sales_ma4 IS NOT NULL THEN inv_lag_1 / greatest(sales_ma4, 0.01) END AS weeks_of_supply,
         CASE WHEN sell_in_ma4 IS NOT NULL THEN sales_ma4 / greatest(sell_in_ma4, 0.01) END AS sell_through_rate_4w,
         CASE WHEN sell_in_ma13 IS NOT NULL THEN sales_ma13 / greatest(sell_in_ma13, 0.01) END AS sell_through_rate_13w,
         CASE WHEN sales_lag_1 IS NOT NULL THEN inv_lag_1 / greatest(sales_lag_1, 0.01) END AS inv_vs_sales_ratio,
         CASE WHEN inv_ma13 IS NOT NULL THEN inv_lag_1 / greatest(inv_ma13, 0.01) END AS inv_vs_trend,
         inv_lag_1 - inv_lag_2 AS inv_delta_1, inv_lag_1 - inv_lag_4 AS inv_delta_4, inv_ma4 - inv_ma13 AS inv_momentum,
         sell_in_lag_1 - sales_lag_1 AS replenishment_gap FROM store_base""",
)


@query(
    "D1_flag_and_repair",
    f"""SELECT {KEY3}, yw AS year_week, CASE WHEN cat = 'Channel Inv.' AND q < 0 THEN 0.0 ELSE q END AS quantity,
        CASE WHEN q = 50 AND yw // 100 = 2001 THEN 1 ELSE 0 END AS is_censored,
        CASE WHEN cat = 'Channel Inv.' AND q < 0 THEN 1 ELSE 0 END AS inv_was_negative FROM signed_fine""",
)
def d1(spark, d):
    return fs.flag_and_repair(tb.signed_observations(spark, d).drop("l_linenumber"), 50.0, 2001)


@query("D2_pivot_categories", f"SELECT {KEY2}, yw AS year_week, si AS sell_in, cs AS cust_sales, ci AS channel_inv FROM wide_coarse")
def d2(spark, d):
    return wide(spark, d)


define(
    "residuals",
    """SELECT ch, mat, pos, yw, ci - (coalesce(lag(ci) OVER s, ci) + si - cs) AS res FROM wide_coarse
       WINDOW s AS (PARTITION BY ch, mat ORDER BY pos)""",
)


@query("D3_balance_residual", f"SELECT {KEY2}, yw AS year_week, res AS balance_residual FROM residuals")
def d3(spark, d):
    return sp.balance_residual(wide(spark, d)).select(*SKU, WEEK, "balance_residual")


@query(
    "D3_balance_quality",
    f"""SELECT {KEY2}, round(avg(abs(res)), 6) + 0.0 AS mean_abs_residual,
        round(avg(CASE WHEN abs(res) > 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0 AS pct_weeks_with_adjustments,
        max(abs(res)) AS max_residual FROM residuals GROUP BY ch, mat""",
)
def d3_quality(spark, d):
    return rounded(sp.balance_quality(wide(spark, d)), "mean_abs_residual", "pct_weeks_with_adjustments")


_LAG_COLS = [f"{m}_lag_{n}" for m, lags in fs.LAGS.items() for n in lags]


@query("D4_measure_lags", f"SELECT {KEY2}, yw AS year_week, {', '.join(_LAG_COLS)} FROM store_base")
def d4(spark, d):
    return fs.with_measure_lags(wide(spark, d)).select(*SKU, WEEK, *_LAG_COLS)


_ROLL_COLS = [f"{m}_ma{n}" for m in _S for n in fs.ROLLING] + [f"{m}_std{n}" for m in ("sell_in", "sales") for n in fs.ROLLING]


@query(
    "D5_measure_rolling",
    f"""SELECT {KEY2}, yw AS year_week, {_r(*_ROLL_COLS)}, round(sell_in_std13 / (sell_in_ma13 + 1e-9), 6) + 0.0 AS sell_in_cv13
        FROM store_base""",
)
def d5(spark, d):
    df = rounded(fs.with_measure_rolling(wide(spark, d)), *_ROLL_COLS, "sell_in_cv13")
    return df.select(*SKU, WEEK, *_ROLL_COLS, "sell_in_cv13")


@query(
    "D6_ratios",
    f"""SELECT {KEY2}, yw AS year_week, {_r(*fs.RATIOS)}, CASE WHEN days_of_supply > 60 THEN 1 WHEN days_of_supply IS NOT NULL THEN 0 END AS inv_overstock_flag,
        CASE WHEN days_of_supply < 14 THEN 1 WHEN days_of_supply IS NOT NULL THEN 0 END AS inv_stockout_flag FROM store""",
)
def d6(spark, d):
    df = rounded(store(spark, d), *fs.RATIOS)
    return df.select(*SKU, WEEK, *fs.RATIOS, "inv_overstock_flag", "inv_stockout_flag")


_EVENTS = ", ".join(
    f"CASE WHEN yw % 100 BETWEEN {a} AND {b} THEN 1 ELSE 0 END AS {n}" for n, (a, b) in fs.EVENT_WEEKS.items()
)


@query(
    "D7_calendar",
    f"""SELECT yw AS year_week, CAST(yw % 100 AS INTEGER) AS week_num, CAST(month(d) AS INTEGER) AS month, CAST(quarter(d) AS INTEGER) AS quarter,
        round(sin(2 * pi() * (yw % 100) / 52), 6) + 0.0 AS week_sin, round(cos(2 * pi() * (yw % 100) / 52), 6) + 0.0 AS week_cos,
        round(sin(2 * pi() * month(d) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(d) / 12), 6) + 0.0 AS month_cos,
        CASE WHEN quarter(d) = 4 THEN 1 ELSE 0 END AS is_q4, CASE WHEN month(d) = 1 THEN 1 ELSE 0 END AS is_jan, pos AS weeks_since_epoch,
        (yw // 100 - 1995) / 2.0::DOUBLE AS year_normalized, CAST(greatest(48 - yw % 100, 0) AS INTEGER) AS weeks_to_black_friday,
        CAST(greatest(yw % 100 - 48, 0) AS INTEGER) AS weeks_after_black_friday, {_EVENTS}
        FROM weeks WHERE yw IN (SELECT yw FROM long_fine)""",
)
def d7(spark, d):
    df = tb.long_table(spark, d).select(WEEK).distinct().withColumns(fs.calendar_columns(tb.FIRST_WEEK, 1995))
    return rounded(df, "week_sin", "week_cos", "month_sin", "month_cos")


@query(
    "D8_year_over_year",
    f"""SELECT {KEY2}, yw AS year_week,
        round(lag(si, 52) OVER s / (lag(si, 104) OVER s + 1e-9), 3) + 0.0 AS yoy_sell_in_ratio,
        round(lag(cs, 52) OVER s / (lag(cs, 104) OVER s + 1e-9), 3) + 0.0 AS yoy_sales_ratio,
        round(avg(si) OVER (PARTITION BY ch, mat, yw % 100 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
          / (avg(si) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9), 6) + 0.0 AS seasonal_index_sell_in,
        round(avg(cs) OVER (PARTITION BY ch, mat, yw % 100 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
          / (avg(cs) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9), 6) + 0.0 AS seasonal_index_sales
        FROM wide_coarse WINDOW s AS (PARTITION BY ch, mat ORDER BY pos)""",
)
def d8(spark, d):
    df = fs.with_year_over_year(wide(spark, d))
    ratios = ["yoy_sell_in_ratio", "yoy_sales_ratio"]
    index = ["seasonal_index_sell_in", "seasonal_index_sales"]
    return df.select(
        *SKU, WEEK, *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ratios], *[r6(c).alias(c) for c in index]
    )


_ZERO = ["prob_nonzero_4w", "prob_nonzero_13w", "prob_nonzero_52w", "inter_demand_interval", "demand_size_mean", "demand_size_cv"]


@query(
    "D9_zero_inflation",
    f"""SELECT {KEY2}, yw AS year_week, {_r(*_ZERO)}, weeks_since_last_nonzero, weeks_since_last_sales FROM (
        SELECT ch, mat, yw,
          avg(sold) OVER (s ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS prob_nonzero_4w,
          avg(sold) OVER (s ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) AS prob_nonzero_13w,
          avg(sold) OVER (s ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS prob_nonzero_52w,
          (max(sold_at) OVER b - min(sold_at) OVER b) / nullif(count(sold_at) OVER b - 1, 0) AS inter_demand_interval,
          avg(size) OVER b AS demand_size_mean, stddev_samp(size) OVER b / avg(size) OVER b AS demand_size_cv,
          pos - max(sold_at) OVER b AS weeks_since_last_nonzero, pos - max(sale_at) OVER b AS weeks_since_last_sales
        FROM (SELECT *, CASE WHEN si > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sold, CASE WHEN si > 0 THEN pos END AS sold_at,
                CASE WHEN si > 0 THEN si END AS size, CASE WHEN cs > 0 THEN pos END AS sale_at FROM wide_coarse)
        WINDOW s AS (PARTITION BY ch, mat ORDER BY pos),
          b AS (PARTITION BY ch, mat ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
def d9(spark, d):
    df = rounded(fs.with_zero_inflation(wide(spark, d)), *_ZERO)
    return df.select(*SKU, WEEK, *_ZERO, "weeks_since_last_nonzero", "weeks_since_last_sales")


define(
    "fine_ma4",
    """SELECT ch, mat, split_part(mat, ',', 1) AS fam, yw, CASE WHEN pos >= 4 THEN avg(si) OVER
         (PARTITION BY ch, mat ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS ma FROM wide_fine""",
)


@query(
    "D10_cross_series",
    """SELECT fam AS product_family, ch AS "Channel", yw AS year_week, round(max(ft), 6) + 0.0 AS family_total_sell_in_4w,
         round(max(ct), 6) + 0.0 AS channel_total_sell_in_4w, round(sum(ma / nullif(ft, 0)), 6) + 0.0 AS family_channel_share,
         round(sum(ma / nullif(ct, 0)), 6) + 0.0 AS sku_channel_share
       FROM fine_ma4 JOIN (SELECT fam, yw, coalesce(sum(ma), 0.0) AS ft FROM fine_ma4 GROUP BY fam, yw) USING (fam, yw)
       JOIN (SELECT ch, yw, coalesce(sum(ma), 0.0) AS ct FROM fine_ma4 GROUP BY ch, yw) USING (ch, yw) GROUP BY fam, ch, yw""",
)
def d10(spark, d):
    df = fs.with_cross_series(fs.with_measure_rolling(wide(spark, d, "fine")).select(*SKU, WEEK, "sell_in_ma4"))
    got = df.groupBy("product_family", CHANNEL, WEEK).agg(
        *[F.max(c).alias(c) for c in ("family_total_sell_in_4w", "channel_total_sell_in_4w")],
        *[F.sum(c).alias(c) for c in ("family_channel_share", "sku_channel_share")],
    )
    return rounded(got, "family_total_sell_in_4w", "channel_total_sell_in_4w", "family_channel_share", "sku_channel_share")


@query(
    "D11_lifecycle",
    f"""SELECT {KEY2}, yw AS year_week, CAST(age AS INTEGER) AS sku_age_weeks, CASE WHEN age <= 8 THEN 1 WHEN age IS NOT NULL THEN 0 END AS sku_is_new,
        CASE WHEN age > 26 THEN 1 WHEN age IS NOT NULL THEN 0 END AS sku_is_mature,
        CAST(recent = 0 AND age > 26 AS INTEGER) AS sku_is_retiring,
        CAST(CASE WHEN pos >= c0 THEN pos - c0 END AS INTEGER) AS channel_tenure_weeks FROM (
        SELECT *, CASE WHEN pos >= first THEN pos - first END AS age FROM (
          SELECT ch, mat, pos, yw, min(CASE WHEN si > 0 THEN pos END) OVER (PARTITION BY ch, mat) AS first,
            min(CASE WHEN si > 0 THEN pos END) OVER (PARTITION BY ch) AS c0,
            sum(si) OVER (PARTITION BY ch, mat ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS recent FROM wide_coarse))""",
)
def d11(spark, d):
    df = fs.with_lifecycle(wide(spark, d), tb.FIRST_WEEK)
    return df.select(*SKU, WEEK, "sku_age_weeks", "sku_is_new", "sku_is_mature", "sku_is_retiring", "channel_tenure_weeks")


def _registry(grain):
    return f"""SELECT *, CASE WHEN quadrant IN ('dead', 'rare') THEN quadrant WHEN quadrant = 'smooth' AND k >= 13 THEN 'regular' ELSE 'intermittent' END AS segment
     FROM (SELECT *, CASE WHEN k = 0 THEN 'dead' WHEN k < 4 THEN 'rare' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN cv2 < 0.49 THEN 'intermittent'
       WHEN adi < 1.32 THEN 'erratic' ELSE 'lumpy' END AS quadrant FROM (
       SELECT ch, mat, count(gap) + CASE WHEN max(n) > 0 THEN 1 ELSE 0 END AS k, CASE WHEN max(n) = 0 THEN NULL WHEN max(n) < 4 THEN 52.0::DOUBLE / max(n) ELSE avg(gap) END AS adi,
         CASE WHEN max(n) < 4 THEN 0.0::DOUBLE ELSE pow(stddev_samp(size) / avg(size), 2) END AS cv2, min(week) AS first_week, max(week) AS last_week
       FROM (SELECT ch, mat, size, week, sold_at - lag(sold_at) OVER (PARTITION BY ch, mat, sold_at IS NULL ORDER BY sold_at) AS gap, count(sold_at) OVER (PARTITION BY ch, mat) AS n
             FROM (SELECT ch, mat, CASE WHEN q > 0 AND pos > 304 AND pos <= 356 THEN pos END AS sold_at, CASE WHEN q > 0 AND pos > 304 AND pos <= 356 THEN q END AS size,
                     CASE WHEN q > 0 AND pos > 304 AND pos <= 356 THEN yw END AS week FROM {grain})) GROUP BY ch, mat))"""


define("registry_coarse", _registry('si_coarse'))
define("registry_fine", _registry('si_fine'))


@query(
    "D12_series_registry",
    f"""SELECT {KEY2}, k AS active_weeks, first_week AS first_active_week, last_week AS last_active_week, round(adi, 6) + 0.0 AS adi,
        round(cv2, 6) + 0.0 AS cv2, quadrant, segment FROM registry_coarse""",
)
def d12(spark, d):
    return rounded(dp.series_registry(tb.sell_in(spark, d), NOW), "adi", "cv2")


_STATUS = """CASE WHEN days_of_supply < 7 THEN 'critical_stockout' WHEN days_of_supply < 14 THEN 'warning_stockout'
  WHEN days_of_supply < 45 THEN 'healthy' WHEN days_of_supply < 60 THEN 'warning_overstock' ELSE 'critical_overstock' END"""


@query(
    "D13_supply_health",
    f"""SELECT {KEY2}, yw AS year_week, inv_lag_1 AS current_inv_units, sales_ma4 AS avg_weekly_sales, round(days_of_supply, 6) + 0.0 AS days_of_supply,
        {_STATUS} AS dos_status, round(sell_through_rate_4w, 6) + 0.0 AS sell_through_rate_4w FROM store WHERE yw = {NOW}""",
)
def d13(spark, d):
    return rounded(sp.supply_health(store(spark, d), NOW), "days_of_supply", "sell_through_rate_4w")


_KPI = ["sell_in_yoy_pct", "avg_dos", "sell_through_rate"]


@query(
    "D14_executive_kpis",
    f"""SELECT ytd AS sell_in_ytd, round((ytd / before - 1) * 100, 6) + 0.0 AS sell_in_yoy_pct, pos_ytd, {_r('avg_dos', 'sell_through_rate')}, active_skus, active_channels
        FROM (SELECT sum(si) FILTER (yw BETWEEN 200101 AND {NOW}) AS ytd, sum(si) FILTER (yw BETWEEN 200001 AND {NOW - 100}) AS before,
          sum(cs) FILTER (yw BETWEEN 200101 AND {NOW}) AS pos_ytd, avg(days_of_supply) FILTER (yw = {NOW}) AS avg_dos,
          avg(sell_through_rate_4w) * 100 AS sell_through_rate, count(DISTINCT mat) FILTER (yw = {NOW} AND sell_in_ma4 > 0) AS active_skus,
          count(DISTINCT ch) FILTER (yw = {NOW} AND sell_in_ma4 > 0) AS active_channels FROM store)""",
)
def d14(spark, d):
    return rounded(sp.executive_kpis(store(spark, d), NOW), *_KPI)


@query(
    "D14_sell_through_ytd",
    """SELECT ch AS "Channel", sum(cs) AS total_sales, sum(si) AS total_sell_in, round(sum(cs) * 100.0::DOUBLE / nullif(sum(si), 0), 6) + 0.0 AS sell_through_pct
       FROM wide_coarse WHERE yw // 100 = 2001 GROUP BY ch""",
)
def d14_ytd(spark, d):
    df = pivot_categories(tb.long_table(spark, d, "coarse"))
    return rounded(sp.sell_through_ytd(df, 2001), "sell_through_pct")


@query(
    "D14_overstock_units",
    """SELECT round(coalesce(sum(greatest(inv_lag_1 - sales_ma4 * (45.0::DOUBLE / 7), 0.0)) FILTER (days_of_supply > 60), 0.0), 6) + 0.0 AS overstock_units FROM store""",
)
def d14_over(spark, d):
    return rounded(sp.overstock_units(store(spark, d)), "overstock_units")


def _fc_actual(spark, d):
    actual = tb.dense_table(spark, d, "coarse", "Sell-in").select(*SKU, WEEK, F.col(QTY).alias("actual"))
    fc = blended(spark, d).select(*SKU, WEEK, F.col("forecast_q50").alias("forecast"))
    return mo.forecast_vs_actual(fc, actual)


define("fc_actual", "SELECT b.ch, b.mat, b.yw, b.q50 AS f, s.q AS a FROM blended b JOIN si_coarse s ON s.ch = b.ch AND s.mat = b.mat AND s.yw = b.yw")


@query(
    "D15_forecast_vs_actual",
    f"""SELECT {KEY2}, yw AS year_week, round(f, 6) + 0.0 AS forecast, a AS actual,
        round(abs(f - a) / nullif((abs(f) + abs(a)) / 2, 0) * 100, 6) + 0.0 AS row_smape FROM fc_actual""",
)
def d15(spark, d):
    return rounded(_fc_actual(spark, d), "forecast", "row_smape")


@query(
    "D15_hit_rate",
    """SELECT yw AS year_week, round(coalesce(avg(CASE WHEN abs(a - f) / a <= 0.25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (a > 0), 0) * 100, 6) + 0.0 AS hit_rate
       FROM fc_actual GROUP BY yw""",
)
def d15_hit(spark, d):
    return _fc_actual(spark, d).groupBy(WEEK).agg(r6(mo.hit_rate()).alias("hit_rate"))


_ACC = """round(avg(2.0::DOUBLE * abs(a - f) / (abs(a) + abs(f) + 1e-9)) * 100, 6) + 0.0 AS smape,
  round(CASE WHEN avg(abs(a)) >= 1e-9 THEN avg(f - a) / avg(abs(a)) * 100 ELSE 0.0::DOUBLE END, 3) + 0.0 AS bias_pct,
  round(coalesce(avg(CASE WHEN abs(a - f) / a <= 0.25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (a > 0), 0) * 100, 6) + 0.0 AS hit_rate_25pct, count(*) AS n_series"""
define("acc_rows", "SELECT f.*, r.segment, substring(f.mat, 1, 7) AS fam FROM fc_actual f JOIN registry_coarse r USING (ch, mat)")
define(
    "acc_log",
    f"""SELECT yw, 'overall' AS scope, 'all' AS member, {_ACC} FROM acc_rows GROUP BY yw
        UNION ALL SELECT yw, 'segment', segment, {_ACC} FROM acc_rows GROUP BY yw, segment
        UNION ALL SELECT yw, 'family', fam, {_ACC} FROM acc_rows GROUP BY yw, fam""",
)


def _acc_log(spark, d):
    seg = dp.series_registry(tb.sell_in(spark, d), NOW).select(*SKU, "segment")
    rows = _fc_actual(spark, d).join(seg, SKU).withColumn("product_family", F.substring(MATERIAL, 1, 7))
    return mo.accuracy_log(rows)


@query("D16_accuracy_log", "SELECT yw AS year_week, scope, member, smape, bias_pct, hit_rate_25pct, n_series FROM acc_log")
def d16(spark, d):
    df = rounded(_acc_log(spark, d), "smape", "hit_rate_25pct")
    return df.withColumn("bias_pct", F.round("bias_pct", 3) + F.lit(0.0))


_PSI = ["sell_in_ma13", "sales_ma13", "inv_ma13"]
define(
    "psi_rows",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN yw BETWEEN 199901 AND 200052 THEN 'ref' ELSE 'cur' END AS side, {c} AS x FROM store WHERE yw BETWEEN 199901 AND {NOW} AND {c} IS NOT NULL"
        for c in _PSI
    ),
)
define("psi_ends", "SELECT feature, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM psi_rows WHERE side = 'ref' GROUP BY feature")
define(
    "psi_bins",
    """SELECT e.feature, b.i, count(*) FILTER (r.side = 'ref') AS r, count(*) FILTER (r.side = 'cur') AS c
       FROM psi_ends e CROSS JOIN range(10) b(i) LEFT JOIN psi_rows r ON r.feature = e.feature AND r.x BETWEEN e.lo AND e.hi
         AND least(floor((r.x - e.lo) / ((e.hi - e.lo) / 10)), 9) = b.i GROUP BY e.feature, b.i""",
)
define(
    "psi_values",
    """SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM (
         SELECT feature, (r + 1e-6::DOUBLE) / (sum(r) OVER f + 1e-5::DOUBLE) AS p, (c + 1e-6::DOUBLE) / (sum(c) OVER f + 1e-5::DOUBLE) AS q
         FROM psi_bins WINDOW f AS (PARTITION BY feature)) GROUP BY feature""",
)
define(
    "psi_table",
    """SELECT feature, psi, CASE WHEN psi < 0.1 THEN 'green' WHEN psi < 0.2 THEN 'yellow' ELSE 'red' END AS status, s.* EXCLUDE (feature) FROM psi_values JOIN (
         SELECT feature, avg(x) FILTER (side = 'ref') AS ref_mean, avg(x) FILTER (side = 'cur') AS cur_mean, count(*) FILTER (side = 'ref') AS ref_n,
           count(*) FILTER (side = 'cur') AS cur_n, quantile_cont(x, 0.5) FILTER (side = 'ref') AS ref_p50, quantile_cont(x, 0.5) FILTER (side = 'cur') AS cur_p50
         FROM psi_rows GROUP BY feature) s USING (feature)""",
)
_PSI_COLS = ["psi", "ref_mean", "cur_mean", "ref_p50", "cur_p50", "mean_shift_pct"]


def _psi(spark, d):
    w = F.col(WEEK)
    return mo.stability_index(store(spark, d), _PSI, w.between(199901, 200052), w.between(200101, NOW))


@query(
    "D17_stability_index",
    f"""SELECT feature, status, ref_n, cur_n, {_r('psi', 'ref_mean', 'cur_mean', 'ref_p50', 'cur_p50')},
        round((cur_mean - ref_mean) / (abs(ref_mean) + 1e-6) * 100, 6) + 0.0 AS mean_shift_pct FROM psi_table""",
)
def d17(spark, d):
    return rounded(_psi(spark, d), *_PSI_COLS)


define("weekly_acc", "SELECT yw, avg(2.0::DOUBLE * abs(a - f) / (abs(a) + abs(f) + 1e-9)) * 100 AS smape FROM acc_rows GROUP BY yw")


@query(
    "D18_concept_drift",
    """SELECT *, round(recent - base, 6) + 0.0 AS delta_pp, CASE WHEN recent - base > 5 THEN 'red' WHEN recent - base > 3 THEN 'yellow' ELSE 'green' END AS status
       FROM (SELECT base, recent, slope, n FROM (
         SELECT avg(smape) FILTER (i <= 8) AS base, avg(smape) FILTER (i > n - 4) AS recent, regr_slope(smape, i) FILTER (i > n - 4) AS slope, max(n) AS n
         FROM (SELECT smape, row_number() OVER (ORDER BY yw) AS i, count(*) OVER () AS n FROM weekly_acc)))""".replace(
        "SELECT *, round(recent - base, 6)",
        "SELECT round(base, 6) + 0.0 AS baseline_smape, round(recent, 6) + 0.0 AS recent_smape, round(slope, 6) + 0.0 AS trend_slope_per_week, n AS weeks_analyzed, round(recent - base, 6)",
    ),
)
def d18(spark, d):
    log = _acc_log(spark, d).filter(F.col("scope") == "overall")
    return rounded(mo.concept_drift(log), "baseline_smape", "recent_smape", "trend_slope_per_week", "delta_pp")


@query(
    "D20_alerts",
    """SELECT CAST(c AS INTEGER) AS n_critical, CAST(w AS INTEGER) AS n_warning, CASE WHEN c >= 1 THEN 'RETRAIN_IMMEDIATE' WHEN w >= 3 THEN 'RETRAIN_SCHEDULED' ELSE 'MONITOR_ONLY' END AS action FROM (
         SELECT CAST(smape > 30 AS INTEGER) + CAST(abs(bias_pct) > 10 AS INTEGER) + (SELECT max(CAST(status = 'red' AS INTEGER)) FROM psi_table) AS c,
           CAST(smape <= 30 AND smape > 21 AS INTEGER) + (SELECT max(CAST(status = 'yellow' AS INTEGER)) FROM psi_table) AS w
         FROM acc_log WHERE scope = 'overall' AND yw = 200113)""",
)
def d20(spark, d):
    acc = _acc_log(spark, d).filter((F.col("scope") == "overall") & (F.col(WEEK) == 200113))
    return mo.alerts(acc, _psi(spark, d))


# ---- composite stock risk --------------------------------------------------
define(
    "scored_parts",
    """SELECT *, coalesce(days_of_supply, 30) AS dos, coalesce(inv_delta_1, 0) AS delta, coalesce(sell_through_rate_4w, 0.8) AS st, coalesce(prob13, 0.5) AS pr,
         greatest(coalesce(sales_ma4, 1), 0.01) AS wk, coalesce(sales_ma4, 1) / greatest(coalesce(sales_ma13, 1), 0.01) AS tr
       FROM (SELECT *, avg(CASE WHEN si > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY ch, mat ORDER BY pos ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) AS prob13 FROM store)""",
)
define(
    "scored_points",
    """SELECT *, CASE WHEN dos > 90 THEN 40.0::DOUBLE WHEN dos > 60 THEN 20 + (dos - 60) / 30 * 20 ELSE greatest(0.0::DOUBLE, (dos - 45) / 15 * 20) END AS o0,
         CASE WHEN delta > 0 THEN least(delta / wk * 25, 25.0::DOUBLE) ELSE 0.0::DOUBLE END AS o1,
         CASE WHEN st < 0.5 THEN 20.0::DOUBLE WHEN st < 0.75 THEN (0.75::DOUBLE - st) / 0.25::DOUBLE * 20 ELSE 0.0::DOUBLE END AS o2,
         CASE WHEN tr < 0.7 THEN 15.0::DOUBLE WHEN tr < 0.9 THEN (0.9::DOUBLE - tr) / 0.2::DOUBLE * 15 ELSE 0.0::DOUBLE END AS o3,
         CASE WHEN dos < 7 THEN 40.0::DOUBLE WHEN dos < 14 THEN 20 + (14 - dos) / 7 * 20 ELSE 0.0::DOUBLE END AS s0,
         CASE WHEN delta < 0 THEN least(abs(delta) / wk * 30, 30.0::DOUBLE) ELSE 0.0::DOUBLE END AS s1,
         CASE WHEN pr > 0.7 AND st > 1 THEN 20.0::DOUBLE WHEN st > 0.9 THEN (st - 0.9::DOUBLE) / 0.1::DOUBLE * 10 ELSE 0.0::DOUBLE END AS s2,
         CASE WHEN tr > 1.3 THEN 10.0::DOUBLE WHEN tr > 1.1 THEN (tr - 1.1::DOUBLE) / 0.2::DOUBLE * 10 ELSE 0.0::DOUBLE END AS s3 FROM scored_parts""",
)
define(
    "stock_risk",
    """SELECT *, least(greatest(o, s), 100.0) AS score, CASE WHEN kind = 'overstock' AND dos > 90 THEN 'CRITICAL_OVERSTOCK' WHEN kind = 'overstock' AND dos > 60 THEN 'HIGH_OVERSTOCK'
           WHEN kind = 'stockout' AND dos < 7 THEN 'CRITICAL_STOCKOUT' WHEN kind = 'stockout' AND dos < 14 THEN 'LOW_STOCK_WARNING' ELSE 'HEALTHY' END AS tier,
         CASE kind WHEN 'overstock' THEN CASE greatest(o0, o1, o2, o3) WHEN o0 THEN 'dos_component' WHEN o1 THEN 'velocity_component' WHEN o2 THEN 'sell_through_component' ELSE 'demand_trend_component' END
           WHEN 'stockout' THEN CASE greatest(s0, s1, s2, s3) WHEN s0 THEN 'dos_component' WHEN s1 THEN 'velocity_component' WHEN s2 THEN 'demand_pressure_component' ELSE 'acceleration_component' END
           ELSE 'none' END AS driver
       FROM (SELECT *, CASE WHEN o > s THEN 'overstock' WHEN s > 5 THEN 'stockout' ELSE 'healthy' END AS kind FROM (SELECT *, o0 + o1 + o2 + o3 AS o, s0 + s1 + s2 + s3 AS s FROM scored_points))""",
)


def _stock_risk(spark, d):
    df = store(spark, d)
    prob = F.avg((F.col("sell_in") > 0).cast("int")).over(fs.by_week().rowsBetween(-13, -1))
    return sp.composite_risk(df.withColumn("prob_nonzero_13w", prob))


@query(
    "D21_composite_risk",
    f"""SELECT {KEY2}, yw AS year_week, round(score, 6) + 0.0 AS risk_score, kind AS risk_type, tier AS risk_tier, driver AS primary_driver,
        round(o, 6) + 0.0 AS overstock_score, round(s, 6) + 0.0 AS stockout_score FROM stock_risk""",
)
def d21(spark, d):
    df = rounded(_stock_risk(spark, d), "risk_score", "overstock_score", "stockout_score")
    return df.select(*SKU, WEEK, "risk_score", "risk_type", "risk_tier", "primary_driver", "overstock_score", "stockout_score")


define(
    "stock_trend",
    f"""SELECT ch, mat, slope, CASE WHEN slope > 5 THEN 'critical_worsening' WHEN slope > 2 THEN 'worsening' WHEN slope < -2 THEN 'improving' ELSE 'stable' END AS trend
        FROM (SELECT ch, mat, regr_slope(score, pos) AS slope FROM stock_risk WHERE pos BETWEEN 353 AND 356 GROUP BY ch, mat)""",
)


@query("D22_risk_trend", f"SELECT {KEY2}, round(slope, 6) + 0.0 AS slope, trend AS risk_trend FROM stock_trend")
def d22(spark, d):
    return rounded(sp.risk_trend(_stock_risk(spark, d), NOW), "slope")


_TIERS = ", ".join(f"count(*) FILTER (tier = '{v}') AS {k}_count" for k, v in sp.TIERS.items())


@query(
    "D22_risk_overview",
    f"""SELECT count(*) AS total_series, {_TIERS}, round(coalesce(sum(CASE WHEN days_of_supply > 60 THEN greatest(inv_lag_1 - greatest(sales_ma4, 0.01) * (45.0::DOUBLE / 7), 0.0) END), 0.0), 6) + 0.0 AS overstock_excess_units,
        round(count(*) FILTER (tier <> 'HEALTHY') * 100.0::DOUBLE / count(*), 6) + 0.0 AS pct_at_risk,
        count(*) FILTER (trend IN ('worsening', 'critical_worsening')) AS worsening_count FROM stock_risk LEFT JOIN stock_trend USING (ch, mat) WHERE yw = {NOW}""",
)
def d22_overview(spark, d):
    scored = _stock_risk(spark, d)
    return rounded(sp.risk_overview(scored, sp.risk_trend(scored, NOW), NOW), "overstock_excess_units", "pct_at_risk")


_IMPACT = ["excess_units", "carrying_cost_weekly", "weeks_to_healthy_dos", "weeks_to_stockout", "lost_sales_units"]


@query(
    "D23_impact",
    f"""SELECT {KEY2}, yw AS year_week, impact_type, {_r(*_IMPACT)} FROM (
        SELECT *, CASE WHEN over THEN excess END AS excess_units, CASE WHEN over THEN excess * 100 * 0.003::DOUBLE END AS carrying_cost_weekly, CASE WHEN over THEN (days_of_supply - 45) / 7 END AS weeks_to_healthy_dos,
          CASE WHEN short THEN days_of_supply / 7 END AS weeks_to_stockout, CASE WHEN short THEN greatest(sales_ma4, 0.01) * greatest(0.0::DOUBLE, 2 - days_of_supply / 7) END AS lost_sales_units,
          CASE WHEN over THEN 'overstock' WHEN short THEN 'stockout' ELSE 'healthy' END AS impact_type
        FROM (SELECT *, days_of_supply > 60 AS over, days_of_supply < 14 AS short, greatest(inv_lag_1 - greatest(sales_ma4, 0.01) * (45.0::DOUBLE / 7), 0.0) AS excess FROM store))""",
)
def d23(spark, d):
    return rounded(sp.with_impact(store(spark, d)), *_IMPACT).select(*SKU, WEEK, "impact_type", *_IMPACT)


@query(
    "D24_adjusted_forecast",
    f"""SELECT {KEY2}, year_week, reason, round(m, 6) + 0.0 AS multiplier, round(f * m, 6) + 0.0 AS adjusted FROM (
        SELECT ch, mat, b.yw AS year_week, b.q50 AS f, CASE WHEN dos IS NULL THEN 'no_inv_data' WHEN dos >= 90 THEN 'critical_overstock_suppression' WHEN dos >= 60 THEN 'warning_overstock_suppression'
            WHEN dos <= 7 THEN 'critical_stockout_boost' WHEN dos <= 14 THEN 'warning_stockout_boost' ELSE 'healthy' END AS reason,
          CASE WHEN dos IS NULL THEN 1.0::DOUBLE WHEN dos >= 90 THEN greatest(0.05::DOUBLE, 1 - (dos - 90) / 60) * CASE WHEN mom > 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END
            WHEN dos >= 60 THEN 1 - 0.4::DOUBLE * ((dos - 60) / 30) WHEN dos <= 7 THEN least(3.0::DOUBLE, 1 + greatest(0.0::DOUBLE, b.q50 * 30 / 7 - dos * b.q50 / 7) / greatest(b.q50, 1.0))
            WHEN dos <= 14 THEN 1 + 0.3::DOUBLE * ((14 - dos) / 14) ELSE 1.0::DOUBLE END AS m
        FROM blended b JOIN (SELECT ch, mat, days_of_supply AS dos, inv_momentum AS mom FROM store WHERE yw = 200101) USING (ch, mat))""",
)
def d24(spark, d):
    state = store(spark, d).filter(F.col(WEEK) == 200101).select(*SKU, "days_of_supply", "inv_momentum")
    df = sp.with_adjusted_forecast(blended(spark, d).join(state, SKU), "forecast_q50")
    return rounded(df, "multiplier", "adjusted").select(*SKU, WEEK, "reason", "multiplier", "adjusted")


define(
    "flow",
    """SELECT w.ch, w.mat, w.pos, w.yw, b.q50 AS inflow, w.cs AS outflow, coalesce(i.inv, 0.0) AS start FROM wide_coarse w
       JOIN blended b ON b.ch = w.ch AND b.mat = w.mat AND b.yw = w.yw LEFT JOIN inv_now i ON i.ch = w.ch AND i.mat = w.mat""",
)
define(
    "projected",
    """SELECT ch, mat, pos, yw, outflow, greatest(0.0, start + inflow - outflow) AS inv FROM flow WHERE yw = 200101
       UNION ALL SELECT f.ch, f.mat, f.pos, f.yw, f.outflow, greatest(0.0, p.inv + f.inflow - f.outflow) FROM projected p
       JOIN flow f ON f.ch = p.ch AND f.mat = p.mat AND f.pos = p.pos + 1""",
)


def _projected(spark, d):
    from stockweave.operators.inventory import current_inventory

    inv = current_inventory(tb.long_table(spark, d, "coarse").filter(F.col(WEEK) <= tb.CUTOFF_WEEK)).select(*SKU, "current_inventory")
    sales = wide(spark, d).select(*SKU, WEEK, "cust_sales")
    flow = blended(spark, d).join(sales, [*SKU, WEEK]).join(inv, SKU, "left").fillna(0.0, subset=["current_inventory"])
    return sp.project_inventory(flow, "current_inventory", "forecast_q50", "cust_sales")


@query("D25_projected_inventory", f"SELECT {KEY2}, yw AS year_week, round(inv, 6) + 0.0 AS projected_inv FROM projected")
def d25(spark, d):
    return rounded(_projected(spark, d), "projected_inv").select(*SKU, WEEK, "projected_inv")


_PROJ = ["max_projected_dos", "min_projected_inv", "ends_at_inv", "ends_at_dos"]


@query(
    "D25_projection_checks",
    f"""SELECT {KEY2}, count(*) FILTER (d > 90) AS weeks_overstock, round(max(d), 3) + 0.0 AS max_projected_dos, round(min(inv), 3) + 0.0 AS min_projected_inv,
        round(arg_max(inv, yw), 3) + 0.0 AS ends_at_inv, round(arg_max(d, yw), 3) + 0.0 AS ends_at_dos
        FROM (SELECT *, inv / greatest(outflow / 7, 0.01) AS d FROM projected) GROUP BY ch, mat""",
)
def d25_checks(spark, d):
    df = sp.projection_checks(_projected(spark, d), "cust_sales")
    return df.withColumns({c: F.round(c, 3) + F.lit(0.0) for c in _PROJ})


# ---- hierarchy -------------------------------------------------------------
define(
    "levels",
    """SELECT 'total' AS level, yw, NULL::VARCHAR AS fam, NULL::VARCHAR AS ch, NULL::VARCHAR AS mat, sum(q) AS q FROM sold GROUP BY yw
       UNION ALL SELECT 'family', yw, split_part(mat, ',', 1), NULL, NULL, sum(q) FROM sold GROUP BY ALL
       UNION ALL SELECT 'family_channel', yw, split_part(mat, ',', 1), ch, NULL, sum(q) FROM sold GROUP BY ALL
       UNION ALL SELECT 'sku_channel', yw, split_part(mat, ',', 1), ch, mat, sum(q) FROM sold GROUP BY ALL""",
)


@query(
    "D26_hierarchy_sums",
    """SELECT level, yw AS year_week, fam AS product_family, ch AS "Channel", mat AS "Material Description", q AS quantity FROM levels""",
)
def d26(spark, d):
    return hi.hierarchy_sums(tb.sell_in(spark, d, "fine"), QTY)


@query(
    "D26_coherence",
    """SELECT yw AS year_week, sum(q) FILTER (level = 'sku_channel') AS bottom, sum(q) FILTER (level = 'total') AS top,
         abs(sum(q) FILTER (level = 'sku_channel') - sum(q) FILTER (level = 'total')) AS residual, 1 AS is_consistent, 0.0::DOUBLE AS pct_error FROM levels GROUP BY yw""",
)
def d26_check(spark, d):
    return hi.coherence(hi.hierarchy_sums(tb.sell_in(spark, d, "fine"), QTY), QTY)


define(
    "hist_share",
    """SELECT ch, mat, fam, coalesce(s, 0.0) / 26 AS hp FROM (SELECT DISTINCT ch, mat, split_part(mat, ',', 1) AS fam FROM sold WHERE yw <= 200144)
       LEFT JOIN (SELECT ch, mat, sum(q / greatest(t, 0.001)) AS s FROM (SELECT ch, mat, q, sum(q) OVER (PARTITION BY split_part(mat, ',', 1), ch, yw) AS t
         FROM sold WHERE yw BETWEEN 200119 AND 200144) GROUP BY ch, mat) USING (ch, mat)""",
)
define("shares", "SELECT *, hp / greatest(sum(hp) OVER (PARTITION BY fam, ch), 0.001) AS np FROM hist_share")


@query(
    "D27_proportions",
    f"SELECT {KEY2}, fam AS product_family, round(hp, 6) + 0.0 AS historical_proportion, round(np, 6) + 0.0 AS normalized_proportion FROM shares",
)
def d27(spark, d):
    df = hi.proportions(tb.sell_in(spark, d, "fine"), NOW)
    return rounded(df, "historical_proportion", "normalized_proportion")


define("upper", "SELECT split_part(mat, ',', 1) AS fam, ch, sum(q) AS p50, sum(q) * 1.6::DOUBLE AS p90 FROM sold WHERE yw = 200144 GROUP BY ALL")


@query(
    "D27_disaggregate",
    f"SELECT {KEY2}, fam AS product_family, round(np * p50, 6) + 0.0 AS p50, round(np * p90, 6) + 0.0 AS p90 FROM shares LEFT JOIN upper USING (fam, ch)",
)
def d27_split(spark, d):
    df = tb.sell_in(spark, d, "fine")
    upper = df.filter(F.col(WEEK) == NOW).groupBy(fs.family().alias("product_family"), CHANNEL).agg(
        F.sum(QTY).alias("p50"), (F.sum(QTY) * 1.6).alias("p90")
    )
    out = hi.disaggregate(upper, hi.proportions(df, NOW), ["p50", "p90"])
    return rounded(out, "p50", "p90").select(*SKU, "product_family", "p50", "p90")


_QUANT = ["q10", "q50", "q90"]


def _crossed(spark, d):
    return blended(spark, d).select(
        *SKU, WEEK, F.col("forecast_q10").alias("q10"), (F.col("forecast_q50") * 0.3).alias("q50"), F.col("forecast_q90").alias("q90")
    )


@query(
    "D28_ordered_quantiles",
    f"""SELECT {KEY2}, yw AS year_week, round(q10, 6) + 0.0 AS q10, round(greatest(q10, q50 * 0.3::DOUBLE), 6) + 0.0 AS q50,
        round(greatest(q10, q50 * 0.3::DOUBLE, q90), 6) + 0.0 AS q90 FROM blended""",
)
def d28(spark, d):
    return rounded(hi.ordered_quantiles(_crossed(spark, d), _QUANT), *_QUANT)


@query(
    "D28_quantile_violations",
    """SELECT 'q10>q50' AS pair, count(*) FILTER (q50 * 0.3::DOUBLE < q10) AS violations FROM blended
       UNION ALL SELECT 'q50>q90', count(*) FILTER (q90 < q50 * 0.3::DOUBLE) FROM blended""",
)
def d28_check(spark, d):
    return hi.quantile_violations(_crossed(spark, d), _QUANT)


define(
    "own_sales",
    """SELECT s.ch, s.mat, split_part(s.mat, ',', 1) AS fam, r.segment, sum(s.q) AS total, count(*) FILTER (s.q > 0) AS n,
         count(*) FILTER (s.q > 0 AND s.yw >= 200132) AS recent FROM sold s JOIN registry_fine r ON r.ch = s.ch AND r.mat = s.mat WHERE s.yw <= 200144 GROUP BY ALL""",
)


@query(
    "D29_rare_forecast",
    f"""SELECT {KEY2}, fam AS product_family, round(greatest((0.6::DOUBLE * coalesce(total / nullif(n, 0), 0) + 0.4::DOUBLE * coalesce(fm, 0)) * recent / 13, 0.0), 6) + 0.0 AS weekly_forecast
        FROM own_sales LEFT JOIN (SELECT fam, ch, sum(total) / nullif(sum(n), 0) AS fm FROM own_sales WHERE segment <> 'dead' GROUP BY fam, ch) USING (fam, ch) WHERE segment = 'rare'""",
)
def d29(spark, d):
    df = tb.sell_in(spark, d, "fine")
    return rounded(dp.rare_forecast(df, dp.series_registry(df, NOW), NOW), "weekly_forecast")


define(
    "analog_rows",
    f"""SELECT ch, mat, split_part(mat, ',', 1) AS fam, yw, si, ma, CASE WHEN pos >= first THEN pos - first END AS age FROM (
          SELECT *, min(CASE WHEN si > 0 THEN pos END) OVER (PARTITION BY ch, mat) AS first,
            CASE WHEN pos >= 4 THEN avg(cs) OVER (PARTITION BY ch, mat ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS ma FROM wide_fine)""",
)


@query(
    "D30_cold_start",
    """SELECT fam AS product_family, ch AS "Channel", CAST(s.i AS INTEGER) AS step,
         round(coalesce(m, base) * CASE s.i WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.6::DOUBLE WHEN 3 THEN 0.8::DOUBLE WHEN 4 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END, 6) + 0.0 AS forecast
       FROM (SELECT fam, ch, avg(si) AS base FROM analog_rows WHERE yw = 199640 GROUP BY fam, ch)
       LEFT JOIN (SELECT fam, ch, median(si) AS m FROM (SELECT *, row_number() OVER (PARTITION BY fam, ch ORDER BY coalesce(ma, -1) DESC, mat DESC) AS r
         FROM analog_rows WHERE yw = 199640 AND age > 8 AND age < 104) WHERE r <= 3 GROUP BY fam, ch) USING (fam, ch) CROSS JOIN range(1, 20) s(i)""",
)
def d30(spark, d):
    df = fs.with_lifecycle(fs.with_measure_rolling(wide(spark, d, "fine")), tb.FIRST_WEEK)
    return rounded(dp.cold_start(df, 199640), "forecast")


@query(
    "D32_training_set",
    f"""SELECT {KEY2}, yw AS year_week, si AS sell_in, sell_in_lag_52, round(sell_in_ma26, 6) + 0.0 AS sell_in_ma26 FROM store
        WHERE yw <= 200133 AND NOT (si = 50 AND yw // 100 = 2001) AND sell_in_lag_52 IS NOT NULL AND sell_in_ma26 > 0""",
)
def d32(spark, d):
    df = fs.training_set(store(spark, d), tb.REFERENCE_WEEK, 50.0, 2001)
    return rounded(df, "sell_in_ma26").select(*SKU, WEEK, "sell_in", "sell_in_lag_52", "sell_in_ma26")


@query(
    "D33_promotion",
    """SELECT model, round(gain, 6) + 0.0 AS smape_gain_pct, round(worse, 6) + 0.0 AS bias_change_pp, failed AS failed_gates, CASE WHEN failed = '' THEN 1 ELSE 0 END AS promote
       FROM (SELECT *, CASE WHEN gain < 3 AND worse > 5 THEN 'smape;bias' WHEN gain < 3 THEN 'smape' WHEN worse > 5 THEN 'bias' ELSE '' END AS failed FROM (
         SELECT n.model, (o.smape - n.smape) / o.smape * 100 AS gain, abs(n.bias) - abs(o.bias) AS worse FROM cv_mean n
         JOIN cv_mean o ON o.model = 'tsb' WHERE n.model <> 'tsb'))""",
)
def d33(spark, d):
    mean = ev.benchmark(_cv(spark, d)).select("model", "smape", "bias")
    return rounded(mo.promotion(mean, "tsb"), "smape_gain_pct", "bias_change_pp")


@query(
    "D34_audit_counts",
    """SELECT event_type, user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events
       WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY event_type, user_id""",
)
def d34(spark, d):
    return mo.audit_counts(tb.table(spark, d, "events"), "2024-01-05 00:00:00")


@query(
    "D34_latest_events",
    "SELECT * FROM events WHERE event_type = 'error' AND contains(props, '6') ORDER BY ts DESC, event_id LIMIT 5",
)
def d34_latest(spark, d):
    return mo.latest_events(tb.table(spark, d, "events"), "error", "6")


@query(
    "D35_composite_score",
    """SELECT model, round(0.35::DOUBLE * avg(wape) + 0.25::DOUBLE * avg(smape) + 0.2::DOUBLE * avg(mase) + 0.15::DOUBLE * abs(avg(bias)) + 0.05::DOUBLE * (1 - avg(slp)), 6) + 0.0 AS composite,
         round(stddev_pop(wape) / avg(wape), 6) + 0.0 AS wape_cv, CASE WHEN stddev_pop(wape) / avg(wape) <= 0.2 THEN 'STABLE' ELSE 'UNSTABLE' END AS stability FROM cv_metrics GROUP BY model""",
)
def d35(spark, d):
    return rounded(mo.composite_score(_cv(spark, d)), "composite", "wape_cv")


define(
    "level_sums",
    """SELECT ch, mat, avg(q) FILTER (pos > 308) AS mean_4, avg(q) AS historical_mean, sum(q) FILTER (pos > 260) / nullif(sum(q) FILTER (pos <= 260 AND pos > 208), 0) AS g
       FROM hist WHERE fold = 5 GROUP BY ch, mat""",
)


@query(
    "D36_simple_forecasts",
    f"""SELECT {KEY2}, yw AS year_week, round(mean_4, 6) + 0.0 AS mean_4, round(historical_mean, 6) + 0.0 AS historical_mean,
        round(naive * coalesce(g, 1.0), 6) + 0.0 AS seasonal_growth FROM fc_naive JOIN level_sums USING (ch, mat)""",
)
def d36(spark, d):
    df = bl.simple_forecasts(tb.sell_in(spark, d), tb.FIRST_WEEK, tb.CUTOFF_WEEK, 13)
    return rounded(df, "mean_4", "historical_mean", "seasonal_growth")


@query(
    "X1_file_arrivals",
    "SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def x1(spark, d):
    """Daily files, every event written twice, read as a stream into a table."""
    events = tb.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bronze, target = scratch_path(spark, "arrivals"), scratch_path(spark, "loaded")
    twice = events.unionByName(events).withColumn("day", F.to_date("ts"))
    twice.write.partitionBy("day").parquet(bronze)
    stream = arrivals.arrivals(spark, bronze, events.schema)
    arrivals.load_new(stream, target, scratch_path(spark, "stream-state"), ["event_id"])
    return arrivals.weekly_counts(spark.read.schema(events.schema).parquet(target), "ts", "event_type")
