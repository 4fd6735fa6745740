"""Dashboard and notebook aggregates."""

from pyspark.sql import functions as F

from stockweave.functions.scalars import correlation, r6
from stockweave.operators import aggregates as ag
from stockweave.operators import churn as ch
from stockweave.operators import features as ft
from stockweave.operators import inventory as iv
from stockweave.plans.business_queries import _churn, _r, blended, fc_alt, fc_naive, risk, rounded
from stockweave.plans.registry import KEY2, define, query
from stockweave.schema import CATEGORY, CHANNEL, MATERIAL, QTY, RISK_LEVELS, SELL_IN, SKU, WEEK
from stockweave.sources import tables as tb

define("sold", "SELECT ch, mat, yw, CAST(yw // 100 AS INTEGER) AS year, CAST(yw % 100 AS INTEGER) AS week, q FROM long_fine WHERE cat = 'Sell-in'")


def _sold(spark, d):
    return tb.sell_in(spark, d, "fine")


@query("A2_weekly_totals", "SELECT yw AS year_week, sum(q) AS quantity FROM sold GROUP BY yw")
def a2(spark, d):
    return ag.weekly_totals(_sold(spark, d))


@query(
    "A3_annual_totals",
    """SELECT year, q AS quantity, round((q - lag(q) OVER (ORDER BY year)) / lag(q) OVER (ORDER BY year) * 100, 6) + 0.0 AS yoy_pct
       FROM (SELECT year, sum(q) AS q FROM sold GROUP BY year)""",
)
def a3(spark, d):
    return rounded(ag.annual_totals(_sold(spark, d)), "yoy_pct")


@query("A4_year_week_matrix", "SELECT year, week, sum(q) AS quantity FROM sold GROUP BY year, week")
def a4(spark, d):
    return ag.year_week_matrix(_sold(spark, d))


define("season_means", "SELECT week, avg(q) AS m FROM sold GROUP BY week")


@query(
    "A5_seasonal_profile",
    """SELECT week, round(m, 6) + 0.0 AS mean_quantity,
         CASE WHEN round(m, 9) >= round((SELECT quantile_cont(m, 0.85) FROM season_means), 9) THEN 1 ELSE 0 END AS is_peak FROM season_means""",
)
def a5(spark, d):
    return rounded(ag.seasonal_profile(_sold(spark, d)), "mean_quantity")


@query("A5_top_weeks", "SELECT week, round(m, 6) + 0.0 AS mean_quantity FROM season_means ORDER BY m DESC, week LIMIT 5")
def a5_top(spark, d):
    df = ag.seasonal_profile(_sold(spark, d)).select("week", "mean_quantity")
    return rounded(df.orderBy(F.desc("mean_quantity"), "week").limit(5), "mean_quantity")


@query("A6_top_products", "SELECT mat AS name, sum(q) AS quantity FROM sold GROUP BY mat ORDER BY 2 DESC, 1 LIMIT 10")
def a6(spark, d):
    return ag.top_n(_sold(spark, d), MATERIAL, 10)


@query("A6_top_channels", "SELECT ch AS name, sum(q) AS quantity FROM sold GROUP BY ch ORDER BY 2 DESC, 1 LIMIT 10")
def a6_channels(spark, d):
    return ag.top_n(_sold(spark, d), CHANNEL, 10)


@query(
    "A6_top_families",
    "SELECT split_part(mat, ',', 1) AS name, sum(q) AS quantity FROM sold GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def a6_families(spark, d):
    return ag.top_n(_sold(spark, d), ag.product_family(), 10)


@query("A7_category_totals", 'SELECT cat AS "Category", sum(q) AS quantity FROM long_fine GROUP BY cat')
def a7(spark, d):
    return ag.category_totals(tb.long_table(spark, d))


@query(
    "A8_inventory_coverage",
    """SELECT CAST(yw // 100 AS INTEGER) AS year, sum(q) FILTER (cat = 'Channel Inv.') AS inventory, sum(q) FILTER (cat = 'Sell-in') AS sales,
         round(sum(q) FILTER (cat = 'Channel Inv.') / sum(q) FILTER (cat = 'Sell-in'), 6) + 0.0 AS coverage FROM long_fine GROUP BY 1""",
)
def a8(spark, d):
    return rounded(ag.inventory_coverage(tb.long_table(spark, d)), "coverage")


@query(
    "A9_active_inventory",
    """SELECT count(*) FILTER (m > 0) AS active_skus, count(*) AS total_skus, round(count(*) FILTER (m > 0) * 100.0::DOUBLE / count(*), 6) + 0.0 AS active_pct
       FROM (SELECT max(q) AS m FROM (SELECT ch, mat, CASE WHEN line = 7 THEN 0.0 ELSE q END AS q FROM obs_fine WHERE cat = 'Channel Inv.') GROUP BY ch, mat)""",
)
def a9(spark, d):
    df = tb.observations(spark, d).withColumn(QTY, F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col(QTY)))
    return rounded(ag.active_inventory_share(df), "active_pct")


@query(
    "A10_intermittency",
    """SELECT round(avg(CASE WHEN q > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0 AS nonzero_rate, round(avg(q) FILTER (q > 0), 6) + 0.0 AS mean, max(q) AS max,
         quantile_cont(q, 0.5) FILTER (q > 0) AS median, round(quantile_cont(q, 0.9) FILTER (q > 0), 6) + 0.0 AS p90 FROM si_coarse""",
)
def a10(spark, d):
    df = tb.dense_table(spark, d, "coarse", SELL_IN)
    return rounded(ag.intermittency(df), "nonzero_rate", "mean", "p90")


@query(
    "A11_histogram",
    """SELECT CAST(least(floor((x - lo) / ((hi - lo) / 60.0::DOUBLE)), 59) AS INTEGER) AS bin, count(*) AS n
       FROM (SELECT least(q, 500.0) AS x, min(least(q, 500.0)) OVER () AS lo, max(least(q, 500.0)) OVER () AS hi FROM sold WHERE q > 0) GROUP BY 1""",
)
def a11(spark, d):
    return ag.histogram(_sold(spark, d))


@query(
    "A12_distinct_counts",
    "SELECT count(DISTINCT (ch, mat)) AS n_skus, count(DISTINCT ch) AS n_channels, count(DISTINCT mat) AS n_materials FROM long_fine",
)
def a12(spark, d):
    return ag.distinct_counts(tb.long_table(spark, d))


@query(
    "A13_recent_trend",
    """SELECT recent, year_ago, round((recent - year_ago) / year_ago * 100, 6) + 0.0 AS trend_pct FROM (
         SELECT sum(q) FILTER (yw >= 200141) AS recent, sum(q) FILTER (yw BETWEEN 200041 AND 200044) AS year_ago FROM sold)""",
)
def a13(spark, d):
    return rounded(ag.recent_trend(_sold(spark, d), tb.LAST_SALES_WEEK), "trend_pct")


@query(
    "A14_projected_demand",
    "SELECT round(sum(v), 6) + 0.0 AS total, round(avg(v), 6) + 0.0 AS weekly_mean FROM (SELECT sum(q50) AS v FROM blended GROUP BY yw)",
)
def a14(spark, d):
    return rounded(ag.projected_demand(blended(spark, d)), "total", "weekly_mean")


@query(
    "A15_history_and_forecast",
    """SELECT kind, yw AS year_week, round(v, 6) + 0.0 AS value, CAST(row_number() OVER (ORDER BY kind, yw) - 1 AS INTEGER) AS idx,
         'W' || lpad(CAST(yw % 100 AS VARCHAR), 2, '0') || '·' || CAST(yw // 100 AS VARCHAR) AS label FROM (
         SELECT 'Histórico' AS kind, yw, sum(q) AS v FROM long_coarse WHERE cat = 'Sell-in' AND yw BETWEEN 200026 AND 200052 GROUP BY yw
         UNION ALL SELECT 'Proyección', yw, sum(q50) FROM blended GROUP BY yw)""",
)
def a15(spark, d):
    df = ag.history_and_forecast(tb.sell_in(spark, d), blended(spark, d), tb.CUTOFF_WEEK)
    return rounded(df, "value")


@query(
    "A16_risk_distribution",
    """SELECT l.risk_level, CAST(l.position AS INTEGER) AS position, count(r.risk_level) AS n FROM (VALUES ('CRITICAL', 0), ('HIGH', 1), ('MEDIUM', 2), ('LOW', 3)) l(risk_level, position)
       LEFT JOIN risk r ON r.risk_level = l.risk_level GROUP BY ALL""",
)
def a16(spark, d):
    return iv.level_counts(risk(spark, d), "risk_level", RISK_LEVELS)


@query(
    "A17_deficit",
    """SELECT round(sum(greatest(forecast_q90_total - inv, 0.0)), 6) + 0.0 AS deficit,
         round(median(weeks_of_supply_conservative), 6) + 0.0 AS median_cover FROM risk""",
)
def a17(spark, d):
    return rounded(iv.deficit(risk(spark, d)), "deficit", "median_cover")


@query(
    "A18_at_risk_per_channel",
    """SELECT ch AS "Channel", count(*) AS n FROM risk WHERE risk_level IN ('CRITICAL', 'HIGH') GROUP BY ch ORDER BY n DESC, ch LIMIT 10""",
)
def a18(spark, d):
    return iv.at_risk_per_channel(risk(spark, d))


@query(
    "A18_channel_levels",
    'SELECT ch AS "Channel", ' + ", ".join(f"count(*) FILTER (risk_level = '{v}') AS \"{v}\"" for v in RISK_LEVELS) + " FROM risk GROUP BY ch",
)
def a18_pivot(spark, d):
    return iv.channel_levels(risk(spark, d))


@query(
    "A19_reorder_table",
    """SELECT risk_level, ch AS "Channel", substring(mat, 1, 42) AS "Material Description", CAST(round_even(inv, 0) AS BIGINT) AS inventory,
         round(weeks_of_supply_conservative, 2) AS cover_weeks, CAST(round_even(greatest(forecast_q90_total - inv, 0.0), 0) AS BIGINT) AS units_to_buy,
         CASE WHEN stockout_week IS NULL THEN 'Inminente' ELSE 'W' || lpad(CAST(stockout_week % 100 AS VARCHAR), 2, '0') || '·' || CAST(stockout_week // 100 AS VARCHAR) END AS stockout
       FROM risk LEFT JOIN stockout USING (ch, mat) WHERE risk_level IN ('CRITICAL', 'HIGH') ORDER BY weeks_of_supply_conservative, ch, mat LIMIT 20""",
)
def a19(spark, d):
    return iv.reorder_table(risk(spark, d))


@query(
    "A20_churn_actions",
    f"""SELECT churn_risk, ch AS "Channel", 'W' || lpad(CAST(last_purchase_week % 100 AS VARCHAR), 2, '0') || '·' || CAST(last_purchase_week // 100 AS VARCHAR) AS last_purchase,
        weeks_since_last_purchase, {_r('active_weeks_pct', 'avg_weekly_volume', 'volume_change_pct')} FROM churned WHERE churn_risk IN ('ALTO', 'MEDIO')""",
)
def a20(spark, d):
    return rounded(ch.action_table(_churn(spark, d)), "active_weeks_pct", "avg_weekly_volume", "volume_change_pct")


define(
    "growth",
    """SELECT mat, coalesce(sum(yhat) FILTER (yw % 100 <= 26), 0.0) AS h1, coalesce(sum(yhat) FILTER (yw % 100 > 26), 0.0) AS h2
       FROM fc_forward WHERE yw // 100 = 2002 GROUP BY mat""",
)
define("growth_pct", "SELECT mat, h1, h2, round((h2 - h1) / (h1 + 1) * 100, 6) + 0.0 AS g FROM growth WHERE h1 > 0")


@query(
    "A21_half_year_growth",
    """SELECT * FROM (SELECT mat AS "Material Description", h1, h2, g AS growth_pct, 'up' AS side FROM growth_pct ORDER BY g DESC, mat LIMIT 8)
       UNION ALL SELECT * FROM (SELECT mat, h1, h2, g, 'down' FROM growth_pct ORDER BY g, mat LIMIT 5)""",
)
def a21(spark, d):
    from stockweave.operators.baselines import naive_forecast

    fc = naive_forecast(tb.sell_in(spark, d), tb.FIRST_WEEK, tb.LAST_SALES_WEEK, 71)
    return rounded(ag.growth_extremes(ag.half_year_growth(fc, 2002, "forecast_naive")), "growth_pct")


_CORR = {
    "quantity": "q", "lag_1": "lag_1", "lag_4": "lag_4", "lag_52": "lag_52", "rolling_mean_4": "rm4", "rolling_mean_12": "rm12",
    "rolling_std_12": "rs12", "weeks_since_last_sale": "wsls", "intermittent_flag": "interm", "inventory_days_of_supply": "dos",
}
define(
    "corr_rows",
    "SELECT " + ", ".join(f"{s} AS {n}" for n, s in _CORR.items())
    + " FROM si_featured f JOIN same_week_dos s USING (ch, mat, yw) WHERE lag_52 IS NOT NULL AND rs12 IS NOT NULL AND dos IS NOT NULL",
)
define(
    "corr_cells",
    " UNION ALL ".join(
        f"SELECT '{a}' AS row_var, '{b}' AS col_var, {'max(1.0::DOUBLE)' if a == b else f"nullif(corr({a}, {b}), 'nan'::DOUBLE)"} AS r FROM corr_rows" for a in _CORR for b in _CORR
    ),
)


def _gold_sell_in(spark, d):
    return ft.gold(tb.dense_table(spark, d, "coarse")).filter(F.col(CATEGORY) == SELL_IN)


@query("A22_correlation_matrix", "SELECT row_var, col_var, round(r, 6) + 0.0 AS r FROM corr_cells")
def a22(spark, d):
    return rounded(ag.correlation_matrix(_gold_sell_in(spark, d), list(_CORR)), "r")


@query(
    "A22_correlation_ranking",
    """SELECT col_var AS variable, round(r, 6) + 0.0 AS r, CAST(row_number() OVER (ORDER BY round(abs(r), 9) DESC, col_var) AS INTEGER) AS position
       FROM corr_cells WHERE row_var = 'quantity' AND col_var <> 'quantity'""",
)
def a22_rank(spark, d):
    m = ag.correlation_matrix(_gold_sell_in(spark, d), list(_CORR))
    return rounded(ag.correlation_ranking(m, QTY), "r")


_PAIRS = [
    ("lag_1", "quantity"), ("lag_52", "quantity"), ("rolling_mean_12", "quantity"), ("rolling_mean_4", "rolling_mean_12"),
    ("weeks_since_last_sale", "quantity"), ("rolling_std_12", "quantity"),
]
define(
    "pair_rows",
    """SELECT q AS quantity, lag_1, lag_52, rm4 AS rolling_mean_4, rm12 AS rolling_mean_12, rs12 AS rolling_std_12, wsls AS weeks_since_last_sale
       FROM si_featured WHERE q > 0 AND lag_52 IS NOT NULL AND rs12 IS NOT NULL""",
)
_CLIP = ", ".join(
    f"least(greatest({c}, 0.0), (SELECT quantile_cont({c}, 0.95) FROM pair_rows)) AS {c}"
    for c in ("quantity", "lag_1", "lag_52", "rolling_mean_4", "rolling_mean_12", "rolling_std_12", "weeks_since_last_sale")
)
define("clipped_rows", f"SELECT {_CLIP} FROM pair_rows")


@query(
    "A23_clipped_trends",
    " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, round(regr_slope({y}, {x}), 6) + 0.0 AS slope, round(regr_intercept({y}, {x}), 6) + 0.0 AS intercept, round(corr({y}, {x}), 6) + 0.0 AS r FROM clipped_rows"
        for x, y in _PAIRS
    ),
)
def a23(spark, d):
    df = ft.series_features(tb.dense_table(spark, d, "coarse", SELL_IN)).filter(F.col(QTY) > 0)
    return rounded(ag.clipped_trends(df, _PAIRS), "slope", "intercept", "r")


define(
    "sale_inv",
    """SELECT s.ch, s.yw, s.q AS sales, i.q AS inventory FROM (SELECT ch, yw, sum(q) AS q FROM long_fine WHERE cat = 'Sell-in' GROUP BY ch, yw) s
       JOIN (SELECT ch, yw, sum(q) AS q FROM long_fine WHERE cat = 'Channel Inv.' GROUP BY ch, yw) i USING (ch, yw) WHERE s.q > 0 AND i.q > 0""",
)


@query("A24_sales_inventory_corr", "SELECT count(*) AS n, round(corr(sales, inventory), 6) + 0.0 AS r FROM sale_inv")
def a24(spark, d):
    df = ag.sales_against_inventory(tb.long_table(spark, d))
    return df.agg(F.count("*").alias("n"), r6(correlation("sales", "inventory")).alias("r"))


@query(
    "A24_channel_means",
    """SELECT ch AS "Channel", round(avg(sales), 6) + 0.0 AS mean_sales, round(avg(inventory), 6) + 0.0 AS mean_inventory FROM sale_inv
       GROUP BY ch ORDER BY round(avg(sales), 9) DESC, ch LIMIT 10""",
)
def a24_means(spark, d):
    return rounded(ag.channel_means(ag.sales_against_inventory(tb.long_table(spark, d))), "mean_sales", "mean_inventory")


@query(
    "A27_union_forecasts",
    f"""SELECT {KEY2}, yw AS year_week, round(naive, 6) + 0.0 AS forecast, 'naive' AS source FROM fc_naive
        UNION ALL SELECT ch, mat, yw, round(q50, 6) + 0.0, 'model' FROM fc_alt""",
)
def a27(spark, d):
    naive = fc_naive(spark, d).select(*SKU, WEEK, F.col("forecast_naive").alias("forecast"), F.lit("naive").alias("source"))
    alt = fc_alt(spark, d).select(*SKU, WEEK, F.col("forecast_q50").alias("forecast"), F.lit("model").alias("source"))
    return rounded(naive.unionByName(alt), "forecast")
