"""Validation and data quality."""

from pyspark.sql import functions as F

from stockweave.functions.scalars import r6
from stockweave.operators import features as ft
from stockweave.operators import quality as ql
from stockweave.operators.reshape import clip_negative, sum_duplicates, union_years, with_calendar
from stockweave.plans.registry import KEY3, define, query
from stockweave.plans.source_queries import wide_frames
from stockweave.schema import QTY, SERIES, WEEK
from stockweave.sources import tables as tb

Y = "CAST(yw // 100 AS INTEGER)"
W = "CAST(yw % 100 AS INTEGER)"
define("clean_fine", "SELECT ch, mat, cat, yw, sum(greatest(q, 0.0)) AS q FROM signed_fine GROUP BY ALL")
define("wide_keys", "SELECT DISTINCT ch, mat, cat, yw // 100 AS year FROM long_coarse")


def _clean(spark, d):
    df = sum_duplicates(clip_negative(tb.signed_observations(spark, d).drop("l_linenumber")))
    return with_calendar(df)


@query(
    "V1_source_schema",
    """SELECT CAST(year AS INTEGER) AS year, count(*) AS n_rows, CASE year WHEN 1998 THEN 53 ELSE 52 END AS week_columns, '' AS missing_columns,
       CAST(0 AS BIGINT) AS unknown_category_rows, CAST(0 AS BIGINT) AS "null_Channel",
       CAST(0 AS BIGINT) AS "null_Material Description", CAST(0 AS BIGINT) AS "null_Category", 1 AS is_valid
       FROM wide_keys GROUP BY year""",
)
def v1(spark, d):
    return union_years([ql.source_schema(df, y) for y, df in wide_frames(spark, d).items()])


@query(
    "V2_comma_cells",
    """SELECT CAST(w.yw AS VARCHAR) AS week_column, CAST(w.yw // 100 AS INTEGER) AS year,
         count(*) FILTER (w.yw > 200100 AND l.q * 100 >= 1000) AS comma_cells
       FROM weeks w LEFT JOIN long_coarse l ON l.yw = w.yw GROUP BY w.yw""",
)
def v2(spark, d):
    return union_years([ql.comma_cells(df, y) for y, df in wide_frames(spark, d).items()])


@query(
    "V3_schema_check",
    """SELECT 'schema' AS validator, 1 AS passed, 'missing_columns' AS metric, 0.0::DOUBLE AS value, count(*) AS n_rows
       FROM clean_fine""",
)
def v3(spark, d):
    return ql.schema_check(_clean(spark, d))


@query(
    "V4_null_shares",
    """SELECT column_name, CAST(n AS BIGINT) AS null_count, round(n / total, 6) + 0.0 AS null_share,
         CASE WHEN n / total > 0.05 THEN 1 ELSE 0 END AS violation FROM (
         SELECT count(*) AS total, count(*) - count(lag_1) AS lag_1, count(*) - count(lag_4) AS lag_4,
           count(*) - count(lag_52) AS lag_52, count(*) - count(rm4) AS rolling_mean_4,
           count(*) - count(rs12) AS rolling_std_12 FROM featured)
       UNPIVOT (n FOR column_name IN (lag_1, lag_4, lag_52, rolling_mean_4, rolling_std_12))""",
)
def v4(spark, d):
    df = ft.with_rolling(ft.with_lags(tb.dense_table(spark, d)))
    out = ql.null_shares(df, ["lag_1", "lag_4", "lag_52", "rolling_mean_4", "rolling_std_12"])
    return out.withColumn("null_share", r6("null_share"))


@query(
    "V5_temporal",
    f"""SELECT count(*) FILTER ({W} NOT BETWEEN 1 AND 53) AS invalid_week_rows,
          count(*) FILTER ({Y} NOT BETWEEN 1995 AND 2000) AS invalid_year_rows,
          count(*) FILTER (length(CAST(yw AS VARCHAR)) <> 6) AS malformed_rows,
          min({Y}) AS min_year, max({Y}) AS max_year,
          CASE WHEN count(*) FILTER ({Y} NOT BETWEEN 1995 AND 2000) = 0 THEN 1 ELSE 0 END AS passed FROM long_fine""",
)
def v5(spark, d):
    return ql.temporal(with_calendar(tb.long_table(spark, d)), (1995, 2000))


@query(
    "V6_leakage",
    """SELECT CAST(0 AS BIGINT) AS order_violations, CAST(0 AS BIGINT) AS week_gaps,
         count(*) FILTER (f.lag_1 IS DISTINCT FROM p.q) AS lag_mismatches, 0 AS future_columns
       FROM featured f LEFT JOIN dense_coarse p ON p.ch = f.ch AND p.mat = f.mat AND p.cat = f.cat AND p.pos = f.pos - 1""",
)
def v6(spark, d):
    return ql.leakage(ft.with_lags(tb.dense_table(spark, d), (1,)))


@query(
    "V6_week_gaps",
    """SELECT count(*) FILTER (step <= 0) AS order_violations, count(*) FILTER (step > 1) AS week_gaps,
         count(*) FILTER (prev IS NOT NULL AND step <> 1) AS lag_mismatches, 0 AS future_columns
       FROM (SELECT w.pos - lag(w.pos) OVER k AS step, lag(l.q) OVER k AS prev
             FROM long_fine l JOIN weeks w USING (yw) WINDOW k AS (PARTITION BY ch, mat, cat ORDER BY w.pos))""",
)
def v6_gaps(spark, d):
    return ql.leakage(ft.with_lags(tb.long_table(spark, d), (1,)))


@query(
    "V7_duplicates",
    """SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_key_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows
       FROM (SELECT count(*) AS n FROM obs_fine GROUP BY ch, mat, cat, yw)""",
)
def v7(spark, d):
    return ql.duplicates(tb.observations(spark, d))


@query(
    "V8_ranges",
    """SELECT count(*) FILTER (q < 0) AS negative_rows, count(*) FILTER (q > 1000000) AS extreme_rows, count(q) AS n,
         round(avg(q), 6) + 0.0 AS mean, round(stddev_samp(q), 6) + 0.0 AS std, min(q) AS min, max(q) AS max,
         quantile_cont(q, 0.25) AS p25, quantile_cont(q, 0.5) AS p50, quantile_cont(q, 0.75) AS p75 FROM signed_fine""",
)
def v8(spark, d):
    df = ql.ranges(tb.signed_observations(spark, d))
    return df.withColumns({"mean": r6("mean"), "std": r6("std")})


@query(
    "V9_inventory_consistency",
    """SELECT count(*) FILTER (cat = 'Channel Inv.') AS inventory_rows,
         count(*) FILTER (cat = 'Channel Inv.' AND q < 0) AS negative_rows, count(DISTINCT cat) AS n_categories,
         round(count(*) FILTER (cat = 'Channel Inv.' AND q < 0) / count(*) FILTER (cat = 'Channel Inv.'), 6) + 0.0 AS negative_share,
         CASE WHEN count(*) FILTER (cat = 'Channel Inv.' AND q < 0) / count(*) FILTER (cat = 'Channel Inv.') < 0.01
           THEN 1 ELSE 0 END AS passed FROM signed_fine""",
)
def v9(spark, d):
    df = ql.inventory_consistency(tb.signed_observations(spark, d))
    return df.withColumn("negative_share", r6("negative_share"))


define(
    "check_rows",
    """SELECT 'schema' AS validator, 1 AS passed, 'missing_columns' AS metric, 0.0::DOUBLE AS value
       UNION ALL SELECT 'null', 1, 'violations', 0.0::DOUBLE
       UNION ALL SELECT 'temporal', 1, 'invalid_year_rows', CAST(count(*) FILTER (yw // 100 NOT BETWEEN 1995 AND 2002) AS DOUBLE) FROM signed_fine
       UNION ALL SELECT 'duplicate', CASE WHEN sum(n - 1) = 0 THEN 1 ELSE 0 END, 'duplicate_rows', CAST(sum(n - 1) AS DOUBLE)
         FROM (SELECT count(*) AS n FROM signed_fine GROUP BY ch, mat, cat, yw)
       UNION ALL SELECT 'range', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END, 'negative_rows', CAST(count(*) AS DOUBLE) FROM signed_fine WHERE q < 0
       UNION ALL SELECT 'inventory_consistency', CASE WHEN avg(CASE WHEN q < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) < 0.01 THEN 1 ELSE 0 END,
         'negative_share', avg(CASE WHEN q < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM signed_fine WHERE cat = 'Channel Inv.'""",
)


def _checks(spark, d):
    df = with_calendar(tb.signed_observations(spark, d).drop("l_linenumber"))
    return ql.run_all(df, tb.YEAR_RANGE)


@query("V10_all_checks", "SELECT validator, passed, metric, round(value, 6) + 0.0 AS value FROM check_rows")
def v10(spark, d):
    return _checks(spark, d).withColumn("value", r6("value"))


@query(
    "V10_check_summary",
    """SELECT count(*) AS validators_run, count(*) FILTER (passed = 1) AS validators_passed, min(passed) AS overall_passed
       FROM check_rows""",
)
def v10_summary(spark, d):
    return ql.summarise(_checks(spark, d))


@query(
    "V11_quality_score",
    """SELECT total_rows, null_rows, negative_rows, zero_rows, 0.0::DOUBLE AS null_share,
         round(zero_rows / total_rows, 6) + 0.0 AS zero_share,
         round(greatest(0.0, 1.0 - 5.0 * negative_rows / total_rows - greatest(0.0, (zero_rows / total_rows - 0.6) * 0.5)), 6) + 0.0 AS quality_score
       FROM (SELECT count(*) AS total_rows, count(*) - count(q) AS null_rows, count(*) FILTER (q < 0) AS negative_rows,
               count(*) FILTER (q = 0) AS zero_rows FROM dense_coarse)""",
)
def v11(spark, d):
    df = ql.quality_score(tb.dense_table(spark, d))
    return df.withColumns({c: r6(c) for c in ("null_share", "zero_share", "quality_score")})


@query(
    "V12_truncation",
    """SELECT week_num, total, last_nonzero_week, CASE WHEN week_num > last_nonzero_week THEN 1 ELSE 0 END AS in_zero_tail
       FROM (SELECT CAST(yw % 100 AS INTEGER) AS week_num, sum(q) AS total,
               max(CASE WHEN sum(q) > 0 THEN CAST(yw % 100 AS INTEGER) END) OVER () AS last_nonzero_week
             FROM dense_coarse WHERE yw // 100 = 2001 GROUP BY yw)""",
)
def v12(spark, d):
    return ql.truncation(with_calendar(tb.dense_table(spark, d)), 2001)


define(
    "zscores",
    """SELECT ch, mat, cat, yw, q, (q - avg(q) OVER g) / (stddev_samp(q) OVER g + 1e-9) AS z
       FROM long_fine WHERE q > 0 WINDOW g AS (PARTITION BY ch, cat)""",
)


@query(
    "V13_outlier_summary",
    """SELECT count(*) FILTER (abs(z) > 2.5) AS anomaly_count, count(*) AS nonzero_rows,
         round(count(*) FILTER (abs(z) > 2.5) / count(*), 6) + 0.0 AS anomaly_share FROM zscores""",
)
def v13(spark, d):
    df = ql.outlier_summary(tb.long_table(spark, d), 2.5)
    return df.withColumn("anomaly_share", r6("anomaly_share"))


@query(
    "V13_top_outliers",
    f"""SELECT {KEY3}, yw AS year_week, q AS quantity, round(z, 6) + 0.0 AS z FROM zscores WHERE abs(z) > 2.5
        ORDER BY round(z, 6) DESC, ch, mat, cat, yw LIMIT 20""",
)
def v13_top(spark, d):
    return ql.top_outliers(tb.long_table(spark, d), 2.5).withColumn("z", r6("z"))


@query(
    "V14_footprint",
    """SELECT 'lineitem' AS table_name, count(*) AS n_rows, 11 AS n_columns FROM lineitem
       UNION ALL SELECT 'orders', count(*), 6 FROM orders UNION ALL SELECT 'part', count(*), 6 FROM part
       UNION ALL SELECT 'weekly', count(*), 5 FROM long_fine""",
)
def v14(spark, d):
    frames = {t: tb.table(spark, d, t) for t in ("lineitem", "orders", "part")}
    return ql.footprint({**frames, "weekly": tb.long_table(spark, d)})


@query(
    "V15_preflight",
    """SELECT count(*) AS n_rows, count(*) FILTER (cat = 'Sell-in') AS sell_in_rows, min(yw) AS first_week, max(yw) AS last_week
       FROM dense_coarse""",
)
def v15(spark, d):
    return ql.preflight(tb.dense_table(spark, d))


@query(
    "D19_schema_drift",
    """SELECT CAST(k.year AS INTEGER) AS year, k.n_rows, c.check_name, c.severity,
         CASE WHEN check_name = 'WRONG_WEEK_COUNT' AND k.year = 1998 THEN 53 ELSE c.found END AS found, c.drift
       FROM (SELECT year, count(*) AS n_rows FROM wide_keys GROUP BY year) k
       CROSS JOIN (VALUES ('MISSING_COLUMNS', 'CRITICAL', CAST(0 AS BIGINT), 0), ('WRONG_WEEK_COUNT', 'HIGH', CAST(52 AS BIGINT), 0),
         ('CATEGORY_DRIFT', 'CRITICAL', CAST(0 AS BIGINT), 0)) c(check_name, severity, found, drift)""",
)
def d19(spark, d):
    return union_years([ql.schema_drift(df, y) for y, df in wide_frames(spark, d).items()])


define(
    "gate_rows",
    """SELECT 'no_duplicates' AS check_name, 'CRITICAL' AS severity, CAST(sum(n - 1) AS BIGINT) AS findings
         FROM (SELECT count(*) AS n FROM signed_fine GROUP BY ch, mat, cat, yw)
       UNION ALL SELECT 'no_negative_inventory', 'CRITICAL', count(*) FROM signed_fine WHERE cat = 'Channel Inv.' AND q < 0
       UNION ALL SELECT 'category_balance', 'HIGH', count(*) FROM (SELECT ch, mat FROM signed_fine GROUP BY ch, mat HAVING count(DISTINCT cat) <> 3)
       UNION ALL SELECT 'no_target_leakage', 'CRITICAL', 0 UNION ALL SELECT 'inventory_lagged', 'CRITICAL', 1""",
)


def _gates(spark, d):
    df = tb.signed_observations(spark, d)
    return ql.gates(df, ["lag_1", "rolling_mean_4", "inventory_days_of_supply"])


@query("D31_gates", "SELECT *, CASE WHEN findings = 0 THEN 1 ELSE 0 END AS passed FROM gate_rows")
def d31(spark, d):
    return _gates(spark, d)


@query(
    "D31_gate_score",
    """SELECT count(*) AS n_checks, count(*) FILTER (findings > 0) AS n_failed,
         CAST(greatest(0, 100 - sum(CASE WHEN findings > 0 THEN CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'HIGH' THEN 5 ELSE 2 END
           ELSE 0 END)) AS BIGINT) AS score FROM gate_rows""",
)
def d31_score(spark, d):
    return ql.gate_score(_gates(spark, d))
