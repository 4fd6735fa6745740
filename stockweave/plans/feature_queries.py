"""Look-back features."""

from pyspark.sql import functions as F

from stockweave.functions.scalars import r6
from stockweave.operators import features as ft
from stockweave.operators.reshape import head_rows, with_calendar
from stockweave.plans.registry import KEY2, KEY3, define, query
from stockweave.schema import QTY, SELL_IN, SERIES, SKU, WEEK
from stockweave.sources import tables as tb

define(
    "featured",
    """
    SELECT ch, mat, cat, pos, yw, q,
      lag(q, 1) OVER s AS lag_1, lag(q, 4) OVER s AS lag_4, lag(q, 52) OVER s AS lag_52,
      avg(q) OVER (s ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rm4,
      avg(q) OVER (s ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rm12,
      stddev_samp(q) OVER (s ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rs12,
      CAST(coalesce(pos - max(CASE WHEN q > 0 THEN pos END)
           OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, pos) AS DOUBLE) AS wsls,
      CASE WHEN avg(CASE WHEN q = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
           OVER (s ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS interm
    FROM dense_coarse WINDOW s AS (PARTITION BY ch, mat, cat ORDER BY pos)""",
)
define(
    "same_week_dos",
    """
    SELECT s.ch, s.mat, s.yw, CASE WHEN s.q > 0 THEN i.q / (s.q / 7.0::DOUBLE) END AS dos
    FROM (SELECT * FROM dense_coarse WHERE cat = 'Sell-in') s
    LEFT JOIN (SELECT * FROM dense_coarse WHERE cat = 'Channel Inv.') i
      ON s.ch = i.ch AND s.mat = i.mat AND s.yw = i.yw""",
)


def _coarse(spark, d):
    return tb.dense_table(spark, d, "coarse")


def _rounded(df, cols):
    return df.select(*SERIES, WEEK, *[r6(c).alias(c) for c in cols])


@query(
    "F0_series_ids",
    f"""SELECT {KEY3}, row_number() OVER (ORDER BY md5(ch || '|' || mat || '|' || cat), ch, mat, cat) - 1 AS series_id
        FROM (SELECT DISTINCT ch, mat, cat FROM long_fine)""",
)
def series_ids(spark, d):
    return ft.series_ids(tb.long_table(spark, d, "fine"))


@query("F1_lags", f"SELECT {KEY3}, yw AS year_week, lag_1, lag_4, lag_52 FROM featured")
def lags(spark, d):
    df = ft.with_lags(_coarse(spark, d))
    return df.select(*SERIES, WEEK, *ft.LAG_FEATURES)


@query("F2_rolling_mean_4", f"SELECT {KEY3}, yw AS year_week, round(rm4, 6) + 0.0 AS rolling_mean_4 FROM featured")
def rolling_mean_4(spark, d):
    return _rounded(ft.with_rolling(_coarse(spark, d)), ["rolling_mean_4"])


@query("F3_rolling_mean_12", f"SELECT {KEY3}, yw AS year_week, round(rm12, 6) + 0.0 AS rolling_mean_12 FROM featured")
def rolling_mean_12(spark, d):
    return _rounded(ft.with_rolling(_coarse(spark, d)), ["rolling_mean_12"])


@query("F4_rolling_std_12", f"SELECT {KEY3}, yw AS year_week, round(rs12, 6) + 0.0 AS rolling_std_12 FROM featured")
def rolling_std_12(spark, d):
    return _rounded(ft.with_rolling(_coarse(spark, d)), ["rolling_std_12"])


@query("F5_weeks_since_last_sale", f"SELECT {KEY3}, yw AS year_week, wsls AS weeks_since_last_sale FROM featured")
def weeks_since_last_sale(spark, d):
    return ft.with_recency(_coarse(spark, d)).select(*SERIES, WEEK, "weeks_since_last_sale")


@query("F6_intermittent_flag", f"SELECT {KEY3}, yw AS year_week, interm AS intermittent_flag FROM featured")
def intermittent_flag(spark, d):
    return ft.with_recency(_coarse(spark, d)).select(*SERIES, WEEK, "intermittent_flag")


@query(
    "F7_week_cycle",
    f"""SELECT {KEY3}, yw AS year_week, round(sin(2 * pi() * (yw % 100) / 52.18::DOUBLE), 6) + 0.0 AS week_sin,
        round(cos(2 * pi() * (yw % 100) / 52.18::DOUBLE), 6) + 0.0 AS week_cos FROM long_coarse""",
)
def week_cycle(spark, d):
    return _rounded(ft.with_season(tb.long_table(spark, d, "coarse")), ["week_sin", "week_cos"])


@query(
    "F8_head_sample",
    f"""SELECT {KEY3}, yw AS year_week, q AS quantity FROM long_fine JOIN (
          SELECT ch, mat, cat, sum(n) OVER (ORDER BY ch, mat, cat) - n AS before
          FROM (SELECT ch, mat, cat, count(*) AS n FROM long_fine GROUP BY ALL)) USING (ch, mat, cat) WHERE before < 1000""",
)
def head_sample(spark, d):
    return head_rows(tb.long_table(spark, d, "fine"), 1000)


@query(
    "F9_feature_nulls",
    """SELECT feature, CAST(null_count AS BIGINT) AS null_count FROM (
        SELECT count(*) - count(lag_1) AS lag_1, count(*) - count(lag_4) AS lag_4,
          count(*) - count(lag_52) AS lag_52, count(*) - count(rm4) AS rolling_mean_4,
          count(*) - count(rm12) AS rolling_mean_12, count(*) - count(rs12) AS rolling_std_12,
          count(*) - count(wsls) AS weeks_since_last_sale, count(*) - count(interm) AS intermittent_flag,
          CAST(0 AS BIGINT) AS week_sin, CAST(0 AS BIGINT) AS week_cos,
          count(*) - count(dos) AS inventory_days_of_supply
        FROM featured f LEFT JOIN same_week_dos s USING (ch, mat, yw))
       UNPIVOT (null_count FOR feature IN (COLUMNS(*)))""",
)
def feature_nulls(spark, d):
    return ft.null_counts(ft.gold(_coarse(spark, d)), ft.GOLD_FEATURES)


@query(
    "F10_days_of_supply",
    """SELECT k.ch AS "Channel", k.mat AS "Material Description", k.cat AS "Category", w.yw AS year_week,
          round(CASE WHEN p.s > 0 AND k.stocked THEN coalesce(p.i, 0) / (p.s / 7.0::DOUBLE) END, 6) + 0.0 AS inventory_days_of_supply
        FROM (SELECT ch, mat, cat, bool_or(cat = 'Channel Inv.') OVER (PARTITION BY ch, mat) AS stocked
              FROM (SELECT DISTINCT ch, mat, cat FROM long_coarse)) k
        CROSS JOIN weeks w
        LEFT JOIN (SELECT ch, mat, yw, sum(q) FILTER (cat = 'Sell-in') AS s, sum(q) FILTER (cat = 'Channel Inv.') AS i
                   FROM long_coarse GROUP BY ALL) p ON p.ch = k.ch AND p.mat = k.mat AND p.yw = w.yw""",
)
def days_of_supply(spark, d):
    return _rounded(ft.with_days_of_supply(_coarse(spark, d)), ["inventory_days_of_supply"])


@query(
    "F11_nonzero_lags",
    f"""SELECT {KEY3}, yw AS year_week,
        CASE WHEN lag_1 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lag_nonzero_1,
        CASE WHEN lag_4 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lag_nonzero_4,
        CASE WHEN lag_52 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lag_nonzero_52 FROM featured""",
)
def nonzero_lags(spark, d):
    df = ft.with_nonzero_lags(ft.with_lags(_coarse(spark, d)))
    return df.select(*SERIES, WEEK, "lag_nonzero_1", "lag_nonzero_4", "lag_nonzero_52")


@query(
    "F12_demand_rate",
    f"""SELECT {KEY3}, yw AS year_week, 1.0::DOUBLE - interm AS demand_rate_12,
        round(avg(CASE WHEN q > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY ch, mat, cat ORDER BY pos
          ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 6) + 0.0 AS prob_nonzero_12 FROM featured""",
)
def demand_rate(spark, d):
    df = ft.with_true_demand_rate(ft.with_demand_rate(ft.with_recency(_coarse(spark, d))))
    return _rounded(df, ["demand_rate_12", "prob_nonzero_12"])


def _sell_in_features(spark, d):
    return ft.series_features(tb.dense_table(spark, d, "coarse", SELL_IN))


define("si_featured", "SELECT * FROM featured WHERE cat = 'Sell-in'")
define(
    "ch_stats",
    """SELECT ch, avg(rm12) AS ch_mean, stddev_samp(rm12) AS ch_std,
       avg(CASE WHEN q > 0 THEN q END) AS ch_nz FROM si_featured GROUP BY ch""",
)


@query(
    "F13_zscore_vs_channel",
    f"""SELECT {KEY3}, yw AS year_week, round((rm12 - ch_mean) / (ch_std + 1e-9), 6) + 0.0 AS zscore_vs_channel
        FROM si_featured JOIN ch_stats USING (ch)""",
)
def zscore_vs_channel(spark, d):
    df = _sell_in_features(spark, d)
    return _rounded(ft.with_channel_features(df, ft.channel_stats(df)), ["zscore_vs_channel"])


@query(
    "F14_log_features",
    f"""SELECT {KEY3}, yw AS year_week, round(ln(1 + coalesce(lag_1, 0)), 6) + 0.0 AS log_lag_1,
        round(ln(1 + coalesce(lag_4, 0)), 6) + 0.0 AS log_lag_4,
        round(ln(1 + coalesce(rm12, 0)), 6) + 0.0 AS log_rolling_mean_12 FROM featured""",
)
def log_features(spark, d):
    df = ft.with_logs(ft.with_rolling(ft.with_lags(_coarse(spark, d))))
    return _rounded(df, ["log_lag_1", "log_lag_4", "log_rolling_mean_12"])


@query(
    "F15_cv_12",
    f"""SELECT {KEY3}, yw AS year_week, round(least(greatest(coalesce(rs12 / (rm12 + 1e-9), 0), 0), 10), 6) + 0.0 AS cv_12
        FROM featured""",
)
def cv_12(spark, d):
    return _rounded(ft.with_cv(ft.with_rolling(_coarse(spark, d))), ["cv_12"])


@query(
    "F16_channel_nonzero_avg",
    f"""SELECT {KEY3}, yw AS year_week, round(coalesce(ch_nz, 0), 6) + 0.0 AS channel_nonzero_avg
        FROM si_featured JOIN ch_stats USING (ch)""",
)
def channel_nonzero_avg(spark, d):
    df = _sell_in_features(spark, d)
    return _rounded(ft.with_channel_features(df, ft.channel_stats(df)), ["channel_nonzero_avg"])


@query(
    "F17_training_rows",
    f"""SELECT {KEY2}, yw AS year_week, q AS quantity, lag_1, coalesce(lag_52, 0) AS lag_52,
        round(coalesce(rs12, 0), 6) + 0.0 AS rolling_std_12, CASE WHEN q > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
        CASE WHEN yw <= 200052 THEN 'train' ELSE 'val' END AS role
        FROM si_featured WHERE lag_1 IS NOT NULL AND (yw <= 200052 OR yw BETWEEN 200101 AND 200113)""",
)
def training_rows(spark, d):
    df = ft.training_rows(_sell_in_features(spark, d), ["lag_1", "lag_4", "lag_52", *ft.ROLLING_FEATURES])
    train = F.col(WEEK) <= tb.CUTOFF_WEEK
    return df.filter(train | F.col(WEEK).between(200101, 200113)).select(
        *SKU, WEEK, QTY, "lag_1", "lag_52", r6("rolling_std_12").alias("rolling_std_12"), "label",
        F.when(train, "train").otherwise("val").alias("role"),
    )


@query(
    "F18_next_week_features",
    f"""SELECT {KEY2}, yw AS year_week, lag_1, lag_4, lag_52, round(rm4, 6) + 0.0 AS rolling_mean_4,
        round(rm12, 6) + 0.0 AS rolling_mean_12, round(rs12, 6) + 0.0 AS rolling_std_12,
        CASE WHEN max(CASE WHEN q > 0 THEN pos END) OVER (PARTITION BY ch, mat ORDER BY pos
               ROWS BETWEEN 104 PRECEDING AND 1 PRECEDING) IS NULL THEN 104.0::DOUBLE ELSE wsls END AS weeks_since_last_sale,
        interm AS intermittent_flag, round(sin(2 * pi() * (yw % 100) / 52.18::DOUBLE), 6) + 0.0 AS week_sin,
        round(cos(2 * pi() * (yw % 100) / 52.18::DOUBLE), 6) + 0.0 AS week_cos
        FROM si_featured QUALIFY yw = 200101""",
)
def next_week_features(spark, d):
    df = tb.sell_in(spark, d, "coarse")
    hist = ft.latest_history(df, tb.CUTOFF_WEEK)
    week = F.lit(200101)
    cols = ft.array_features("hist", week)
    return hist.select(*SKU, week.alias(WEEK), *[r6(c).alias(k) for k, c in cols.items()])
