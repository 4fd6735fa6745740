"""Wide feature store: lags, rolling statistics, ratios, calendar, lifecycle.

Input is the dense wide table (one row per SKU and week with ``sell_in``,
``cust_sales``, ``channel_inv``). Every window is one SKU; totals over a
channel or a family are aggregates joined back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.functions.scale import join_stats
from stockweave.schema import CATEGORY, CHANNEL, CHANNEL_INV, MATERIAL, QTY, SKU, WEEK

EPS = 1e-9
LAGS = {
    "sell_in": (1, 2, 4, 8, 13, 26, 51, 52, 53),
    "sales": (1, 2, 4, 13, 52),
    "inv": (1, 2, 4),
}
SOURCE = {"sell_in": "sell_in", "sales": "cust_sales", "inv": "channel_inv"}
ROLLING = (4, 13, 26)


def by_week():
    return Window.partitionBy(*SKU).orderBy(WEEK)


def flag_and_repair(df: DataFrame, cap: float, year: int) -> DataFrame:
    """Mark values at the cap of one year and negative inventory; the latter become 0."""
    negative = (F.col(CATEGORY) == CHANNEL_INV) & (F.col(QTY) < 0)
    return df.withColumns(
        {
            "is_censored": ((F.col(QTY) == cap) & (wk.year_of(WEEK) == year)).cast("int"),
            "inv_was_negative": negative.cast("int"),
            QTY: F.when(negative, 0.0).otherwise(F.col(QTY)),
        }
    )


def with_measure_lags(df: DataFrame) -> DataFrame:
    w = by_week()
    return df.withColumns(
        {f"{m}_lag_{n}": F.lag(SOURCE[m], n).over(w) for m, lags in LAGS.items() for n in lags}
    )


def with_measure_rolling(df: DataFrame) -> DataFrame:
    """Means and deviations over full past windows, null before a window is full."""
    out = {}
    for n in ROLLING:
        frame = by_week().rowsBetween(-n, -1)
        full = F.count(F.lit(1)).over(frame) == n
        for m, c in SOURCE.items():
            out[f"{m}_ma{n}"] = F.when(full, F.avg(c).over(frame))
            if m != "inv":
                out[f"{m}_std{n}"] = F.when(full, F.stddev_samp(c).over(frame))
    df = df.withColumns(out)
    return df.withColumns(
        {
            f"{m}_cv{n}": F.col(f"{m}_std{n}") / (F.col(f"{m}_ma{n}") + EPS)
            for m in ("sell_in", "sales")
            for n in ROLLING
        }
    )


def with_ratios(df: DataFrame) -> DataFrame:
    """Inventory ratios, all from lagged values."""
    c = F.col

    def floor(x, low=0.01):
        return F.when(c(x).isNotNull(), F.greatest(c(x), F.lit(low)))

    gap = F.sum(c("sell_in") - c("cust_sales")).over(by_week().rowsBetween(-4, -1))
    daily = F.when(c("sales_ma4").isNotNull(), F.greatest(c("sales_ma4") / 7, F.lit(0.01)))
    df = df.withColumns(
        {
            "days_of_supply": c("inv_lag_1") / daily,
            "weeks_of_supply": c("inv_lag_1") / floor("sales_ma4"),
            "sell_through_rate_4w": c("sales_ma4") / floor("sell_in_ma4"),
            "sell_through_rate_13w": c("sales_ma13") / floor("sell_in_ma13"),
            "inv_vs_sales_ratio": c("inv_lag_1") / floor("sales_lag_1"),
            "inv_vs_trend": c("inv_lag_1") / floor("inv_ma13"),
            "inv_delta_1": c("inv_lag_1") - c("inv_lag_2"),
            "inv_delta_4": c("inv_lag_1") - c("inv_lag_4"),
            "inv_momentum": c("inv_ma4") - c("inv_ma13"),
            "replenishment_gap": c("sell_in_lag_1") - c("sales_lag_1"),
            "cumulative_gap_4w": gap,
        }
    )
    return df.withColumns(
        {
            "inv_overstock_flag": (c("days_of_supply") > 60).cast("int"),
            "inv_stockout_flag": (c("days_of_supply") < 14).cast("int"),
        }
    )


RATIOS = [
    "days_of_supply", "weeks_of_supply", "sell_through_rate_4w", "sell_through_rate_13w",
    "inv_vs_sales_ratio", "inv_vs_trend", "inv_delta_1", "inv_delta_4", "inv_momentum",
    "replenishment_gap", "cumulative_gap_4w",
]

# Event weeks of the retail calendar (week numbers, inclusive).
EVENT_WEEKS = {
    "is_mothers_day_week": (18, 19),
    "is_fathers_day_week": (26, 26),
    "is_black_friday_week": (47, 48),
    "is_christmas_week": (50, 52),
    "is_new_year_restock": (1, 3),
    "is_back_to_school": (30, 34),
}
BLACK_FRIDAY_WEEK = 48


def calendar_columns(first: int, first_year: int) -> dict[str, Column]:
    """Calendar attributes of a week label, as expressions: nothing to join."""
    monday = wk.monday_of(WEEK)
    week = wk.week_of(WEEK)
    month = F.month(monday)

    def cycle(x, period):
        return x * F.lit(2 * math.pi / period)

    out = {
        "week_num": week,
        "month": month,
        "quarter": F.quarter(monday),
        "week_sin": F.sin(cycle(week, 52)),
        "week_cos": F.cos(cycle(week, 52)),
        "month_sin": F.sin(cycle(month, 12)),
        "month_cos": F.cos(cycle(month, 12)),
        "is_q4": (F.quarter(monday) == 4).cast("int"),
        "is_jan": (month == 1).cast("int"),
        "weeks_since_epoch": wk.week_index(F.col(WEEK), first),
        "year_normalized": (wk.year_of(WEEK) - first_year) / F.lit(2.0),
        "weeks_to_black_friday": F.greatest(F.lit(BLACK_FRIDAY_WEEK) - week, F.lit(0)),
        "weeks_after_black_friday": F.greatest(week - BLACK_FRIDAY_WEEK, F.lit(0)),
    }
    for name, (a, b) in EVENT_WEEKS.items():
        out[name] = week.between(a, b).cast("int")
    return out


def with_year_over_year(df: DataFrame) -> DataFrame:
    """Growth against a year earlier, and the index of a week of year.

    The index divides the mean of the same week in earlier years by the mean
    of all earlier weeks.
    """
    w = by_week()
    same = (
        Window.partitionBy(*SKU, "_w").orderBy(WEEK).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_w", wk.week_of(WEEK))
    out = {}
    for m in ("sell_in", "sales"):
        c = SOURCE[m]
        out[f"yoy_{m}_ratio"] = F.lag(c, 52).over(w) / (F.lag(c, 104).over(w) + EPS)
        out[f"seasonal_index_{m}"] = F.avg(c).over(same) / (F.avg(c).over(before) + EPS)
    return df.withColumns(out).drop("_w")


def with_zero_inflation(df: DataFrame) -> DataFrame:
    """Shares of sold weeks, interval and size of past sales, recency."""
    w = by_week()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_i", F.row_number().over(w) - 1)
    sold = F.col("sell_in") > 0
    at = F.when(sold, F.col("_i"))
    k = F.count(at).over(before)
    size = F.when(sold, F.col("sell_in"))
    out = {
        f"prob_nonzero_{n}w": F.avg(sold.cast("int")).over(w.rowsBetween(-n, -1)) for n in (4, 13, 52)
    }
    out["inter_demand_interval"] = F.try_divide(
        F.max(at).over(before) - F.min(at).over(before), F.nullif(k - 1, F.lit(-1))
    )
    out["demand_size_mean"] = F.avg(size).over(before)
    out["demand_size_cv"] = F.stddev_samp(size).over(before) / F.avg(size).over(before)
    for name, c in (("nonzero", "sell_in"), ("sales", "cust_sales")):
        out[f"weeks_since_last_{name}"] = F.col("_i") - F.max(F.when(F.col(c) > 0, F.col("_i"))).over(before)
    return df.withColumns(out).drop("_i")


def family(c: str = MATERIAL) -> Column:
    return F.trim(F.get(F.split(c, ","), F.lit(0)))


def with_cross_series(df: DataFrame) -> DataFrame:
    """4-week totals of family and channel, and shares. Needs ``sell_in_ma4``.

    Totals are aggregated first and joined on (group, week): a family may hold
    a large part of all rows.
    """
    df = df.withColumn("product_family", family())
    ma = F.coalesce(F.sum("sell_in_ma4"), F.lit(0.0))
    fam = df.groupBy("product_family", WEEK).agg(ma.alias("family_total_sell_in_4w"))
    chan = df.groupBy(CHANNEL, WEEK).agg(ma.alias("channel_total_sell_in_4w"))
    df = join_stats(join_stats(df, fam, ["product_family", WEEK]), chan, [CHANNEL, WEEK])
    return df.withColumns(
        {
            "family_channel_share": F.try_divide("sell_in_ma4", "family_total_sell_in_4w"),
            "sku_channel_share": F.try_divide("sell_in_ma4", "channel_total_sell_in_4w"),
        }
    )


def with_lifecycle(df: DataFrame, first: int) -> DataFrame:
    """Age since the first sale, life stage, and weeks since the channel's first sale."""
    pos = wk.week_index(F.col(WEEK), first)
    df = df.withColumn("_p", pos)
    per_sku = Window.partitionBy(*SKU)
    sold = F.col("sell_in") > 0
    start = F.min(F.when(sold, F.col("_p"))).over(per_sku)
    age = F.when(F.col("_p") >= start, F.col("_p") - start)
    recent = F.sum("sell_in").over(by_week().rowsBetween(-8, -1))
    tenure = df.groupBy(CHANNEL).agg(F.min(F.when(sold, F.col("_p"))).alias("_c"))
    out = df.withColumns({"sku_age_weeks": age, "_recent": recent})
    out = join_stats(out, tenure, [CHANNEL])
    a = F.col("sku_age_weeks")
    return out.withColumns(
        {
            "sku_is_new": (a <= 8).cast("int"),
            "sku_is_mature": (a > 26).cast("int"),
            "sku_is_retiring": ((F.col("_recent") == 0) & (a > 26)).cast("int"),
            "channel_tenure_weeks": F.when(F.col("_p") >= F.col("_c"), F.col("_p") - F.col("_c")),
        }
    ).drop("_p", "_recent", "_c")


def feature_store(df: DataFrame) -> DataFrame:
    """Lags, rolling statistics and ratios of the dense wide table."""
    return with_ratios(with_measure_rolling(with_measure_lags(df)))


def training_set(df: DataFrame, last_week: int, cap: float | None = None, cap_year: int | None = None):
    """Rows fit for training: up to the cut-off, not censored, with a year of history, alive."""
    out = df.filter(
        (F.col(WEEK) <= last_week) & F.col("sell_in_lag_52").isNotNull() & (F.col("sell_in_ma26") > 0)
    )
    if cap is not None:
        out = out.filter(~((F.col("sell_in") == cap) & (wk.year_of(WEEK) == cap_year)))
    return out
