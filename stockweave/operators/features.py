"""Look-back features of weekly series.

All frames are row frames that end one row before the current one, over
``partitionBy(series).orderBy(week)``. Input is dense (one row per week), so a
partition is one series of bounded length, and because every feature shares the
window the series are shuffled and sorted once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions import scalars as sc
from stockweave.functions import weeks as wk
from stockweave.functions.scale import join_stats
from stockweave.schema import (
    CATEGORY, CHANNEL, CHANNEL_INV, QTY, SELL_IN, SERIES, SKU, WEEK,
)

LAG_FEATURES = ["lag_1", "lag_4", "lag_52"]
ROLLING_FEATURES = ["rolling_mean_4", "rolling_mean_12", "rolling_std_12"]
GOLD_FEATURES = [
    *LAG_FEATURES, *ROLLING_FEATURES, "weeks_since_last_sale", "intermittent_flag",
    "week_sin", "week_cos", "inventory_days_of_supply",
]
STAGE_FEATURES = [
    "lag_nonzero_1", "lag_nonzero_4", "lag_nonzero_52", "demand_rate_12", "zscore_vs_channel",
]
SCALE_FEATURES = ["log_lag_1", "log_lag_4", "log_rolling_mean_12", "cv_12", "channel_nonzero_avg"]


def series_window(keys: list[str] = SERIES):
    return Window.partitionBy(*keys).orderBy(WEEK)


def past(keys: list[str], n: int):
    return series_window(keys).rowsBetween(-n, -1)


def with_lags(df: DataFrame, lags=(1, 4, 52), keys: list[str] = SERIES, value: str = QTY):
    w = series_window(keys)
    prefix = "lag" if value == QTY else f"{value}_lag"
    return df.withColumns({f"{prefix}_{n}": F.lag(value, n).over(w) for n in lags})


def with_rolling(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Means over 4 and 12 past weeks and the sample deviation over 12."""
    return df.withColumns(
        {
            "rolling_mean_4": F.avg(QTY).over(past(keys, 4)),
            "rolling_mean_12": F.avg(QTY).over(past(keys, 12)),
            "rolling_std_12": F.stddev_samp(QTY).over(past(keys, 12)),
        }
    )


def with_recency(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Weeks since the last sale, and whether most of the past 12 were zero."""
    w = series_window(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_i", F.row_number().over(w) - 1)
    last = F.max(F.when(F.col(QTY) > 0, F.col("_i"))).over(before)
    zero_share = F.avg((F.col(QTY) == 0).cast("int")).over(past(keys, 12))
    return df.withColumns(
        {
            "weeks_since_last_sale": F.coalesce(F.col("_i") - last - 1, F.col("_i")).cast("double"),
            "intermittent_flag": F.coalesce((zero_share > 0.5).cast("double"), F.lit(0.0)),
        }
    ).drop("_i")


def with_season(df: DataFrame) -> DataFrame:
    angle = wk.week_of(WEEK) * F.lit(2 * math.pi / wk.WEEKS_IN_YEAR)
    return df.withColumns({"week_sin": F.sin(angle), "week_cos": F.cos(angle)})


def with_days_of_supply(df: DataFrame) -> DataFrame:
    """Same-week inventory over daily Sell-in, on all categories of a SKU week.

    Descriptive only: it uses the sale of its own week. Models take the lagged
    ratio of :func:`with_lagged_days_of_supply`.
    """
    w = Window.partitionBy(*SKU, WEEK)  # at most one row per category
    sold = F.max(F.when(F.col(CATEGORY) == SELL_IN, F.col(QTY))).over(w)
    inv = F.max(F.when(F.col(CATEGORY) == CHANNEL_INV, F.col(QTY))).over(w)
    return df.withColumn("inventory_days_of_supply", F.when(sold > 0, inv / (sold / 7.0)))


def with_lagged_days_of_supply(df: DataFrame, inventory: DataFrame) -> DataFrame:
    """Inventory of the week before over the mean daily sale of 4 past weeks."""
    inv = inventory.select(*SKU, wk.shift_week(WEEK, 1).alias(WEEK), F.col(QTY).alias("_inv"))
    daily = F.greatest(F.col("rolling_mean_4") / 7.0, F.lit(0.01))
    return (
        df.join(inv, [*SKU, WEEK], "left")
        .withColumn(
            "inventory_days_of_supply",
            F.when(F.col("rolling_mean_4").isNotNull(), F.coalesce("_inv", F.lit(0.0)) / daily),
        )
        .drop("_inv")
    )


def series_features(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Lags, rolling statistics, recency and season of a dense table."""
    return with_season(with_recency(with_rolling(with_lags(df, keys=keys), keys), keys))


def gold(df: DataFrame) -> DataFrame:
    """All eleven features of the dense table."""
    return with_days_of_supply(series_features(df))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "feature", "null_count")


def with_nonzero_lags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            f"lag_nonzero_{n}": F.coalesce(F.col(f"lag_{n}") > 0, F.lit(False)).cast("double")
            for n in (1, 4, 52)
        }
    )


def with_demand_rate(df: DataFrame) -> DataFrame:
    """``demand_rate_12`` is 1 minus the intermittent flag, hence 0 or 1."""
    return df.withColumn("demand_rate_12", 1.0 - F.col("intermittent_flag"))


def with_true_demand_rate(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return df.withColumn(
        "prob_nonzero_12", F.avg((F.col(QTY) > 0).cast("int")).over(past(keys, 12))
    )


def channel_stats(df: DataFrame, fit: Column | None = None) -> DataFrame:
    """Per channel: mean and deviation of the 12-week mean, mean positive sale.

    ``fit`` restricts the rows the statistics are learned from.
    """
    rows = df if fit is None else df.filter(fit)
    return rows.groupBy(CHANNEL).agg(
        F.avg("rolling_mean_12").alias("ch_mean"),
        F.stddev_samp("rolling_mean_12").alias("ch_std"),
        F.avg(F.when(F.col(QTY) > 0, F.col(QTY))).alias("ch_nonzero_avg"),
    )


def with_channel_columns(df: DataFrame) -> DataFrame:
    """z-score and mean sale from the channel statistics on the row."""
    return df.withColumns(
        {
            "zscore_vs_channel": (F.col("rolling_mean_12") - F.col("ch_mean"))
            / (F.col("ch_std") + sc.EPS),
            "channel_nonzero_avg": F.coalesce("ch_nonzero_avg", F.lit(0.0)),
        }
    )


def with_channel_features(df: DataFrame, stats: DataFrame) -> DataFrame:
    out = with_channel_columns(join_stats(df, stats, [CHANNEL]))
    return out.drop("ch_mean", "ch_std", "ch_nonzero_avg")


def with_logs(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f"log_{c}": F.log1p(F.coalesce(c, F.lit(0.0))) for c in ("lag_1", "lag_4", "rolling_mean_12")}
    )


def with_cv(df: DataFrame) -> DataFrame:
    raw = F.col("rolling_std_12") / (F.col("rolling_mean_12") + sc.EPS)
    return df.withColumn(
        "cv_12", F.least(F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)), F.lit(10.0))
    )


def model_features(df: DataFrame, stats: DataFrame) -> DataFrame:
    """The 21-column input of the learned models, from a featured table."""
    return with_cv(with_logs(with_channel_features(with_demand_rate(with_nonzero_lags(df)), stats)))


MODEL_FEATURES = [*GOLD_FEATURES, *STAGE_FEATURES, *SCALE_FEATURES]


def training_rows(df: DataFrame, columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """Rows with a first lag; other nulls become 0; 0/1 label added."""
    return (
        df.dropna(subset=["lag_1"])
        .fillna(0.0, subset=columns)
        .withColumn("label", (F.col(QTY) > 0).cast("double"))
    )


def latest_history(df: DataFrame, last: int, size: int = 104, keys: list[str] = SKU) -> DataFrame:
    """Per series an array of its ``size`` weeks up to ``last``, oldest first.

    Works on sparse rows: absent weeks are 0. The array is bounded by ``size``,
    and a series without recent rows keeps an all-zero history.
    """
    first = wk.week_add(last, 1 - size)
    pos = wk.week_index(F.col(WEEK), first)
    rows = df.filter(F.col(WEEK) <= last).select(*keys, pos.alias("pos"), QTY)
    entry = F.when(F.col("pos") >= 0, F.struct("pos", F.col(QTY).alias("q")))
    e = F.col("_e")

    def zeros(k):
        return F.array_repeat(F.lit(0.0), k.cast("int"))

    def with_gap(x, i):
        until = F.coalesce(F.get(e, i + 1)["pos"], F.lit(size))
        return F.concat(F.array(x["q"]), zeros(until - x["pos"] - 1))

    lead_in = F.coalesce(F.get(e, F.lit(0))["pos"], F.lit(size))
    return (
        rows.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(entry)).alias("_e"))
        .select(*keys, F.concat(zeros(lead_in), F.flatten(F.transform(e, with_gap))).alias("hist"))
    )


def array_features(hist: str, week: Column) -> dict[str, Column]:
    """Features of the week after the last element of a history array."""
    h = F.col(hist)
    n = F.size(h)

    def back(k: int) -> Column:
        return F.coalesce(F.get(h, n - k), F.lit(0.0))

    def tail(k: int) -> Column:
        return F.slice(h, F.greatest(n - (k - 1), F.lit(1)), F.least(n, F.lit(k)))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def mean(a: Column) -> Column:
        return total(a) / F.size(a)

    m12 = mean(tail(12))
    ss = F.aggregate(tail(12), F.lit(0.0), lambda s, x: s + (x - m12) * (x - m12))
    zero12 = F.size(F.filter(tail(12), lambda x: x == 0)) / F.size(tail(12))
    last_pos = F.array_max(
        F.transform(h, lambda x, i: F.when(x > 0, i).otherwise(F.lit(-1)))
    )
    angle = wk.week_of(week) * F.lit(2 * math.pi / wk.WEEKS_IN_YEAR)
    return {
        "lag_1": back(1),
        "lag_4": back(4),
        "lag_52": back(52),
        "rolling_mean_4": mean(tail(4)),
        "rolling_mean_12": m12,
        "rolling_std_12": F.sqrt(ss / F.nullif(F.size(tail(12)) - 1, F.lit(0))),
        "weeks_since_last_sale": F.when(last_pos < 0, n).otherwise(n - 1 - last_pos).cast("double"),
        "intermittent_flag": (zero12 > 0.5).cast("double"),
        "week_sin": F.sin(angle),
        "week_cos": F.cos(angle),
    }


def series_ids(keys_df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Dense 0-based id per series, in order of the key's MD5.

    The first three hex digits split the keys in 4096 even groups, so no task
    sees all keys; group offsets come from the 4096 group sizes.
    """
    h = F.md5(F.concat_ws("|", *keys))
    df = keys_df.select(*keys).distinct().withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    sizes = df.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_b").orderBy("_h", *keys)
    return df.join(F.broadcast(offsets), "_b").select(
        *keys, (F.col("_off") + F.row_number().over(w) - 1).alias("series_id")
    )
