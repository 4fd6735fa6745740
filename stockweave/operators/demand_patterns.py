"""Demand classes, and forecasts for rare and new products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.functions.scale import exact_percentiles
from stockweave.operators.feature_store import family
from stockweave.schema import CHANNEL, MATERIAL, QTY, SKU, WEEK


def quadrant(adi: Column, cv2: Column, adi_cut: float = 1.32, cv2_cut: float = 0.49) -> Column:
    return (
        F.when((adi < adi_cut) & (cv2 < cv2_cut), "smooth")
        .when(cv2 < cv2_cut, "intermittent")
        .when(adi < adi_cut, "erratic")
        .otherwise("lumpy")
    )


def series_registry(
    df: DataFrame, last: int, weeks: int = 52, min_regular: int = 13, keys: list[str] = SKU
) -> DataFrame:
    """Class of every series over its last weeks, from sparse rows in one aggregate.

    The mean interval needs only the first and last sale and their number.
    """
    first = wk.week_add(last, 1 - weeks)
    pos = wk.week_index(F.col(WEEK), first)
    sold = (pos >= 0) & (F.col(QTY) > 0)
    got = df.filter(F.col(WEEK) <= last).groupBy(*keys).agg(
        F.count_if(sold).alias("active_weeks"),
        F.min(F.when(sold, pos)).alias("_a"),
        F.max(F.when(sold, pos)).alias("_b"),
        F.avg(F.when(sold, F.col(QTY))).alias("_m"),
        F.stddev_samp(F.when(sold, F.col(QTY))).alias("_s"),
        F.min(F.when(sold, F.col(WEEK))).alias("first_active_week"),
        F.max(F.when(sold, F.col(WEEK))).alias("last_active_week"),
    )
    k = F.col("active_weeks")
    spread = F.coalesce(F.col("_s"), F.lit(0.0)) / F.col("_m")
    got = got.withColumns(
        {
            "adi": F.when(k == 0, F.lit(None).cast("double"))
            .when(k < 4, F.lit(float(weeks)) / k)
            .otherwise(F.try_divide(F.col("_b") - F.col("_a"), k - 1)),
            "cv2": F.when(k < 4, 0.0).otherwise(spread * spread),
        }
    )
    q = F.when(k == 0, "dead").when(k < 4, "rare").otherwise(quadrant(F.col("adi"), F.col("cv2")))
    got = got.withColumn("quadrant", q)
    seg = (
        F.when(F.col("quadrant").isin("dead", "rare"), F.col("quadrant"))
        .when((F.col("quadrant") == "smooth") & (k >= min_regular), "regular")
        .otherwise("intermittent")
    )
    return got.withColumn("segment", seg).drop("_a", "_b", "_m", "_s")


def rare_forecast(
    df: DataFrame, registry: DataFrame, last: int, family_weight: float = 0.4, recent: int = 13
) -> DataFrame:
    """Flat weekly level of rare series: own and family mean sale times recent activity.

    Family means leave out dead series and come from one aggregate per
    (family, channel).
    """
    start = wk.week_add(last, 1 - recent)
    sold = F.col(QTY) > 0
    per_sku = df.filter(F.col(WEEK) <= last).groupBy(*SKU).agg(
        F.coalesce(F.sum(F.when(sold, F.col(QTY))), F.lit(0.0)).alias("_sum"),
        F.count_if(sold).alias("_n"),
        F.count_if(sold & (F.col(WEEK) >= start)).alias("_recent"),
    )
    rows = per_sku.join(registry.select(*SKU, "segment"), SKU).withColumn("product_family", family())
    live = F.col("segment") != "dead"
    fam = rows.groupBy("product_family", CHANNEL).agg(
        F.try_divide(F.sum(F.when(live, F.col("_sum"))), F.sum(F.when(live, F.col("_n")))).alias("_f")
    )
    own = F.coalesce(F.try_divide("_sum", "_n"), F.lit(0.0))
    level = (1 - family_weight) * own + family_weight * F.coalesce("_f", F.lit(0.0))
    return (
        rows.filter(F.col("segment") == "rare")
        .join(fam, ["product_family", CHANNEL], "left")
        .select(*SKU, "product_family", F.greatest(level * F.col("_recent") / recent, F.lit(0.0)).alias("weekly_forecast"))
    )


# Share of the analog level reached in the first weeks.
RAMP = [0.3, 0.6, 0.8, 0.9]


def cold_start(
    store: DataFrame, week: int, horizon: int = 19, n_analogs: int = 3
) -> DataFrame:
    """Forecast for a new product per (family, channel) from established analogs.

    Analogs are older than 8 and younger than 104 weeks; the level is the median
    sell-in of the three with the largest recent sales, else the family mean.
    Spark cuts the ranking to three rows per group in every task before it moves rows.
    """
    rows = store.filter(F.col(WEEK) == week).withColumn("product_family", family())
    groups = ["product_family", CHANNEL]
    a = F.col("sku_age_weeks")
    best = Window.partitionBy(*groups).orderBy(F.coalesce("sales_ma4", F.lit(-1.0)).desc(), F.col(MATERIAL).desc())
    tops = rows.filter((a > 8) & (a < 104)).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= n_analogs)
    level = tops.groupBy(*groups).agg(F.median("sell_in").alias("_analog"))
    base = rows.groupBy(*groups).agg(F.avg("sell_in").alias("_mean"))
    ramp = F.coalesce(F.get(F.array(*[F.lit(r) for r in RAMP]), F.col("step") - 1), F.lit(1.0))
    out = base.join(level, groups, "left").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return out.select(*groups, "step", (F.coalesce("_analog", "_mean") * ramp).alias("forecast"))
