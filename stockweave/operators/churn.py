"""Customer churn from weekly Sell-in per channel.

Works on observed rows only. Weeks without a row count as zero: means divide
by the number of weeks, and the trend uses sums over the last weeks instead of
filled-in series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.functions.scalars import level_order
from stockweave.schema import CATEGORY, CHANNEL, CHURN_TIERS, QTY, SELL_IN, WEEK

TREND_WEEKS = 26
RECENT_WEEKS = 13


def client_weeks(df: DataFrame, reference: int) -> DataFrame:
    """Sell-in per customer and week up to the reference week."""
    return (
        df.filter((F.col(CATEGORY) == SELL_IN) & (F.col(WEEK) <= reference))
        .groupBy(CHANNEL, WEEK)
        .agg(F.sum(QTY).alias(QTY))
    )


def week_ranks(weekly: DataFrame) -> DataFrame:
    """Observed weeks, latest = 0, with their number and the first one.

    One row per calendar week.
    """
    w = Window.orderBy(F.desc(WEEK))
    every = Window.partitionBy(F.lit(1))
    weeks = weekly.select(WEEK).distinct()
    return weeks.select(
        WEEK,
        (F.row_number().over(w) - 1).alias("rank"),
        F.count("*").over(every).alias("n_weeks"),
        F.min(WEEK).over(every).alias("first_week"),
    )


def dense_client_weeks(weekly: DataFrame) -> DataFrame:
    """Every buying customer on every observed week.

    The weeks form one array of calendar length, exploded next to each
    customer.
    """
    weeks = weekly.agg(F.sort_array(F.collect_set(WEEK)).alias("w")).scalar()
    clients = weekly.groupBy(CHANNEL).agg(F.max(QTY).alias("_m")).filter("_m > 0").select(CHANNEL)
    grid = clients.withColumn(WEEK, F.explode(weeks))
    return grid.join(weekly, [CHANNEL, WEEK], "left").fillna(0.0, subset=[QTY])


def client_metrics(weekly: DataFrame, reference: int) -> DataFrame:
    """Recency, activity, trend and volume change per buying customer."""
    ranks = week_ranks(weekly)  # one row per calendar week
    n, first = F.col("n_weeks"), F.col("first_week")
    rows = weekly.join(F.broadcast(ranks), WEEK)
    q, r = F.col(QTY), F.col("rank")
    m = F.least(n, F.lit(TREND_WEEKS))
    x = (m - 1 - r).cast("double")

    def total(cond: Column, value: Column = q):
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))

    out = rows.groupBy(CHANNEL).agg(
        F.max("n_weeks").alias("n_weeks"),
        F.max("first_week").alias("first_week"),
        F.max(F.when(q > 0, F.col(WEEK))).alias("last_purchase_week"),
        F.count_if(q > 0).alias("_active"),
        F.sum(q).alias("_total"),
        total(r < m).alias("_sy"),
        total(r < m, q * x).alias("_sxy"),
        total(r < RECENT_WEEKS).alias("_recent"),
        total((r >= RECENT_WEEKS) & (r < 2 * RECENT_WEEKS)).alias("_before"),
    ).filter(F.col("_active") > 0)
    # least squares over x = 0 .. m-1: the sums of x and x² are closed forms
    sx = m * (m - 1) / 2.0
    sxx = m * (m - 1) * (2 * m - 1) / 6.0
    slope = F.try_divide(m * F.col("_sxy") - sx * F.col("_sy"), m * sxx - sx * sx)
    recent = F.col("_recent") / F.least(n, F.lit(RECENT_WEEKS))
    before = F.try_divide(
        F.col("_before"), F.least(F.greatest(n - RECENT_WEEKS, F.lit(0)), F.lit(RECENT_WEEKS))
    )
    before = F.coalesce(before, F.lit(0.0))
    change = (
        F.when(before > 0, (recent - before) / before * 100).when(recent > 0, 100.0).otherwise(0.0)
    )
    return out.select(
        CHANNEL,
        "last_purchase_week",
        wk.flat52_weeks_between(F.coalesce("last_purchase_week", first), F.lit(reference)).alias(
            "weeks_since_last_purchase"
        ),
        (F.col("_active") / n * 100).alias("active_weeks_pct"),
        slope.alias("trend_slope"),
        (F.col("_total") / n).alias("avg_weekly_volume"),
        recent.alias("last_13w_avg"),
        change.alias("volume_change_pct"),
    )


def churn_tier() -> Column:
    """ALTO after 26 idle weeks, MEDIO after 13 or on a steep fall, else ACTIVO.

    BAJO follows ACTIVO in the rule order and is never reached.
    """
    idle = F.col("weeks_since_last_purchase")
    falling = (F.col("trend_slope") < -0.5) & (F.col("volume_change_pct") < -40.0)
    return (
        F.when(idle > 26, "ALTO")
        .when(idle > 13, "MEDIO")
        .when(F.coalesce(falling, F.lit(False)), "MEDIO")
        .when(idle <= 13, "ACTIVO")
        .otherwise("BAJO")
    )


def churn_table(df: DataFrame, reference: int) -> DataFrame:
    return client_metrics(client_weeks(df, reference), reference).withColumn(
        "churn_risk", churn_tier()
    )


def report_order(churn: DataFrame) -> DataFrame:
    return churn.orderBy(
        level_order("churn_risk", CHURN_TIERS), F.desc("weeks_since_last_purchase"), CHANNEL
    )


def never_bought(df: DataFrame, reference: int) -> DataFrame:
    """Customers with Sell-in rows but no purchase up to the reference week."""
    rows = df.filter(F.col(CATEGORY) == SELL_IN)
    buyers = rows.filter((F.col(QTY) > 0) & (F.col(WEEK) <= reference)).select(CHANNEL).distinct()
    return rows.select(CHANNEL).distinct().join(buyers, CHANNEL, "left_anti")


def churn_summary(churn: DataFrame) -> DataFrame:
    tier = F.col("churn_risk")
    return churn.agg(
        F.count("*").alias("n_customers"),
        *[F.count_if(tier == t).alias(t.lower()) for t in CHURN_TIERS],
        F.try_divide(F.count_if(tier == "ALTO") * 100.0, F.count("*")).alias("pct_high"),
    )


def action_table(churn: DataFrame) -> DataFrame:
    return (
        churn.filter(F.col("churn_risk").isin("ALTO", "MEDIO"))
        .select(
            "churn_risk", CHANNEL, wk.format_week("last_purchase_week").alias("last_purchase"),
            "weeks_since_last_purchase", "active_weeks_pct", "avg_weekly_volume", "volume_change_pct",
        )
        .orderBy("churn_risk", F.desc("weeks_since_last_purchase"), CHANNEL)
    )
