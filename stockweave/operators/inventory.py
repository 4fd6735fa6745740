"""Stock-out risk: inventory on hand against forecast demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.scale import exact_percentiles
from stockweave.functions.scalars import level_order
from stockweave.functions.weeks import format_week
from stockweave.schema import CATEGORY, CHANNEL, CHANNEL_INV, MATERIAL, QTY, RISK_LEVELS, SKU, WEEK

EPS = 1e-6


def current_inventory(df: DataFrame, keys: list[str] = SKU) -> DataFrame:
    """Last positive inventory reading and its week per SKU."""
    inv = df.filter((F.col(CATEGORY) == CHANNEL_INV) & (F.col(QTY) > 0))
    return inv.groupBy(*keys).agg(
        F.max_by(QTY, WEEK).alias("current_inventory"), F.max(WEEK).alias("last_inv_week")
    )


def forecast_totals(
    fc: DataFrame, keys: list[str] = SKU, demand: str = "forecast_q50",
    upper: str | None = None, horizon: int | None = None, path: bool = False,
) -> DataFrame:
    """Totals, weekly means and span of the forecast per SKU.

    Weekly means divide by ``horizon`` when given: forecasts that leave out
    zero weeks would otherwise overstate demand.
    """
    upper = upper or demand
    weeks = F.lit(float(horizon)) if horizon else F.count("*")
    return fc.groupBy(*keys).agg(
        F.sum(demand).alias("forecast_total"),
        F.sum(upper).alias("forecast_q90_total"),
        (F.sum(demand) / weeks).alias("avg_weekly_demand"),
        (F.sum(upper) / weeks).alias("avg_weekly_demand_q90"),
        F.min(WEEK).alias("forecast_start"),
        F.max(WEEK).alias("forecast_end"),
        F.count("*").alias("n_weeks"),
        *([demand_path(demand).alias("_path")] if path else []),
    )


def with_coverage(df: DataFrame) -> DataFrame:
    inv = F.col("current_inventory")
    return df.withColumns(
        {
            "coverage_ratio": inv / (F.col("forecast_total") + EPS),
            "weeks_of_supply": inv / (F.col("avg_weekly_demand") + EPS),
            "weeks_of_supply_conservative": inv / (F.col("avg_weekly_demand_q90") + EPS),
        }
    )


def risk_level(weeks: Column | str) -> Column:
    """Below 2, 4 and 8 weeks of supply; LOW from 8 on."""
    c = F.col(weeks) if isinstance(weeks, str) else weeks
    return (
        F.when(c < 2, "CRITICAL").when(c < 4, "HIGH").when(c < 8, "MEDIUM").otherwise("LOW")
    )


def demand_path(demand: str) -> Column:
    """Aggregate: forecast weeks of a SKU in order, as an array of horizon length."""
    return F.array_sort(F.collect_list(F.struct(F.col(WEEK).alias("w"), F.col(demand).alias("d"))))


def stockout_week(path: Column | str, inventory: Column | str) -> Column:
    """First week in which running demand reaches the inventory, null if never."""
    path = F.col(path) if isinstance(path, str) else path
    inv = F.col(inventory) if isinstance(inventory, str) else inventory
    start = F.struct(F.lit(0.0).alias("used"), F.lit(None).cast("int").alias("w"))

    def step(acc, x):
        used = acc["used"] + x["d"]
        w = F.when(acc["w"].isNull() & (used >= inv), x["w"]).otherwise(acc["w"])
        return F.struct(used.alias("used"), w.alias("w"))

    return F.aggregate(path, start, step, lambda acc: acc["w"])


def stockout_weeks(
    inventory: DataFrame, fc: DataFrame, keys: list[str] = SKU, demand: str = "forecast_q50"
) -> DataFrame:
    paths = fc.groupBy(*keys).agg(demand_path(demand).alias("_path"))
    return inventory.join(paths, keys).select(
        *keys, "current_inventory", stockout_week("_path", "current_inventory").alias("stockout_week")
    )


def risk_table(
    weekly: DataFrame, fc: DataFrame, keys: list[str] = SKU, demand: str = "forecast_q50",
    upper: str | None = None, horizon: int | None = None,
) -> DataFrame:
    """One row per SKU that has both inventory and a forecast.

    One aggregate per side and one join on the SKU; the stock-out week is read
    off the demand path carried along.
    """
    inv = current_inventory(weekly, keys)
    totals = forecast_totals(fc, keys, demand, upper, horizon, path=True)
    return (
        with_coverage(inv.join(totals, keys))
        .withColumns(
            {
                "risk_level": risk_level("weeks_of_supply_conservative"),
                "stockout_week": stockout_week("_path", "current_inventory"),
            }
        )
        .drop("_path")
    )


def report_order(df: DataFrame, keys: list[str] = SKU) -> DataFrame:
    return df.orderBy(level_order("risk_level", RISK_LEVELS), "weeks_of_supply", *keys)


def level_counts(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Rows per level in fixed order, zero for unused levels."""
    counts = df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in levels])
    out = counts.unpivot([], levels, column, "n")
    return out.withColumn("position", level_order(column, levels))


def risk_summary(risk: DataFrame) -> DataFrame:
    level = F.col("risk_level")
    return risk.agg(
        F.count("*").alias("n_skus"),
        *[F.count_if(level == v).alias(v.lower()) for v in RISK_LEVELS],
        F.min("forecast_start").alias("forecast_start"),
        F.max("forecast_end").alias("forecast_end"),
        F.try_divide(
            F.count_if(level.isin("CRITICAL", "HIGH")) * 100.0, F.count("*")
        ).alias("pct_at_risk"),
    )


def top_critical(risk: DataFrame, n: int = 20, keys: list[str] = SKU) -> DataFrame:
    return (
        risk.filter(F.col("risk_level") == "CRITICAL")
        .orderBy("weeks_of_supply", *keys)
        .limit(n)
        .select(*keys, "current_inventory", "forecast_total", "weeks_of_supply", "stockout_week")
    )


def deficit(risk: DataFrame) -> DataFrame:
    """Units missing against the upper forecast and the median cover."""
    short = F.greatest(F.col("forecast_q90_total") - F.col("current_inventory"), F.lit(0.0))
    mid = exact_percentiles(risk, "weeks_of_supply_conservative", {"median_cover": 0.5})
    return risk.agg(F.sum(short).alias("deficit")).withColumn("median_cover", mid.scalar())


def at_risk_per_channel(risk: DataFrame, n: int = 10) -> DataFrame:
    return (
        risk.filter(F.col("risk_level").isin("CRITICAL", "HIGH"))
        .groupBy(CHANNEL)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), CHANNEL)
        .limit(n)
    )


def channel_levels(risk: DataFrame) -> DataFrame:
    return risk.groupBy(CHANNEL).agg(
        *[F.count_if(F.col("risk_level") == v).alias(v) for v in RISK_LEVELS]
    )


def reorder_table(risk: DataFrame, n: int = 20, keys: list[str] = SKU) -> DataFrame:
    """Lowest cover first: units to buy and a label of the stock-out week."""
    units = F.greatest(F.col("forecast_q90_total") - F.col("current_inventory"), F.lit(0.0))
    label = F.when(F.col("stockout_week").isNull(), "Inminente").otherwise(format_week("stockout_week"))
    return (
        risk.filter(F.col("risk_level").isin("CRITICAL", "HIGH"))
        .orderBy("weeks_of_supply_conservative", *keys)
        .limit(n)
        .select(
            "risk_level", CHANNEL, F.substring(MATERIAL, 1, 42).alias(MATERIAL),
            F.bround("current_inventory", 0).cast("bigint").alias("inventory"),
            F.round("weeks_of_supply_conservative", 2).alias("cover_weeks"),
            F.bround(units, 0).cast("bigint").alias("units_to_buy"),
            label.alias("stockout"),
        )
    )
