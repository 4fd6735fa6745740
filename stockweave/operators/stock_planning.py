"""Balance checks, days of supply, composite stock risk, adjusted forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.schema import CHANNEL, SKU, WEEK


def balance_residual(df: DataFrame) -> DataFrame:
    """``inv − (inv before + sell-in − sales)``; the first week has no earlier inventory."""
    w = Window.partitionBy(*SKU).orderBy(WEEK)
    before = F.coalesce(F.lag("channel_inv").over(w), F.col("channel_inv"))
    res = F.col("channel_inv") - (before + F.col("sell_in") - F.col("cust_sales"))
    return df.withColumn("balance_residual", res)


def balance_quality(df: DataFrame, tolerance: float = 5.0) -> DataFrame:
    r = F.abs("balance_residual")
    return balance_residual(df).groupBy(*SKU).agg(
        F.avg(r).alias("mean_abs_residual"),
        F.avg((r > tolerance).cast("double")).alias("pct_weeks_with_adjustments"),
        F.max(r).alias("max_residual"),
    )


def supply_status(dos: str = "days_of_supply") -> Column:
    d = F.col(dos)
    return (
        F.when(d < 7, "critical_stockout")
        .when(d < 14, "warning_stockout")
        .when(d < 45, "healthy")
        .when(d < 60, "warning_overstock")
        .otherwise("critical_overstock")
    )


def supply_health(store: DataFrame, week: int) -> DataFrame:
    return store.filter(F.col(WEEK) == week).select(
        *SKU, WEEK, F.col("inv_lag_1").alias("current_inv_units"),
        F.col("sales_ma4").alias("avg_weekly_sales"), "days_of_supply",
        supply_status().alias("dos_status"), "sell_through_rate_4w",
    )


def sell_through_ytd(df: DataFrame, year: int, group: list[str] = [CHANNEL]) -> DataFrame:  # noqa: B006
    return (
        df.filter(wk.year_of(WEEK) == year)
        .groupBy(*group)
        .agg(
            F.sum("cust_sales").alias("total_sales"),
            F.sum("sell_in").alias("total_sell_in"),
            (F.try_divide(F.sum("cust_sales"), F.sum("sell_in")) * 100).alias("sell_through_pct"),
        )
    )


def overstock_units(store: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Units above 45 days of supply, over rows beyond the threshold."""
    excess = F.greatest(F.col("inv_lag_1") - F.col("sales_ma4") * (45.0 / 7.0), F.lit(0.0))
    over = F.col("days_of_supply") > threshold
    return store.agg(F.coalesce(F.sum(F.when(over, excess)), F.lit(0.0)).alias("overstock_units"))


def executive_kpis(store: DataFrame, current: int) -> DataFrame:
    """Year to date against the year before, supply, reach: one row."""
    year, w = current // 100, F.col(WEEK)
    ytd = w.between(year * 100 + 1, current)
    prior = w.between((year - 1) * 100 + 1, current - 100)
    now = w == current
    live = now & (F.col("sell_in_ma4") > 0)
    total = F.sum(F.when(ytd, F.col("sell_in")))
    before = F.sum(F.when(prior, F.col("sell_in")))
    return store.agg(
        total.alias("sell_in_ytd"),
        ((F.try_divide(total, before) - 1) * 100).alias("sell_in_yoy_pct"),
        F.sum(F.when(ytd, F.col("cust_sales"))).alias("pos_ytd"),
        F.avg(F.when(now, F.col("days_of_supply"))).alias("avg_dos"),
        (F.avg("sell_through_rate_4w") * 100).alias("sell_through_rate"),
        F.countDistinct(F.when(live, F.col("Material Description"))).alias("active_skus"),
        F.countDistinct(F.when(live, F.col(CHANNEL))).alias("active_channels"),
    )


def _ramp(x: Column, start: float, end: float, points: float) -> Column:
    """0 at ``start``, ``points`` at ``end``, straight in between and flat outside."""
    share = (x - start) / (end - start)
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * points


# Driver names per side, in order of precedence on ties.
OVER_DRIVERS = ["dos_component", "velocity_component", "sell_through_component", "demand_trend_component"]
STOCKOUT_DRIVERS = ["dos_component", "velocity_component", "demand_pressure_component", "acceleration_component"]


def score_columns() -> dict[str, Column]:
    """Points per driver of both risks."""
    dos = F.coalesce("days_of_supply", F.lit(30.0))
    delta = F.coalesce("inv_delta_1", F.lit(0.0))
    through = F.coalesce("sell_through_rate_4w", F.lit(0.8))
    regular = F.coalesce("prob_nonzero_13w", F.lit(0.5))
    weekly = F.greatest(F.coalesce("sales_ma4", F.lit(1.0)), F.lit(0.01))
    trend = F.coalesce("sales_ma4", F.lit(1.0)) / F.greatest(F.coalesce("sales_ma13", F.lit(1.0)), F.lit(0.01))
    pace = delta / weekly
    return {
        "_dos": dos,
        "_o0": F.when(dos <= 60, F.greatest((dos - 45) / 15 * 20, F.lit(0.0))).otherwise(20 + _ramp(dos, 60, 90, 20)),
        "_o1": F.when(delta > 0, F.least(pace * 25, F.lit(25.0))).otherwise(0.0),
        "_o2": 20 - _ramp(through, 0.5, 0.75, 20),
        "_o3": F.when(trend < 0.7, 15.0).when(trend < 0.9, (0.9 - trend) / 0.2 * 15).otherwise(0.0),
        "_s0": F.when(dos < 7, 40.0).when(dos < 14, 20 + (14 - dos) / 7 * 20).otherwise(0.0),
        "_s1": F.when(delta < 0, F.least(-pace * 30, F.lit(30.0))).otherwise(0.0),
        "_s2": F.when((regular > 0.7) & (through > 1.0), 20.0)
        .when(through > 0.9, (through - 0.9) / 0.1 * 10)
        .otherwise(0.0),
        "_s3": F.when(trend > 1.3, 10.0).when(trend > 1.1, (trend - 1.1) / 0.2 * 10).otherwise(0.0),
    }


def _largest(prefix: str, names: list[str]) -> Column:
    """Name of the largest component, the earlier one on ties."""
    best = F.greatest(*[F.col(f"{prefix}{i}") for i in range(4)])
    out = F.lit(names[3])
    for i in (2, 1, 0):
        out = F.when(F.col(f"{prefix}{i}") >= best, names[i]).otherwise(out)
    return out


def composite_risk(store: DataFrame) -> DataFrame:
    """0–100 score, side, tier and main driver per row."""
    df = store.withColumns(score_columns())
    over = sum((F.col(f"_o{i}") for i in range(1, 4)), F.col("_o0"))
    out = sum((F.col(f"_s{i}") for i in range(1, 4)), F.col("_s0"))
    df = df.withColumns({"overstock_score": over, "stockout_score": out})
    o, s, dos = F.col("overstock_score"), F.col("stockout_score"), F.col("_dos")
    df = df.withColumn(
        "risk_type", F.when(o > s, "overstock").when(s > 5, "stockout").otherwise("healthy")
    )
    kind = F.col("risk_type")
    return df.withColumns(
        {
            "risk_score": F.least(F.greatest(o, s), F.lit(100.0)),
            "risk_tier": F.when((kind == "overstock") & (dos > 90), "CRITICAL_OVERSTOCK")
            .when((kind == "overstock") & (dos > 60), "HIGH_OVERSTOCK")
            .when((kind == "stockout") & (dos < 7), "CRITICAL_STOCKOUT")
            .when((kind == "stockout") & (dos < 14), "LOW_STOCK_WARNING")
            .otherwise("HEALTHY"),
            "primary_driver": F.when(kind == "overstock", _largest("_o", OVER_DRIVERS))
            .when(kind == "stockout", _largest("_s", STOCKOUT_DRIVERS))
            .otherwise("none"),
        }
    ).drop("_dos", *[f"_{p}{i}" for p in "os" for i in range(4)])


def risk_trend(scored: DataFrame, last: int, weeks: int = 4) -> DataFrame:
    """Direction of the last weekly scores per SKU from their least-squares slope."""
    first = wk.week_add(last, 1 - weeks)
    rows = scored.filter(F.col(WEEK).between(first, last))
    x = wk.week_index(F.col(WEEK), first).cast("double")
    slope = F.col("slope")
    label = (
        F.when(slope > 5, "critical_worsening")
        .when(slope > 2, "worsening")
        .when(slope < -2, "improving")
        .otherwise("stable")
    )
    out = rows.groupBy(*SKU).agg(F.regr_slope(F.col("risk_score"), x).alias("slope"))
    return out.withColumn("risk_trend", label)


TIERS = {
    "critical_overstock": "CRITICAL_OVERSTOCK", "high_overstock": "HIGH_OVERSTOCK", "healthy": "HEALTHY",
    "low_stock": "LOW_STOCK_WARNING", "critical_stockout": "CRITICAL_STOCKOUT",
}


def risk_overview(scored: DataFrame, trend: DataFrame, week: int) -> DataFrame:
    rows = with_impact(scored.filter(F.col(WEEK) == week)).join(trend.select(*SKU, "risk_trend"), SKU, "left")
    tier = F.col("risk_tier")
    return rows.agg(
        F.count("*").alias("total_series"),
        *[F.count_if(tier == v).alias(f"{k}_count") for k, v in TIERS.items()],
        F.coalesce(F.sum("excess_units"), F.lit(0.0)).alias("overstock_excess_units"),
        F.try_divide(F.count_if(tier != "HEALTHY") * 100.0, F.count("*")).alias("pct_at_risk"),
        F.count_if(F.col("risk_trend").isin("worsening", "critical_worsening")).alias("worsening_count"),
    )


def with_impact(df: DataFrame, unit_cost: float = 100.0) -> DataFrame:
    """Excess units and carrying cost when overstocked; weeks left and lost sales when short."""
    dos = F.col("days_of_supply")
    weekly = F.greatest(F.col("sales_ma4"), F.lit(0.01))
    over, short = dos > 60, dos < 14
    excess = F.greatest(F.col("inv_lag_1") - weekly * (45.0 / 7.0), F.lit(0.0))
    return df.withColumns(
        {
            "impact_type": F.when(over, "overstock").when(short, "stockout").otherwise("healthy"),
            "excess_units": F.when(over, excess),
            "carrying_cost_weekly": F.when(over, excess * unit_cost * 0.003),
            "weeks_to_healthy_dos": F.when(over, (dos - 45) / 7),
            "weeks_to_stockout": F.when(short, dos / 7.0),
            "lost_sales_units": F.when(short, weekly * F.greatest(F.lit(0.0), 2 - dos / 7.0)),
        }
    )


def with_adjusted_forecast(df: DataFrame, forecast: str) -> DataFrame:
    """Damp forecasts of overstocked SKUs, lift those about to run out.

    Damping never goes below 5 % (before the extra cut for growing stock), the
    lift never above threefold.
    """
    f, dos = F.col(forecast), F.col("days_of_supply")
    growing = F.coalesce("inv_momentum", F.lit(0.0)) > 0
    damp = F.greatest(F.lit(0.05), 1 - (dos - 90) / 60.0) * F.when(growing, 0.7).otherwise(1.0)
    rebuild = F.greatest(F.lit(0.0), f * 30.0 / 7.0 - dos * f / 7.0)
    lift = F.least(F.lit(3.0), 1 + rebuild / F.greatest(f, F.lit(1.0)))

    def pick(none, high, some, low, few, rest):
        return (
            F.when(dos.isNull(), none).when(dos >= 90, high).when(dos >= 60, some)
            .when(dos <= 7, low).when(dos <= 14, few).otherwise(rest)
        )

    return df.withColumns(
        {
            "multiplier": pick(
                F.lit(1.0), damp, 1 - 0.4 * ((dos - 60) / 30.0), lift, 1 + 0.3 * ((14 - dos) / 14.0), F.lit(1.0)
            ),
            "reason": pick(
                F.lit("no_inv_data"), F.lit("critical_overstock_suppression"), F.lit("warning_overstock_suppression"),
                F.lit("critical_stockout_boost"), F.lit("warning_stockout_boost"), F.lit("healthy"),
            ),
        }
    ).withColumn("adjusted", f * F.col("multiplier"))


def project_inventory(df: DataFrame, start: str, inflow: str, outflow: str) -> DataFrame:
    """Weekly inventory that never drops below zero.

    With ``S`` the running balance including the start, the floored path is
    ``S − min(0, running minimum of S)``.
    """
    w = Window.partitionBy(*SKU).orderBy(WEEK).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_s", F.col(start) + F.sum(F.col(inflow) - F.col(outflow)).over(w))
    floor = F.least(F.lit(0.0), F.min("_s").over(w))
    return df.withColumn("projected_inv", F.col("_s") - floor).drop("_s")


def projection_checks(df: DataFrame, outflow: str, threshold: float = 90.0) -> DataFrame:
    dos = F.col("projected_inv") / F.greatest(F.col(outflow) / 7.0, F.lit(0.01))
    return df.withColumn("_d", dos).groupBy(*SKU).agg(
        F.count_if(F.col("_d") > threshold).alias("weeks_overstock"),
        F.max("_d").alias("max_projected_dos"),
        F.min("projected_inv").alias("min_projected_inv"),
        F.max_by("projected_inv", WEEK).alias("ends_at_inv"),
        F.max_by("_d", WEEK).alias("ends_at_dos"),
    )
