"""Bias factors, gating, log targets and the naive/model blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.scalars import EPS
from stockweave.schema import SKU, WEEK

# Interval multipliers of the naive forecast.
NAIVE_Q10, NAIVE_Q90 = 0.45, 1.60


def product_forecast(prob: str = "demand_prob", qty: str = "quantity_hat") -> Column:
    return F.col(prob) * F.col(qty)


def gated_forecast(threshold, prob: str = "demand_prob", qty: str = "quantity_hat") -> Column:
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return F.when(F.col(prob) >= t, F.col(qty)).otherwise(0.0)


def to_log(c: str) -> Column:
    return F.log1p(F.col(c))


def from_log(c) -> Column:
    return F.greatest(F.expm1(F.col(c) if isinstance(c, str) else c), F.lit(0.0))


def bias_factors(
    scored: DataFrame, cut: float = 0.3, low: float = 0.8, high: float = 5.0, min_rows: int = 20
) -> DataFrame:
    """Mean actual over mean forecast of sold weeks: global, regular, sparse.

    A segment with fewer than ``min_rows`` rows takes the global factor. One
    conditional aggregate.
    """
    rows = scored.filter(F.col("quantity_actual") > 0)
    regular = F.col("demand_prob") > cut

    def factor(cond=None):
        a, f = F.col("quantity_actual"), F.col("forecast_q50")
        if cond is not None:
            a, f = F.when(cond, a), F.when(cond, f)
        return F.least(F.greatest(F.avg(a) / (F.avg(f) + EPS), F.lit(low)), F.lit(high))

    out = rows.agg(
        F.coalesce(factor(), F.lit(1.0)).alias("global"),
        factor(regular).alias("_r"), F.count_if(regular).alias("_nr"),
        factor(~regular).alias("_s"), F.count_if(~regular).alias("_ns"),
    )
    return out.select(
        "global",
        F.when(F.col("_nr") >= min_rows, F.col("_r")).otherwise(F.col("global")).alias("regular"),
        F.when(F.col("_ns") >= min_rows, F.col("_s")).otherwise(F.col("global")).alias("sparse"),
    )


def blend(
    naive: DataFrame, model: DataFrame, keys: list[str] = SKU, naive_start: int | None = None
) -> DataFrame:
    """Model values where there are any, else the naive forecast with fixed bands.

    Model weeks before the first naive week come on top. Give ``naive_start``
    where it is known; otherwise it is looked up.
    """
    key = [*keys, WEEK]
    bands = ["forecast_q10", "forecast_q50", "forecast_q90"]
    base = naive.select(
        *key,
        (F.col("forecast_naive") * NAIVE_Q10).alias("_n10"),
        F.col("forecast_naive").alias("_n50"),
        (F.col("forecast_naive") * NAIVE_Q90).alias("_n90"),
    )
    has = F.col("forecast_q50").isNotNull()
    merged = base.join(model.select(*key, *bands), key, "left").select(
        *key,
        *[
            F.coalesce(F.when(has, F.col(b)).otherwise(F.col(n)), F.lit(0.0)).alias(b)
            for b, n in zip(bands, ["_n10", "_n50", "_n90"])
        ],
        F.when(has, "model").otherwise("seasonal_naive").alias("source"),
    )
    start = F.lit(naive_start) if naive_start else naive.agg(F.min(WEEK)).scalar()
    extra = model.filter(F.col(WEEK) < start).select(
        *key, *[F.coalesce(b, F.lit(0.0)).alias(b) for b in bands], F.lit("model").alias("source")
    )
    return merged.unionByName(extra)


def blend_summary(blended: DataFrame) -> DataFrame:
    weekly = blended.groupBy(WEEK).agg(
        F.sum("forecast_q50").alias("q50"), F.sum("forecast_q90").alias("q90"),
        F.count("*").alias("n"), F.count_if(F.col("source") == "model").alias("m"),
    )
    n_skus = blended.select(*SKU).distinct().agg(F.count("*").alias("c")).scalar()
    return weekly.agg(
        F.sum("n").alias("total_rows"),
        F.sum("m").alias("model_rows"),
        F.count("*").alias("n_weeks"),
        F.min(WEEK).alias("first_week"),
        F.max(WEEK).alias("last_week"),
        F.sum("q50").alias("total_q50"),
        F.sum("q90").alias("total_q90"),
        F.avg("q50").alias("avg_weekly_q50"),
        F.avg("q90").alias("avg_weekly_q90"),
    ).withColumn("n_skus", n_skus)
