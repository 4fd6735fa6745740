"""Intermittent-demand forecasts, all series in one job.

Input rows are sparse: ``keys, pos, quantity, n`` with ``pos`` the 0-based week
position and ``n`` the history length of the series. Absent weeks are zero.
Rows at ``pos >= n`` only announce the series. The recursions of Croston and
TSB unroll to weighted sums over the sales, so no array of history is built
and a single shuffle by key serves all models.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.functions import weeks as wk
from stockweave.schema import QTY, SKU, WEEK

SEASON = 52
MODELS = [
    "seasonal_naive", "rolling_seasonal_mean", "croston", "sba", "tsb", "rolling_average",
]
SUITE = MODELS[:5]


def positioned(df: DataFrame, first: int, cutoff: int, keys: list[str] = SKU) -> DataFrame:
    """Sparse weekly rows with positions; history ends at ``cutoff``."""
    return df.filter(F.col(WEEK) >= first).select(
        *keys,
        wk.week_index(F.col(WEEK), first).alias("pos"),
        F.col(QTY).alias(QTY),
        F.lit(wk.week_span(first, cutoff) + 1).alias("n"),
    )


def series_state(
    rows: DataFrame,
    keys: list[str],
    alpha: float = 0.1,
    beta: float = 0.1,
    window: int = 12,
    season: int = SEASON,
    held_out: Column | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per series with all that the models need.

    ``held_out`` numbers the rows to keep aside as actuals (null for others);
    they come back as the map ``held_out``. ``carry`` are columns constant
    within a series. The first aggregate sums plain numbers per week of the
    season; only its few rows per series are put in a map.
    """
    pos, n, q = F.col("pos"), F.col("n"), F.col(QTY)
    is_past = pos < n
    sale = is_past & (q > 0)
    w = Window.partitionBy(*keys).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    rows = rows.withColumns(
        {
            "_k": F.count(F.when(sale, 1)).over(upto),
            "_sales": F.count(F.when(sale, 1)).over(every),
            "_prev": F.max(F.when(sale, pos)).over(before),
        }
    )
    k, total = F.col("_k"), F.col("_sales")
    a, b = F.lit(alpha), F.lit(beta)
    weight = F.pow(1 - a, (total - k).cast("double")) * F.when(k == 1, 1.0).otherwise(a)
    gap = F.when(k == 1, pos + 1).otherwise(pos - F.col("_prev"))
    p_weight = F.pow(1 - b, (n - 1 - pos).cast("double")) * F.when(k == 1, 1.0 / (pos + 1)).otherwise(b)

    def over_sales(x):
        return F.sum(F.when(sale, x))

    aside = held_out if held_out is not None else F.lit(None).cast("int")
    rows = rows.withColumns({"_h": F.pmod(pos - n, F.lit(season)), "_v": aside})
    opening = sale & (k == 1)
    per_slot = rows.groupBy(*keys, "_h", "_v").agg(
        F.max("n").alias("n"),
        F.max("_sales").alias("_sales"),
        over_sales(weight * q).alias("_size"),
        over_sales(weight * gap).alias("_gap"),
        over_sales(p_weight).alias("_prob"),
        F.max(F.when(opening, pos)).alias("_i"),
        F.max(F.when(opening, q)).alias("_y"),
        F.sum(F.when(is_past & (pos >= n - window), q)).alias("_recent"),
        F.sum(F.when(is_past, q)).alias("_season"),
        F.max(F.when(is_past & (pos >= n - season), q)).alias("_last"),
        F.max(F.when(pos == n - 1, q)).alias("_tail"),
        F.max(q).alias("_q"),
        *[F.max(c).alias(c) for c in carry or []],
    )
    values = F.struct(F.col("_season").alias("sum"), F.col("_last").alias("last"))
    slot = F.when(F.col("_v").isNull(), F.struct(F.col("_h"), values))
    kept = F.when(F.col("_v").isNotNull(), F.struct(F.col("_v"), F.col("_q")))
    state = per_slot.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("_sales").alias("n_sales"),
        F.coalesce(F.sum("_size"), F.lit(0.0)).alias("_size"),
        F.sum("_gap").alias("_gap"),
        F.coalesce(F.sum("_prob"), F.lit(0.0)).alias("_prob"),
        F.max("_i").alias("_i"),
        F.max("_y").alias("_y"),
        (F.coalesce(F.sum("_recent"), F.lit(0.0)) / F.least(F.max("n"), F.lit(window))).alias("recent_mean"),
        F.coalesce(F.max("_tail"), F.lit(0.0)).alias("last_value"),
        F.map_from_entries(F.collect_list(slot)).alias("season"),
        *([F.map_from_entries(F.collect_list(kept)).alias("held_out")] if held_out is not None else []),
        *[F.max(c).alias(c) for c in carry or []],
    )
    single = F.when(F.col("_i") > 0, F.col("_y") / F.col("_i")).otherwise(F.col("_y"))
    return state.withColumns(
        {
            "croston": F.when(F.col("n_sales") == 0, 0.0)
            .when(F.col("n_sales") == 1, single)
            .otherwise(F.col("_size") / F.greatest(F.col("_gap"), F.lit(1e-9))),
            "tsb": F.col("_prob") * F.col("_size"),
        }
    ).drop("_size", "_gap", "_prob", "_i", "_y")


def forecast_columns(h: Column, alpha: float = 0.1, blend: float = 0.5, season: int = SEASON):
    """Model values for 0-based step ``h`` from a :func:`series_state` row."""
    n = F.col("n")
    slot = F.pmod(h, F.lit(season))
    at = F.try_element_at(F.col("season"), slot.cast("int"))
    lag = season - slot
    seen = F.when(n >= lag, F.floor((n - lag) / season) + 1).otherwise(0)
    seasonal = F.when(seen > 0, F.coalesce(at["sum"], F.lit(0.0)) / seen).otherwise(F.col("recent_mean"))
    return {
        "seasonal_naive": F.when(n >= season, F.coalesce(at["last"], F.lit(0.0))).otherwise(F.col("last_value")),
        "rolling_seasonal_mean": blend * seasonal + (1 - blend) * F.col("recent_mean"),
        "croston": F.col("croston"),
        "sba": F.col("croston") * (1 - alpha / 2),
        "tsb": F.col("tsb"),
        "rolling_average": F.col("recent_mean"),
    }


def forecast(
    state: DataFrame, keys: list[str], horizon: int, models: list[str] = MODELS
) -> DataFrame:
    """``keys, step`` (1-based) and one non-negative column per model."""
    steps = state.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    cols = forecast_columns(F.col("_h"))
    return steps.select(
        *keys,
        (F.col("_h") + 1).alias("step"),
        *[F.greatest(cols[m], F.lit(0.0)).alias(m) for m in models],
    )


def tall(wide: DataFrame, keys: list[str], models: list[str] = MODELS) -> DataFrame:
    return wide.unpivot([*keys, "step"], models, "model", "yhat")


def run_models(
    df: DataFrame, first: int, cutoff: int, horizon: int, models: list[str] = MODELS,
    keys: list[str] = SKU,
) -> DataFrame:
    """Several models by name, one row per model, series and step."""
    unknown = set(models) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}; available: {MODELS}")
    state = series_state(positioned(df, first, cutoff, keys), keys)
    return tall(forecast(state, keys, horizon, models), keys, models)


def naive_forecast(
    df: DataFrame, first: int, cutoff: int, horizon: int, keys: list[str] = SKU,
    min_history: int = 26,
) -> DataFrame:
    """Seasonal naive after ``cutoff`` with ISO week labels."""
    state = series_state(positioned(df, first, cutoff, keys), keys)
    out = forecast(state.filter(F.col("n") >= min_history), keys, horizon, ["seasonal_naive"])
    label = wk.shift_week(F.lit(cutoff), F.col("step"))
    return out.select(
        *keys,
        label.alias(WEEK),
        F.col("step").alias("horizon_step"),
        F.col("seasonal_naive").alias("forecast_naive"),
        wk.week_of(label).alias("week_num"),
        wk.year_of(label).alias("year"),
    )


def last_sales_week(df: DataFrame) -> int:
    """Last week in which anything was sold (one number, read on the driver)."""
    return df.filter(F.col(QTY) > 0).agg(F.max(WEEK)).first()[0]


def user_model(
    df: DataFrame, first: int, cutoff: int, horizon: int,
    fit_predict: Callable[[np.ndarray, int], np.ndarray], keys: list[str] = SKU,
) -> DataFrame:
    """A Python model per series: history vector in, horizon vector out.

    Values are made finite and non-negative and padded with zeros. A group is
    one series, so at most the weeks of the calendar reach one call.
    """
    n = wk.week_span(first, cutoff) + 1
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("step", T.IntegerType()), T.StructField("yhat", T.DoubleType())]
    )

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(n)
        past = pdf[pdf["pos"] < n]
        y[past["pos"].to_numpy()] = past[QTY].to_numpy()
        got = np.nan_to_num(np.asarray(fit_predict(y, horizon), dtype=float), posinf=0.0, neginf=0.0)
        yhat = np.zeros(horizon)
        m = min(horizon, len(got))
        yhat[:m] = got[:m].clip(min=0.0)
        out = pd.DataFrame({"step": np.arange(1, horizon + 1, dtype="int32"), "yhat": yhat})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "step", "yhat"]]

    return positioned(df, first, cutoff, keys).groupBy(*keys).applyInPandas(per_series, schema)


def simple_forecasts(df: DataFrame, first: int, cutoff: int, horizon: int, keys: list[str] = SKU):
    """4-week mean, mean of all history, seasonal naive times yearly growth."""
    rows = positioned(df, first, cutoff, keys)
    pos, n, q = F.col("pos"), F.col("n"), F.col(QTY)

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, q)), F.lit(0.0))

    extra = rows.groupBy(*keys).agg(
        (total((pos < n) & (pos >= n - 4)) / 4).alias("mean_4"),
        (total(pos < n) / F.max(n)).alias("historical_mean"),
        F.try_divide(
            total((pos < n) & (pos >= n - SEASON)),
            total((pos < n - SEASON) & (pos >= n - 2 * SEASON)),
        ).alias("_growth"),
    )
    naive = naive_forecast(df, first, cutoff, horizon, keys)
    return naive.join(extra, keys).select(
        *keys,
        WEEK,
        "mean_4",
        "historical_mean",
        (F.col("forecast_naive") * F.coalesce("_growth", F.lit(1.0))).alias("seasonal_growth"),
    )
