"""Forecast accuracy as aggregates over (actual, forecast) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.scalars import EPS
from stockweave.functions.scale import running_totals
from stockweave.schema import SKU, WEEK


def _a() -> Column:
    return F.col("actual")


def _f() -> Column:
    return F.col("forecast")


def _abs_err() -> Column:
    return F.abs(_a() - _f())


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def smape() -> Column:
    return F.avg(2.0 * _abs_err() / (F.abs(_a()) + F.abs(_f()) + EPS)) * 100


def wape(cond: Column | None = None) -> Column:
    """Error over volume; 0 when there is no volume."""
    err, vol = _abs_err(), F.abs(_a())
    if cond is not None:
        err, vol = F.when(cond, err), F.when(cond, vol)
    return F.when(F.sum(vol) >= EPS, F.sum(err) / F.sum(vol) * 100).otherwise(0.0)


def active_wape() -> Column:
    return wape(_a() > 0)


def bias_pct() -> Column:
    vol = F.avg(F.abs(_a()))
    return F.when(vol >= EPS, F.avg(_f() - _a()) / vol * 100).otherwise(0.0)


def service_level() -> Column:
    return F.avg((_f() >= _a()).cast("double"))


def mae() -> Column:
    return F.avg(_abs_err())


def rmse() -> Column:
    return F.sqrt(F.avg((_a() - _f()) * (_a() - _f())))


def demand_f1(threshold: float = 0.5) -> Column:
    """F1 of "something is sold" with forecasts above ``threshold`` as positives."""
    t, p = _a() > 0, _f() > threshold
    tp = F.count_if(t & p)
    return _or_zero(F.try_divide(2.0 * tp, 2 * tp + F.count_if(~t & p) + F.count_if(t & ~p)))


def pinball(q: float) -> Column:
    d = _a() - _f()
    return F.avg(F.when(d >= 0, q * d).otherwise((q - 1.0) * d))


def clean(df: DataFrame) -> DataFrame:
    """Non-finite values to 0, negative forecasts to 0."""

    def finite(c):
        bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(bad, 0.0).otherwise(c)

    return df.withColumns({"actual": finite(_a()), "forecast": F.greatest(finite(_f()), F.lit(0.0))})


SUITE = ["smape", "wape", "active_wape", "bias", "slp", "demand_f1", "pinball_50", "mae", "rmse"]


def suite_columns() -> list[Column]:
    return [
        smape().alias("smape"),
        wape().alias("wape"),
        active_wape().alias("active_wape"),
        bias_pct().alias("bias"),
        service_level().alias("slp"),
        demand_f1().alias("demand_f1"),
        pinball(0.5).alias("pinball_50"),
        mae().alias("mae"),
        rmse().alias("rmse"),
    ]


def metric_suite(
    df: DataFrame, groups: list[str], extra: list[Column] | None = None
) -> DataFrame:
    """All order-free metrics per group: one partial and one final aggregate."""
    return clean(df).groupBy(*groups).agg(
        *suite_columns(), F.count("*").alias("n_obs"), *(extra or [])
    )


def per_sku(df: DataFrame, keys: list[str] = SKU) -> DataFrame:
    return clean(df).groupBy(*keys).agg(
        *suite_columns(),
        F.count("*").alias("n_obs"),
        F.sum(_a()).alias("actual_sum"),
        F.sum(_f()).alias("forecast_sum"),
    )


def diff_scale(
    df: DataFrame, groups: list[str], series: list[str] = SKU, order: str = WEEK
) -> DataFrame:
    """Mean absolute step of the concatenated actuals of each group.

    Series follow each other in order of the MD5 of their key, a fixed total
    order. Steps inside a series and steps between neighbours are added
    separately; neighbours are found inside 4096 even hash groups and over the
    group edges, so no task walks over all series. With a single value the
    scale is its absolute value plus a small constant.
    """
    w = Window.partitionBy(*groups, *series).orderBy(order)
    rows = df.withColumn("_step", F.abs(_a() - F.lag(_a()).over(w)))
    per_series = rows.groupBy(*groups, *series).agg(
        F.sum("_step").alias("_in"),
        F.count("*").alias("_n"),
        F.min_by(_a(), F.col(order)).alias("_first"),
        F.max_by(_a(), F.col(order)).alias("_last"),
    )
    h = F.md5(F.concat_ws("|", *series))
    per_series = per_series.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    inside = Window.partitionBy(*groups, "_b").orderBy("_h", *series)
    per_series = per_series.withColumn(
        "_gap", F.abs(F.col("_first") - F.lag("_last").over(inside))
    )
    per_bucket = per_series.groupBy(*groups, "_b").agg(
        (F.coalesce(F.sum("_in"), F.lit(0.0)) + F.coalesce(F.sum("_gap"), F.lit(0.0))).alias("_in"),
        F.sum("_n").alias("_n"),
        F.min_by("_first", F.struct("_h", *series)).alias("_first"),
        F.max_by("_last", F.struct("_h", *series)).alias("_last"),
    )
    edges = Window.partitionBy(*groups).orderBy("_b")
    per_bucket = per_bucket.withColumn(
        "_gap", F.abs(F.col("_first") - F.lag("_last").over(edges))
    )
    steps = F.sum("_in") + F.coalesce(F.sum("_gap"), F.lit(0.0))
    return per_bucket.groupBy(*groups).agg(
        F.when(F.sum("_n") > 1, steps / (F.sum("_n") - 1))
        .otherwise(F.max(F.abs("_first")) + EPS)
        .alias("scale")
    )


def with_mase(metrics: DataFrame, scale: DataFrame, groups: list[str]) -> DataFrame:
    """``mase`` = MAE over the scale of its group (a row per group on each side)."""
    return metrics.join(scale, groups).withColumn("mase", F.col("mae") / (F.col("scale") + EPS))


def seasonal_scale(train: DataFrame, keys: list[str], value: str, season: int = 52) -> DataFrame:
    """Per dense series: mean absolute difference to the value a season earlier."""
    w = Window.partitionBy(*keys).orderBy(WEEK)
    return (
        train.withColumn("_d", F.abs(F.col(value) - F.lag(value, season).over(w)))
        .groupBy(*keys)
        .agg(F.avg("_d").alias("scale"))
    )


def mase_seasonal(rows: DataFrame, train: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per series MASE against the seasonal naive error of its own history."""
    err = rows.groupBy(*keys).agg(mae().alias("mae"))
    return err.join(seasonal_scale(train, keys, value), keys).select(
        *keys, "mae", "scale", (F.col("mae") / (F.col("scale") + EPS)).alias("mase_seasonal")
    )


def active_errors(df: DataFrame, groups: list[str], series: list[str] = SKU) -> DataFrame:
    """MAE, RMSE, MAPE, bias over sold weeks per series, then averaged."""
    err = _a() - _f()
    on = _a() > 0

    def mean(x):
        return _or_zero(F.avg(F.when(on, x)))

    per_series = df.groupBy(*groups, *series).agg(
        mean(F.abs(err)).alias("mae"),
        F.sqrt(mean(err * err)).alias("rmse"),
        (mean(F.abs(F.try_divide(err, _a()))) * 100).alias("mape"),
        mean(err).alias("bias"),
    )
    return per_series.groupBy(*groups).agg(
        *[F.avg(c).alias(c) for c in ("mae", "rmse", "mape", "bias")],
        F.count("*").alias("n_series"),
    )


def score_counts(df: DataFrame, score: str, label: str, groups: list[str] | None = None):
    """Positives and negatives per distinct score with running totals, best first."""
    counts = df.groupBy(*(groups or []), F.col(score).alias("score")).agg(
        F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) <= 0).alias("neg")
    )
    return running_totals(counts, "score", ["pos", "neg"], groups, descending=True)


def roc_auc(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve; ties count one half."""
    r = score_counts(df, score, label, groups)
    # positives of this score beat all later negatives and half of the tied ones
    wins = F.col("pos") * (F.col("all_neg") - F.col("cum_neg") + F.col("neg") / 2.0)
    return r.groupBy(*(groups or [])).agg(
        (F.sum(wins) / F.nullif(F.max("all_pos") * F.max("all_neg"), F.lit(0))).alias("auc")
    )


def youden_threshold(
    df: DataFrame, score: str, label: str, low: float = 0.01, high: float = 0.95,
    groups: list[str] | None = None,
) -> DataFrame:
    """Score with the largest TPR − FPR, ties to the highest, clipped."""
    r = score_counts(df, score, label, groups)
    j = F.try_divide("cum_pos", "all_pos") - F.try_divide("cum_neg", "all_neg")
    r = r.withColumn("j", F.round(j, 12))
    best = r.groupBy(*(groups or [])).agg(F.max(F.struct("j", "score")).alias("_m"))
    return best.select(
        *(groups or []),
        F.col("_m.j").alias("youden_j"),
        F.least(F.greatest(F.col("_m.score"), F.lit(low)), F.lit(high)).alias("threshold"),
    )
