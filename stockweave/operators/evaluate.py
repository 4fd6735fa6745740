"""Walk-forward validation and model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.operators import baselines as bl
from stockweave.operators import metrics as mt
from stockweave.schema import QTY, SKU, WEEK

MIN_TRAIN_WEEKS = 26


def check_folds(folds) -> None:
    """Validation must start after training ends, in every fold."""
    for fold, train_end, val_start, val_end in folds:
        if not train_end < val_start <= val_end:
            raise ValueError(f"fold {fold} leaks: train ends {train_end}, validation {val_start}")


def fold_table(spark, folds) -> DataFrame:
    schema = "fold int, train_end int, val_start int, val_end int"
    return spark.createDataFrame([tuple(f) for f in folds], schema)


def fold_structs(folds, first: int | None = None) -> Column:
    """The fold list as an array literal; a handful of entries."""
    items = []
    for fold, train_end, val_start, val_end in folds:
        fields = [
            F.lit(fold).alias("fold"),
            F.lit(train_end).alias("train_end"),
            F.lit(val_start).alias("val_start"),
            F.lit(val_end).alias("val_end"),
        ]
        if first is not None:
            fields += [
                F.lit(wk.week_span(first, train_end) + 1).alias("n"),
                F.lit(wk.week_span(first, val_start)).alias("v0"),
                F.lit(wk.week_span(first, val_end)).alias("v1"),
            ]
        items.append(F.struct(*fields))
    return F.array(*items)


def assign_folds(df: DataFrame, folds) -> DataFrame:
    """One copy of a row per fold that uses it, marked train or val.

    The fold list is unrolled inside the row, so no join and no shuffle.
    """
    check_folds(folds)
    f = F.col("_f")
    week = F.col(WEEK)
    role = F.when(week <= f["train_end"], "train").when(
        week.between(f["val_start"], f["val_end"]), "val"
    )
    return (
        df.withColumn("_f", F.explode(fold_structs(folds)))
        .withColumns({"fold": f["fold"], "role": role})
        .filter(F.col("role").isNotNull())
        .drop("_f")
    )


def leakage_guard(df: DataFrame, folds) -> DataFrame:
    """Per fold the last training week, the first validation week and the verdict."""
    return (
        assign_folds(df, folds)
        .groupBy("fold")
        .agg(
            F.max(F.when(F.col("role") == "train", F.col(WEEK))).alias("last_train_week"),
            F.min(F.when(F.col("role") == "val", F.col(WEEK))).alias("first_val_week"),
        )
        .withColumn("ok", (F.col("last_train_week") < F.col("first_val_week")).cast("int"))
    )


def common_skus(df: DataFrame, folds, keys: list[str] = SKU) -> DataFrame:
    """SKUs with rows in both parts of a fold."""
    rows = assign_folds(df, folds)
    return rows.groupBy("fold", *keys).agg(
        F.max((F.col("role") == "train").cast("int")).alias("_t"),
        F.max((F.col("role") == "val").cast("int")).alias("_v"),
    ).filter((F.col("_t") == 1) & (F.col("_v") == 1)).select("fold", *keys)


def fold_rows(
    df: DataFrame, first: int, folds, models: list[str], keys: list[str] = SKU
) -> DataFrame:
    """Forecasts and actuals of every fold, series and validation week.

    Sparse input is placed by series once; the copies per fold are made after
    that shuffle and stay in place. Validation actuals ride along as a map
    of at most the horizon.
    """
    check_folds(folds)
    f = F.col("_f")
    pos = wk.week_index(F.col(WEEK), first)
    rows = (
        df.filter(F.col(WEEK) >= first)
        .select(*keys, pos.alias("pos"), QTY)
        .repartition(*keys)
        .withColumn("_f", F.explode(fold_structs(folds, first)))
        .filter(f["n"] >= MIN_TRAIN_WEEKS)
        .select(
            *keys, f["fold"].alias("fold"), "pos", QTY, f["n"].alias("n"),
            (F.col("pos") - f["v0"]).alias("val_step"), (f["v1"] - f["v0"] + 1).alias("val_weeks"),
        )
    )
    step = F.col("val_step")
    state = bl.series_state(
        rows, ["fold", *keys],
        held_out=F.when((step >= 0) & (step < F.col("val_weeks")), step),
        carry=["val_weeks"],
    )
    actual = F.coalesce(F.try_element_at("held_out", F.col("_h")), F.lit(0.0))
    cols = bl.forecast_columns(F.col("_h"))
    return (
        state.withColumn("_h", F.explode(F.sequence(F.lit(0), F.col("val_weeks") - 1)))
        .select(
            "fold", *keys, (F.col("_h") + 1).alias("step"), actual.alias("actual"),
            *[F.greatest(cols[m], F.lit(0.0)).alias(m) for m in models],
        )
    )


def walk_forward(
    df: DataFrame, first: int, folds, models: list[str] = bl.SUITE, keys: list[str] = SKU
) -> DataFrame:
    """Metrics per fold and model over all series, in one job."""
    wide = fold_rows(df, first, folds, models, keys)
    rows = wide.unpivot(["fold", *keys, "step", "actual"], models, "model", "forecast")
    n_skus = F.count_if(F.col("step") == 1).alias("n_skus")
    per_model = mt.metric_suite(rows, ["fold", "model"], [n_skus])
    scale = mt.diff_scale(wide, ["fold"], keys, "step")
    ends = F.element_at(
        F.create_map(*[F.lit(x) for f in folds for x in (f[0], f[1])]), F.col("fold")
    )
    starts = F.element_at(
        F.create_map(*[F.lit(x) for f in folds for x in (f[0], f[2])]), F.col("fold")
    )
    out = mt.with_mase(per_model, scale, ["fold"])
    return out.select(
        "fold", "model", ends.alias("train_end"), starts.alias("val_start"), "n_skus",
        *mt.SUITE, "mase",
    )


def benchmark(cv: DataFrame, rank_metric: str = "smape") -> DataFrame:
    """Mean per model over folds, ranked; rank 1 wins. One row per model."""
    cols = ["smape", "wape", "mase", "bias", "slp", "mae", "rmse"]
    mean = cv.groupBy("model").agg(*[F.avg(c).alias(c) for c in cols])
    w = Window.orderBy(rank_metric, "model")
    return mean.withColumn("model_rank", F.row_number().over(w)).withColumn(
        "is_best", (F.col("model_rank") == 1).cast("int")
    )


def fold_aggregate(cv: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, population deviation, min and max over folds per model and metric."""
    tall = cv.unpivot(["fold", "model"], columns, "metric", "value")
    return tall.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def improvement(cv_mean: DataFrame, reference_model: str, columns: list[str]) -> DataFrame:
    """``(old − new) / old · 100`` of every model against one model."""
    tall = cv_mean.unpivot(["model"], columns, "metric", "value")
    old = tall.filter(F.col("model") == reference_model).select(
        "metric", F.col("value").alias("reference_value")
    )
    return tall.join(old, "metric").select(
        "model", "metric", "value", "reference_value",
        (F.try_divide(F.col("reference_value") - F.col("value"), "reference_value") * 100).alias(
            "improvement_pct"
        ),
    )


def holdout(df: DataFrame, first: int, last: int, horizon: int = 13, keys: list[str] = SKU):
    """Last ``horizon`` weeks against seasonal naive and rolling average, all series."""
    train_end = wk.week_add(last, -horizon)
    fold = [(0, train_end, wk.week_add(train_end, 1), last)]
    models = ["seasonal_naive", "rolling_average"]
    rows = fold_rows(df, first, fold, models, keys).unpivot(
        [*keys, "step", "actual"], models, "model", "forecast"
    )
    return mt.active_errors(rows, ["model"], keys)
