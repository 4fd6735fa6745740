"""Queries over run records kept as tall tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_id(experiment, name, params) -> Column:
    """First 16 hex digits of SHA-256 over ``experiment:name:params``."""
    return F.substring(F.sha2(F.concat_ws(":", experiment, name, params), 256), 1, 16)


def metric_rows(df: DataFrame, run_keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide result rows to ``run keys, key, value``."""
    return df.unpivot(run_keys, metrics, "key", "value")


def runs_with_metrics(
    runs: DataFrame, metrics: DataFrame, experiment: str, keys: list[str]
) -> DataFrame:
    """Runs of one experiment, newest first, a column per metric."""
    wide = metrics.groupBy("run_id").agg(
        *[F.first(F.when(F.col("key") == k, F.col("value")), ignorenulls=True).alias(k) for k in keys]
    )
    mine = runs.filter(F.col("experiment") == experiment)
    return mine.join(wide, "run_id", "left").orderBy(F.desc("start_time"), "run_id")


def best_run(
    runs: DataFrame, metrics: DataFrame, experiment: str, metric: str, mode: str = "min"
) -> DataFrame:
    """The run with the lowest or highest value; ties to the smaller id."""
    if mode not in ("min", "max"):
        raise ValueError("mode must be min or max")
    rows = runs.filter(F.col("experiment") == experiment).join(
        metrics.filter(F.col("key") == metric), "run_id"
    )
    value = F.col("value") if mode == "min" else -F.col("value")
    return rows.orderBy(value, "run_id").limit(1)
