"""Wide to long, duplicate sums, gap filling, typed silver rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions import scalars as sc
from stockweave.functions import weeks as wk
from stockweave.schema import (
    CATEGORIES, CATEGORY, CHANNEL_INV, CUST_SALES, MATERIAL, QTY, SELL_IN, SERIES, WEEK,
)

WEEK_COLUMN = re.compile(r"^\d{6}$")


def week_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if WEEK_COLUMN.match(c)]


def melt_weeks(df: DataFrame, ids: list[str] = SERIES, strict: bool = True) -> DataFrame:
    """Wide week columns to rows; text quantities to doubles clipped at 0.

    The clip happens per row, before duplicates are added up.
    """
    long = df.unpivot(ids, week_columns(df), WEEK, QTY)
    return long.select(
        *ids,
        F.col(WEEK).cast("int").alias(WEEK),
        sc.non_negative(sc.number_text(QTY, strict)).alias(QTY),
        F.substring(WEEK, 1, 4).cast("int").alias("year"),
        F.substring(WEEK, 5, 2).cast("int").alias("week_num"),
    )


def union_years(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumn("year", wk.year_of(WEEK)).withColumn("week_num", wk.week_of(WEEK))


def clip_negative(df: DataFrame) -> DataFrame:
    return df.withColumn(QTY, sc.non_negative(QTY))


def sum_duplicates(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """One row per key and week. Rows with a null key are dropped.

    A hot key costs nothing here: each task first adds up its own rows.
    """
    return (
        df.dropna(subset=[*keys, WEEK])
        .groupBy(*keys, WEEK)
        .agg(F.sum(QTY).alias(QTY))
    )


def duplicate_report(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Rows before and after :func:`sum_duplicates`, and rows without a key."""
    no_key = F.lit(False)
    for k in [*keys, WEEK]:
        no_key = no_key | F.col(k).isNull()
    per_key = df.groupBy(*keys, WEEK).agg(F.count("*").alias("n"), F.max(no_key).alias("no_key"))
    return per_key.agg(
        F.sum("n").alias("rows_before"),
        F.count_if(~F.col("no_key")).alias("rows_after"),
        F.coalesce(F.sum(F.when(F.col("no_key"), F.col("n"))), F.lit(0)).alias("null_key_rows"),
    ).withColumn(
        "duplicates_removed", F.col("rows_before") - F.col("null_key_rows") - F.col("rows_after")
    )


def valid_categories(df: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    return df.filter(F.col(CATEGORY).isin(categories))


def with_material_parts(df: DataFrame) -> DataFrame:
    return df.withColumns(sc.material_parts(MATERIAL))


def silver(df: DataFrame) -> DataFrame:
    """Long rows to the clean weekly table."""
    out = sum_duplicates(valid_categories(clip_negative(df)))
    return with_material_parts(with_calendar(out))


def densify(
    df: DataFrame, keys: list[str], first: int, last: int, values: list[str] = [QTY],  # noqa: B006
    cluster: list[str] | None = None,
) -> DataFrame:
    """Every series on every ISO week from ``first`` to ``last``.

    A series with no row in the range is there too, with zeros.

    Each observed row also emits the zero weeks up to the next observed row,
    so nothing is joined and only observed rows are shuffled. Input has one
    row per key and week; at most one series' weeks meet in a window.

    ``cluster`` (a subset of the keys) places the sparse rows once, so that
    later windows over those columns and more find the long dense rows in
    place. A cluster must stay small, such as the categories of one SKU.
    """
    if cluster:
        df = df.repartition(*cluster)
    n = wk.week_span(first, last) + 1
    w = Window.partitionBy(*keys).orderBy("pos")  # rows outside the range come first, as nulls
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        df.select(
            *keys, F.when(F.col(WEEK).between(first, last), wk.week_index(F.col(WEEK), first)).alias("pos"), *values
        )
        .withColumns(
            {"_nth": F.row_number().over(w), "_prev": F.lag("pos").over(w), "_next": F.lead("pos").over(w), "_most": F.max("pos").over(whole)}
        )
        .filter(F.col("pos").isNotNull() | (F.col("_most").isNull() & (F.col("_nth") == 1)))
        .withColumn("_from", F.when(F.col("_prev").isNull(), 0).otherwise(F.col("pos")))
        .withColumn("_to", F.coalesce("_next", F.lit(n)) - 1)
        .select(*keys, "pos", *values, F.explode(F.sequence("_from", "_to")).alias("_at"))
        .select(
            *keys,
            wk.week_at("_at", first, n).alias(WEEK),
            *[F.when(F.col("_at") == F.col("pos"), F.col(v)).otherwise(0.0).alias(v) for v in values],
        )
    )


def pivot_categories(df: DataFrame) -> DataFrame:
    """One row per SKU and week with a column per measure."""

    def total(category):
        return F.coalesce(F.sum(F.when(F.col(CATEGORY) == category, F.col(QTY))), F.lit(0.0))

    keys = [c for c in SERIES if c != CATEGORY]
    return df.groupBy(*keys, WEEK).agg(
        total(SELL_IN).alias("sell_in"),
        total(CUST_SALES).alias("cust_sales"),
        total(CHANNEL_INV).alias("channel_inv"),
    )


def sorted_rows(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return df.orderBy(*keys, WEEK)


def head_rows(df: DataFrame, n: int, keys: list[str] = SERIES) -> DataFrame:
    """The first series in key order, whole, until they hold at least ``n`` rows.

    A series has at least one row, so the first ``n`` series are enough; their
    counts are all that is ordered.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).orderBy(*keys).limit(n)
    before = F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    chosen = counts.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < n).select(*keys)
    return df.join(F.broadcast(chosen), keys, "left_semi")


def sell_in_extract(df: DataFrame, category: str) -> DataFrame:
    """One category with narrow types, for dashboards."""
    return df.filter(F.col(CATEGORY) == category).select(
        *[c for c in SERIES if c != CATEGORY],
        F.col(WEEK).cast("int").alias(WEEK),
        F.coalesce(F.col(QTY), F.lit(0.0)).cast("float").alias(QTY),
    )
