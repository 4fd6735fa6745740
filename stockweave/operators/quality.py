"""Validation and data-quality reports, each one aggregate over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.functions import weeks as wk
from stockweave.functions.scale import exact_percentiles, join_stats
from stockweave.functions.scalars import EPS
from stockweave.operators.reshape import union_years, week_columns
from stockweave.schema import CATEGORIES, CATEGORY, CHANNEL, CHANNEL_INV, QTY, SELL_IN, SERIES, WEEK

REQUIRED = [*SERIES, WEEK, QTY, "year", "week_num"]


def _flag(c) -> Column:
    return (F.lit(c) if isinstance(c, bool) else c).cast("int")


def source_schema(df: DataFrame, year: int, ids: list[str] = SERIES) -> DataFrame:
    """Missing id columns, unknown categories, null ids, number of week columns."""
    present = [c for c in ids if c in df.columns]
    missing = [c for c in ids if c not in df.columns]
    unknown = F.lit(None).cast("boolean")
    if CATEGORY in present:
        unknown = ~F.col(CATEGORY).isin(CATEGORIES)
    out = df.agg(
        F.lit(year).alias("year"),
        F.count("*").alias("n_rows"),
        F.lit(len(week_columns(df))).alias("week_columns"),
        F.lit(",".join(missing)).alias("missing_columns"),
        F.count_if(unknown).alias("unknown_category_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present],
    )
    ok = (F.col("missing_columns") == "") & (F.col("unknown_category_rows") == 0)
    return out.withColumn("is_valid", _flag(ok))


def unknown_categories(df: DataFrame) -> DataFrame:
    """The category values that are not expected, with their row counts."""
    return df.filter(~F.col(CATEGORY).isin(CATEGORIES)).groupBy(CATEGORY).agg(F.count("*").alias("n_rows"))


def comma_cells(df: DataFrame, year: int) -> DataFrame:
    """Cells with a thousands separator per week column, over all rows."""
    weeks = week_columns(df)
    counts = df.agg(*[F.count_if(F.contains(F.col(f"`{w}`"), F.lit(","))).alias(w) for w in weeks])
    return counts.unpivot([], weeks, "week_column", "comma_cells").withColumn("year", F.lit(year))


def schema_check(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    ok = not missing and isinstance(df.schema[QTY].dataType, (T.DoubleType, T.FloatType))
    return df.agg(
        F.lit("schema").alias("validator"),
        _flag(ok).alias("passed"),
        F.lit("missing_columns").alias("metric"),
        F.lit(float(len(missing))).alias("value"),
        F.count("*").alias("n_rows"),
    )


def null_shares(df: DataFrame, columns: list[str], threshold: float = 0.05) -> DataFrame:
    counts = df.agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    share = F.try_divide("null_count", "_n")
    return counts.unpivot(["_n"], columns, "column_name", "null_count").select(
        "column_name", "null_count", share.alias("null_share"),
        _flag(F.coalesce(share, F.lit(0.0)) > threshold).alias("violation"),
    )


def temporal(df: DataFrame, years: tuple[int, int]) -> DataFrame:
    bad_year = ~F.col("year").between(*years)
    return df.agg(
        F.count_if(~F.col("week_num").between(1, 53)).alias("invalid_week_rows"),
        F.count_if(bad_year).alias("invalid_year_rows"),
        F.count_if(F.length(F.col(WEEK).cast("string")) != 6).alias("malformed_rows"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
    ).withColumn(
        "passed",
        _flag(
            (F.col("invalid_week_rows") == 0)
            & (F.col("invalid_year_rows") == 0)
            & (F.col("malformed_rows") == 0)
        ),
    )


def leakage(featured: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Repeated or skipped weeks, and stored first lags that a lookup of the week before contradicts."""
    w = Window.partitionBy(*keys).orderBy(WEEK)
    step = F.datediff(wk.monday_of(WEEK), wk.monday_of(F.lag(WEEK).over(w))) / 7
    before = featured.select(*keys, wk.shift_week(WEEK, 1).alias(WEEK), F.col(QTY).alias("_before"))
    joined = featured.withColumn("_step", step).join(before, [*keys, WEEK], "left")
    future = [c for c in featured.columns if "future" in c.lower()]
    return joined.agg(
        F.count_if(F.col("_step") <= 0).alias("order_violations"),
        F.count_if(F.col("_step") > 1).alias("week_gaps"),
        F.count_if(~F.col("lag_1").eqNullSafe(F.col("_before"))).alias("lag_mismatches"),
        F.lit(len(future)).alias("future_columns"),
    )


def duplicates(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    per_key = df.groupBy(*keys, WEEK).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.sum("n").alias("total_rows"),
        F.count("*").alias("unique_key_rows"),
        (F.sum("n") - F.count("*")).alias("duplicate_rows"),
    )


def ranges(df: DataFrame, extreme: float = 1_000_000) -> DataFrame:
    """Negative and extreme rows, and count, mean, deviation, quartiles, limits."""
    base = df.agg(
        F.count_if(F.col(QTY) < 0).alias("negative_rows"),
        F.count_if(F.col(QTY) > extreme).alias("extreme_rows"),
        F.count(QTY).alias("n"),
        F.avg(QTY).alias("mean"),
        F.stddev_samp(QTY).alias("std"),
        F.min(QTY).alias("min"),
        F.max(QTY).alias("max"),
    )
    p = exact_percentiles(df, QTY, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return base.withColumns({c: p.select(c).scalar() for c in ("p25", "p50", "p75")})


def inventory_consistency(df: DataFrame, limit: float = 0.01) -> DataFrame:
    inv = F.col(CATEGORY) == CHANNEL_INV
    out = df.agg(
        F.count_if(inv).alias("inventory_rows"),
        F.count_if(inv & (F.col(QTY) < 0)).alias("negative_rows"),
        F.countDistinct(CATEGORY).alias("n_categories"),
    )
    share = F.coalesce(F.try_divide("negative_rows", "inventory_rows"), F.lit(0.0))
    return out.withColumns({"negative_share": share, "passed": _flag(share < limit)})


def run_all(df: DataFrame, years: tuple[int, int], keys: list[str] = SERIES) -> DataFrame:
    """Every check as one row ``(validator, passed, metric, value)``.

    One pass: rows shrink to one per key and week (needed for duplicates), all
    other counts are carried along and added up.
    """
    inv = F.col(CATEGORY) == CHANNEL_INV
    bad_week = ~F.col("week_num").between(1, 53) | (F.length(F.col(WEEK).cast("string")) != 6)
    checked = [*keys, WEEK, QTY]
    per_key = df.groupBy(*keys, WEEK).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null{i}") for i, c in enumerate(checked)],
        F.count_if(bad_week).alias("_week"),
        F.count_if(~F.col("year").between(*years)).alias("_year"),
        F.count_if(F.col(QTY) < 0).alias("_neg"),
        F.count_if(inv).alias("_inv"),
        F.count_if(inv & (F.col(QTY) < 0)).alias("_ninv"),
    )
    total = F.sum("n")
    shares = [F.coalesce(F.try_divide(F.sum(f"_null{i}"), total), F.lit(0.0)) for i in range(len(checked))]
    got = per_key.agg(
        total.alias("n"),
        sum(((s > 0.05).cast("int") for s in shares), F.lit(0)).alias("violations"),
        F.sum("_week").alias("bad_week"),
        F.sum("_year").alias("bad_year"),
        (total - F.count("*")).alias("dup"),
        F.sum("_neg").alias("neg"),
        F.coalesce(F.try_divide(F.sum("_ninv"), F.sum("_inv")), F.lit(0.0)).alias("inv_share"),
    )
    schema_ok = not [c for c in REQUIRED if c not in df.columns] and isinstance(
        df.schema[QTY].dataType, (T.DoubleType, T.FloatType)
    )
    missing = float(len([c for c in REQUIRED if c not in df.columns]))

    def row(name, ok, metric, value):
        return F.struct(
            F.lit(name).alias("validator"), _flag(ok).alias("passed"), F.lit(metric).alias("metric"),
            value.cast("double").alias("value"),
        )

    c = F.col
    rows = F.array(
        row("schema", schema_ok, "missing_columns", F.lit(missing)),
        row("null", c("violations") == 0, "violations", c("violations")),
        row("temporal", (c("bad_week") == 0) & (c("bad_year") == 0), "invalid_year_rows", c("bad_year")),
        row("duplicate", c("dup") == 0, "duplicate_rows", c("dup")),
        row("range", c("neg") == 0, "negative_rows", c("neg")),
        row("inventory_consistency", c("inv_share") < 0.01, "negative_share", c("inv_share")),
    )
    return got.select(F.inline(rows))


def summarise(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count("*").alias("validators_run"),
        F.count_if(F.col("passed") == 1).alias("validators_passed"),
        F.min("passed").alias("overall_passed"),
    )


def quality_score(df: DataFrame) -> DataFrame:
    out = df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col(QTY).isNull()).alias("null_rows"),
        F.count_if(F.col(QTY) < 0).alias("negative_rows"),
        F.count_if(F.col(QTY) == 0).alias("zero_rows"),
    )

    def share(c):
        return F.coalesce(F.try_divide(c, "total_rows"), F.lit(0.0))

    penalty = (
        share("null_rows") * 5
        + share("negative_rows") * 5
        + F.greatest(F.lit(0.0), (share("zero_rows") - 0.6) * 0.5)
    )
    return out.withColumns(
        {
            "null_share": share("null_rows"),
            "zero_share": share("zero_rows"),
            "quality_score": F.greatest(F.lit(0.0), 1.0 - penalty),
        }
    )


def truncation(df: DataFrame, year: int) -> DataFrame:
    """Trailing all-zero weeks of a year, one row per week with its state."""
    weekly = df.filter(F.col("year") == year).groupBy("week_num").agg(F.sum(QTY).alias("total"))
    one_year = Window.partitionBy(F.lit(year))  # at most 53 rows
    last = F.max(F.when(F.col("total") > 0, F.col("week_num"))).over(one_year)
    return weekly.select("week_num", "total", last.alias("last_nonzero_week")).withColumn(
        "in_zero_tail", _flag(F.col("week_num") > F.coalesce("last_nonzero_week", F.lit(0)))
    )


def with_zscore(df: DataFrame, groups: list[str] = [CHANNEL, CATEGORY]) -> DataFrame:  # noqa: B006
    sold = df.filter(F.col(QTY) > 0)
    stats = sold.groupBy(*groups).agg(F.avg(QTY).alias("mu"), F.stddev_samp(QTY).alias("sigma"))
    z = (F.col(QTY) - F.col("mu")) / (F.col("sigma") + EPS)
    return join_stats(sold, stats, groups).withColumn("z", z)


def outliers(df: DataFrame, threshold: float = 4.0) -> DataFrame:
    return with_zscore(df).filter(F.abs("z") > threshold)


def outlier_summary(df: DataFrame, threshold: float = 4.0) -> DataFrame:
    out = with_zscore(df).agg(
        F.count_if(F.abs("z") > threshold).alias("anomaly_count"), F.count("*").alias("nonzero_rows")
    )
    return out.withColumn(
        "anomaly_share", F.coalesce(F.try_divide("anomaly_count", "nonzero_rows"), F.lit(0.0))
    )


def top_outliers(df: DataFrame, threshold: float = 4.0, n: int = 20) -> DataFrame:
    out = outliers(df, threshold).orderBy(F.desc(F.round("z", 6)), *SERIES, WEEK).limit(n)
    return out.select(*SERIES, WEEK, QTY, "z")


def footprint(tables: dict[str, DataFrame]) -> DataFrame:
    return union_years(
        [
            df.agg(
                F.lit(name).alias("table_name"),
                F.count("*").alias("n_rows"),
                F.lit(len(df.columns)).alias("n_columns"),
            )
            for name, df in tables.items()
        ]
    )


def preflight(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(CATEGORY) == SELL_IN).alias("sell_in_rows"),
        F.min(WEEK).alias("first_week"),
        F.max(WEEK).alias("last_week"),
    )


def schema_drift(df: DataFrame, year: int, n_weeks: int | None = None) -> DataFrame:
    """Contract of a wide file: one row per check with its severity.

    ``n_weeks``: expected week columns, else the ISO weeks of the year.
    """
    if n_weeks is None:
        n_weeks = wk.week_span(year * 100 + 1, (year + 1) * 100 + 1)
    missing = [c for c in SERIES if c not in df.columns]
    weeks = [c for c in week_columns(df) if c.startswith(str(year))]
    if CATEGORY in df.columns:
        unknown = F.count_if(~F.col(CATEGORY).isin(CATEGORIES))
        absent = sum(
            (F.when(F.count_if(F.col(CATEGORY) == c) == 0, 1).otherwise(0) for c in CATEGORIES), F.lit(0)
        )
    else:
        unknown, absent = F.lit(0), F.lit(len(CATEGORIES))
    seen = df.agg(F.count("*").alias("n_rows"), unknown.alias("unknown"), absent.alias("absent"))

    def check(name, severity, found, drift):
        return F.struct(
            F.lit(name).alias("check_name"),
            F.lit(severity).alias("severity"),
            F.lit(found).cast("bigint").alias("found") if isinstance(found, int) else found.cast("bigint").alias("found"),
            _flag(drift).alias("drift"),
        )

    checks = F.array(
        check("MISSING_COLUMNS", "CRITICAL", len(missing), bool(missing)),
        check("WRONG_WEEK_COUNT", "HIGH", len(weeks), len(weeks) != n_weeks),
        check(
            "CATEGORY_DRIFT", "CRITICAL", F.col("unknown") + F.col("absent"),
            (F.col("unknown") > 0) | (F.col("absent") > 0),
        ),
    )
    return seen.select(F.lit(year).alias("year"), "n_rows", F.inline(checks))


def gates(df: DataFrame, feature_columns: list[str]) -> DataFrame:
    """Release checks on the clean table and on model inputs, with severities."""
    sku = [c for c in SERIES if c != CATEGORY]
    per_sku = df.groupBy(*sku, CATEGORY).agg(F.lit(1).alias("_x")).groupBy(*sku).agg(F.count("*").alias("n"))
    # Same-week measures and derived inventory columns that are allowed.
    forbidden = {"sell_in", "cust_sales", "channel_inv"}
    allowed = {"inv_delta_1", "inv_momentum", "inv_overstock_flag", "inv_stockout_flag"}
    inputs = [c for c in feature_columns if not c.endswith("_target") and "lag_0" not in c]
    leaks = [c for c in inputs if c in forbidden]
    direct = [c for c in inputs if "inv" in c and "lag" not in c and c not in allowed]

    def row(frame, name, severity):
        return frame.select(
            F.lit(name).alias("check_name"),
            F.lit(severity).alias("severity"),
            F.col("n").cast("bigint").alias("findings"),
            _flag(F.col("n") == 0).alias("passed"),
        )

    inv = (F.col(CATEGORY) == CHANNEL_INV) & (F.col(QTY) < 0)
    return union_years(
        [
            row(duplicates(df).select(F.col("duplicate_rows").alias("n")), "no_duplicates", "CRITICAL"),
            row(df.agg(F.count_if(inv).alias("n")), "no_negative_inventory", "CRITICAL"),
            row(per_sku.agg(F.count_if(F.col("n") != 3).alias("n")), "category_balance", "HIGH"),
            row(df.agg(F.lit(len(leaks)).alias("n")), "no_target_leakage", "CRITICAL"),
            row(df.agg(F.lit(len(direct)).alias("n")), "inventory_lagged", "CRITICAL"),
        ]
    )


def gate_score(checks: DataFrame) -> DataFrame:
    failed = F.col("passed") == 0
    cost = F.when(F.col("severity") == "CRITICAL", 20).when(F.col("severity") == "HIGH", 5).otherwise(2)
    return checks.agg(
        F.count("*").alias("n_checks"),
        F.count_if(failed).alias("n_failed"),
        F.greatest(F.lit(0), 100 - F.coalesce(F.sum(F.when(failed, cost)), F.lit(0))).alias("score"),
    )
