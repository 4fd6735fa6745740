"""Aggregates behind the planning dashboard and the exploratory notebook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.functions.scalars import correlation
from stockweave.functions.scale import exact_percentiles
from stockweave.schema import CATEGORY, CHANNEL, CHANNEL_INV, MATERIAL, QTY, SELL_IN, SKU, WEEK


def weekly_totals(df: DataFrame) -> DataFrame:
    return df.groupBy(WEEK).agg(F.sum(QTY).alias(QTY))


def annual_totals(df: DataFrame) -> DataFrame:
    """Yearly totals with change against the year before (one row per year)."""
    annual = df.groupBy(wk.year_of(WEEK).alias("year")).agg(F.sum(QTY).alias(QTY))
    before = F.lag(QTY).over(Window.orderBy("year"))
    return annual.withColumn("yoy_pct", F.try_divide(F.col(QTY) - before, before) * 100)


def year_week_matrix(df: DataFrame) -> DataFrame:
    return df.groupBy(wk.year_of(WEEK).alias("year"), wk.week_of(WEEK).alias("week")).agg(
        F.sum(QTY).alias(QTY)
    )


def seasonal_profile(df: DataFrame, q: float = 0.85) -> DataFrame:
    """Mean per week of year, marked from the given percentile of the means on."""
    mean = df.groupBy(wk.week_of(WEEK).alias("week")).agg(F.avg(QTY).alias("mean_quantity"))
    # the window holds one row per week of year
    cut = F.percentile("mean_quantity", F.lit(q)).over(Window.partitionBy(F.lit(1)))
    return mean.withColumn("is_peak", (F.round("mean_quantity", 9) >= F.round(cut, 9)).cast("int"))


def top_n(df: DataFrame, key: str | Column, n: int, name: str = "name", value: str = QTY) -> DataFrame:
    col = F.col(key) if isinstance(key, str) else key
    return (
        df.groupBy(col.alias(name)).agg(F.sum(value).alias(value)).orderBy(F.desc(value), name).limit(n)
    )


def product_family(c: str = MATERIAL) -> Column:
    return F.trim(F.get(F.split(c, ","), F.lit(0)))


def category_totals(df: DataFrame) -> DataFrame:
    return df.groupBy(CATEGORY).agg(F.sum(QTY).alias(QTY))


def inventory_coverage(df: DataFrame) -> DataFrame:
    """Inventory over Sell-in per year."""

    def total(c):
        return F.sum(F.when(F.col(CATEGORY) == c, F.col(QTY)))

    return df.groupBy(wk.year_of(WEEK).alias("year")).agg(
        total(CHANNEL_INV).alias("inventory"),
        total(SELL_IN).alias("sales"),
        F.try_divide(total(CHANNEL_INV), total(SELL_IN)).alias("coverage"),
    )


def active_inventory_share(df: DataFrame) -> DataFrame:
    """SKUs that ever had inventory, of all SKUs with inventory rows."""
    per_sku = (
        df.filter(F.col(CATEGORY) == CHANNEL_INV).groupBy(*SKU).agg(F.max(QTY).alias("m"))
    )
    active = F.count_if(F.col("m") > 0)
    return per_sku.agg(
        active.alias("active_skus"),
        F.count("*").alias("total_skus"),
        F.try_divide(active * 100.0, F.count("*")).alias("active_pct"),
    )


def intermittency(df: DataFrame) -> DataFrame:
    """Share of sold weeks, and median, mean, P90 and maximum of sold quantities."""
    sold = F.col(QTY) > 0
    out = df.agg(
        F.avg(sold.cast("double")).alias("nonzero_rate"),
        F.avg(F.when(sold, F.col(QTY))).alias("mean"),
        F.max(F.when(sold, F.col(QTY))).alias("max"),
    )
    p = exact_percentiles(df.filter(sold), QTY, {"median": 0.5, "p90": 0.9})
    return out.withColumns({c: p.select(c).scalar() for c in ("median", "p90")})


def histogram(df: DataFrame, upper: float = 500.0, bins: int = 60) -> DataFrame:
    """Counts of sold quantities clipped to [0, upper] in equal bins from min to max.

    The last bin is closed on the right; empty bins have no row.
    """
    clipped = df.filter(F.col(QTY) > 0).select(
        F.least(F.greatest(F.col(QTY), F.lit(0.0)), F.lit(upper)).alias("x")
    )
    ends = clipped.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width = (hi - lo) / bins
    b = F.least(F.floor(F.try_divide(F.col("x") - lo, width)), F.lit(bins - 1))
    return clipped.groupBy(F.coalesce(b, F.lit(0)).cast("int").alias("bin")).agg(
        F.count("*").alias("n")
    )


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """SKUs, channels and materials. SKUs shrink to distinct rows first."""
    skus = df.select(*SKU).distinct()
    d = F.approx_count_distinct if approximate else F.countDistinct
    return skus.agg(
        F.count("*").alias("n_skus"), d(CHANNEL).alias("n_channels"), d(MATERIAL).alias("n_materials")
    )


def recent_trend(df: DataFrame, last_week: int, weeks: int = 4) -> DataFrame:
    """The last weeks against the same weeks a year earlier."""
    start = wk.week_add(last_week, 1 - weeks)
    y1, y0 = wk.week_add(last_week, -52), wk.week_add(last_week, -51 - weeks)

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col(QTY))), F.lit(0.0))

    w = F.col(WEEK)
    out = df.filter(w >= y0).agg(
        total(w >= start).alias("recent"), total(w.between(y0, y1)).alias("year_ago")
    )
    change = F.try_divide(F.col("recent") - F.col("year_ago"), "year_ago") * 100
    return out.withColumn("trend_pct", F.coalesce(change, F.lit(0.0)))


def projected_demand(fc: DataFrame, value: str = "forecast_q50") -> DataFrame:
    weekly = fc.groupBy(WEEK).agg(F.sum(value).alias("v"))
    return weekly.agg(F.sum("v").alias("total"), F.avg("v").alias("weekly_mean"))


def history_and_forecast(
    df: DataFrame, fc: DataFrame, last_week: int, weeks_back: int = 26, value: str = "forecast_q50"
) -> DataFrame:
    """Chart rows: weekly history, then weekly forecast, numbered through.

    History stops at the last week with sales.
    """
    hist = df.filter(F.col(WEEK).between(wk.week_add(last_week, -weeks_back), last_week))
    rows = weekly_totals(hist).select(
        F.lit("Histórico").alias("kind"), WEEK, F.col(QTY).alias("value")
    ).unionByName(
        fc.groupBy(WEEK).agg(F.sum(value).alias("value")).select(
            F.lit("Proyección").alias("kind"), WEEK, "value"
        )
    )
    w = Window.orderBy("kind", WEEK)  # one row per calendar week
    return rows.select(
        "kind", WEEK, "value", (F.row_number().over(w) - 1).alias("idx"), wk.format_week(WEEK).alias("label")
    )


def half_year_growth(
    fc: DataFrame, year: int, value: str = "forecast_q50", key: str = MATERIAL
) -> DataFrame:
    """``(H2 − H1) / (H1 + 1) · 100`` per product with demand in the first half."""
    rows = fc.filter(wk.year_of(WEEK) == year)
    first = wk.week_of(WEEK) <= 26
    out = rows.groupBy(key).agg(
        F.coalesce(F.sum(F.when(first, F.col(value))), F.lit(0.0)).alias("h1"),
        F.coalesce(F.sum(F.when(~first, F.col(value))), F.lit(0.0)).alias("h2"),
    )
    growth = (F.col("h2") - F.col("h1")) / (F.col("h1") + 1) * 100
    return out.withColumn("growth_pct", growth).filter(F.col("h1") > 0)


def growth_extremes(growth: DataFrame, up: int = 8, down: int = 5, key: str = MATERIAL) -> DataFrame:
    g = F.round("growth_pct", 6)
    top = growth.orderBy(F.desc(g), key).limit(up).withColumn("side", F.lit("up"))
    low = growth.orderBy(g, key).limit(down).withColumn("side", F.lit("down"))
    return top.unionByName(low)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise correlations of complete rows: one aggregate, one row per pair."""
    rows = df.dropna(subset=columns)
    pairs = [(a, b) for a in columns for b in columns]
    upper = {(a, b): f"_{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j}
    got = rows.agg(*[correlation(a, b).alias(n) for (a, b), n in upper.items()])

    def cell(a, b):
        c = F.lit(1.0) if a == b else F.col(upper.get((a, b)) or upper[(b, a)])
        return F.struct(F.lit(a).alias("row_var"), F.lit(b).alias("col_var"), c.alias("r"))

    return got.select(F.inline(F.array(*[cell(a, b) for a, b in pairs])))


def correlation_ranking(matrix: DataFrame, target: str) -> DataFrame:
    """Variables by absolute correlation with the target (one row per variable)."""
    rows = matrix.filter((F.col("row_var") == target) & (F.col("col_var") != target))
    w = Window.orderBy(F.desc(F.round(F.abs("r"), 9)), "col_var")
    return rows.select(
        F.col("col_var").alias("variable"), "r", F.row_number().over(w).alias("position")
    )


def clipped_trends(df: DataFrame, pairs: list[tuple[str, str]], q: float = 0.95) -> DataFrame:
    """Slope, intercept and r per pair after clipping both sides at a percentile."""
    columns = sorted({c for p in pairs for c in p})
    rows = df.dropna(subset=columns)
    caps = {c: exact_percentiles(rows, c, {"p": q}).scalar() for c in columns}
    clipped = rows.select(
        *[F.least(F.greatest(F.col(c), F.lit(0.0)), caps[c]).alias(c) for c in columns]
    )
    aggs = []
    for i, (x, y) in enumerate(pairs):
        aggs += [
            F.regr_slope(y, x).alias(f"s{i}"),
            F.regr_intercept(y, x).alias(f"i{i}"),
            correlation(y, x).alias(f"r{i}"),
        ]
    cells = [
        F.struct(
            F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"s{i}").alias("slope"),
            F.col(f"i{i}").alias("intercept"), F.col(f"r{i}").alias("r"),
        )
        for i, (x, y) in enumerate(pairs)
    ]
    return clipped.agg(*aggs).select(F.inline(F.array(*cells)))


def sales_against_inventory(df: DataFrame) -> DataFrame:
    """Channel weeks with both Sell-in and inventory."""

    def weekly(category, name):
        return (
            df.filter(F.col(CATEGORY) == category).groupBy(CHANNEL, WEEK).agg(F.sum(QTY).alias(name))
        )

    both = weekly(SELL_IN, "sales").join(weekly(CHANNEL_INV, "inventory"), [CHANNEL, WEEK])
    return both.filter((F.col("sales") > 0) & (F.col("inventory") > 0))


def channel_means(pairs: DataFrame, n: int = 10) -> DataFrame:
    return (
        pairs.groupBy(CHANNEL)
        .agg(F.avg("sales").alias("mean_sales"), F.avg("inventory").alias("mean_inventory"))
        .orderBy(F.desc(F.round("mean_sales", 9)), CHANNEL)
        .limit(n)
    )
