"""Forecast hierarchy: sums, coherence, top-down split, ordered quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.operators.feature_store import family
from stockweave.schema import CHANNEL, MATERIAL, QTY, SKU, WEEK

LEVELS = {7: "total", 3: "family", 1: "family_channel", 0: "sku_channel"}


def hierarchy_sums(df: DataFrame, value: str) -> DataFrame:
    """Total, family, family × channel and SKU × channel sums per week in one rollup."""
    rows = df.withColumn("product_family", family())
    cols = ["product_family", CHANNEL, MATERIAL]
    # the rollup runs inside each week
    got = rows.groupingSets(
        [[F.col(c) for c in [WEEK, *cols[:i]]] for i in range(4)], F.col(WEEK), *[F.col(c) for c in cols]
    ).agg(F.grouping_id().alias("_g"), F.sum(value).alias(value))
    level = F.lit(None).cast("string")
    for g, name in LEVELS.items():
        level = F.when(F.col("_g") == g, name).otherwise(level)
    return got.select(level.alias("level"), WEEK, *cols, value)


def coherence(levels: DataFrame, value: str, tolerance: float = 0.01) -> DataFrame:
    """Per week: do the lowest level's sums equal the total?"""

    def at(name):
        return F.coalesce(F.sum(F.when(F.col("level") == name, F.col(value))), F.lit(0.0))

    got = levels.groupBy(WEEK).agg(at("sku_channel").alias("bottom"), at("total").alias("top"))
    res = F.abs(F.col("bottom") - F.col("top"))
    return got.withColumns(
        {
            "residual": res,
            "is_consistent": (res <= tolerance).cast("int"),
            "pct_error": res / F.greatest(F.col("top"), F.lit(0.001)) * 100,
        }
    )


def proportions(df: DataFrame, last: int, window: int = 26) -> DataFrame:
    """Share of each SKU in its family × channel over the last weeks, summing to 1.

    Sparse input: weeks without a row count as share 0.
    """
    first = wk.week_add(last, 1 - window)
    rows = df.filter(F.col(WEEK) <= last).withColumn("product_family", family())
    groups = ["product_family", CHANNEL]
    recent = rows.filter(F.col(WEEK) >= first)
    totals = recent.groupBy(*groups, WEEK).agg(F.sum(QTY).alias("_t"))
    share = F.col(QTY) / F.greatest(F.col("_t"), F.lit(0.001))
    got = recent.join(totals, [*groups, WEEK]).groupBy(*SKU, "product_family").agg(F.sum(share).alias("_s"))
    every = rows.select(*SKU, "product_family").distinct()
    hist = every.join(got, [*SKU, "product_family"], "left").select(
        *SKU, "product_family", (F.coalesce("_s", F.lit(0.0)) / window).alias("historical_proportion")
    )
    norm = hist.groupBy(*groups).agg(F.sum("historical_proportion").alias("_n"))
    return hist.join(norm, groups).select(
        *SKU, "product_family", "historical_proportion",
        (F.col("historical_proportion") / F.greatest(F.col("_n"), F.lit(0.001))).alias("normalized_proportion"),
    )


def disaggregate(upper: DataFrame, shares: DataFrame, values: list[str]) -> DataFrame:
    """Split family × channel forecasts over SKUs by their shares."""
    out = shares.join(upper, ["product_family", CHANNEL], "left")
    return out.withColumns({v: F.col(v) * F.col("normalized_proportion") for v in values})


def quantile_violations(df: DataFrame, quantiles: list[str]) -> DataFrame:
    """Rows in which a higher quantile lies below a lower one, per neighbouring pair."""
    pairs = list(zip(quantiles, quantiles[1:]))
    got = df.agg(*[F.count_if(F.col(b) < F.col(a)).alias(f"{a}>{b}") for a, b in pairs])
    return got.unpivot([], [f"{a}>{b}" for a, b in pairs], "pair", "violations")


def ordered_quantiles(df: DataFrame, quantiles: list[str]) -> DataFrame:
    """Raise each quantile to the largest one below it."""
    out = {}
    for i, q in enumerate(quantiles):
        out[q] = F.greatest(*[F.col(c) for c in quantiles[: i + 1]]) if i else F.col(q)
    return df.withColumns(out)
