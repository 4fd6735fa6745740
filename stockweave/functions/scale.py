"""Building blocks that keep plans flat when one key holds much of the data."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BUCKETS = 256


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for an aggregate of at most ``limit`` rows.

    The aggregate is kept, so the size check is not paid twice. Above the
    limit there is no hint: the join shuffles and adaptive execution splits
    skewed partitions.
    """
    df = df.persist()
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    df.unpersist()
    return df


def join_stats(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of per-group statistics back to the rows of the group.

    Not a window over the group: a group may hold a large share of all rows.
    """
    return df.join(broadcast_if_small(stats), keys, "left")


def with_range_bucket(df: DataFrame, col: str, out: str = "_b", n: int = BUCKETS) -> DataFrame:
    """Order-preserving bucket number with near-even bucket sizes.

    Bounds are approximate quantiles, fetched once (at most ``n`` numbers);
    they only steer the split, results do not depend on them.
    """
    bounds = df.approxQuantile(col, [i / n for i in range(1, n)], 1 / (2 * n))
    bounds = sorted({b for b in bounds if b == b and abs(b) != float("inf")})
    if not bounds:
        return df.withColumn(out, F.lit(0.0))
    splits = [-float("inf"), *bounds, float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol=out).transform(df)


def running_totals(
    df: DataFrame,
    order: str,
    values: list[str],
    groups: list[str] | None = None,
    descending: bool = False,
    n: int = BUCKETS,
) -> DataFrame:
    """Running and overall totals along ``order``, without one global sort.

    ``df`` has one row per group and order value. Adds ``cum_<v>`` (current
    row included) and ``all_<v>``. Rows are summed inside range buckets; the
    few bucket totals give every bucket its start.
    """
    groups = groups or []
    rows = with_range_bucket(df.withColumn("_o", F.col(order).cast("double")), "_o", n=n)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = rows.groupBy(*groups, "_b").agg(*[F.sum(v).alias(v) for v in values])
    per_group = Window.partitionBy(*groups)
    before = per_group.orderBy(direction("_b")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *groups,
        "_b",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_s_{v}") for v in values],
        *[F.sum(v).over(per_group).alias(f"all_{v}") for v in values],
    )
    inside = (
        Window.partitionBy(*groups, "_b")
        .orderBy(direction("_o"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = rows.withColumns({f"_c_{v}": F.sum(v).over(inside) for v in values}).join(
        starts, [*groups, "_b"]
    )
    return out.withColumns(
        {f"cum_{v}": F.col(f"_s_{v}") + F.col(f"_c_{v}") for v in values}
    ).drop("_b", "_o", *[f"_s_{v}" for v in values], *[f"_c_{v}" for v in values])


def exact_percentiles(
    df: DataFrame, value: str, probs: dict[str, float], groups: list[str] | None = None
) -> DataFrame:
    """Linear-interpolation percentiles, one column per entry of ``probs``.

    Rows shrink to (value, count) before anything is ordered, and the ordered
    counts stay spread over range buckets.
    """
    groups = groups or []
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    ranked = running_totals(counts, "_v", ["_n"], groups)
    first, past = F.col("cum__n") - F.col("_n"), F.col("cum__n")

    def at(rank):
        return F.max(F.when((first <= rank) & (rank < past), F.col("_v")))

    aggs = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("all__n") - 1)
        lo, hi = F.floor(h), F.ceil(h)
        aggs += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}"), F.max(h - lo).alias(f"_f_{name}")]
    got = ranked.groupBy(*groups).agg(*aggs) if groups else ranked.agg(*aggs)
    return got.select(
        *groups,
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_f_{name}")
            ).alias(name)
            for name in probs
        ],
    )


def order_statistics(rows: DataFrame, ranks, cells: int = 256, few: int = 20_000) -> dict:
    """Exact order statistics of ``v`` per ``key`` by counting, for a bounded number of keys.

    ``ranks(n)`` gives the wanted ranks, from 1, of a key with ``n`` values;
    the result is {key: {rank: value}}. Every pass counts the values in equal
    cells of the open intervals of all keys and goes on with the cell that
    holds the rank, until its values are equal or at most ``few`` rows are left
    in all, which are fetched: nothing is sorted, and the driver holds ``cells``
    numbers for each open interval. Null and NaN values
    do not count; a key without values is absent.
    """
    spark = rows.sparkSession
    v = F.col("v")
    rows = rows.select("key", v.cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    first = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    out: dict = {r["key"]: {} for r in first}
    wanted = [(r["key"], rank, 0, r["lo"], r["hi"], r["n"]) for r in first for rank in sorted(set(ranks(r["n"])))]
    all_rows = True
    kind = rows.schema["key"].dataType.simpleString()
    while wanted:
        still = []
        for key, rank, below, lo, hi, n in wanted:
            if lo == hi:
                out[key][rank] = lo
            else:
                still.append((key, rank, below, lo, hi, n))
        if not still:
            break
        open_ = {(key, lo, hi): n for key, _, _, lo, hi, n in still}
        left = sum(open_.values())
        if left <= few and all_rows:
            values: dict = {}
            for r in rows.collect():
                values.setdefault(r["key"], []).append(r["v"])
            for key, rank, *_ in still:
                out[key][rank] = sorted(values[key])[rank - 1]
            break
        all_rows = False
        table = spark.createDataFrame(sorted(open_, key=str), f"_key {kind}, _lo double, _hi double")
        inside = (F.col("key") == F.col("_key")) & v.between(F.col("_lo"), F.col("_hi"))
        if left <= few:
            values = {}
            for r in rows.join(F.broadcast(table), inside).select("_key", "_lo", "_hi", "v").collect():
                values.setdefault((r["_key"], r["_lo"], r["_hi"]), []).append(r["v"])
            for key, rank, below, lo, hi, _ in still:
                out[key][rank] = sorted(values[key, lo, hi])[rank - below - 1]
            break
        # scaled before subtracting: the width of an interval of doubles may not fit a double
        share = (v / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        cell = F.least(F.floor(share * cells), F.lit(cells - 1))
        counted = (
            rows.join(F.broadcast(table), inside)
            .groupBy("_key", "_lo", "_hi", cell.alias("cell"))
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()
        )
        held: dict = {}
        for r in sorted(counted, key=lambda r: r["cell"]):
            held.setdefault((r["_key"], r["_lo"], r["_hi"]), []).append((r["n"], r["lo"], r["hi"]))
        wanted = []
        for key, rank, below, lo, hi, _ in still:
            for n, a, b in held[key, lo, hi]:
                if rank <= below + n:
                    wanted.append((key, rank, below, a, b, n))
                    break
                below += n
    return out


def percentiles(df: DataFrame, columns: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Linear-interpolation percentiles of many columns, all columns counted in the same passes."""
    probs = {c: [float(p) for p in ps] for c, ps in columns.items()}
    every = sorted({p for ps in probs.values() for p in ps})

    def ranks(n):
        return [r for p in every for r in (int(p * (n - 1)) + 1, min(int(p * (n - 1)) + 2, n))]

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("v")) for c in probs])).alias("x"))
    long = long.select("x.key", "x.v")
    got = order_statistics(long, ranks)
    counts = {r["key"]: r["n"] for r in long.filter("v is not null and not isnan(v)").groupBy("key").agg(F.count("*").alias("n")).collect()}

    def at(c, p):
        if c not in got:
            return None
        h = p * (counts[c] - 1)
        lo = got[c][int(h) + 1]
        return lo + (got[c][min(int(h) + 2, counts[c])] - lo) * (h - int(h))

    return {c: [at(c, p) for p in ps] for c, ps in probs.items()}


def one_value(df: DataFrame, col: str):
    """A one-row aggregate as a scalar subquery."""
    return df.select(col).scalar()
