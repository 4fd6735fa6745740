"""Forecast accuracy over time, drift, alerts, promotion, audit queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.scale import exact_percentiles
from stockweave.operators import metrics as mt
from stockweave.operators.reshape import union_years
from stockweave.schema import SKU, WEEK


def forecast_vs_actual(fc: DataFrame, actual: DataFrame, keys: list[str] = SKU) -> DataFrame:
    """Joined rows with the symmetric error of each row (null when both are 0)."""
    out = fc.join(actual, [*keys, WEEK])
    half = (F.abs("forecast") + F.abs("actual")) / 2
    return out.withColumn("row_smape", F.try_divide(F.abs(F.col("forecast") - F.col("actual")), half) * 100)


def hit_rate(threshold: float = 0.25) -> Column:
    """Share of sold weeks forecast within the threshold, in percent."""
    a, f = F.col("actual"), F.col("forecast")
    hit = (F.try_divide(F.abs(a - f), a) <= threshold).cast("double")
    return F.coalesce(F.avg(F.when(a > 0, hit)), F.lit(0.0)) * 100


def accuracy_log(rows: DataFrame) -> DataFrame:
    """Weekly accuracy in total, per segment and per family: one grouping-sets aggregate."""
    got = rows.groupingSets(
        [[F.col(WEEK)], [F.col(WEEK), F.col("segment")], [F.col(WEEK), F.col("product_family")]],
        F.col(WEEK), F.col("segment"), F.col("product_family"),
    ).agg(
        F.grouping_id().alias("_g"),
        mt.smape().alias("smape"),
        mt.bias_pct().alias("bias_pct"),
        hit_rate().alias("hit_rate_25pct"),
        F.count("*").alias("n_series"),
    )
    scope = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "segment").otherwise("family")
    member = F.when(F.col("_g") == 3, "all").otherwise(F.coalesce("segment", "product_family"))
    return got.select(
        WEEK, scope.alias("scope"), member.alias("member"), "smape", "bias_pct", "hit_rate_25pct", "n_series"
    )


def stability_index(
    df: DataFrame, features: list[str], reference: Column, current: Column, bins: int = 10, eps: float = 1e-6
) -> DataFrame:
    """PSI per feature between two sets of rows, with mean and median shift.

    Bins are equal between the reference's 1st and 99th percentile, values
    outside are left out, the last bin is closed on the right.
    """
    side = F.when(reference, "ref").when(current, "cur")
    tall = (
        df.withColumn("side", side)
        .filter(F.col("side").isNotNull())
        .select("side", *[F.col(c).cast("double").alias(c) for c in features])
        .unpivot(["side"], features, "feature", "x")
        .filter(F.col("x").isNotNull())
    )
    ends = exact_percentiles(
        tall.filter(F.col("side") == "ref"), "x", {"lo": 0.01, "hi": 0.99}, ["feature"]
    )
    # one row per feature
    rows = tall.join(F.broadcast(ends), "feature")
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(bins - 1))
    inside = F.col("x").between(F.col("lo"), F.col("hi"))
    counts = rows.filter(inside).groupBy("feature", F.coalesce(b, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c")
    )
    per_feature = counts.groupBy("feature").agg(
        F.sum("r").alias("R"), F.sum("c").alias("C"), F.collect_list(F.struct("bin", "r", "c")).alias("h")
    )
    bin_of = F.map_from_entries(F.transform("h", lambda x: F.struct(x["bin"], F.struct(x["r"].alias("r"), x["c"].alias("c")))))

    def share(n, total):
        return (F.coalesce(n, F.lit(0)) + eps) / (total + eps * bins)

    def term(i):
        cell = F.try_element_at(F.col("m"), i)
        p, q = share(cell["r"], F.col("R")), share(cell["c"], F.col("C"))
        return (q - p) * F.log(q / p)

    psi = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), term), F.lit(0.0), lambda s, x: s + x)
    scored = per_feature.withColumn("m", bin_of).select("feature", psi.alias("psi"))

    def mean(s):
        return F.avg(F.when(F.col("side") == s, F.col("x")))

    shift = tall.groupBy("feature").agg(
        mean("ref").alias("ref_mean"), mean("cur").alias("cur_mean"),
        F.count_if(F.col("side") == "ref").alias("ref_n"), F.count_if(F.col("side") == "cur").alias("cur_n"),
    )
    mid = exact_percentiles(tall, "x", {"p50": 0.5}, ["feature", "side"])
    mids = mid.groupBy("feature").agg(
        F.max(F.when(F.col("side") == "ref", F.col("p50"))).alias("ref_p50"),
        F.max(F.when(F.col("side") == "cur", F.col("p50"))).alias("cur_p50"),
    )
    return (
        scored.join(shift, "feature")
        .join(mids, "feature")
        .withColumns(
            {
                "status": F.when(F.col("psi") < 0.10, "green").when(F.col("psi") < 0.20, "yellow").otherwise("red"),
                "mean_shift_pct": (F.col("cur_mean") - F.col("ref_mean")) / (F.abs("ref_mean") + 1e-6) * 100,
            }
        )
    )


def concept_drift(log: DataFrame, recent: int = 4, baseline: int = 8, threshold: float = 5.0) -> DataFrame:
    """Recent against first accuracy of a weekly log (one row per week), with trend."""
    up = Window.orderBy(WEEK)
    down = Window.orderBy(F.desc(WEEK))
    rows = log.select(WEEK, "smape").withColumns({"_i": F.row_number().over(up), "_j": F.row_number().over(down)})
    late = F.col("_j") <= recent
    got = rows.agg(
        F.avg(F.when(F.col("_i") <= baseline, F.col("smape"))).alias("baseline_smape"),
        F.avg(F.when(late, F.col("smape"))).alias("recent_smape"),
        F.coalesce(
            F.regr_slope(F.when(late, F.col("smape")), F.col("_i").cast("double")), F.lit(0.0)
        ).alias("trend_slope_per_week"),
        F.count("*").alias("weeks_analyzed"),
    )
    delta = F.col("recent_smape") - F.col("baseline_smape")
    return got.withColumns(
        {
            "delta_pp": delta,
            "status": F.when(delta > threshold, "red").when(delta > threshold * 0.6, "yellow").otherwise("green"),
        }
    )


def alerts(
    accuracy: DataFrame, drift: DataFrame, smape_limit: float = 30.0, bias_limit: float = 10.0
) -> DataFrame:
    """Numbers of critical and warning alerts and the retraining decision.

    ``accuracy`` is one row with ``smape`` and ``bias_pct``; ``drift`` has a
    status per feature.
    """
    s, b = F.max("smape"), F.abs(F.max("bias_pct"))
    acc = accuracy.agg(
        F.when(s > smape_limit, 1).otherwise(0).alias("_c1"),
        F.when((s <= smape_limit) & (s > smape_limit * 0.7), 1).otherwise(0).alias("_w1"),
        F.when(b > bias_limit, 1).otherwise(0).alias("_c2"),
    )
    red = drift.agg(F.max((F.col("status") == "red").cast("int"))).scalar()
    yellow = drift.agg(F.max((F.col("status") == "yellow").cast("int"))).scalar()
    zero = F.lit(0)
    out = acc.select(
        (F.col("_c1") + F.col("_c2") + F.coalesce(red, zero)).alias("n_critical"),
        (F.col("_w1") + F.coalesce(yellow, zero)).alias("n_warning"),
    )
    return out.withColumn(
        "action",
        F.when(F.col("n_critical") >= 1, "RETRAIN_IMMEDIATE")
        .when(F.col("n_warning") >= 3, "RETRAIN_SCHEDULED")
        .otherwise("MONITOR_ONLY"),
    )


def promotion(
    metrics: DataFrame, champion: str, min_gain: float = 3.0, max_bias: float = 5.0
) -> DataFrame:
    """Which models may replace the champion.

    ``metrics`` has one row per model with ``smape`` and ``bias``; optional
    ``leakage_ok`` (0/1) and ``residual`` columns add their gates.
    """
    old = metrics.filter(F.col("model") == champion).select(
        F.col("smape").alias("_s"), F.abs("bias").alias("_b")
    )
    gain = F.try_divide(old.select("_s").scalar() - F.col("smape"), old.select("_s").scalar()) * 100
    worse = F.abs("bias") - old.select("_b").scalar()
    leak = F.col("leakage_ok") == 1 if "leakage_ok" in metrics.columns else F.lit(True)
    coherent = F.col("residual") <= 0.01 if "residual" in metrics.columns else F.lit(True)
    gates = [
        F.when(~(gain >= min_gain), "smape"), F.when(~(worse <= max_bias), "bias"),
        F.when(~leak, "leakage"), F.when(~coherent, "reconciliation"),
    ]
    out = metrics.filter(F.col("model") != champion).select(
        "model", gain.alias("smape_gain_pct"), worse.alias("bias_change_pp"),
        F.concat_ws(";", *gates).alias("failed_gates"),
    )
    return out.withColumn("promote", (F.col("failed_gates") == "").cast("int"))


def audit_counts(events: DataFrame, since: str, kind: str | None = None) -> DataFrame:
    """Events since a time per subtype and actor, with first and last time."""
    rows = events.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if kind:
        rows = rows.filter(F.col("event_type") == kind)
    return rows.groupBy("event_type", "user_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def latest_events(events: DataFrame, kind: str, pattern: str, n: int = 5) -> DataFrame:
    rows = events.filter((F.col("event_type") == kind) & F.col("props").contains(pattern))
    return rows.orderBy(F.desc("ts"), "event_id").limit(n)


def composite_score(cv: DataFrame, stable_cv: float = 0.2) -> DataFrame:
    """Weighted score per model over folds, and how steady its WAPE is."""
    got = cv.groupBy("model").agg(
        *[F.avg(c).alias(c) for c in ("wape", "smape", "mase", "bias", "slp")],
        F.try_divide(F.stddev_pop("wape"), F.avg("wape")).alias("wape_cv"),
    )
    # Weights of the composite score.
    score = (
        0.35 * F.col("wape") + 0.25 * F.col("smape") + 0.20 * F.col("mase")
        + 0.15 * F.abs("bias") + 0.05 * (1 - F.col("slp"))
    )
    return got.select(
        "model", score.alias("composite"), "wape_cv",
        F.when(F.col("wape_cv") <= stable_cv, "STABLE").otherwise("UNSTABLE").alias("stability"),
    )
