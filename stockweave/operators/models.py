"""Learned demand models on Spark ML: two stages, calibration, intervals.

Quantities are learned on a log target, with squared loss by Spark ML's boosted
trees or with Huber loss by :mod:`boosting`. The Q10/Q90 band comes from pinball
boosting, widened or narrowed by held-out rows so that it covers what it should;
the folds of the cross-validation use constant split-conformal offsets.
Thresholds, calibration, offsets and early stopping all use the last block of
the training weeks, never the validation weeks.
"""

from __future__ import annotations

import functools
import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.functions import weeks as wk
from stockweave.functions.scale import exact_percentiles, join_stats, order_statistics
from stockweave.operators import blending as bd
from stockweave.operators import boosting as bo
from stockweave.operators import features as ft
from stockweave.operators import metrics as mt
from stockweave.operators import recursion as rc
from stockweave.schema import CATEGORY, CHANNEL, CHANNEL_INV, QTY, SELL_IN, SKU, WEEK
from stockweave.session import cut_lineage, scratch_path

TUNE_WEEKS = 13
MIN_SEGMENT_ROWS = 20
SEGMENT_CUT = 0.1  # on demand_rate_12
FULL = {"maxIter": 60, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 7}


def stored(df: DataFrame, name: str = "model_frame") -> DataFrame:
    """Write once to the shared folder and read back, columnar, for many passes."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def base_frame(dense: DataFrame) -> DataFrame:
    """Sell-in rows with the features that need no fitting.

    Days of supply use the inventory of the week before.
    """
    inv = dense.filter(F.col(CATEGORY) == CHANNEL_INV)
    base = ft.series_features(dense.filter(F.col(CATEGORY) == SELL_IN))
    return ft.with_lagged_days_of_supply(base, inv)


def model_frame(base: DataFrame, train_end: int) -> DataFrame:
    """All model inputs; channel statistics are learned on weeks up to ``train_end``."""
    stats = ft.channel_stats(base, F.col(WEEK) <= train_end)
    return assemble(ft.training_rows(ft.model_features(base, stats)))


def assemble(df: DataFrame, columns: list[str] = ft.MODEL_FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(
        df.fillna(0.0, subset=columns)
    )


def with_roles(df: DataFrame, train_end: int, tune_weeks: int = TUNE_WEEKS) -> DataFrame:
    """Training rows, the last block of them flagged for tuning."""
    tune_start = wk.week_add(train_end, 1 - tune_weeks)
    return df.filter(F.col(WEEK) <= train_end).withColumn("is_tune", F.col(WEEK) >= tune_start)


def one_stage(rows: DataFrame, params: dict = FULL):
    """Absolute-loss regressor of the quantity on all rows."""
    return GBTRegressor(
        featuresCol="features", labelCol=QTY, predictionCol="reg_pred", lossType="absolute",
        validationIndicatorCol="is_tune", **params,
    ).fit(rows)


def demand_classifier(rows: DataFrame, params: dict = FULL):
    """Stage 1. Positives weigh (1 − p) / p, with p their share of training rows."""
    p = rows.filter(~F.col("is_tune")).agg(F.avg("label")).first()[0] or 0.5
    weight = (1 - p) / p if 0 < p < 1 else 1.0
    rows = rows.withColumn("_w", F.when(F.col("label") > 0, weight).otherwise(1.0))
    model = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="_w", predictionCol="clf_pred",
        validationIndicatorCol="is_tune", **params,
    ).fit(rows)
    return model, weight


def quantity_regressor(rows: DataFrame, params: dict = FULL, early_stop: bool = True):
    """Stage 2: log quantity of sold weeks; all rounds are run without ``early_stop``."""
    sold = rows.filter(F.col(QTY) > 0).withColumn("log_target", F.log1p(QTY))
    stop = {"validationIndicatorCol": "is_tune"} if early_stop else {}
    return GBTRegressor(
        featuresCol="features", labelCol="log_target", predictionCol="reg_pred", lossType="squared", **stop, **params,
    ).fit(sold)


@dataclass
class TreeModel:
    """Flat trees in the place of a fitted Spark ML regressor."""

    trees: bo.Trees

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("reg_pred", self.trees.column())


BOOST = {"rounds": 24, "depth": 4, "step": 0.15}


def huber_regressor(rows: DataFrame, log_target: bool = True, settings: dict = BOOST) -> TreeModel:
    """Stage 2 with Huber loss, whose bend is the 90 % point of absolute residuals of each round."""
    label = F.log1p(QTY) if log_target else F.col(QTY)
    return TreeModel(bo.boost(rows.filter(F.col(QTY) > 0), bo.Huber(), label, **settings))


def quantile_bands(rows: DataFrame, settings: dict = BOOST) -> tuple[dict, dict]:
    """Pinball-boosted 10 % and 90 % points of the log quantity of sold weeks, and each segment's widening.

    The widening is the 80 % point of how far sold rows of the tuning block lie
    outside the band (negative: inside), so that 80 % of them are covered. A
    segment without such rows takes the pooled widening.
    """
    sold = rows.filter(F.col(QTY) > 0)
    with ThreadPoolExecutor(2) as pool:
        lo, hi = pool.map(lambda q: bo.boost(sold, bo.Pinball(q), F.log1p(QTY), **settings), (0.1, 0.9))
    y = F.log1p(QTY)
    tune = sold.filter("is_tune").withColumn("key", F.when(segment() == "regular", 0).otherwise(1))
    tune = tune.select("key", F.greatest(lo.column() - y, y - hi.column()).alias("v"))
    both = tune.select(F.explode(F.array("key", F.lit(2))).alias("key"), "v")
    got = {k: next(iter(v.values())) for k, v in order_statistics(both, bo.quantile_rank(0.8)).items()}
    wide = {name: got.get(k, got.get(2, 0.0)) for k, name in enumerate(("regular", "sparse"))}
    return {"lo": lo, "hi": hi}, {name: (-w, w) for name, w in wide.items()}


def with_probability(df: DataFrame, classifier, calibrator=None) -> DataFrame:
    out = classifier.transform(df).withColumn("raw_prob", vector_to_array("probability")[1])
    out = out.drop("rawPrediction", "probability", "clf_pred")
    if calibrator is None:
        return out.withColumn("demand_prob", F.col("raw_prob"))
    return calibrator.transform(out)


def fit_calibrator(scored: DataFrame, bins: int | None = None):
    """Isotonic map from raw score to demand rate, clipped outside its range.

    The fit sees one weighted point per distinct score. ``bins`` rounds scores
    down to that many equal steps first, for data with very many of them.
    """
    b = F.floor(F.col("raw_prob") * bins) / bins if bins else F.col("raw_prob")
    points = scored.groupBy(b.alias("raw_prob")).agg(
        F.avg("label").alias("rate"), F.count("*").cast("double").alias("w")
    )
    return IsotonicRegression(
        featuresCol="raw_prob", labelCol="rate", weightCol="w", predictionCol="demand_prob"
    ).fit(points)


def segment():
    return F.when(F.col("demand_rate_12") > SEGMENT_CUT, "regular").otherwise("sparse")


def with_quantity(df: DataFrame, regressors: dict) -> DataFrame:
    """Quantity given a sale; each segment by its own model or by the other's, 0 without any model."""
    if not regressors:
        return df.withColumn("log_qty", F.lit(0.0))
    regular = regressors.get("regular") or regressors.get("sparse")
    sparse = regressors.get("sparse") or regressors.get("regular")
    if regular is sparse:
        return regular.transform(df).withColumn("log_qty", F.col("reg_pred")).drop("reg_pred")
    out = regular.transform(df).withColumnRenamed("reg_pred", "_r")
    out = sparse.transform(out).withColumnRenamed("reg_pred", "_s")
    pick = F.when(segment() == "regular", F.col("_r")).otherwise(F.col("_s"))
    return out.withColumn("log_qty", pick).drop("_r", "_s")


def segment_regressors(rows: DataFrame, params: dict = FULL, min_rows: int = MIN_SEGMENT_ROWS) -> dict:
    """A stage-2 model per segment with at least ``min_rows`` sold rows.

    A segment without sold rows in the tuning block is trained without early
    stopping.
    """
    sold = rows.filter(F.col(QTY) > 0)
    counts = {
        (r["s"], r["is_tune"]): r["n"]
        for r in sold.groupBy(segment().alias("s"), "is_tune").agg(F.count("*").alias("n")).collect()
    }
    out = {}
    for name in ("regular", "sparse"):
        if counts.get((name, False), 0) >= min_rows:
            own = sold.filter(segment() == name)
            out[name] = quantity_regressor(own, params, early_stop=counts.get((name, True), 0) > 0)
    return out


def conformal_offsets(scored: DataFrame) -> dict[str, tuple[float, float]]:
    """10 % and 90 % points of log residuals of sold rows, per segment.

    Four numbers; a segment without rows takes the pooled ones.
    """
    res = scored.filter(F.col(QTY) > 0).select(
        segment().alias("segment"), (F.log1p(QTY) - F.col("log_qty")).alias("res")
    )
    per = exact_percentiles(res, "res", {"lo": 0.1, "hi": 0.9}, ["segment"]).collect()
    out = {r["segment"]: (r["lo"], r["hi"]) for r in per}
    if len(out) < 2:
        r = exact_percentiles(res, "res", {"lo": 0.1, "hi": 0.9}).first()
        pooled = (r["lo"] or 0.0, r["hi"] or 0.0) if r else (0.0, 0.0)
        out = {"regular": out.get("regular", pooled), "sparse": out.get("sparse", pooled)}
    return {k: (min(lo, 0.0), max(hi, 0.0)) for k, (lo, hi) in out.items()}


@dataclass
class TwoStage:
    """Fitted models and the few numbers that go with them."""

    classifier: object
    regressors: dict
    calibrator: object | None = None
    threshold: float = 0.5
    pos_weight: float = 1.0
    offsets: dict = field(default_factory=lambda: {"regular": (0.0, 0.0), "sparse": (0.0, 0.0)})
    factors: dict = field(default_factory=lambda: {"regular": 1.0, "sparse": 1.0})
    bands: dict = field(default_factory=dict)

    def flat(self) -> rc.FlatTwoStage:
        """The same model as arrays, for tasks."""
        flat = {k: m.trees if isinstance(m, TreeModel) else bo.flatten(m) for k, m in self.regressors.items()}
        calibrator = None
        if self.calibrator is not None:
            calibrator = self.calibrator.boundaries.toArray(), self.calibrator.predictions.toArray()
        return rc.FlatTwoStage(
            bo.flatten(self.classifier), flat, calibrator, self.threshold, self.offsets, self.factors, self.bands, SEGMENT_CUT
        )


def fit_two_stage(
    rows: DataFrame, params: dict = FULL, calibrate: bool = False, segmented: bool = False,
    low: float = 0.01, high: float = 0.95, bands: bool = False,
) -> TwoStage:
    """Fit on the early training weeks, tune on the flagged block."""
    classifier, weight = demand_classifier(rows, params)
    tune = rows.filter("is_tune")
    calibrator = fit_calibrator(with_probability(tune, classifier)) if calibrate else None
    if segmented:
        regressors = segment_regressors(rows, params)
    else:
        regressors = {"regular": quantity_regressor(rows, params)}
    scored = with_quantity(with_probability(tune, classifier, calibrator), regressors)
    best = mt.youden_threshold(scored, "demand_prob", "label", low, high).first()
    m = TwoStage(classifier, regressors, calibrator, best["threshold"], weight)
    if bands:
        m.bands, m.offsets = quantile_bands(rows)
    else:
        m.offsets = conformal_offsets(scored)
    bias = bd.bias_factors(
        scored.select(
            F.col(QTY).alias("quantity_actual"), bd.from_log("log_qty").alias("forecast_q50"), "demand_prob"
        )
    ).first()
    m.factors = {"regular": bias["regular"], "sparse": bias["sparse"]}
    return m


def score(df: DataFrame, m: TwoStage, with_bias: bool = False) -> DataFrame:
    """Adds ``demand_prob``, ``quantity_hat``, ``product``, ``gated`` and the gated band."""
    out = with_quantity(with_probability(df, m.classifier, m.calibrator), m.regressors)
    lo = F.when(segment() == "regular", m.offsets["regular"][0]).otherwise(m.offsets["sparse"][0])
    hi = F.when(segment() == "regular", m.offsets["regular"][1]).otherwise(m.offsets["sparse"][1])
    factor = F.lit(1.0)
    if with_bias:
        factor = F.when(F.col("demand_prob") > 0.3, m.factors["regular"]).otherwise(m.factors["sparse"])
    out = out.withColumns(
        {
            "quantity_hat": bd.from_log("log_qty") * factor,
            "_lo": bd.from_log((m.bands["lo"].column() if m.bands else F.col("log_qty")) + lo),
            "_hi": bd.from_log((m.bands["hi"].column() if m.bands else F.col("log_qty")) + hi),
        }
    )
    on = F.col("demand_prob") >= m.threshold
    q50 = F.when(on, F.col("quantity_hat")).otherwise(0.0)
    return out.withColumns(
        {
            "product": bd.product_forecast(),
            "gated": q50,
            "forecast_q50": q50,
            "forecast_q10": F.when(on, F.least("_lo", "quantity_hat")).otherwise(0.0),
            "forecast_q90": F.when(on, F.greatest("_hi", "quantity_hat")).otherwise(0.0),
        }
    ).drop("_lo", "_hi", "log_qty")


def importances(model, columns: list[str] = ft.MODEL_FEATURES, n: int = 10) -> list[tuple[str, float]]:
    pairs = sorted(zip(columns, model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))
    return pairs[:n]


def suite(scored: DataFrame, forecast: str, label: str) -> DataFrame:
    rows = scored.select(*SKU, WEEK, F.col(QTY).alias("actual"), F.col(forecast).alias("forecast"))
    rows = rows.withColumn("variant", F.lit(label))
    scale = mt.diff_scale(rows, ["variant"])
    return mt.with_mase(mt.metric_suite(rows, ["variant"]), scale, ["variant"])


def cross_validate(
    base: DataFrame, folds, params: dict = FULL, segmented: bool = False, min_rows: int = 500
) -> tuple[DataFrame, DataFrame]:
    """Two-stage models over expanding folds.

    Returns metrics per fold and variant, and the scored rows of all folds. A
    fold with fewer than ``min_rows`` training rows has one row with ``skipped``
    = 1 and no metrics. Features are written once, the assembled rows once per
    fold; the loop is over folds, each a distributed fit.
    """
    base = stored(base)
    numbers = ["clf_auc", "threshold", "pos_weight", *mt.SUITE, "mase"]
    results, rows_of = [], []
    for fold, train_end, val_start, val_end in folds:
        frame = stored(model_frame(base, train_end))
        rows = with_roles(frame, train_end)
        val = frame.filter(F.col(WEEK).between(val_start, val_end))
        if rows.limit(min_rows).count() < min_rows:
            none = {c: F.lit(None).cast("double") for c in numbers} | {"n_obs": F.lit(None).cast("long")}
            one = base.sparkSession.range(1).select(
                F.lit(fold).alias("fold"), F.lit(None).cast("string").alias("variant"), F.lit(1).alias("skipped"),
                *[c.alias(k) for k, c in none.items()],
            )
            results.append(one)
            continue
        m = fit_two_stage(rows, params, calibrate=segmented, segmented=segmented)
        scored = stored(score(val, m).drop("features"), "scored")
        auc = mt.roc_auc(scored, "demand_prob", "label").first()["auc"]
        variants = ["gated"] if segmented else ["product", "gated"]
        for v in variants:
            results.append(
                suite(scored, v, v).select(
                    F.lit(fold).alias("fold"), "variant", F.lit(0).alias("skipped"), F.lit(auc).cast("double").alias("clf_auc"),
                    F.lit(float(m.threshold)).alias("threshold"), F.lit(float(m.pos_weight)).alias("pos_weight"),
                    *mt.SUITE, "mase", "n_obs",
                )
            )
        rows_of.append(scored.withColumn("fold", F.lit(fold)))
    if not rows_of:
        band = {c: F.lit(0.0) for c in ("forecast_q50", "forecast_q10", "forecast_q90", "demand_prob")}
        rows_of = [base.limit(0).select(F.lit(0).alias("fold"), *SKU, WEEK, QTY).withColumns(band)]
    return functools.reduce(DataFrame.unionByName, results), functools.reduce(DataFrame.unionByName, rows_of)


def interval_rows(scored: DataFrame) -> DataFrame:
    keys = [c for c in ("fold",) if c in scored.columns]
    return scored.select(
        *keys, *SKU, WEEK, F.col(QTY).alias("quantity_actual"), "forecast_q50", "forecast_q10", "forecast_q90", "demand_prob"
    )


def sample_settings(n: int = 30, seed: int = 42, base: dict = FULL) -> list[dict]:
    """Seeded random stage-2 settings over the parameters boosting has in Spark ML."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        out.append(
            {
                **base,
                "log_target": rng.random() < 0.5,
                "lossType": rng.choice(["squared", "absolute"]),
                "maxDepth": rng.randint(3, 6),
                "stepSize": round(math.exp(rng.uniform(math.log(0.01), math.log(0.15))), 4),
                "minInstancesPerNode": rng.randint(5, 50),
                "featureSubsetStrategy": str(round(rng.uniform(0.5, 1.0), 2)),
                "subsamplingRate": round(rng.uniform(0.5, 1.0), 2),
            }
        )
    return out


def grid_search(rows: DataFrame, val: DataFrame, grid: list[dict], parallel: int = 4) -> DataFrame:
    """Stage-2 settings ranked by active WAPE on later weeks; ``parallel`` fits run at once.

    ``log_target`` in a setting switches the target; other entries go to the
    regressor. One row per setting.
    """
    sold = rows.filter(F.col(QTY) > 0)

    def trial(numbered):
        i, setting = numbered
        params = {k: v for k, v in setting.items() if k != "log_target"}
        log_target = setting.get("log_target", True)
        fit_rows = sold.withColumn("_y", F.log1p(QTY) if log_target else F.col(QTY))
        model = GBTRegressor(
            featuresCol="features", labelCol="_y", predictionCol="reg_pred", validationIndicatorCol="is_tune", **params
        ).fit(fit_rows)
        pred = bd.from_log("reg_pred") if log_target else F.greatest("reg_pred", F.lit(0.0))
        got = model.transform(val).select(F.col(QTY).alias("actual"), pred.alias("forecast"))
        wape = got.agg(mt.active_wape().alias("active_wape")).first()["active_wape"]
        return i, str(sorted(setting.items())), wape

    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(trial, enumerate(grid)))
    out = rows.sparkSession.createDataFrame(done, "trial int, setting string, active_wape double")
    return out.orderBy("active_wape", "trial")


def start_state(sparse: DataFrame, stats: DataFrame, last: int, inventory: DataFrame | None = None) -> DataFrame:
    """History array, channel statistics and last inventory per series."""
    state = join_stats(ft.latest_history(sparse, last), stats, [CHANNEL])
    if inventory is None:
        return state.withColumn("_inv", F.lit(0.0))
    inv = inventory.filter(F.col(WEEK) <= last).groupBy(*SKU).agg(F.max_by(QTY, WEEK).alias("_inv"))
    return state.join(inv, SKU, "left").fillna(0.0, subset=["_inv"])


def step_features(state: DataFrame, week: int) -> DataFrame:
    """Model inputs of one future week from the history arrays."""
    df = state.withColumns(ft.array_features("hist", F.lit(week)))
    df = df.withColumn(
        "inventory_days_of_supply", F.col("_inv") / F.greatest(F.col("rolling_mean_4") / 7.0, F.lit(0.01))
    )
    df = ft.with_demand_rate(ft.with_nonzero_lags(df))
    return assemble(ft.with_cv(ft.with_logs(ft.with_channel_columns(df))))


def recursive_forecast(
    state: DataFrame, last: int, horizon: int, predict, size: int = 104, cut_every: int = 4
) -> DataFrame:
    """Week by week: features, forecast, append Q50 to the history.

    ``predict(df)`` adds ``forecast_q10/q50/q90``. All series advance together;
    the loop is over weeks. Lineage is cut by checkpoint every few weeks.
    """
    bands = ["forecast_q10", "forecast_q50", "forecast_q90"]
    base = state.columns
    empty = "array<struct<year_week:int,forecast_q10:double,forecast_q50:double,forecast_q90:double>>"
    df = state.withColumn("_out", F.array().cast(empty))
    for i in range(1, horizon + 1):
        week = wk.week_add(last, i)
        scored = predict(step_features(df, week))
        point = F.struct(F.lit(week).alias(WEEK), *[F.col(b).cast("double").alias(b) for b in bands])
        df = scored.select(
            *[c for c in base if c != "hist"],
            F.slice(F.concat("hist", F.array(F.col("forecast_q50").cast("double"))), 2, size).alias("hist"),
            F.concat("_out", F.array(point)).alias("_out"),
        )
        if i % cut_every == 0 and i < horizon:
            df = cut_lineage(df)
    return df.select(*SKU, F.inline("_out"))


def one_stage_predict(model):
    def predict(df):
        q = F.greatest(F.col("reg_pred"), F.lit(0.0))
        return model.transform(df).withColumns({f"forecast_q{p}": q for p in (10, 50, 90)})

    return predict


def two_stage_predict(m: TwoStage):
    return lambda df: score(df, m, with_bias=True)
