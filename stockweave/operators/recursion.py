"""Recursive forecasts in one pass: every task runs all weeks of its series on arrays.

Feature rules are those of :mod:`features`; models are flat trees of bounded
size that travel with the task. There is no shuffle and no plan per week.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.functions import scalars as sc
from stockweave.functions import weeks as wk
from stockweave.operators import features as ft
from stockweave.operators.boosting import Trees
from stockweave.schema import SKU, WEEK

TIE = 1e-12  # the threshold is a probability that occurs; exponentials of two libraries differ in the last place
BANDS = ["forecast_q10", "forecast_q50", "forecast_q90"]


@dataclass
class FlatTwoStage:
    """The fitted two-stage model as arrays: everything a task needs."""

    classifier: Trees
    regressors: dict[str, Trees]
    calibrator: tuple[np.ndarray, np.ndarray] | None
    threshold: float
    offsets: dict
    factors: dict
    bands: dict = field(default_factory=dict)
    cut: float = 0.1
    steady: float = 0.3

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prob = 1 / (1 + np.exp(-2 * self.classifier.predict(x)))
        if self.calibrator is not None:
            prob = np.interp(prob, *self.calibrator)
        regular = x[:, ft.MODEL_FEATURES.index("demand_rate_12")] > self.cut
        log_qty = np.zeros(len(x))
        for name, rows in (("regular", regular), ("sparse", ~regular)):
            model = self.regressors.get(name) or next(iter(self.regressors.values()), None)
            if model is not None:
                log_qty[rows] = model.predict(x[rows])
        factor = np.where(prob > self.steady, self.factors["regular"], self.factors["sparse"])
        quantity = np.maximum(np.expm1(log_qty), 0) * factor
        ends = []
        for side, name in enumerate(("lo", "hi")):
            base = self.bands[name].predict(x) if self.bands else log_qty
            offset = np.where(regular, self.offsets["regular"][side], self.offsets["sparse"][side])
            ends.append(np.maximum(np.expm1(base + offset), 0))
        on = prob >= self.threshold - TIE
        return np.where(on, np.minimum(ends[0], quantity), 0.0), np.where(on, quantity, 0.0), np.where(on, np.maximum(ends[1], quantity), 0.0)


@dataclass
class FlatOneStage:
    regressor: Trees

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = np.maximum(self.regressor.predict(x), 0)
        return q, q, q


def array_inputs(hist: np.ndarray, season: float, fixed: dict[str, np.ndarray]) -> np.ndarray:
    """Model inputs of the week after the last column of ``hist`` (series x weeks), in the models' column order."""
    n = hist.shape[1]
    last12, sold = hist[:, -12:], hist > 0
    back = lambda k: hist[:, n - k] if n >= k else np.zeros(len(hist))
    mean4, mean12 = hist[:, -4:].mean(axis=1), last12.mean(axis=1)
    std12 = last12.std(axis=1, ddof=1) if last12.shape[1] > 1 else np.zeros(len(hist))
    zeros = (last12 == 0).mean(axis=1) > 0.5
    columns = {
        "lag_1": back(1), "lag_4": back(4), "lag_52": back(52),
        "rolling_mean_4": mean4, "rolling_mean_12": mean12, "rolling_std_12": std12,
        "weeks_since_last_sale": np.where(sold.any(axis=1), np.argmax(sold[:, ::-1], axis=1), n),
        "intermittent_flag": zeros,
        "week_sin": np.full(len(hist), math.sin(season)), "week_cos": np.full(len(hist), math.cos(season)),
        "inventory_days_of_supply": fixed["_inv"] / np.maximum(mean4 / 7.0, 0.01),
        "lag_nonzero_1": back(1) > 0, "lag_nonzero_4": back(4) > 0, "lag_nonzero_52": back(52) > 0,
        "demand_rate_12": 1.0 - zeros,
        "zscore_vs_channel": np.nan_to_num((mean12 - fixed["ch_mean"]) / (fixed["ch_std"] + sc.EPS), nan=0.0),
        "log_lag_1": np.log1p(back(1)), "log_lag_4": np.log1p(back(4)), "log_rolling_mean_12": np.log1p(mean12),
        "cv_12": np.clip(std12 / (mean12 + sc.EPS), 0, 10),
        "channel_nonzero_avg": np.nan_to_num(fixed["ch_nonzero_avg"], nan=0.0),
    }
    return np.column_stack([columns[c].astype(np.float64) for c in ft.MODEL_FEATURES])


def recursive_forecast(state: DataFrame, last: int, horizon: int, model, series: int = 4096) -> DataFrame:
    """Q10, Q50 and Q90 of each series for ``horizon`` weeks after ``last``; Q50 is fed back.

    ``state`` has a row per series, as ``models.start_state`` gives it: history
    arrays of one length, channel statistics, last inventory. Rows stay in their
    partition; a task holds ``series`` histories at a time.
    """
    weeks = [wk.week_add(last, i) for i in range(1, horizon + 1)]
    angles = [w % 100 * (2 * math.pi / wk.WEEKS_IN_YEAR) for w in weeks]
    fixed = ["ch_mean", "ch_std", "ch_nonzero_avg", "_inv"]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), series):
                part = batch.iloc[at : at + series]
                hist = np.stack(part["hist"].to_numpy()).astype(np.float64)
                known = {c: part[c].to_numpy(dtype=np.float64, na_value=np.nan) for c in fixed}
                found = np.empty((len(part), horizon, 3))
                for i, angle in enumerate(angles):
                    found[:, i, 0], found[:, i, 1], found[:, i, 2] = model(array_inputs(hist, angle, known))
                    hist = np.hstack([hist[:, 1:], found[:, i, 1:2]])
                out = {c: np.repeat(part[c].to_numpy(), horizon) for c in SKU} | {WEEK: np.tile(np.array(weeks, np.int32), len(part))}
                yield pd.DataFrame(out | {b: found[:, :, k].ravel() for k, b in enumerate(BANDS)})

    kinds = ", ".join(f"`{c}` {state.schema[c].dataType.simpleString()}" for c in SKU)
    columns = [*SKU, "hist", *[F.col(c).cast("double").alias(c) for c in fixed]]
    return state.select(*columns).mapInPandas(run, f"{kinds}, {WEEK} int, " + ", ".join(f"{b} double" for b in BANDS))
