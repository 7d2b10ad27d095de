"""Seasonal trend models of the fee forecast from Gram matrices.

A model is a trend with hinges and Fourier terms, linear in its features (Taylor and Letham 2018). The Laplace prior on trend changes is an L1 term on
the hinges and the normal prior on seasonal terms an L2 term on the waves, weighted by the noise that is left; trend and level are free. All that a
fit needs of its rows is the matrix of sums of products of features and targets, which tasks add up for all training windows in one pass. A
coordinate descent on sub-matrices then gives the models of all settings of a window, so a search over hundreds of settings reads the history once.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from blockloom.functions.columns import AsOf, newest, seconds, span
from blockloom.operators.series import DAY, FEES, HORIZON_HOURS, HOUR, order_fees, prediction_rows

# Lookbacks of the seasonal models.
SEASONAL_LOOKBACKS = {"very_short": "3d", "hourly": "3w", "daily": "180d", "weekly": "365d"}


@dataclass(frozen=True)
class Seasonal:
    """Settings of one seasonal trend model; a changepoint scale of zero leaves a straight trend."""

    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    daily: bool = True
    weekly: bool = True
    yearly: bool = False
    mode: str = "additive"


# Search grids of the seasonal models.
SEASONAL_GRID = {
    "changepoint_prior_scale": [0.001, 0.01, 0.05, 0.1, 0.2],
    "seasonality_prior_scale": [0.1, 1.0, 5.0, 10.0, 20.0],
    "daily": [True, False], "weekly": [True, False], "yearly": [True, False],
    "mode": ["additive", "multiplicative"],
}
SEASONAL_GRID_SHORT = {
    "changepoint_prior_scale": [0.01, 0.05, 0.1], "seasonality_prior_scale": [0.1, 1.0, 5.0],
    "daily": [True], "weekly": [False], "yearly": [False], "mode": ["additive"],
}
STRAIGHT = Seasonal(changepoint_prior_scale=0.0, daily=False, weekly=False)
# Least points for each seasonality (two cycles of hourly data), in general, and in total.
MIN_DAILY, MIN_WEEKLY, MIN_YEARLY, MIN_POINTS, MIN_TOTAL = 48, 336, 17_520, 30, 100
# Taylor and Letham (2018): Fourier orders and trend hinges.
ORDERS = {"daily": (DAY, 4), "weekly": (7 * DAY, 3), "yearly": (365.25 * DAY, 10)}
HINGES, HINGE_SHARE = 25, 0.8
WAVES = [(kind, cycle, k) for kind, (cycle, order) in ORDERS.items() for k in range(1, order + 1)]
WIDTH = 1 + HINGES + 2 * len(WAVES)
SWEEPS, ROUNDS, NEAR = 200, 3, 1e-9
FIELDS = list(Seasonal.__dataclass_fields__)
SETTING = "changepoint_prior_scale double, seasonality_prior_scale double, daily boolean, weekly boolean, yearly boolean, mode string"
MODEL = f"model_name string, fee_type string, start double, length double, level double, weights array<double>, points bigint, {SETTING}"
SCORES = "frame int, setting int, points bigint, mape double"


# ---- features ---------------------------------------------------------------


def features(t: np.ndarray, start: float, length: float) -> np.ndarray:
    """Trend, hinges spread over the first 80 % of the window, and Fourier terms, of times in seconds."""
    trend = (t - start) / length
    hinges = np.maximum(trend[:, None] - HINGE_SHARE * np.arange(1, HINGES + 1) / (HINGES + 1), 0.0)
    angles = np.stack([t * (2 * math.pi * k / cycle) for _, cycle, k in WAVES], axis=1)
    return np.concatenate([trend[:, None], hinges, np.sin(angles), np.cos(angles)], axis=1)


def feature_array(t: Column, start: Column, length: Column) -> Column:
    """The same as an array column."""
    trend = (t - start) / length
    hinges = [F.greatest(trend - HINGE_SHARE * i / (HINGES + 1), F.lit(0.0)) for i in range(1, HINGES + 1)]
    angles = [t * (2 * math.pi * k / cycle) for _, cycle, k in WAVES]
    return F.array(trend, *hinges, *[F.sin(a) for a in angles], *[F.cos(a) for a in angles])


def enabled(s: Seasonal) -> np.ndarray:
    """Which features the settings use."""
    waves = [getattr(s, kind) for kind, _, _ in WAVES]
    return np.array([True, *[s.changepoint_prior_scale > 0] * HINGES, *waves, *waves])


# ---- sums of products -------------------------------------------------------


@dataclass(frozen=True)
class Frame:
    """A training window of one fee, in seconds, both ends included."""

    number: int
    fee: str
    start: float
    end: float


def products(df: DataFrame, frames: list[Frame]) -> DataFrame:
    """(frame, sums): sums over the rows of each window of the products of 1, features, fee and log of one plus fee.

    One pass over the rows for all windows (their number is bounded by the calendar); tasks send one matrix for each window that they have rows of.
    """
    side = WIDTH + 3

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            t = batch.column("t").to_numpy(zero_copy_only=False)
            fees = {fee: batch.column(fee).to_numpy(zero_copy_only=False) for fee in {frame.fee for frame in frames}}
            for frame in frames:
                y = fees[frame.fee]
                on = (t >= frame.start) & (t <= frame.end) & ~np.isnan(y)
                if on.any():
                    own, y = t[on], y[on]
                    rows = np.column_stack([np.ones(len(own)), features(own, frame.start, max(frame.end - frame.start, 1.0)), y, np.log1p(np.maximum(y, 0.0))])
                    sums[frame.number] = sums.get(frame.number, 0.0) + rows.T @ rows
        if sums:
            flat = pa.array(np.concatenate([matrix.ravel() for matrix in sums.values()]))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.ListArray.from_arrays(
                pa.array(np.arange(len(sums) + 1) * side * side, pa.int32()), flat)], names=["frame", "sums"])

    names = sorted({frame.fee for frame in frames})
    rows = df.select((F.unix_micros("timestamp") / 1e6).alias("t"), *[F.col(fee).cast("double").alias(fee) for fee in names])
    return rows.mapInArrow(run, "frame int, sums array<double>")


def solve(sums: np.ndarray, settings: list[Seasonal]) -> tuple[np.ndarray, np.ndarray]:
    """(levels, weights by feature) of the models of all settings, from one matrix of sums.

    Targets are scaled by their root mean square. The noise is estimated from what the previous round leaves.
    """
    count = sums[0, 0]
    mean = sums[0, 1:WIDTH + 1] / count
    centred = sums[1:WIDTH + 1, 1:WIDTH + 1] / count - np.outer(mean, mean)
    target = [WIDTH + 1 if s.mode == "additive" else WIDTH + 2 for s in settings]
    level = sums[0, target] / count
    squares = sums[target, target] / count
    scale = np.sqrt(np.maximum(squares, 1e-30))
    towards = (sums[1:WIDTH + 1][:, target].T / count - np.outer(level, mean)) / scale[:, None]
    spread = np.maximum(squares - level ** 2, 0.0) / scale ** 2
    diagonal = np.diag(centred)
    usable = np.array([enabled(s) for s in settings]) & (diagonal > 1e-12)
    waves = np.arange(WIDTH) > HINGES
    tau = np.array([s.changepoint_prior_scale or 1.0 for s in settings])
    sigma = np.array([s.seasonality_prior_scale for s in settings])
    weights, noise = np.zeros((len(settings), WIDTH)), spread
    for _ in range(ROUNDS):
        soft, ridge = noise / (count * tau), noise / (count * sigma ** 2)
        rest = towards - weights @ centred  # what is left to explain, for every feature
        for _ in range(SWEEPS):
            moved = 0.0
            for j in np.flatnonzero(usable.any(0)):
                pull = rest[:, j] + weights[:, j] * diagonal[j]
                if waves[j]:
                    new = pull / (diagonal[j] + ridge)
                elif j:
                    new = np.sign(pull) * np.maximum(np.abs(pull) - soft, 0.0) / diagonal[j]
                else:
                    new = pull / diagonal[j]
                step = np.where(usable[:, j], new - weights[:, j], 0.0)
                if step.any():
                    weights[:, j] += step
                    rest -= step[:, None] * centred[j]
                    moved = max(moved, float((step ** 2).max() * diagonal[j]))
            if moved < NEAR ** 2:
                break
        noise = np.maximum(spread - 2 * (weights * towards).sum(1) + ((weights @ centred) * weights).sum(1), 1e-9)
    weights *= scale[:, None]
    return level - weights @ mean, weights


# ---- models -----------------------------------------------------------------


def min_points(s: Seasonal = Seasonal(), hours: int = HORIZON_HOURS) -> int:
    """Least number of training points for the enabled seasonalities and the horizon."""
    return max(MIN_DAILY if s.daily else 0, MIN_WEEKLY if s.weekly else 0, MIN_YEARLY if s.yearly else 0, 3 * hours, MIN_POINTS)


def data_sufficiency(df: DataFrame, lookbacks: dict[str, str] | None = None, s: Seasonal = Seasonal(),
                     hours: int = HORIZON_HOURS) -> DataFrame:
    """Points per lookback against the least number, in one conditional aggregate."""
    lookbacks = lookbacks or SEASONAL_LOOKBACKS
    end, need = newest(df), min_points(s, hours)
    counted = df.agg(F.array(*[
        F.struct(F.lit(name).alias("model_name"), F.count_if(F.col("timestamp") >= end - span(seconds(i))).alias("points"))
        for name, i in lookbacks.items()]).alias("counts"), F.count("*").alias("total"))
    return counted.select("total", F.inline("counts")).select(
        "model_name", "points", F.lit(need).alias("required"),
        ((F.col("points") >= need) & (F.col("total") >= MIN_TOTAL)).alias("sufficient"))


def _extent(df: DataFrame, lookbacks: dict[str, str], fees: list[str]) -> dict[tuple[str, str], tuple[int, float, float]]:
    """Points, first and last time per lookback and fee, and the number of all rows under ("", ""): one aggregate, a row for the driver."""
    end, at = newest(df), F.unix_micros("timestamp") / 1e6
    parts = [F.count("*").alias("total")]
    for name, interval in lookbacks.items():
        for fee in fees:
            own = F.when((F.col("timestamp") >= end - span(seconds(interval))) & F.col(fee).isNotNull(), at)
            parts.append(F.struct(F.count(own), F.min(own), F.max(own)).alias(f"{name}.{fee}"))
    row = df.agg(*parts).first().asDict()
    return {("", ""): (row["total"], 0.0, 0.0)} | {
        (name, fee): (row[f"{name}.{fee}"][0], float(row[f"{name}.{fee}"][1] or 0), float(row[f"{name}.{fee}"][2] or 0)) for name in lookbacks for fee in fees}


def train_seasonal(df: DataFrame, lookbacks: dict[str, str] | None = None, settings: dict[str, Seasonal] | None = None,
                   hours: int = HORIZON_HOURS, fees: list[str] = FEES) -> DataFrame:
    """A row for each lookback and fee with its model; a lookback with too few points for its seasonalities has none.

    Settings are those of a search, else the defaults.
    """
    lookbacks, settings = lookbacks or SEASONAL_LOOKBACKS, settings or {}
    extent = _extent(df, lookbacks, fees)
    keys = [key for key, (count, _, _) in extent.items() if key[0] and extent["", ""][0] >= MIN_TOTAL
            and count >= min_points(settings.get(key[0], Seasonal()), hours)]
    frames = [Frame(i, key[1], *extent[key][1:]) for i, key in enumerate(keys)]
    if not frames:
        return df.sparkSession.createDataFrame([], MODEL)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["frame"].iloc[0])
        (name, fee), window = keys[number], frames[number]
        sums = np.sum(np.stack(frame["sums"].to_list()), axis=0).reshape(WIDTH + 3, -1)
        s = settings.get(name, Seasonal())
        level, weights = solve(sums, [s])
        return pd.DataFrame([(name, fee, window.start, max(window.end - window.start, 1.0), float(level[0]), weights[0].tolist(), int(round(sums[0, 0])),
                              *[getattr(s, field) for field in FIELDS])], columns=["model_name", "fee_type", "start", "length", "level", "weights", "points", *FIELDS])

    return products(df, frames).groupBy("frame").applyInPandas(fit, MODEL)


def forecast_seasonal(models: DataFrame, times: DataFrame, generated_at: AsOf) -> DataFrame:
    """Ordered, complete predictions of all lookbacks, in plain expressions over the models' weights."""
    every = models.agg(F.collect_list(F.struct(*models.columns)).alias("models"))  # one row: lookbacks by fees
    rows = times.withColumn("models", every.scalar()).select("prediction_time", F.inline("models"))
    t = F.unix_micros("prediction_time") / 1e6
    terms = F.zip_with(feature_array(t, F.col("start"), F.col("length")), "weights", lambda x, w: x * w)
    guess = F.col("level") + F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    rows = rows.select("prediction_time", "model_name", "fee_type", F.when(F.col("mode") == "multiplicative", F.expm1(guess)).otherwise(guess).alias("guess"))
    wide = rows.groupBy("prediction_time", "model_name").agg(*[F.max(F.when(F.col("fee_type") == fee, F.col("guess"))).alias(fee) for fee in FEES])
    return prediction_rows(order_fees(wide, "sort"), F.col("model_name"), generated_at)


# ---- rolling evaluation and search ------------------------------------------


def cutoffs(start: float, end: float, initial: float, period: float, ahead: float) -> list[float]:
    """Cutoff times of a rolling evaluation, oldest first (their number is span / period)."""
    last = end - ahead
    count = int((last - start - initial) // period) + 1 if last >= start + initial else 0
    return [last - i * period for i in reversed(range(count))]


def rolling_scores(df: DataFrame, settings: list[Seasonal], windows: list[tuple[str, float, list[float]]], ahead: float) -> DataFrame:
    """(frame, setting, points, mape) of every setting at every cutoff of every window (fee, start, cutoffs); frames count through all cutoffs in order.

    Training rows go into the matrices of the cutoffs after them; the rows within the horizon behind a cutoff meet its models. A zero fee has
    no percentage error and does not count.
    """
    frames = [Frame(i, fee, start, cut) for i, (fee, start, cut) in enumerate((fee, start, cut) for fee, start, cuts in windows for cut in cuts)]
    cuts = pa.array([frame.end for frame in frames]).to_numpy()

    def tests(batches):
        for batch in batches:
            t = batch.column("t").to_numpy(zero_copy_only=False)
            for frame in frames:
                y = batch.column(frame.fee).to_numpy(zero_copy_only=False)
                on = (t > cuts[frame.number]) & (t <= cuts[frame.number] + ahead) & ~np.isnan(y) & (y != 0)
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(on.sum()), frame.number, np.int32)), pa.array(t[on]), pa.array(y[on])], names=["frame", "t", "y"])

    def score(partial: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
        if not len(partial) or not len(test):
            return pd.DataFrame(columns=["frame", "setting", "points", "mape"])
        frame = frames[int(partial["frame"].iloc[0])]
        level, weights = solve(np.sum(np.stack(partial["sums"].to_list()), axis=0).reshape(WIDTH + 3, -1), settings)
        y = test["y"].to_numpy()
        guess = features(test["t"].to_numpy(), frame.start, max(frame.end - frame.start, 1.0)) @ weights.T + level
        logged = np.array([s.mode == "multiplicative" for s in settings])
        guess[:, logged] = np.expm1(np.minimum(guess[:, logged], 700.0))
        error = np.abs((y[:, None] - guess) / y[:, None]).mean(0)
        return pd.DataFrame({"frame": np.int32(frame.number), "setting": np.arange(len(settings), dtype=np.int32), "points": np.int64(len(y)), "mape": error})

    names = sorted({frame.fee for frame in frames})
    rows = df.select((F.unix_micros("timestamp") / 1e6).alias("t"), *[F.col(fee).cast("double").alias(fee) for fee in names])
    test = rows.mapInArrow(tests, "frame int, t double, y double")
    partial = products(df, frames)
    tasks = max(1, min(len(frames), 200))
    return (partial.repartition(tasks, "frame").groupBy("frame").cogroup(test.repartition(tasks, "frame").groupBy("frame"))
            .applyInPandas(score, SCORES))


def rolling_cv(df: DataFrame, fee: str = "fast_fee", settings: dict[str, Seasonal] | None = None, initial_days: float = 60, period_days: float = 15,
               horizon_hours: float = HORIZON_HOURS) -> DataFrame:
    """(model_name, cutoff, points, mape) of named settings at every cutoff of the history.

    Cutoffs run back from the end minus the horizon in steps of the period, while the initial span is left.
    """
    settings = settings or {"default": Seasonal(), "straight": STRAIGHT}
    row = df.where(F.col(fee).isNotNull()).agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    start, end = ((value or 0) / 1e6 for value in row)
    cuts = cutoffs(start, end, initial_days * DAY, period_days * DAY, horizon_hours * HOUR)
    spark = df.sparkSession
    if not cuts:
        return spark.createDataFrame([], "model_name string, cutoff timestamp, points bigint, mape double")
    scores = rolling_scores(df, list(settings.values()), [(fee, start, cuts)], horizon_hours * HOUR)
    names = F.element_at(F.array(*[F.lit(name) for name in settings]), F.col("setting") + 1)
    cutoff = F.timestamp_micros(F.element_at(F.array(*[F.lit(round(cut * 1e6)) for cut in cuts]), F.col("frame") + 1))
    return scores.select(names.alias("model_name"), cutoff.alias("cutoff"), "points", "mape")


def grid_points(grid: dict[str, list]) -> list[Seasonal]:
    points = [Seasonal(**dict(zip(grid, values))) for values in itertools.product(*grid.values())]
    return points if Seasonal() in points else [Seasonal(), *points]


def search_seasonal(df: DataFrame, name: str, grid: dict[str, list] | None = None, initial_days: float = 60, period_days: float = 15,
                    hours: int = HORIZON_HOURS) -> tuple[Seasonal, list[tuple[Seasonal, float]]]:
    """Best settings of a lookback's rows by rolling percentage error, and all scores. The defaults are always tried; they stay when
    the rows are too few. Tuned on the fast fee, else on the first fee that has data."""
    span_row = df.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp")), *[F.count(fee) for fee in FEES]).first()
    start, end, counts = (span_row[0] or 0) / 1e6, (span_row[1] or 0) / 1e6, dict(zip(FEES, span_row[2:]))
    fee = next((f for f in FEES if counts[f]), None)
    initial, period, ahead = initial_days * DAY, period_days * DAY, hours * HOUR
    if fee is None or end - start < initial + period + ahead:
        return Seasonal(), []
    grid = grid or (SEASONAL_GRID_SHORT if name == "very_short" else SEASONAL_GRID)
    points = [s for s in grid_points(grid) if counts[fee] >= min_points(s, hours)]
    if not points:
        return Seasonal(), []
    scores = rolling_scores(df, points, [(fee, start, cutoffs(start, end, initial, period, ahead))], ahead)
    means = {r["setting"]: r["mape"] for r in scores.groupBy("setting").agg(F.avg("mape").alias("mape")).collect()}  # a row for each setting
    scored = [(s, means[i]) for i, s in enumerate(points) if i in means]
    return (min(scored, key=lambda p: p[1])[0] if scored else Seasonal()), scored


def search_lookbacks(df: DataFrame, lookbacks: dict[str, str] | None = None, grids: dict[str, dict[str, list]] | None = None,
                     **rolling: float) -> dict[str, tuple[Seasonal, list[tuple[Seasonal, float]]]]:
    """The search for every lookback, over the rows of the lookback; what comes back are settings and scores, not rows."""
    end = newest(df)
    return {name: search_seasonal(df.where(F.col("timestamp") >= end - span(seconds(interval))), name, (grids or {}).get(name), **rolling)
            for name, interval in (lookbacks or SEASONAL_LOOKBACKS).items()}
