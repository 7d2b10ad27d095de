"""Forests of the fee forecast over feature cells.

The features are hour, weekday, month and year, so any number of snapshots folds into cells of equal features with a count, a sum and a sum of
squares, a table bounded by the calendar. A forest grows on cells as it would on rows, and the error of its predictions on rows follows exactly
from the sums. Spark folds the history once for all lookbacks, fees and folds, and grows the forests of different settings, folds and keys in parallel;
models are rows of a table.
"""

from __future__ import annotations

import random
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from blockloom.functions.columns import AsOf, newest, seconds, span
from blockloom.operators.series import FEES, TIME_FEATURES, order_fees, prediction_rows, time_features

# Lookbacks of the forests.
FOREST_LOOKBACKS = {"very_short": "1H", "hourly": "12H", "daily": "7D", "weekly": "4W"}


@dataclass(frozen=True)
class Forest:
    """Tuned settings of one forest; no depth means no limit."""

    trees: int = 100
    depth: int | None = None
    features: str | float = "sqrt"
    leaf: int = 1
    split: int = 2
    bootstrap: bool = True


# Tuned settings per lookback and fee.
_FLAT = Forest(292, 5, 0.8, 8, 12, False)
_SHORT = Forest(207, 7, 1.0, 2, 13, False)
FOREST_SETTINGS = {
    ("very_short", "fast_fee"): _SHORT,
    ("very_short", "medium_fee"): Forest(90, 49, "log2", 5, 14, False),
    ("very_short", "low_fee"): _SHORT,
    ("hourly", "fast_fee"): Forest(209, 47, 1.0, 4, 14, True),
    ("hourly", "medium_fee"): Forest(253, 6, 0.8, 5, 2, False),
    ("hourly", "low_fee"): Forest(153, 27, 0.6, 8, 5, True),
    ("daily", "fast_fee"): Forest(178, 32, "sqrt", 7, 2, False),
    ("daily", "medium_fee"): Forest(171, 33, 0.6, 8, 8, True),
    ("daily", "low_fee"): Forest(64, 18, 0.6, 9, 16, True),
    ("weekly", "fast_fee"): _FLAT,
    ("weekly", "medium_fee"): _FLAT,
    ("weekly", "low_fee"): _FLAT,
}
# Search space of the forests (whole-number ranges exclude their end).
FOREST_SPACE = {
    "trees": range(50, 300), "features": ["sqrt", "log2", 0.6, 0.8, 1.0], "depth": range(5, 50),
    "split": range(2, 20), "leaf": range(1, 10), "bootstrap": [True, False],
}
MODEL = ("model_name string, fee_type string, trees int, feature array<int>, threshold array<double>, child array<int>, value array<double>, "
         "rows bigint, settings string")
SCORE = "model_name string, fee_type string, draw int, fold int, rows bigint, mse double"


# ---- cells ------------------------------------------------------------------


def in_lookbacks(df: DataFrame, lookbacks: dict[str, str], ts: str = "timestamp") -> DataFrame:
    """A row for each lookback that a row lies in (``model_name``); lookbacks end at the newest row."""
    end = newest(df, ts)
    names = F.array_compact(F.array(*[F.when(F.col(ts) >= end - span(seconds(interval)), F.lit(name)) for name, interval in lookbacks.items()]))
    return df.withColumn("model_name", F.explode(names))


def feature_cells(df: DataFrame, keys: list[str], fees: list[str] = FEES, ts: str = "timestamp", columns: list[str] = TIME_FEATURES) -> DataFrame:
    """Count, sum and sum of squares of each fee by the keys and the time features; rows without the fee do not count."""
    long = time_features(df, ts).unpivot([*keys, *columns], fees, "fee_type", "y").where("y IS NOT NULL")
    return long.groupBy(*keys, "fee_type", *columns).agg(
        F.count("*").alias("n"), F.sum(F.col("y").cast("double")).alias("s"), F.sum(F.col("y").cast("double") * F.col("y")).alias("q"))


def fold_cells(df: DataFrame, lookbacks: dict[str, str], folds: int = 5, fees: list[str] = FEES, ts: str = "timestamp") -> DataFrame:
    """Cells per lookback, fee and fold, where folds are consecutive stretches of the rows by time, the first ones a row longer.

    Rows of one time share the fold of the first of them. Fewer rows than folds make as many folds as there are rows. Ranks come from counts
    per time and per day, not from a global order.
    """
    long = in_lookbacks(df, lookbacks, ts).unpivot([ts, "model_name"], fees, "fee_type", "y").where("y IS NOT NULL")
    key = ["model_name", "fee_type"]
    times = long.groupBy(*key, ts).agg(F.count("*").alias("c")).withColumn("day", F.to_date(ts))
    days = times.groupBy(*key, "day").agg(F.sum("c").alias("c"))
    opening = days.select(*key, "day", F.coalesce(F.sum("c").over(
        Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("opening"))
    totals = days.groupBy(*key).agg(F.sum("c").alias("rows"))
    inside = Window.partitionBy(*key, "day").orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    placed = (times.join(opening, [*key, "day"]).join(totals, key)
              .withColumn("rank", F.col("opening") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
              .withColumn("k", F.least(F.lit(folds), "rows")))
    size, longer = F.expr("rows div k"), F.expr("rows % k")
    fold = F.when(F.col("rank") < longer * (size + 1), F.expr("rank div (rows div k + 1)")).otherwise(
        longer + F.expr("(rank - (rows % k) * (rows div k + 1)) div (rows div k)"))
    folded = long.join(placed.select(*key, ts, fold.cast("int").alias("fold")), [*key, ts])
    return time_features(folded, ts).groupBy(*key, "fold", *TIME_FEATURES).agg(
        F.count("*").alias("n"), F.sum(F.col("y").cast("double")).alias("s"), F.sum(F.col("y").cast("double") * F.col("y")).alias("q"))


# ---- growing ----------------------------------------------------------------


@dataclass
class Trees:
    """Nodes of all trees of a forest; the first nodes are the roots. A leaf has feature -1, a right child follows its left one."""

    count: int
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean prediction of the trees for rows of features."""
        node = np.repeat(np.arange(self.count)[:, None], len(x), axis=1)
        rows = np.broadcast_to(np.arange(len(x)), node.shape)
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return self.value[node].mean(axis=0)
            right = x[rows, np.maximum(feature, 0)] > self.threshold[node]
            node = np.where(inner, self.child[node] + right, node)


def subset_size(features: str | float, count: int) -> int:
    """Features to look at for a split, by name or share."""
    share = {"sqrt": count ** 0.5, "log2": np.log2(count)}.get(features, None)
    return max(1, int(share if share is not None else float(features) * count))


def grow(x: np.ndarray, n: np.ndarray, s: np.ndarray, settings: Forest, seed: int = 42) -> Trees:
    """All trees at once, level by level: a split of a node is the best of the sums over feature values to its left and right.

    A bootstrap draws rows from the cells and gives each the mean of its cell.
    """
    rng, cells, width = np.random.default_rng(seed), len(n), x.shape[1]
    values = [np.unique(x[:, f], return_inverse=True) for f in range(width)]
    count = settings.trees
    if settings.bootstrap:
        weight = rng.multinomial(int(n.sum()), n / n.sum(), size=count).astype(float)
    else:
        weight = np.broadcast_to(n.astype(float), (count, cells))
    tree, cell = np.nonzero(weight)
    w, y = weight[tree, cell], (s / n)[cell]
    node, first, depth = tree.copy(), 0, 0  # nodes of the level are numbered from 0; first is the number of the level's first node
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    size, subset = count, subset_size(settings.features, width)
    while size:
        total, sums = np.bincount(node, w, size), np.bincount(node, w * y, size)
        value = sums / total
        spread = np.bincount(node, w * (y - value[node]) ** 2, size)
        open_ones = (total >= settings.split) & (total >= 2 * settings.leaf) & (spread > 1e-12 * np.maximum(1.0, value ** 2) * total)
        if settings.depth is not None and depth >= settings.depth:
            open_ones[:] = False
        gain, place = np.full((width, size), -np.inf), np.zeros((width, size), int)
        hists = []
        for f, (levels, code) in enumerate(values):
            key = node * len(levels) + code[cell]
            hist = np.bincount(key, w, size * len(levels)).reshape(size, -1)
            left, left_sum = hist.cumsum(1), np.bincount(key, w * y, size * len(levels)).reshape(size, -1).cumsum(1)
            right, right_sum = total[:, None] - left, sums[:, None] - left_sum
            with np.errstate(divide="ignore", invalid="ignore"):
                score = left_sum ** 2 / left + right_sum ** 2 / right - (sums ** 2 / total)[:, None]
            score = np.where((left >= settings.leaf) & (right >= settings.leaf) & (right > 1e-9) & (left > 1e-9), score, -np.inf)
            place[f] = score.argmax(1)
            gain[f] = score[np.arange(size), place[f]]
            hists.append(hist)
        if subset < width:  # features outside a node's draw count only where none inside it can split
            drawn = rng.random((width, size)).argsort(0).argsort(0) < subset
            inside = np.where(drawn, gain, -np.inf)
            gain = np.where(np.isfinite(inside).any(0), inside, gain)
        best = gain.argmax(0)
        open_ones &= np.isfinite(gain[best, np.arange(size)])
        feature, threshold = np.where(open_ones, best, -1), np.zeros(size)
        for f, (levels, code) in enumerate(values):
            own = np.flatnonzero(feature == f)
            if len(own):  # halfway to the next value that the node has
                after = (hists[f][own] > 0) & (np.arange(len(levels)) > place[f][own][:, None])
                threshold[own] = (levels[place[f][own]] + levels[after.argmax(1)]) / 2
        order = np.cumsum(open_ones) - 1
        child = np.where(open_ones, first + size + 2 * order, -1)
        out.append((feature, threshold, child, value))
        on = open_ones[node]
        tree, cell, w, y, node = tree[on], cell[on], w[on], y[on], node[on]
        node = 2 * order[node] + (x[cell, feature[node]] > threshold[node])
        first, size, depth = first + size, 2 * int(open_ones.sum()), depth + 1
    return Trees(count, *(np.concatenate([level[k] for level in out]) for k in range(4)))


def _cells_of(frame: pd.DataFrame, columns: list[str] = TIME_FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    frame = frame.sort_values(columns)
    return frame[columns].to_numpy(float), frame["n"].to_numpy(), frame["s"].to_numpy(), frame["q"].to_numpy()


def _together(frame: pd.DataFrame) -> pd.DataFrame:
    """Cells of several folds as one."""
    return frame.groupby(TIME_FEATURES, as_index=False)[["n", "s", "q"]].sum()


# ---- training, prediction and search ----------------------------------------


def train_forests(train: DataFrame, lookbacks: dict[str, str] | None = None, settings: dict | None = None,
                  fees: list[str] = FEES, seed: int = 42, columns: list[str] = TIME_FEATURES) -> DataFrame:
    """A row for each lookback and fee with the forest grown on the rows near the end of the training part; keys without rows have none."""
    lookbacks, settings = lookbacks or FOREST_LOOKBACKS, FOREST_SETTINGS if settings is None else settings
    cells = feature_cells(in_lookbacks(train, lookbacks), ["model_name"], fees, columns=columns)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        key = (frame["model_name"].iloc[0], frame["fee_type"].iloc[0])
        chosen = settings.get(key, Forest())
        x, n, s, _ = _cells_of(frame, columns)
        trees = grow(x, n, s, chosen, seed)
        return pd.DataFrame([(*key, trees.count, trees.feature.tolist(), trees.threshold.tolist(), trees.child.tolist(), trees.value.tolist(),
                              int(n.sum()), str(asdict(chosen)))], columns=[part.split(" ")[0] for part in MODEL.split(", ")])

    return cells.repartition(len(lookbacks) * len(fees), "model_name", "fee_type").groupBy("model_name", "fee_type").applyInPandas(fit, MODEL)


def _trees(model: pd.DataFrame) -> Trees:
    row = model.iloc[0]
    return Trees(int(row["trees"]), *(np.array(row[name]) for name in ("feature", "threshold", "child", "value")))


def forest_values(models: DataFrame, times: DataFrame, ts: str = "prediction_time", columns: list[str] = TIME_FEATURES) -> DataFrame:
    """(model_name, fee_type, time features, guess) for the distinct features of the times, a table bounded by the calendar."""
    known = time_features(times, ts).select(*columns).distinct()
    keys = models.agg(F.collect_list(F.struct("model_name", "fee_type")).alias("keys"))  # one row: lookbacks by fees
    asked = known.withColumn("keys", keys.scalar()).select(*columns, F.inline("keys"))

    def predict(asked_frame: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(asked_frame) or not len(model):
            return pd.DataFrame(columns=["model_name", "fee_type", *columns, "guess"])
        return asked_frame.assign(guess=_trees(model).predict(asked_frame[columns].to_numpy(float)))[["model_name", "fee_type", *columns, "guess"]]

    schema = f"model_name string, fee_type string, {', '.join(f'{name} int' for name in columns)}, guess double"
    return asked.groupBy("model_name", "fee_type").cogroup(models.groupBy("model_name", "fee_type")).applyInPandas(predict, schema)


def predict_forests(models: DataFrame, times: DataFrame, name: str) -> DataFrame:
    """Ordered predictions of one lookback for a table of times; a fee without a model leaves the row without fees."""
    found = forest_values(models.where(F.col("model_name") == name), times)
    wide = found.groupBy(*TIME_FEATURES).agg(*[F.max(F.when(F.col("fee_type") == fee, F.col("guess"))).alias(fee) for fee in FEES])
    rows = time_features(times, "prediction_time").join(wide, TIME_FEATURES, "left")
    return order_fees(rows.select("prediction_time", *FEES), "clamp")


def forecast_forests(models: DataFrame, times: DataFrame, generated_at: AsOf | Column) -> DataFrame:
    """Ordered, complete predictions of all lookbacks."""
    wide = forest_values(models, times).groupBy("model_name", *TIME_FEATURES).agg(
        *[F.max(F.when(F.col("fee_type") == fee, F.col("guess"))).alias(fee) for fee in FEES])
    rows = time_features(times, "prediction_time").join(wide, TIME_FEATURES)
    return prediction_rows(order_fees(rows, "clamp"), F.col("model_name"), generated_at)


def evaluate(models: DataFrame, test: DataFrame, fees: list[str] = FEES, columns: list[str] = TIME_FEATURES) -> DataFrame:
    """Mean squared error of every model on the test rows, from the sums of their cells."""
    cells = feature_cells(test, [], fees, columns=columns)
    values = forest_values(models, test, "timestamp", columns)
    return (values.join(cells, ["fee_type", *columns]).groupBy("model_name", "fee_type")
            .agg((F.sum(F.col("q") - 2 * F.col("guess") * F.col("s") + F.col("guess") * F.col("guess") * F.col("n")) / F.sum("n")).alias("mse")))


def drawn_settings(draws: int = 20, seed: int = 42) -> list[Forest]:
    rng = random.Random(seed)
    return [Forest(**{name: rng.choice(list(values)) for name, values in FOREST_SPACE.items()}) for _ in range(draws)]


def score_forests(df: DataFrame, draws: int = 20, folds: int = 5, lookbacks: dict[str, str] | None = None,
                  fees: list[str] = FEES, seed: int = 42) -> DataFrame:
    """(model_name, fee_type, draw, fold, rows, mse): error of every drawn setting on every fold, grown on the other folds.

    All of the history counts, cut by lookback. A key with one row only has no other fold and no score.
    """
    lookbacks = lookbacks or FOREST_LOOKBACKS
    space = drawn_settings(draws, seed)
    cells = fold_cells(df, lookbacks, folds, fees).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        name, fee, draw = frame["model_name"].iloc[0], frame["fee_type"].iloc[0], int(frame["draw"].iloc[0])
        out = []
        for fold in sorted(frame["fold"].unique()):
            rest, held = frame[frame["fold"] != fold], frame[frame["fold"] == fold]
            if len(rest):
                x, n, s, _ = _cells_of(_together(rest))
                own, m, t, q = _cells_of(held)
                guess = grow(x, n, s, space[draw], seed).predict(own)
                out.append((name, fee, draw, int(fold), int(m.sum()), float((q - 2 * guess * t + guess ** 2 * m).sum() / m.sum())))
        return pd.DataFrame(out, columns=["model_name", "fee_type", "draw", "fold", "rows", "mse"])

    tasks = draws * len(lookbacks) * len(fees)
    return cells.repartition(tasks, "model_name", "fee_type", "draw").groupBy("model_name", "fee_type", "draw").applyInPandas(score, SCORE)


def search_forest(df: DataFrame, draws: int = 20, folds: int = 5, lookbacks: dict[str, str] | None = None,
                  fees: list[str] = FEES, seed: int = 42) -> DataFrame:
    """Random search: best settings per lookback and fee by the mean over folds of the mean squared error (the earlier draw of equal ones)."""
    means = score_forests(df, draws, folds, lookbacks, fees, seed).groupBy("model_name", "fee_type", "draw").agg(F.avg("mse").alias("mse"))
    best = means.groupBy("model_name", "fee_type").agg(F.min(F.struct("mse", "draw")).alias("best"))
    table = [(i, s.trees, s.depth, str(s.features), s.leaf, s.split, s.bootstrap) for i, s in enumerate(drawn_settings(draws, seed))]
    settings = df.sparkSession.createDataFrame(table, "draw int, trees int, depth int, features string, leaf int, split int, bootstrap boolean")
    return best.select("model_name", "fee_type", "best.draw", "best.mse").join(settings, "draw").select(
        "model_name", "fee_type", "trees", "depth", "features", "leaf", "split", "bootstrap", "mse")


def found_settings(best: DataFrame) -> dict[tuple[str, str], Forest]:
    """Settings to train with from the rows of a search (one per lookback and fee)."""
    def share(text: str) -> str | float:
        return text if text in ("sqrt", "log2") else float(text)

    return {(r["model_name"], r["fee_type"]): Forest(r["trees"], r["depth"], share(r["features"]), r["leaf"], r["split"], r["bootstrap"]) for r in best.collect()}
