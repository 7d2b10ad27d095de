"""Forests over cells, seasonal models from Gram matrices, their searches, and stored model sets."""

import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from blockloom.operators import forecast, forests, patterns, seasonal
from blockloom.plans.models import ModelStore, PatternStore

T0 = datetime(2024, 1, 1)


def noisy(spark, days, seed=1, step=1):
    """Hourly fees with a trend, a day and noise; now and then a missing fee and a time that comes twice."""
    draw = np.random.default_rng(seed)
    rows = []
    for h in range(0, 24 * days, step):
        base = 20 + 0.01 * h + 6 * math.sin(2 * math.pi * h / 24)
        fast = None if draw.random() < 0.03 else float(base + draw.normal())
        rows.append((T0 + timedelta(hours=h), fast, float(base / 2 + draw.normal()), 3.0))
        if draw.random() < 0.05:
            rows.append((T0 + timedelta(hours=h), float(base), 1.0, None))
    return spark.createDataFrame(rows, "timestamp timestamp, fast_fee double, medium_fee double, low_fee double")


# ---- forests ----------------------------------------------------------------


def best_split(x, n, s, leaf):
    """The best split of all cells by trying each: (gain, feature, threshold)."""
    found = (-1.0, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= a
            if n[left].sum() >= leaf and n[~left].sum() >= leaf:
                gain = s[left].sum() ** 2 / n[left].sum() + s[~left].sum() ** 2 / n[~left].sum() - s.sum() ** 2 / n.sum()
                if gain > found[0] + 1e-9:
                    found = (gain, f, (a + b) / 2)
    return found


def test_splits_are_the_best_ones():
    draw = np.random.default_rng(3)
    for leaf in (1, 4, 9):
        x = np.unique(draw.integers(0, 6, (40, 4)), axis=0).astype(float)
        n = draw.integers(1, 5, len(x))
        s = n * (x[:, 1] * 2 - x[:, 3] + draw.normal(size=len(x)))
        trees = forests.grow(x, n, s, forests.Forest(trees=1, features=1.0, leaf=leaf, depth=1, bootstrap=False))
        gain, feature, threshold = best_split(x, n, s, leaf)
        assert (trees.feature[0], trees.threshold[0]) == (feature, threshold) and len(trees.feature) == 3


def test_a_whole_tree_gives_cell_means_and_limits_hold():
    draw = np.random.default_rng(4)
    x = np.unique(draw.integers(0, 7, (80, 4)), axis=0).astype(float)
    n = draw.integers(1, 6, len(x))
    s = n * draw.normal(size=len(x))
    whole = forests.grow(x, n, s, forests.Forest(trees=3, features="sqrt", bootstrap=False))
    assert np.allclose(whole.predict(x), s / n)
    for settings in (forests.Forest(trees=5, depth=2, features=0.6), forests.Forest(trees=5, leaf=12, features="log2"), forests.Forest(trees=5, split=60)):
        trees = forests.grow(x, n, s, settings, 7)
        again = forests.grow(x, n, s, settings, 7)
        assert np.array_equal(trees.value, again.value) and np.array_equal(trees.feature, again.feature)
        for t in range(5):
            node, depth, todo = t, 0, [(t, 0, np.arange(len(x)))]
            while todo:
                node, depth, rows = todo.pop()
                if trees.feature[node] < 0:
                    assert settings.bootstrap or n[rows].sum() >= settings.leaf
                    continue
                assert settings.depth is None or depth < settings.depth
                left = x[rows, trees.feature[node]] <= trees.threshold[node]
                todo += [(trees.child[node], depth + 1, rows[left]), (trees.child[node] + 1, depth + 1, rows[~left])]
    assert forests.subset_size("sqrt", 4) == forests.subset_size("log2", 4) == forests.subset_size(0.6, 4) == 2 and forests.subset_size(1.0, 4) == 4


def test_folds_are_stretches_of_rows(spark):
    df = noisy(spark, 9)
    cells = forecast.fold_cells(df, {"all": "90d", "day": "24H"}, 5).toPandas()
    rows = df.toPandas().sort_values("timestamp", kind="stable")
    for name, keep in (("all", rows), ("day", rows[rows.timestamp >= rows.timestamp.max() - pd.Timedelta(hours=24)])):
        for fee in forecast.FEES:
            own = keep.dropna(subset=[fee]).reset_index(drop=True)
            first = own.groupby("timestamp")[fee].transform(lambda v: v.index.min())  # rows of a time go with the first of them
            sizes = [len(own) // 5 + (k < len(own) % 5) for k in range(5)]
            own["fold"] = np.searchsorted(np.cumsum(sizes), first, "right")
            got = cells[(cells.model_name == name) & (cells.fee_type == fee)].groupby("fold")[["n", "s", "q"]].sum()
            want = own.groupby("fold")[fee].agg(n="count", s="sum", q=lambda v: (v ** 2).sum())
            assert np.allclose(got.sort_index(), want.sort_index())


def test_errors_from_cells_are_errors_of_rows(spark):
    train, test = forecast.chrono_split(noisy(spark, 40), 0.8)
    models = forecast.train_forests(train, {"weekly": "4W"}, {}, seed=5).persist()
    got = {r.fee_type: r.mse for r in forecast.evaluate(models, test).collect()}
    rows = forecast.time_features(test).toPandas()
    for row in models.collect():
        trees = forests.Trees(row.trees, *(np.array(row[k]) for k in ("feature", "threshold", "child", "value")))
        own = rows.dropna(subset=[row.fee_type])
        error = ((own[row.fee_type] - trees.predict(own[forecast.TIME_FEATURES].to_numpy(float))) ** 2).mean()
        assert got[row.fee_type] == pytest.approx(error)
    models.unpersist()


def test_search_reports_the_smallest_mean_error(spark):
    df = noisy(spark, 30)
    lookbacks = {"day": "24H", "weekly": "2W"}
    scores = forecast.score_forests(df, 4, 3, lookbacks).toPandas()
    assert len(scores) == 2 * 3 * 4 * 3 and not scores.mse.isna().any()
    best = forecast.search_forest(df, 4, 3, lookbacks)
    means = scores.groupby(["model_name", "fee_type", "draw"]).mse.mean().groupby(["model_name", "fee_type"]).min()
    for row in best.collect():
        assert row.mse == pytest.approx(means[row.model_name, row.fee_type])
    settings = forecast.found_settings(best)
    assert set(settings) == set(itertools.product(lookbacks, forecast.FEES)) and set(settings.values()) <= set(forecast.drawn_settings(4))
    assert forecast.train_forests(df, lookbacks, settings).count() == 6


# ---- seasonal models --------------------------------------------------------


def sums_of(t, y, start, length):
    rows = np.column_stack([np.ones(len(t)), seasonal.features(t, start, length), y, np.log1p(y)])
    return rows.T @ rows


def history(days=120, seed=2):
    draw = np.random.default_rng(seed)
    t = T0.timestamp() + 3600.0 * np.arange(24 * days)
    y = 30 + 0.02 * np.arange(len(t)) + 5 * np.sin(2 * math.pi * t / 86400) + np.maximum(0, np.arange(len(t)) - 1500) * 0.03 + draw.normal(size=len(t))
    return t, y


def test_features_are_the_same_in_both_forms(spark):
    t, _ = history(3)
    df = spark.createDataFrame([(float(v),) for v in t], "t double")
    from pyspark.sql import functions as F
    got = np.array([r.f for r in df.select("t", seasonal.feature_array(F.col("t"), F.lit(float(t[0])), F.lit(5e5)).alias("f")).orderBy("t").collect()])
    assert np.allclose(got, seasonal.features(t, float(t[0]), 5e5), atol=1e-7)


def test_a_straight_model_is_least_squares():
    t, y = history()
    level, weights = seasonal.solve(sums_of(t, y, t[0], t[-1] - t[0]), [seasonal.STRAIGHT])
    slope, intercept = np.polyfit((t - t[0]) / (t[-1] - t[0]), y, 1)
    assert weights[0, 0] == pytest.approx(slope) and level[0] == pytest.approx(intercept) and not weights[0, 1:].any()


def test_solutions_meet_the_conditions_of_the_penalties():
    """At the solution the slope of the squared error balances the penalty of every term, for all settings at once."""
    t, y = history()
    settings = [seasonal.Seasonal(a, b, daily, weekly, False) for a in (0.001, 0.05, 0.2) for b in (0.1, 10.0) for daily in (True, False) for weekly in (True, False)]
    sums = sums_of(t, y, t[0], t[-1] - t[0])
    level, weights = seasonal.solve(sums, settings)
    x, scale, n = seasonal.features(t, t[0], t[-1] - t[0]), math.sqrt((y ** 2).mean()), len(t)
    for s, a, w in zip(settings, level, weights):
        left = (y - a - x @ w) / scale
        assert abs(left.mean()) < 1e-9
        on = seasonal.enabled(s)
        assert not w[~on].any()
        slope = x.T @ left / n
        assert abs(slope[0]) < 1e-5
        bound = max(abs(slope[j]) for j in range(1, 26) if on[j])
        for j in range(1, 26):
            if w[j]:
                assert abs(abs(slope[j]) - bound) < 0.05 * bound + 1e-5  # terms in use pull as much as the penalty allows
    default = seasonal.solve(sums, [seasonal.Seasonal()])
    assert ((y - default[0] - x @ default[1][0]) ** 2).mean() < 1.1  # the noise has a variance of one


def test_one_setting_alone_and_among_others():
    t, y = history(60)
    settings = seasonal.grid_points(seasonal.SEASONAL_GRID)[:40]
    sums = sums_of(t, y, t[0], t[-1] - t[0])
    level, weights = seasonal.solve(sums, settings)
    for i in (0, 17, 39):
        own = seasonal.solve(sums, [settings[i]])
        assert np.allclose(own[1][0], weights[i], atol=1e-4) and own[0][0] == pytest.approx(level[i], abs=1e-4)


def test_rolling_scores_equal_fits_of_each_cutoff(spark):
    t, y = history(90)
    df = spark.createDataFrame([(datetime.fromtimestamp(a), float(b), 0.0, None) for a, b in zip(t, y)], "timestamp timestamp, fast_fee double, medium_fee double, low_fee double")
    settings = {"default": seasonal.Seasonal(), "straight": seasonal.STRAIGHT, "log": seasonal.Seasonal(mode="multiplicative")}
    got = forecast.rolling_cv(df.repartition(5), "fast_fee", settings, 60, 10).toPandas()
    cuts = forecast.cutoffs(t[0], t[-1], 60 * 86400, 10 * 86400, 48 * 3600)
    assert len(cuts) == 3 and len(got) == 9
    for name, s in settings.items():
        for cut in cuts:
            on, test = t <= cut, (t > cut) & (t <= cut + 48 * 3600)
            level, weights = seasonal.solve(sums_of(t[on], y[on], t[0], cut - t[0]), [s])
            guess = seasonal.features(t[test], t[0], cut - t[0]) @ weights[0] + level[0]
            guess = np.expm1(guess) if s.mode == "multiplicative" else guess
            row = got[(got.model_name == name) & (got.cutoff == pd.Timestamp(datetime.fromtimestamp(cut)))].iloc[0]
            assert row.points == test.sum() and row.mape == pytest.approx(np.abs((y[test] - guess) / y[test]).mean(), rel=1e-4)


def test_search_tries_the_whole_grid_and_feeds_training(spark):
    t, y = history(85)
    df = spark.createDataFrame([(datetime.fromtimestamp(a), float(b), float(b) / 2, 1.0) for a, b in zip(t, y)], "timestamp timestamp, fast_fee double, medium_fee double, low_fee double").persist()
    found = forecast.search_lookbacks(df, {"very_short": "3d", "weekly": "365d"})
    assert found["very_short"] == (forecast.Seasonal(), [])
    best, scored = found["weekly"]
    assert len(scored) == 200 and best == min(scored, key=lambda p: p[1])[0] and best.daily  # yearly terms need more points
    models = forecast.train_seasonal(df, {"weekly": "365d"}, {"weekly": best})
    assert {r.daily for r in models.collect()} == {True} and models.count() == 3
    rows = forecast.forecast_seasonal(models, forecast.horizon(df, T0 + timedelta(days=85)), T0).collect()
    assert len(rows) == 48 and all(0 <= r.low_fee <= r.medium_fee <= r.fast_fee < 200 for r in rows)
    df.unpersist()


# ---- stored models ----------------------------------------------------------


def test_model_sets_are_reused_until_old_or_incomplete(spark, tmp_path):
    df = noisy(spark, 20)
    store, calls = ModelStore(spark, str(tmp_path / "models")), []

    def train(fees=forecast.FEES):
        calls.append(1)
        return forecast.train_forests(df, {"daily": "7D"}, {("daily", fee): forests.Forest(trees=3) for fee in fees}, fees)

    assert store.load("forest") is None
    first, fresh = store.current("forest", train, T0, names=["daily"])
    assert fresh and first.count() == 3
    again, fresh = store.current("forest", train, T0 + timedelta(hours=23), names=["daily"])
    assert not fresh and len(calls) == 1 and again.exceptAll(first).count() == 0
    _, fresh = store.current("forest", train, T0 + timedelta(hours=24), names=["daily"])
    assert fresh and len(calls) == 2
    store.save("forest", train(["fast_fee"]), T0 + timedelta(hours=25))
    assert store.gate("forest", T0 + timedelta(hours=25)).first().retrain  # two fees are missing
    assert store.current("forest", train, T0 + timedelta(hours=25), names=["daily"])[1]
    assert store.load("seasonal") is None and store.load("forest", 1).count() == 3
    train().write.parquet(str(tmp_path / "models/models/kind=forest/version=9"))  # a version without a manifest row does not count
    assert store.manifest("forest").agg({"number": "max"}).first()[0] == 4
    empty = train().limit(0)
    assert store.save("none", empty, T0) == 1 and store.load("none").count() == 0 and store.gate("none", T0).count() == 0


def test_pattern_store(spark, tmp_path):
    rows = [(d, h, 1.0 if h < 8 else 5.0 if h < 16 else 20.0) for d in range(7) for h in range(24)]
    grid = spark.createDataFrame(rows, "day_of_week_num int, hour_of_day int, avg_fee double")
    store = PatternStore(spark, str(tmp_path / "p"))
    assert store.load() is None
    model = patterns.kmeans_slots(grid, starts=2)
    assert store.save(model, T0) == 1 and store.save(model, T0) == 2
    key = ["day_of_week_num", "hour_of_day", "cluster_label"]
    assert store.load().assign(grid).select(*key).exceptAll(model.assign(grid).select(*key)).count() == 0
    check = patterns.cluster_checks(model, grid).first()
    assert (check.slots, check.misplaced, check.clusters, check.moved) == (168, 0, 3, 0)
