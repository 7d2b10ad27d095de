import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.operators import graph, nearest

COLUMNS = ["v", "w", "x", "y", "z"]


def rows(n: int) -> list[tuple[float, ...]]:
    """Points whose three columns with the most values are one and the same, as times of one-time addresses are; two other columns tell them apart."""
    rng = random.Random(n)
    out = []
    for i in range(n):
        t = (i % 97) / 97 + i * 1e-9
        out.append((t, t, t, float(rng.randrange(40)) / 9, float(rng.randrange(40)) / 9))
    return out


def plain(x: np.ndarray, k: int) -> np.ndarray:
    gap = sum((x[:, c][:, None] - x[:, c][None, :]) ** 2 for c in range(x.shape[1]))
    np.fill_diagonal(gap, np.inf)
    return np.sort(gap, axis=1)[:, k - 1]


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_gaps_over_many_leaves(spark, k):
    points = rows(900) + [(90.0, -90.0, 5.0, 0.0, 0.0)]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, " + ", ".join(f"{c} double" for c in COLUMNS))
    for sample in (nearest.SAMPLE_ROWS, 100):
        got = {r.id: r.gap for r in nearest.nearest_gaps(table, COLUMNS, len(points), k, 32, sample).collect()}
        assert got == dict(enumerate(plain(np.array(points), k).tolist()))


def test_a_point_meets_few_others():
    """Every point looks into a few leaves, however alike the widest columns are."""
    x = np.array(rows(6000))
    tree = nearest.cuts(x, 64)
    leaf = tree.leaf_of(x)
    for at in np.unique(leaf):
        tree.low[at], tree.high[at] = x[leaf == at].min(axis=0), x[leaf == at].max(axis=0)
    for node in range(len(tree.axis) - 1, -1, -1):
        if tree.axis[node] >= 0:
            tree.low[node], tree.high[node] = tree.low[tree.child[node]].min(axis=0), tree.high[tree.child[node]].max(axis=0)
    row, found = tree.within(x, plain(x, 1))
    size = np.bincount(leaf, minlength=len(tree.axis))
    assert size.max() <= 64 and size[found].sum() < 400 * len(x) and set(zip(range(len(x)), leaf)) <= set(zip(row, found))


def test_reach_of_points_without_numbers_between(spark):
    df = spark.createDataFrame([(float(i), 0) for i in range(50)], "x double, y int")
    assert {r.gap for r in graph.neighbour_distances(df, ["x", "y"]).collect()} == {1.0}
    assert graph.neighbour_distances(df.where(F.col("x") < 1), ["x", "y"]).count() == 0
