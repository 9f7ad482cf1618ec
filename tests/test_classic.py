"""Trees, linear models and principal components against plain second computations."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from twinlens.operators.resample import row_counts
from twinlens.plans import classic as K
from twinlens.plans import linear as L
from twinlens.plans import trees as T


def table(spark, n=90, inputs=5, classes=3, parts=3):
    rng = np.random.default_rng(n)
    y = rng.integers(0, classes, n)
    x = np.round(rng.normal(size=(n, inputs)) + y[:, None] * np.linspace(0, 1, inputs), 2)
    x[:, 0] = 1.5  # a constant input
    rows = [(int(i), int(c), [float(v) for v in r], "s") for i, (c, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id long, y int, vec array<double>, tree string").repartition(parts), x, y


def walk(x, y, w, chosen, depth, node=1, level=0):
    """A tree as nested tuples, by trying every split of every input."""
    classes = int(y.max()) + 1 if level == 0 else chosen["classes"]
    chosen["classes"] = classes
    counts = np.bincount(y, w, classes)
    best = (sum(c * c for c in counts) / counts.sum() + T.GAIN, None)
    if level < depth and (counts > 0).sum() > 1:
        for i in chosen["of"](node):
            for t in sorted(set(x[w > 0, i]))[:-1]:
                left, right = np.bincount(y[x[:, i] <= t], w[x[:, i] <= t], classes), np.bincount(y[x[:, i] > t], w[x[:, i] > t], classes)
                score = sum(c * c for c in left) / left.sum() + sum(c * c for c in right) / right.sum()
                if score > best[0]:
                    best = (score, (int(i), int(t)))
    if best[1] is None:
        return counts / counts.sum()
    i, t = best[1]
    side = x[:, i] <= t
    return (i, t, walk(x[side], y[side], w[side], chosen, depth, 2 * node, level + 1), walk(x[~side], y[~side], w[~side], chosen, depth, 2 * node + 1, level + 1))


def share(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize(("depth", "resample", "together"), [(3, False, 4_000_000), (12, False, 1), (4, True, 300)])
def test_trees_against_all_splits(spark, monkeypatch, depth, resample, together):
    """Also with a pass for every few nodes, and as a forest of resampled rows and chosen inputs."""
    monkeypatch.setattr(T, "TOGETHER", together)
    df, x, y = table(spark)
    trees = 3 if resample else 1
    forest = T.grow(df, "id", "vec", "y", trees, depth, False, resample)
    bins = T.binned(x, forest.low, forest.high)
    assert bins.min() == 0 and bins.max() == T.BINS - 1 and (bins[:, 0] == 0).all()
    order = [r["id"] for r in df.orderBy(F.md5(F.concat_ws("|", F.lit("row"), F.col("id").cast("string"))), "id").collect()]
    want = np.zeros((len(y), 3))
    for t in range(trees):
        w = np.ones(len(y))
        if resample:
            w[order] = row_counts(len(y), np.arange(len(y)), np.array([t]), 42)[0]
        some = 3 if resample else 5
        tree = walk(bins[w > 0], y[w > 0], w[w > 0], {"of": lambda k, t=t: T.chosen_inputs(42, t, k, 5, some)}, depth)
        want += np.array([share(tree, b) for b in bins])
    assert np.allclose(forest.shares(bins), want / trees)
    got = {r["id"]: r["y_pred"] for r in forest.predict(df, "vec", ["id"]).collect()}
    assert [got[i] for i in range(len(y))] == np.round(want / trees, 9).argmax(1).tolist()


def test_one_vs_rest_forest_is_one_forest_for_each_class(spark):
    df, x, y = table(spark, n=40)
    forest = T.grow(df, "id", "vec", "y", 2, 12, True, True)
    bins = T.binned(x, forest.low, forest.high)
    for c in range(3):
        alone = T.grow(df.withColumn("y", (F.col("y") == c).cast("int")), "id", "vec", "y", 2, 12, False, False)
        assert alone.classes == 2 and np.allclose(alone.shares(bins)[:, 1], y == c)
    assert forest.shares(bins).shape == (40, 3) and (forest.shares(bins).argmax(1) == y).mean() > 0.8


def test_a_tree_of_one_class_is_a_leaf(spark):
    df, _, _ = table(spark, n=10)
    forest = T.grow(df.withColumn("y", F.lit(1)), "id", "vec", "y")
    assert not forest.splits and {r["y_pred"] for r in forest.predict(df, "vec", ["id"]).collect()} == {1}


def objective(loss, w, x, y):
    z = x @ w[:-1] + w[-1]
    hot = np.eye(z.shape[1])[y]
    side = 2 * hot - 1
    value = {
        "logistic": lambda: np.logaddexp(0, -side * z).sum(1),
        "softmax": lambda: np.logaddexp.reduce(z, axis=1) - (z * hot).sum(1),
        "hinge": lambda: (np.maximum(0, 1 - side * z) ** 2).sum(1),
    }[loss]()
    return value.mean() + (w[:-1] ** 2).sum() / (2 * len(x))


@pytest.mark.parametrize("loss", ["logistic", "softmax", "hinge"])
def test_linear_models_reach_the_minimum(spark, loss):
    df, x, y = table(spark, n=120)
    model = L.fit(df, "vec", "y", loss, 160 if loss == "softmax" else 70)
    at = objective(loss, model.weights, x, y)
    rng = np.random.default_rng(0)
    # the slope vanishes, by differences, and no step around is better by more than rounding
    for _ in range(20):
        step = rng.normal(size=model.weights.shape)
        ahead, back = objective(loss, model.weights + 1e-4 * step, x, y), objective(loss, model.weights - 1e-4 * step, x, y)
        assert abs(ahead - back) / 2e-4 < 0.02 and min(ahead, back) > at - 1e-6
    few = [L.fit(d, "vec", "y", loss, 3).weights for d in (df, df.repartition(7))]
    assert np.allclose(*few)
    got = {r["id"]: r["y_pred"] for r in model.predict(df, "vec", ["id"]).collect()}
    assert [got[i] for i in range(120)] == np.round(x @ model.weights[:-1] + model.weights[-1], 9).argmax(1).tolist()


def test_principal_axes_are_uncorrelated_and_hold_the_variance(spark, monkeypatch):
    monkeypatch.setattr(K, "ROWS_TOGETHER", 2)
    df, x, _ = table(spark, n=70)
    centre, values, axes = K.principal_axes(df, "vec")
    cov = np.cov(x.T)
    assert np.allclose(centre, x.mean(0)) and np.allclose(axes.T @ axes, np.eye(5)) and np.allclose(axes.T @ cov @ axes, np.diag(values), atol=1e-12)
    assert values.sum() == pytest.approx(np.trace(cov)) and (np.diff(values) <= 0).all()
    rows = K.principal_components(df, df, "vec", 2, ["id", "y"]).collect()
    scores = np.array([r["components"] for r in sorted(rows, key=lambda r: r["id"])])
    assert np.allclose(scores, (x - x.mean(0)) @ axes[:, :2]) and np.allclose(np.cov(scores.T), np.diag(values[:2]), atol=1e-12)


def test_jacobi_on_odd_matrices():
    for a in (np.zeros((3, 3)), np.eye(4), np.array([[2.0]]), np.ones((5, 5)), np.diag([1.0, 3.0, 2.0])):
        values, axes = K.jacobi(a)
        assert np.allclose(axes @ np.diag(values) @ axes.T, a) and np.allclose(axes.T @ axes, np.eye(len(a)))
    assert math.isclose(K.jacobi(np.ones((5, 5)))[0][0], 5)
