"""Classic classifiers on embedding features: trees, forests and linear models fitted over partitions, an exact
nearest-neighbour vote by pruned blocks, and principal components by sums of products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinlens.operators import metrics as M
from twinlens.operators.sampling import fixed_sample
from twinlens.plans.linear import fit
from twinlens.plans.train import matrix
from twinlens.plans.trees import grow
from twinlens.session import collect_few, small_side, stored

OVR_MODELS = ("random_forest", "logistic", "svm")
BENCH_MODELS = ("random_forest", "decision_tree", "logistic", "knn", "svm")


def fitted(name: str, train: DataFrame, vector: str, label: str, key: str, per_class: bool, seed: int = 42, trees: int = 100, max_iter: int = 100, depth: int = 12):
    """A trained model. ``per_class`` makes one binary problem of each class; the kernel machine has no distributed form, so the
    linear one with squared hinge stands in for it, which is always one problem for each class."""
    if name == "random_forest":
        return grow(train, key, vector, label, trees, depth, per_class, True, seed)
    if name == "decision_tree":
        return grow(train, key, vector, label, 1, depth, per_class, False, seed)
    return fit(train, vector, label, "hinge" if name == "svm" else "logistic" if per_class else "softmax", max_iter)


def one_vs_rest_models(train: DataFrame, test: DataFrame, vector: str, label: str, key: str, models=OVR_MODELS, seed: int = 42, **options) -> DataFrame:
    """(model, key, y_true, y_pred): every model as one binary classifier per class, all classes in the same passes.

    ``options``: trees, max_iter, depth.
    """
    out = None
    for name in models:
        one = fitted(name, train, vector, label, key, True, seed, **options).predict(test, vector, [key, label])
        one = one.select(F.lit(name).alias("model"), key, F.col(label).cast("int").alias("y_true"), "y_pred")
        out = one if out is None else out.unionByName(one)
    return out


def model_bench(train: DataFrame, test: DataFrame, vector: str, label: str, key: str, models=BENCH_MODELS, seed: int = 42, **options) -> DataFrame:
    """(model, n, accuracy, weighted precision / recall / F1, macro_f1) of five models."""
    out = None
    for name in models:
        if name == "knn":
            votes = knn(train, test, key, vector, label)
            one = votes.join(test.select(key, label), key).withColumn("y_pred", F.col("vote").cast("int"))
        else:
            one = fitted(name, train, vector, label, key, False, seed, **options).predict(test, vector, [key, label])
        one = one.select(F.lit(name).alias("model"), F.col(label).cast("int").alias("y_true"), "y_pred")
        out = one if out is None else out.unionByName(one)
    return M.summary(M.confusion(out, groups=["model"]), ["model"])


# Nearest neighbours

MOST_PIVOTS = 4096
#: Numbers of the largest array that a task makes at a time.
TOGETHER = 1 << 20


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Runs of rows of at most ``TOGETHER`` numbers, one row at least."""
    step = max(1, TOGETHER // max(1, width))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def _closest(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the k rows of x nearest to each row of q, the earlier ones among equals. Distances are made for some rows of q at a time."""
    place = np.empty((len(q), min(k, len(x))), np.int64)
    distance = np.empty(place.shape)
    for part in _slices(len(q), len(x)):
        d = np.round(np.sqrt(_squared(q[part], x)), 9)
        place[part] = d.argsort(axis=1, kind="stable")[:, :k]
        distance[part] = np.take_along_axis(d, place[part], 1)
    return place, distance


def _open_cells(v: np.ndarray, own: np.ndarray, bound: np.ndarray, pivots: np.ndarray, radius: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, cell) of the visits of ``_other_cells``, some at a time."""
    for part in _slices(len(v), len(pivots)):
        d = np.sqrt(_squared(v[part], pivots))
        # distances are rounded to 9 digits
        open_ = (d - radius <= bound[part, None] + 2e-9) & (sizes > 0)
        open_[np.arange(len(d)), own[part]] = False
        row, cell = np.nonzero(open_)
        # a visit takes its row's vector along
        for some in _slices(len(row), v.shape[1]):
            yield row[some] + part.start, cell[some].astype(np.int32)


def _in_cells(df: DataFrame, cols: Sequence[str], pivots: np.ndarray) -> DataFrame:
    """Adds ``cell``, the nearest pivot, and ``reach``, the distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            if b.num_rows:
                v = matrix(b, "__v")
                cell, reach = np.empty(len(v), np.int32), np.empty(len(v))
                for part in _slices(len(v), len(shared.value)):
                    d = np.sqrt(_squared(v[part], shared.value))
                    cell[part], reach[part] = d.argmin(1), d.min(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(reach)], [*b.schema.names, "cell", "reach"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*cols).schema)
    return df.select(*cols, "__v").mapInArrow(run, f"{kept}, __v array<double>, cell int, reach double")


def _other_cells(test: DataFrame, key: str, pivots: np.ndarray, radius: np.ndarray, sizes: np.ndarray) -> DataFrame:
    """(key, vector, cell): the cells, besides the row's own, that can hold a row as near as its ``bound``. A cell whose closest
    possible row is farther cannot."""
    shared = test.sparkSession.sparkContext.broadcast((pivots, radius, sizes))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            own, bound = (b.column(c).to_numpy() for c in ("cell", "bound"))
            for row, cell in _open_cells(matrix(b, "__v"), own, bound, *shared.value):
                out = b.select([key, "__v"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell)], [*out.schema.names, "cell"])

    kind = test.schema[key].dataType.simpleString()
    return test.select(key, "__v", "cell", "bound").mapInArrow(run, f"{key} {kind}, __v array<double>, cell int")


def _nearest(placed: DataFrame, visits: DataFrame, key: str, k: int, block: int) -> DataFrame:
    """(key, neighbour, label, distance): for each visit the k nearest training rows of a part of its cell, at least.

    Each cell is cut by its own counts, into parts of about ``block`` rows on both sides: a training row is copied once for each ``block`` visits of its cell, and
    not at all if there are none. A task compares two parts as matrices, some visits at a time, and emits k rows for each visit, never the pairs. Ties go to the smaller key."""
    cuts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("tcut"))
    cuts = cuts.join(visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("qcut")), "cell")
    # one row for each cell
    cuts = small_side(cuts)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(cuts, "cell").select("cell", part("neighbour", "tcut").alias("tb"), parts("qcut").alias("qb"), "neighbour", "label", "__v")
    right = visits.join(cuts, "cell").select("cell", parts("tcut").alias("tb"), part(key, "qcut").alias("qb"), key, "__v")
    on = ["cell", "tb", "qb"]
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([b.schema.field(key), a.schema.field("neighbour"), a.schema.field("label"), pa.field("distance", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        a, b = a.sort_by("neighbour").combine_chunks(), b.combine_chunks()
        x, q = matrix(a.to_batches()[0], "__v"), matrix(b.to_batches()[0], "__v")
        top, distance = _closest(q, x, k)
        rows = np.repeat(np.arange(len(q)), top.shape[1])
        near = a.select(["neighbour", "label"]).take(pa.array(top.ravel()))
        cols = [b.column(key).take(pa.array(rows)), near.column("neighbour"), near.column("label"), pa.array(distance.ravel())]
        return pa.Table.from_arrays(cols, schema=schema)

    kind = visits.schema[key].dataType.simpleString()
    out = f"{key} {kind}, neighbour {kinds['neighbour']}, label {kinds['label']}, distance double"
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(nearest, out)


def _ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    # Spark keeps only k rows per test row before the shuffle of this window
    rank = F.row_number().over(W.partitionBy(key).orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn_neighbours(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, k: int = 5, pivots: int | None = None, block: int = 4096) -> DataFrame:
    """(key, neighbour, label, distance, rank): the exact k nearest training rows.

    Training rows fall into cells around sampled pivots, by default the square root of their number (``MOST_PIVOTS`` at most, all of
    which a task holds). A test row first looks into its own cell; the k-th distance there bounds the one looked for, so that of the other cells it visits
    only those that the triangle inequality cannot exclude. Both passes join blocks of cells (see ``_nearest``).
    """
    tr = train.select(F.col(key).alias("neighbour"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("__v"))
    te = test.select(key, F.col(vector).cast("array<double>").alias("__v"))
    wanted = pivots or int(min(MOST_PIVOTS, max(16, np.ceil(np.sqrt(train.count())))))
    chosen = np.array([r["__v"] for r in fixed_sample(tr, "neighbour", wanted).select("__v").collect()])
    placed = stored(_in_cells(tr, ["neighbour", "label"], chosen), "cells")
    radius, sizes = np.zeros(len(chosen)), np.zeros(len(chosen), dtype=np.int64)
    for r in collect_few(placed.groupBy("cell").agg(F.max("reach").alias("m"), F.count(F.lit(1)).alias("n")), len(chosen)):
        radius[r["cell"]], sizes[r["cell"]] = r["m"], r["n"]
    home = stored(_in_cells(te, [key], chosen).select(key, "__v", "cell"), "home")
    first = stored(_ranked(_nearest(placed, home, key, k, block), key, k).drop("rank"), "first")
    limit = first.groupBy(F.col(key).alias("__k")).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
    bounded = home.join(limit, F.col(key) == F.col("__k"), "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    visits = stored(_other_cells(bounded, key, chosen, radius, sizes), "visits")
    return _ranked(first.unionByName(_nearest(placed, visits, key, k, block)), key, k)


def knn(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, k: int = 5, **options) -> DataFrame:
    """(key, vote): majority label of the k nearest rows, the smallest label on ties."""
    votes = knn_neighbours(train, test, key, vector, label, k, **options).groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select(key, F.col("b.label").alias("vote"))


# Principal components

#: Rows of the product matrix that travel together.
ROWS_TOGETHER = 64
SWEEPS, SMALL = 60, 1e-15


def vector_mean(df: DataFrame, vector: str) -> tuple[np.ndarray, int]:
    """(mean of a list column, rows)."""
    found = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n")).collect()
    out = np.zeros(len(found))
    for r in found:
        out[r["i"]] = r["x"] / r["n"]
    return out, found[0]["n"] if found else 0


def product_sums(df: DataFrame, vector: str, centre: np.ndarray) -> np.ndarray:
    """Sum over all rows of (x - centre) (x - centre)', added up on the executors: a task sends its matrix in bands of rows, a
    band is added in one place, and the driver gets each band once."""
    size, shared = len(centre), df.sparkSession.sparkContext.broadcast(centre)

    def partial(batches):
        total = np.zeros((size, size))
        for b in batches:
            if b.num_rows:
                x = matrix(b, "__v") - shared.value
                total += x.T @ x
        for i in range(0, size, ROWS_TOGETHER):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i : i + ROWS_TOGETHER].tobytes()], pa.binary())], ["band", "v"])

    def added(batches):
        bands: dict[int, np.ndarray] = {}
        for b in batches:
            for band, v in zip(b.column("band").to_pylist(), b.column("v")):
                x = np.frombuffer(v.as_py())
                bands[band] = bands[band] + x if band in bands else x
        for band, x in bands.items():
            yield pa.RecordBatch.from_arrays([pa.array([band], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["band", "v"])

    kind = "band int, v binary"
    parts = df.select(F.col(vector).cast("array<double>").alias("__v")).mapInArrow(partial, kind).repartition("band").mapInArrow(added, kind)
    out = np.zeros((size, size))
    for r in parts.collect():
        rows = np.frombuffer(r["v"]).reshape(-1, size)
        out[r["band"] : r["band"] + len(rows)] += rows
    return out


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors as columns) of a symmetric matrix by cyclic Jacobi rotations, until what is left
    beside the diagonal is ``SMALL`` of the whole. Of a vector the largest entry (the first of equal ones) is positive."""
    a, v = a.copy(), np.eye(len(a))
    whole = np.sqrt((a * a).sum())
    for _ in range(SWEEPS):
        if np.sqrt(max(0.0, (a * a).sum() - (np.diag(a) ** 2).sum())) <= SMALL * whole:
            break
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if abs(a[i, j]) <= SMALL * SMALL * whole:
                    continue
                tau = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1.0 if tau >= 0 else -1.0) / (abs(tau) + np.sqrt(1 + tau * tau))
                c = 1 / np.sqrt(1 + t * t)
                turn = np.array([[c, t * c], [-t * c, c]])
                a[:, [i, j]] = a[:, [i, j]] @ turn
                a[[i, j]] = turn.T @ a[[i, j]]
                v[:, [i, j]] = v[:, [i, j]] @ turn
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    lead = np.abs(v).argmax(0)
    return np.diag(a)[order], v * np.where(v[lead, np.arange(len(a))] < 0, -1.0, 1.0)


def principal_axes(train: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, variances, axes as columns) of all components of the training rows; variances divide by n - 1."""
    centre, n = vector_mean(train, vector)
    values, axes = jacobi(product_sums(train, vector, centre) / max(1, n - 1))
    return centre, values, axes


def principal_components(train: DataFrame, other: DataFrame, vector: str, k: int, keep: Sequence[str]) -> DataFrame:
    """``keep`` plus ``components`` of ``other``: axes and centre come from ``train`` only. Vectors must not be null and have one length; the
    driver holds one matrix of length x length."""
    centre, _, axes = principal_axes(train, vector)
    shared = other.sparkSession.sparkContext.broadcast((centre, axes[:, :k]))

    def run(batches):
        for b in batches:
            if b.num_rows:
                mean, way = shared.value
                flat = (matrix(b, "__v") - mean) @ way
                offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], [*b.schema.names[:-1], "components"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in other.select(*keep).schema)
    return other.select(*keep, F.col(vector).cast("array<double>").alias("__v")).mapInArrow(run, f"{kept}, components array<double>")
