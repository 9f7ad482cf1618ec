"""Decision trees and forests, grown level by level from histograms summed over partitions.

Inputs are cut into ``BINS`` bins of equal width between their smallest and largest training value. A node sends the bins up to t of one
input to the left; of all splits that leave rows on both sides the one with the largest sum over both sides of sum(c_k^2) / c is taken
(c_k rows of class k among c: the lowest Gini impurity), the first input and then the first t on ties. A node is a leaf when it is pure, at the depth limit, or when
no split is better than none. In a forest each tree has its own resample of the rows (``resample``: tree t is replicate t) and each node looks at
ceil(sqrt(inputs)) inputs, those with the lowest hash of (seed, tree, node, input). Trees vote with the class shares of their leaves.

One-vs-rest is one forest: tree number = class x trees + t, with "is this class" as its label.

Rows keep their place: a pass sends the nodes out, and tasks send back counts by (tree, node, input, bin, class), which are added and
searched where they meet; the driver holds nodes only. A pass takes as many nodes as ``TOGETHER`` counts allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.operators.ranking import order_hash, ordered_scan
from twinlens.operators.resample import MASK, mix, row_counts
from twinlens.plans.train import matrix
from twinlens.session import stored

BINS = 32
#: Counts (8 bytes each) that a task holds in one pass.
TOGETHER = 4_000_000
#: A split must be better than none by this much.
GAIN = 1e-9


@dataclass
class Forest:
    """Nodes by (tree, number): the root is 1, the children of i are 2 i and 2 i + 1. ``classes`` are the labels a tree tells apart."""

    low: np.ndarray
    high: np.ndarray
    trees: int
    classes: int
    per_class: bool
    splits: dict[int, dict[int, tuple[int, int]]] = field(default_factory=dict)
    leaves: dict[int, dict[int, np.ndarray]] = field(default_factory=dict)

    def places(self, bins: np.ndarray, tree: int) -> np.ndarray:
        """The number of the node where each row ends."""
        at, split = np.ones(len(bins), np.int64), self.splits.get(tree, {})
        todo = np.arange(len(bins))
        while len(todo):
            nodes, which = np.unique(at[todo], return_inverse=True)
            known = [split.get(int(k)) for k in nodes]
            on = np.array([k is not None for k in known])[which]
            inputs, cuts = (np.array([k[i] if k else 0 for k in known])[which[on]] for i in (0, 1))
            todo = todo[on]
            at[todo] = 2 * at[todo] + (bins[todo, inputs] > cuts)
        return at

    def shares(self, bins: np.ndarray) -> np.ndarray:
        """(rows, classes): mean over trees of the class shares of the leaves; with ``per_class`` those of "is this class"."""
        out = np.zeros((len(bins), self.classes))
        for tree in range(self.trees * (self.classes if self.per_class else 1)):
            nodes, which = np.unique(self.places(bins, tree), return_inverse=True)
            share = np.array([self.leaves[tree][int(k)] for k in nodes])
            share = (share / share.sum(1, keepdims=True))[which]
            if self.per_class:
                out[:, tree // self.trees] += share[:, 1]
            else:
                out += share
        return out / self.trees

    def predict(self, rows: DataFrame, vector: str, keep: list[str]) -> DataFrame:
        """``keep`` plus ``y_pred``: the class of the largest share (to 9 digits), the lowest one on ties."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    one = shared.value
                    guess = np.round(one.shares(binned(matrix(b, "__v"), one.low, one.high)), 9).argmax(1)
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(guess.astype(np.int32))], [*b.schema.names[:-1], "y_pred"])

        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
        return rows.select(*keep, F.col(vector).cast("array<double>").alias("__v")).mapInArrow(run, f"{kept}, y_pred int")


def binned(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    width = np.where(high > low, high - low, 1.0)
    return np.clip(np.floor((x - low) / width * BINS), 0, BINS - 1).astype(np.int64)


def chosen_inputs(seed: int, tree: int, node: int, inputs: int, some: int) -> np.ndarray:
    """The inputs that a node looks at, in order."""
    if some >= inputs:
        return np.arange(inputs)
    h = np.full(inputs, 3, np.uint64)
    for word in (seed, tree, node, np.arange(inputs)):
        h = mix((h * np.uint64(31) + np.asarray(word, np.uint64)) & np.uint64(MASK))
    return np.sort(np.lexsort((np.arange(inputs), h))[:some])


def _limits(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("i").collect()
    return np.array([r["low"] for r in found]), np.array([r["high"] for r in found])


def best_split(hist: np.ndarray) -> tuple[float, int, int] | None:
    """(score, input, t) of counts (inputs, bins, classes); None if no split leaves rows on both sides."""
    left = hist.cumsum(1)
    right = left[:, -1:, :] - left
    a, b = left.sum(2), right.sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left * left).sum(2) / a + (right * right).sum(2) / b
    score[(a == 0) | (b == 0)] = -np.inf
    at = int(score.argmax())
    i, t = divmod(at, hist.shape[1])
    return None if np.isneginf(score[i, t]) else (float(score[i, t]), i, t)


def grow(train: DataFrame, key: str, vector: str, label: str, trees: int = 1, depth: int = 12, per_class: bool = False, resample: bool = False, seed: int = 42) -> Forest:
    """A tree, or a forest with ``resample``, of rows with a vector and a class number (0 ... C - 1), none of them null."""
    base = train.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
    numbered = ordered_scan(base.withColumn("__h", order_hash("row", F.col("key"))), [], ["__h", "key"], {"row": F.lit(1)})
    rows = stored(numbered.select("row", F.col("row_all").alias("n"), "x", "y"), "tree_rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("c"), F.max(F.size("x")).alias("d")).first()
    low, high = _limits(rows)
    inputs, classes = size["d"], size["c"] + 1
    forest, sides = Forest(low, high, trees, classes, per_class), 2 if per_class else classes
    numbers = range(trees * (classes if per_class else 1))
    some = int(np.ceil(np.sqrt(inputs))) if resample else inputs

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row = b.column("row").to_numpy()
                bins = binned(matrix(b, "x"), low, high).astype(np.int8)
                order, back = np.unique(row, return_inverse=True)
                weight = row_counts(size["n"], order, np.arange(trees), seed)[:, back].T if resample else np.ones((len(row), trees), np.int64)
                lists = [pa.array(list(m.astype(kind))) for m, kind in ((bins, np.int8), (weight, np.int32))]
                yield pa.RecordBatch.from_arrays([b.column("y"), *lists], ["y", "bins", "w"])

    data = stored(rows.mapInArrow(prepared, "y int, bins array<tinyint>, w array<int>"), "binned")
    # a root that is no leaf has been split by nothing yet
    open_ = [(t, 1) for t in numbers]
    for level in range(depth + 1):
        if not open_:
            break
        width = some * BINS * sides
        step = max(1, TOGETHER // width)
        found = []
        for start in range(0, len(open_), step):
            found += _searched(data, forest, open_[start : start + step], inputs, some, sides, seed)
        open_ = []
        for tree, node, counts, split in found:
            better = split and split[0] > (counts.astype(float) ** 2).sum() / counts.sum() + GAIN
            if level < depth and better and (counts > 0).sum() > 1:
                forest.splits.setdefault(tree, {})[node] = split[1:]
                open_ += [(tree, 2 * node), (tree, 2 * node + 1)]
            else:
                forest.leaves.setdefault(tree, {})[node] = counts.astype(float)
    return forest


def _searched(data: DataFrame, forest: Forest, nodes: list[tuple[int, int]], inputs: int, some: int, sides: int, seed: int) -> list[tuple[int, int, np.ndarray, tuple | None]]:
    """(tree, node, class counts, best split) of each of the nodes."""
    shared = data.sparkSession.sparkContext.broadcast((forest, nodes))
    trees, shape = forest.trees, (some, BINS, sides)

    def partial(batches):
        one, wanted = shared.value
        by: dict[int, np.ndarray] = {}
        for t, k in wanted:
            by[t] = np.append(by.get(t, np.empty(0, np.int64)), k)
        by = {t: np.sort(asked) for t, asked in by.items()}
        own = {t: np.array([chosen_inputs(seed, t, int(k), inputs, some) for k in asked]) for t, asked in by.items()}
        sums = {t: np.zeros(len(asked) * some * BINS * sides) for t, asked in by.items()}
        for b in batches:
            if not b.num_rows:
                continue
            bins, w, y = matrix(b, "bins").astype(np.int64), matrix(b, "w").astype(np.int64), b.column("y").to_numpy()
            for t, asked in by.items():
                at = one.places(bins, t)
                place = np.minimum(np.searchsorted(asked, at), len(asked) - 1)
                mine = np.flatnonzero((asked[place] == at) & (w[:, t % trees] > 0))
                label = (y == t // trees).astype(np.int64) if one.per_class else y
                node = place[mine]
                cell = ((node[:, None] * some + np.arange(some)) * BINS + bins[mine[:, None], own[t][node]]) * sides + label[mine, None]
                sums[t] += np.bincount(cell.ravel(), np.repeat(w[mine, t % trees], some), len(sums[t]))
        for t, asked in by.items():
            parts = sums[t].reshape(len(asked), -1)
            kept = np.flatnonzero(parts.any(1))
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), t, np.int32)), pa.array(asked[kept]), pa.array([parts[i].tobytes() for i in kept], pa.binary())], ["tree", "node", "v"])

    def searched(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for t, k, v in zip(b.column("tree").to_pylist(), b.column("node").to_pylist(), b.column("v")):
                x = np.frombuffer(v.as_py())
                sums[t, k] = sums[t, k] + x if (t, k) in sums else x
        for (t, k), x in sums.items():
            hist = x.reshape(shape)
            split = best_split(hist)
            own = chosen_inputs(seed, t, k, inputs, some)
            out = [*(split[:1] if split else [None]), int(own[split[1]]) if split else None, split[2] if split else None]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([z], kind) for z, kind in zip([t, k, hist[0].sum(0).tolist(), *out], kinds)], ["tree", "node", "counts", "score", "input", "cut"])

    parts = data.mapInArrow(partial, "tree int, node long, v binary").repartition("tree", "node")
    found = parts.mapInArrow(searched, "tree int, node long, counts array<double>, score double, input int, cut int").collect()
    shared.destroy()
    rows = [(r["tree"], r["node"], np.array(r["counts"]), None if r["score"] is None else (r["score"], r["input"], r["cut"])) for r in found]
    return sorted(rows, key=lambda r: r[:2])
