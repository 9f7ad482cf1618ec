"""Training and scoring of fusion heads over partitions.

Each step sends the parameters out once and gets sums back: rows never leave their
partition, and the driver holds only parameter-sized vectors. Training rows are written
once to the shared folder, laid out by batch, so a step reads only its batch and a lost
executor re-reads its files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.functions.columns import drop_missing
from twinlens.functions.vectors import argmax
from twinlens.operators import metrics as M
from twinlens.operators.sampling import fixed_sample, route_split
from twinlens.operators.sets import UnseenLabels
from twinlens.plans import heads as H
from twinlens.session import collect_few, scratch_path, stored

BETAS, ADAM_EPS, DECAY = (0.9, 0.999), 1e-8, 0.01
FAN_IN = 32


@dataclass(frozen=True)
class Options:
    method: str
    seed: int = 42
    epochs: int = 100
    batch_size: int = 4096
    lr: float = 3e-4
    patience: int = 5
    hidden: int = 128
    dropout: float = 0.2
    loss: str = "ce"  # "bce": multi-label, or one output with a positive weight
    optimizer: str = "adam"  # or "adamw"
    weighted: bool = True


@dataclass
class Model:
    spec: H.Spec
    labels: list[str]
    params: dict
    running: dict
    epochs_run: int = 0
    history: list[dict] = field(default_factory=list)

    def score(self, df: DataFrame, key: str = "sample_id", keep: Sequence[str] = ()) -> DataFrame:
        """``key`` and ``keep`` plus ``probs`` (and ``gates`` of the gated head)."""
        spec = self.spec
        shared = df.sparkSession.sparkContext.broadcast((self.params, H.scoring_moments(spec, self.running)))
        gated = spec.method == "gated_attention"
        kept = [c for c in (key, *keep)]
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*kept).schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            params, moments = shared.value
            for b in batches:
                if b.num_rows == 0:
                    continue
                one = H.Pass(spec, params, features(b), moments, scoring=True)
                z, extra = one.logits()
                p = 1 / (1 + np.exp(-z)) if spec.loss == "bce" else H.softmax(z)
                cols = [b.column(c) for c in kept] + [vectors(p)]
                names = [*kept, "probs"]
                if gated:
                    cols, names = [*cols, vectors(extra["gates"])], [*names, "gates"]
                yield pa.RecordBatch.from_arrays(cols, names)

        schema = f"{fields}, probs array<double>" + (", gates array<double>" if gated else "")
        return df.select(*kept, *[F.col(c).cast("array<double>").alias(c) for c in ("text_emb", "image_emb")]).mapInArrow(run, schema)

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, shape, values): parameters and running moments."""
        items = dict(self.params)
        for k, (mean, var) in self.running.items():
            items[f"{k}.running_mean"], items[f"{k}.running_var"] = mean, var
        rows = [(k, [int(d) for d in v.shape], [float(x) for x in v.ravel()]) for k, v in sorted(items.items())]
        return spark.createDataFrame(rows, "name string, shape array<int>, values array<double>")

    @staticmethod
    def from_table(df: DataFrame, spec: H.Spec, labels: list[str]) -> Model:
        items = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in collect_few(df, 1000)}
        running = {}
        for k in [k for k in items if k.endswith(".running_mean")]:
            base = k.removesuffix(".running_mean")
            running[base] = (items.pop(k), items.pop(f"{base}.running_var"))
        return Model(spec, labels, items, running)


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column of fixed length as a matrix, without a Python loop over rows."""
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(batch.num_rows, -1)


def vectors(m: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))


def features(batch: pa.RecordBatch) -> dict:
    out = {"text": matrix(batch, "text_emb"), "image": matrix(batch, "image_emb")}
    names = batch.schema.names
    if "y" in names:
        out["y"] = matrix(batch, "y")
    if "row" in names:
        out["row"] = batch.column("row").to_numpy(zero_copy_only=False)
    return out


def sum_over_tasks(df: DataFrame, work, names_shapes: dict[str, tuple], read=features) -> dict[str, np.ndarray]:
    """Sum over all rows of the arrays that ``work(data)`` returns for one Arrow batch, whose data ``read`` takes from it.

    One vector leaves each task. With many tasks the vectors are first added in groups on
    the executors, so the driver receives at most ``FAN_IN`` of them.
    """
    size = sum(math.prod(s) for s in names_shapes.values())

    def flatten(arrays):
        return np.concatenate([np.asarray(arrays[n], dtype=np.float64).ravel() for n in names_shapes])

    def pack(total):
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def partial(batches):
        total = None
        for b in batches:
            if b.num_rows:
                v = flatten(work(read(b)))
                total = v if total is None else total + v
        if total is not None:
            yield pack(total)

    def add(batches):
        total = None
        for b in batches:
            for v in b.column("v"):
                x = np.frombuffer(v.as_py())
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pack(total)

    parts = df.mapInArrow(partial, "v binary")
    if parts.rdd.getNumPartitions() > FAN_IN:
        parts = parts.repartition(FAN_IN).mapInArrow(add, "v binary")
    rows = parts.collect()
    total = np.zeros(size)
    for r in rows:
        total += np.frombuffer(r["v"])
    out, at = {}, 0
    for n, s in names_shapes.items():
        k = math.prod(s)
        out[n] = total[at : at + k].reshape(s)
        at += k
    return out


def gradient_shapes(spec: H.Spec) -> dict[str, tuple]:
    shapes = spec.shapes()
    branched = {b.params for b in spec.branches()}
    out = {k: s for k, s in shapes.items() if k.rsplit(".", 1)[0] not in branched}
    for b in spec.branches():
        width = 1 if b.source == "none" else shapes[f"{b.params}.weight"][1] + 1
        out |= {f"{b.name}.{k}": (spec.hidden,) for k in ("dbeta", "dgamma")}
        out |= {f"{b.name}.{k}": (spec.hidden, width) for k in ("g1", "g2", "g3")}
    return out | {"loss": (1,)}


def step(df: DataFrame, spec: H.Spec, params: dict, running: dict, n: float, weight: float, weights, seed: int, number: int):
    """(loss, gradients) of one batch; updates the running moments."""
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast((params, weights))
    drop = (seed, number)
    moments: dict = {}
    if spec.branches():

        def count(data):
            return H.Pass(spec, shared.value[0], data, drop=drop).branch_moments()

        shapes = {f"{b.name}.{k}": (spec.hidden,) for b in spec.branches() for k in ("sum", "square")}
        moments = H.batch_moments(spec, sum_over_tasks(df, count, shapes), n)
        H.update_running(spec, running, moments, n)

    def work(data):
        one = H.Pass(spec, shared.value[0], data, moments, drop)
        loss = one.loss_and_grads(n, weight, shared.value[1])
        return one.grads | {"loss": [loss]}

    sums = sum_over_tasks(df, work, gradient_shapes(spec))
    shared.unpersist()
    return float(sums["loss"][0]), H.finish_branches(spec, params, sums, moments, n)


class Adam:
    def __init__(self, params: dict, lr: float, decay: float = 0.0):
        self.lr, self.decay, self.t = lr, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, params: dict, grads: dict) -> dict:
        self.t += 1
        (b1, b2), out = BETAS, {}
        for k, p in params.items():
            g = grads[k]
            self.m[k] = b1 * self.m[k] + (1 - b1) * g
            self.v[k] = b2 * self.v[k] + (1 - b2) * g * g
            move = (self.m[k] / (1 - b1**self.t)) / (np.sqrt(self.v[k] / (1 - b2**self.t)) + ADAM_EPS)
            out[k] = p * (1 - self.lr * self.decay) - self.lr * move
        return out


def prepare(df: DataFrame, key: str, batches: int, seed: int, batch_size: int = 0) -> DataFrame:
    """(row, batch, y, text_emb, image_emb), stored by batch under the shared folder.

    ``row`` is a hash of the key: it drives dropout and the batch, both independent of
    partitioning. A batch is one folder with a file per 50,000 rows, so that a step starts
    as many tasks as its rows are worth.
    """
    spark = df.sparkSession
    row = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    out = df.select(row.alias("row"), F.pmod(row, F.lit(batches)).cast("int").alias("batch"), "y", "text_emb", "image_emb")
    path = scratch_path(spark, "training")
    if batches > 1:
        files = F.pmod(F.shiftright("row", 20), F.lit(max(1, batch_size // 50_000)))
        out.repartition("batch", files).write.partitionBy("batch").parquet(path)
    else:
        out.write.parquet(path)
    return spark.read.parquet(path)


def label_weights(counts: dict, spec: H.Spec, weighted: bool):
    """Class weights N/(C n) for cross entropy; (label weight, positive weight) for the other loss."""
    n = counts["n"]
    if spec.loss == "bce":
        ones, pos = np.ones(spec.outputs), np.ones(spec.outputs)
        if not weighted:
            return ones, pos
        hits = np.maximum(counts["classes"], 1e-300)
        if spec.outputs == 1:
            return ones, (n - hits) / hits
        return n / (spec.outputs * hits), pos
    return n / (spec.outputs * counts["classes"]) if weighted else np.ones(spec.outputs)


def class_counts(df: DataFrame, spec: H.Spec) -> dict:
    """Rows, and how often each class (or label) occurs: one number per class."""
    if spec.loss == "bce":
        sums = [F.sum(F.get("y", F.lit(i))).alias(f"c{i}") for i in range(spec.outputs)]
        r = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()
        return {"n": r["n"], "classes": np.array([float(r[f"c{i}"] or 0) for i in range(spec.outputs)])}
    classes = np.zeros(spec.outputs)
    for r in df.groupBy(F.get("y", F.lit(0)).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("k")).collect():
        classes[r["c"]] = r["k"]
    return {"n": int(classes.sum()), "classes": classes}


def batch_sums(df: DataFrame, spec: H.Spec, weights, whole: dict) -> dict[int, tuple[float, float]]:
    """Per batch its rows and the sum of their class weights: two numbers, whatever the number of classes."""
    if "batch" not in df.columns:
        return {0: (float(whole["n"]), float((whole["classes"] * weights).sum()) if spec.loss == "ce" else 0.0)}
    weight = F.lit(0.0)
    if spec.loss == "ce":
        weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.get("y", F.lit(0)).cast("int"))
    sums = df.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).collect()
    return {r["batch"]: (float(r["n"]), float(r["w"])) for r in sums}


def validation(model: Model, val: DataFrame, weights) -> dict:
    """Loss and macro-F1 in one pass: a task returns its counts per class and its loss."""
    spec, c = model.spec, model.spec.outputs
    shared = val.sparkSession.sparkContext.broadcast((model.params, H.scoring_moments(spec, model.running), weights))

    def count(data):
        params, moments, w = shared.value
        z, _ = H.Pass(spec, params, data, moments, scoring=True).logits()
        y = data["y"]
        if spec.loss == "bce":
            lw, pos = w
            hot = z > 0
            loss = (lw * ((1 - y) * z + (1 + (pos - 1) * y) * np.logaddexp(0, -z))).sum() / c
            return {"tp": (y * hot).sum(0), "size": y.sum(0) + hot.sum(0), "loss": [loss], "weight": [len(y)]}
        y = y[:, 0].astype(int)
        p = H.softmax(z)
        guess = p.argmax(1)
        size = np.bincount(y, minlength=c) + np.bincount(guess, minlength=c)
        return {"tp": np.bincount(y[y == guess], minlength=c), "size": size, "loss": [(w[y] * H.nll(p, y)).sum()], "weight": [w[y].sum()]}

    s = sum_over_tasks(val, count, {"tp": (c,), "size": (c,), "loss": (1,), "weight": (1,)})
    shared.unpersist()
    f1 = 2 * s["tp"] / np.maximum(s["size"], 1)
    # single-label: over the classes seen on either side; multi-label: over all labels
    seen = s["size"] > 0 if spec.loss == "ce" else np.ones(c, dtype=bool)
    return {"loss": float(s["loss"][0] / s["weight"][0]), "macro_f1": float(f1[seen].mean())}


def fit(
    train: DataFrame, val: DataFrame, labels: list[str], options: Options, key: str = "sample_id", start: tuple[dict, dict] | None = None
) -> Model:
    """Trains one head, from random parameters or from the (parameters, moments) in ``start``. Both frames have ``key``, ``y`` (array: class index, or 0/1 per
    label), ``text_emb`` and ``image_emb``.

    The epoch with the best validation macro-F1 is kept (for the early head and for
    multi-label training the one with the lowest loss); training stops after ``patience``
    epochs without a gain.
    """
    o = options
    sizes = [F.max(F.size(c)).alias(c) for c in ("text_emb", "image_emb", "y")]
    dims = train.agg(F.count(F.lit(1)).alias("n"), *sizes).first()
    n, outputs = dims["n"], (dims["y"] if o.loss == "bce" else len(labels))
    spec = H.Spec(o.method, dims["text_emb"], dims["image_emb"], outputs, o.hidden, o.dropout, o.loss)
    batches = max(1, math.ceil(n / o.batch_size))
    rows = prepare(train, key, batches, o.seed, o.batch_size)
    held = prepare(val, key, 1, o.seed).persist()
    if batches == 1:
        rows = rows.persist()
    whole = class_counts(rows, spec)
    weights = label_weights(whole, spec, o.weighted)
    totals = batch_sums(rows, spec, weights, whole)
    params, running = start or spec.start(o.seed)
    optimizer = Adam(params, o.lr, DECAY if o.optimizer == "adamw" else 0.0)
    by_loss = o.method == "mlp_early" or o.loss == "bce"
    best, best_score, stale, number, history = None, -math.inf, 0, 0, []
    order = np.random.default_rng(o.seed)
    for epoch in range(1, o.epochs + 1):
        loss = 0.0
        for b in order.permutation(sorted(totals)):
            batch = rows.filter(F.col("batch") == int(b)) if batches > 1 else rows
            size, weight = totals[int(b)]
            number += 1
            share, grads = step(batch, spec, params, running, size, weight, weights, o.seed, number)
            params = optimizer.update(params, grads)
            loss += share * size / whole["n"]
        current = Model(spec, labels, params, dict(running))
        check = validation(current, held, weights)
        history.append({"epoch": epoch, "train_loss": loss, **check})
        score = -check["loss"] if by_loss else check["macro_f1"]
        if score > best_score:
            best, best_score, stale = replace(current, epochs_run=epoch), score, 0
        else:
            stale += 1
            if stale >= o.patience:
                break
    held.unpersist()
    rows.unpersist()
    if best is None:
        raise ValueError("no epoch gave a finite validation score")
    best.history = history
    return best


@dataclass
class Experiment:
    """A table with key, label, split and two vectors, ready for the fixed protocol:
    given or carved validation split, labels numbered on train, one method per run."""

    df: DataFrame
    key: str
    label: str
    text: str
    image: str
    sample: int | None = None
    seed: int = 42

    def __post_init__(self):
        for c in (self.text, self.image):
            if c not in self.df.columns:
                raise ValueError(f"no embedding column {c}")
        rows = drop_missing(self.df, [self.label, self.text, self.image])
        if self.sample:
            rows = fixed_sample(rows, self.key, self.sample, self.seed)
        named = rows.select(
            F.col(self.key).alias("sample_id"), F.col(self.label).cast("string").alias("label"), "split",
            F.col(self.text).alias("text_emb"), F.col(self.image).alias("image_emb"),
        )
        self.rows = stored(route_split(named, "sample_id", 10, seed=self.seed), "experiment")

    def encoded(self) -> tuple[dict[str, DataFrame], list[str]]:
        """Rows per split with ``y``, and the labels in the order of their numbers.

        One count per (split, label) gives the label order and the check for unseen labels.
        """
        # as many rows as the model has outputs, for each split
        counts = self.rows.groupBy("split", "label").count().collect()
        seen = {s: sorted(r["label"] for r in counts if r["split"] == s) for s in ("train", "val", "test")}
        labels = seen["train"]
        for name in ("val", "test"):
            bad = set(seen[name]) - set(labels)
            if bad:
                raise UnseenLabels(f"{name} has labels unseen in train: {sorted(bad)[:20]}")
        spark = self.df.sparkSession
        coded = spark.createDataFrame(list(zip(labels, range(len(labels)))), "label string, index int")
        y = F.array(F.col("index").cast("double")).alias("y")
        rows = self.rows.join(coded, "label").select("split", "sample_id", y, "text_emb", "image_emb")
        return {s: rows.filter(F.col("split") == s).drop("split") for s in seen}, labels

    def run(self, options: Options, start=None) -> tuple[Model, DataFrame]:
        """(model, predictions): sample_id, y_true, y_pred, probs and gates on the test rows."""
        if options.loss != "ce":
            raise ValueError("the fixed protocol is single-label")
        parts, labels = self.encoded()
        model = fit(parts["train"], parts["val"], labels, options, start=start)
        return model, predict(model, parts["test"])

    def metrics(self, predictions: DataFrame) -> DataFrame:
        """(accuracy, f1_score, auc, n_test)."""
        s = M.summary(M.confusion(predictions)).select("accuracy", F.col("macro_f1").alias("f1_score"), F.col("n").alias("n_test"))
        if predictions.select(F.size("probs")).first()[0] == 2:
            scored = predictions.select(F.col("probs")[1].alias("s"), F.col("y_true").alias("p"))
            area = M.auroc(scored, "s", "p")
        else:
            area = M.auroc_macro(predictions)
        # two frames of one row
        return s.join(F.broadcast(area), F.lit(True)).select("accuracy", "f1_score", F.col("auroc").alias("auc"), "n_test")


    def run_row(self, model: Model, predictions: DataFrame, method: str, dataset: str, backbone: str) -> DataFrame:
        """The one-row record of a run: metrics, epoch that was kept, sizes of the splits, classes, and what was run."""
        sizes = self.rows.agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val")])
        # two frames of one row
        row = self.metrics(predictions).join(sizes, F.lit(True))
        tags = {"model": method, "dataset": dataset, "backbone": backbone, "method": method}
        return row.select(
            *[F.lit(v).alias(k) for k, v in tags.items()], F.lit(self.seed).alias("seed"), "accuracy", "f1_score", "auc",
            F.lit(model.epochs_run).alias("epochs_run"), "n_train", "n_val", "n_test", F.lit(len(model.labels)).alias("n_classes"),
        )


def predict(model: Model, df: DataFrame) -> DataFrame:
    scored = model.score(df, "sample_id", ["y"])
    y = F.get("y", F.lit(0)).cast("int").alias("y_true")
    gates = ["gates"] if "gates" in scored.columns else []
    return scored.select("sample_id", y, argmax(F.col("probs")).alias("y_pred"), "probs", *gates)
