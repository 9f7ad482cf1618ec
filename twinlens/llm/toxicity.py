"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence has a score p = sigmoid(bias + sum of the weights of its words); the document's score is the noisy-or 1 - prod(1 - p). Only
documents carry labels; the gradient of their log loss reaches each sentence by (1 - P) / P * p, so the sentence that explains
the label gets the blame, and ``sentences`` returns the offending ones.

Features are words and the byte ``GRAM``-grams within words (stems and endings that new words share), hashed into
``1 << BITS`` weights. Over the drawn documents each feature's number of documents, and of toxic ones, is counted on the executors; features
whose share of toxic documents lies at least ``deviation`` standard errors off the share of all take part in the fit. The fit draws at
most about ``fit_rows`` labelled rows and ``fit_chars`` characters by a hash of the id; scoring goes over whole texts.

Defined cases: a null or empty text, or one without words, has no sentence and gets the score 0; labels that are null or not 0 or 1 are
left out; several labels of one id: the largest counts; without labels, or with one class only, all weights are 0; repeated
rows get equal results; an empty table gives none; all columns of the input stay, replaced where the names clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm.common import Hasher, labelled_sample, per_text, text_slices

BITS = 20
GRAM = 5
#: Bytes of text looked at together.
PART = 1 << 20
_END, _WORD = np.zeros(256, bool), np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True
_WORD[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'"]] = True
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def parse(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features in order, bounds of sentences in features, bounds of texts in sentences, start byte of each sentence).

    A sentence ends after . ! ? or a line end, and with its text; one without a word is none."""
    n = len(data)
    low = _LOWER[data]
    word = _WORD[low]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    edge[1:] |= _END[low]
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(len(bounds), np.int64), np.zeros(0, np.int64)
    h = Hasher(low)
    # how many n-grams begin in a word of each length, and where
    many = np.maximum(b - a - GRAM + 1, 0)
    g = np.repeat(a - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    shift = np.uint64(64 - BITS)
    keys = np.full((n, 2), -1, np.int32)
    keys[a, 0] = h.of(a, b) >> shift
    keys[g, 1] = (h.of(g, g + GRAM) * np.uint64(0x9E3779B97F4A7C15)) >> shift
    flat = keys.ravel()
    at = np.flatnonzero(flat >= 0)
    place = np.cumsum(edge)[at >> 1]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    begin = np.flatnonzero(edge)[place[starts] - 1]
    return flat[at].astype(np.int64), np.append(starts, len(at)), np.searchsorted(begin, bounds, "left"), begin


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def sentence_scores(self, key: np.ndarray, sentences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + per_text(self.weight[key], sentences), -40, 40)))


def noisy_or(p: np.ndarray, texts: np.ndarray) -> np.ndarray:
    return -np.expm1(per_text(np.log1p(-np.minimum(p, 1 - 1e-15)), texts))


def fit(key: np.ndarray, sentences: np.ndarray, texts: np.ndarray, label: np.ndarray, epochs: int = 120, rate: float = 0.1, ridge: float = 1e-5) -> Model:
    """Adam on the whole sample. ``key`` are words, ``sentences`` bounds in words, ``texts`` bounds in sentences."""
    names, slot = np.unique(key, return_inverse=True)
    of_word = np.repeat(np.arange(len(sentences) - 1), np.diff(sentences))
    weight, bias = np.zeros(len(names)), -6.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    if len(np.unique(label)) < 2:
        epochs = 0
    n = max(1, len(label))
    for epoch in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + per_text(weight[slot], sentences), -30, 30)))
        whole = np.clip(noisy_or(p, texts), 1e-9, 1)
        blame = np.where(label == 1, -(1 - whole) / whole, 1.0)
        slope = np.repeat(blame, np.diff(texts)) * p / n
        grad = np.append(np.bincount(slot, slope[of_word], len(names)) + ridge * weight, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
        weight, bias = weight - step[:-1], bias - step[-1]
    full = np.zeros(1 << BITS)
    full[names] = weight
    return Model(full, float(bias))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = 20_000, fit_chars: int = 60_000_000, deviation: float = 4.0) -> Model:
    """Weights from the labelled rows of ``docs`` (doc_id, text)."""
    known = F.max(F.when(F.col(label).isin(0, 1), F.col(label)))
    sample = labelled_sample(docs.where(F.col("text").isNotNull()), labels, known, fit_rows, fit_chars)
    n, bad = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for part, data, ends in text_slices(batches, "text", PART):
            key, bounds, texts, _ = parse(data, ends)
            owner = np.repeat(np.arange(part.num_rows), np.diff(bounds[texts]))
            pairs = np.unique(owner << BITS | key)
            y = part.column("_y").to_numpy()[pairs >> BITS]
            for k in (0, 1):
                total[k] += np.bincount(pairs[y == k] & ((1 << BITS) - 1), minlength=1 << BITS)
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["feature", "clean", "toxic"])

    base = bad / n if n else 0.0
    counts = sample.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg((F.sum("clean") + F.sum("toxic")).alias("n"), F.sum("toxic").alias("toxic"))
    off = F.abs(F.col("toxic") - base * F.col("n")) / F.sqrt(F.col("n") * max(base * (1 - base), 1e-9))
    # at most 1 << BITS numbers
    chosen = np.array([r[0] for r in counts.where((F.col("n") > 2) & (off >= deviation)).select("feature").collect()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(chosen))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << BITS, bool)
        known[shared.value] = True
        for part, data, ends in text_slices(batches, "text", PART):
            key, bounds, texts, _ = parse(data, ends)
            keep = known[key]
            bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
            lists = pa.ListArray.from_arrays(pa.array(bounds[texts].astype(np.int32)), pa.array(key[keep].astype(np.int32)))
            sizes = pa.ListArray.from_arrays(pa.array(texts.astype(np.int32)), pa.array(np.diff(bounds).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_y"), lists, sizes], ["doc_id", "_y", "words", "sizes"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("_y", T.IntegerType()), T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.IntegerType()))])
    table = sample.mapInArrow(words, schema).orderBy("doc_id", F.xxhash64("words")).toArrow()
    lists, sizes = table.column("words").combine_chunks(), table.column("sizes").combine_chunks()
    key = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False))]).astype(np.int64)
    texts = sizes.offsets.to_numpy().astype(np.int64)
    return fit(key, bounds, texts - texts[0], table.column("_y").to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score, predicted (score >= threshold) and worst: (start, end) in bytes of the highest sentence, or null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop("score", "predicted", "worst")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*out.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("worst", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_slices(batches, "text", PART):
            key, sentences, texts, begin = parse(data, ends)
            p = shared.value.sentence_scores(key, sentences)
            whole = noisy_or(p, texts)
            owner = np.repeat(np.arange(part.num_rows), np.diff(texts))
            order = np.lexsort((np.arange(len(p)), -p, owner))
            top = order[np.minimum(texts[:-1], max(0, len(p) - 1))] if len(p) else np.zeros(part.num_rows, np.int64)
            has = np.diff(texts) > 0
            limit = np.append(begin[1:], ends[-1]) if len(p) else np.zeros(1, np.int64)
            start = begin[top] - ends[:-1] if len(p) else np.zeros(part.num_rows, np.int64)
            end = np.minimum(limit[top], ends[1:]) - ends[:-1] if len(p) else start
            worst = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"], mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(whole), pa.array((whole >= threshold).astype(np.int32)), worst], schema.names)

    return out.mapInArrow(run, schema)


def sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, sentence, score): the sentences with a score of at least ``threshold``; positions in UTF-8 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_slices(batches, "text", PART):
            key, bounds, texts, begin = parse(data, ends)
            p = shared.value.sentence_scores(key, bounds)
            owner = np.repeat(np.arange(part.num_rows), np.diff(texts))
            limit = np.minimum(np.append(begin[1:], ends[-1]), ends[1:][owner]) if len(p) else begin
            at = np.flatnonzero(p >= threshold)
            texts_ = [data[begin[i] : limit[i]].tobytes().decode("utf-8", "replace") for i in at]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner[at])), pa.array((begin[at] - ends[owner[at]])), pa.array((limit[at] - ends[owner[at]])), pa.array(texts_, pa.string()), pa.array(p[at])], ["doc_id", "start", "end", "sentence", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("sentence", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
