"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` is one pass over whole texts in byte arrays. A bounded sample of labelled rows (about ``fit_rows`` rows and ``fit_chars`` characters at
most, drawn by a hash of the id) gives bin bounds and trees on the driver; scoring sends the flattened trees to the tasks, which walk all rows of
a batch down the trees together.

Defined cases: null and empty texts have all statistics 0 and get a score like any other; labels that are null or not 0 or 1 are
left out, as are labels of unknown ids; several labels of one id: the smallest counts; without labels, or with one
class only, every score is the smoothed share of that class; repeated rows get equal results; an empty table gives
none; all columns of the input stay, replaced where the names clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm import boosting
from twinlens.llm.common import Hasher, labelled_sample, per_text, text_slices

NAMES = [
    "chars", "words", "lines", "mean_word", "longest_word", "upper", "digits", "marks", "odd_marks", "shouts", "spaces", "beyond_ascii",
    "stops", "mean_line", "short_lines", "ended_lines", "repeated_lines", "distinct_words", "top_word", "repeated_pairs", "capital_words", "bars", "mark_runs", "mean_sentence",
]


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT, _SPACE = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("0123456789"), _set(" \t\n\r\f\v")
_MARK = _set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_ODD, _SHOUT, _BAR, _STOP = _set("#$%&*<>=+\\^_`{}~@"), _set("!"), _set("|"), _set(".!?")
_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True


def _distinct(keys: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: how many different keys it has, and how often its most frequent one occurs."""
    different, most = np.zeros(texts), np.zeros(texts)
    if len(keys):
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]))
        size = np.diff(np.append(first, len(k)))
        different += np.bincount(o[first], minlength=texts)
        np.maximum.at(most, o[first], size)
    return different, most


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, len(NAMES)) statistics; shares are 0 where there is nothing to divide by."""
    texts, n = len(bounds) - 1, np.diff(bounds).astype(float)
    share = lambda a, b: np.divide(a, b, out=np.zeros(texts), where=np.asarray(b) > 0)
    count = lambda mask: per_text(mask.view(np.uint8), bounds).astype(float)
    space, line_end = _SPACE[data], data == 10
    chars = n - count(_CONT[data])
    # words: runs of bytes that are no space, cut at the ends of texts
    word = ~space
    begins = word.copy()
    begins[1:] &= space[:-1]
    inner = bounds[:-1][n > 0]
    begins[inner] = word[inner]
    starts = np.flatnonzero(begins)
    ends = word.copy()
    ends[:-1] &= space[1:]
    last = bounds[1:][n > 0] - 1
    ends[last] = word[last]
    stops = np.flatnonzero(ends) + 1
    owner = np.searchsorted(bounds, starts, "right") - 1
    words, length = np.bincount(owner, minlength=texts).astype(float), stops - starts
    longest = np.zeros(texts)
    np.maximum.at(longest, owner, length)
    h = Hasher(data)
    keys = h.of(starts, stops)
    different, top = _distinct(keys, owner, texts)
    pair = owner[1:] == owner[:-1]
    pairs = keys[1:][pair] * np.uint64(3) + keys[:-1][pair]
    pair_kinds, _ = _distinct(pairs, owner[1:][pair], texts)
    pair_n = np.bincount(owner[1:][pair], minlength=texts).astype(float)
    capital = np.bincount(owner[_UPPER[data[starts]] & _UPPER[data[stops - 1]] & (length > 2)], minlength=texts).astype(float) if len(starts) else np.zeros(texts)
    # lines: stretches between line ends that are not empty
    cuts = np.unique(np.concatenate([bounds, np.flatnonzero(line_end), np.flatnonzero(line_end) + 1]))
    a, b = cuts[:-1], cuts[1:]
    real = ~line_end[a] if len(a) else np.zeros(0, bool)
    a, b = a[real], b[real]
    of = np.searchsorted(bounds, a, "right") - 1
    lines = np.bincount(of, minlength=texts).astype(float)
    line_kinds, _ = _distinct(h.of(a, b), of, texts)
    part = lambda mask: share(np.bincount(of[mask], minlength=texts).astype(float), lines)
    mark = _MARK[data]
    run = mark.copy()
    run[1:] &= mark[:-1]
    return np.column_stack([
        np.log1p(chars), np.log1p(words), np.log1p(lines), share(np.bincount(owner, length, texts), words), np.log1p(longest),
        share(count(_UPPER[data]), n), share(count(_DIGIT[data]), n), share(count(mark), n), share(count(_ODD[data]), n), share(count(_SHOUT[data]), n), share(count(space), n), share(count(data >= 128), n),
        share(count(_STOP[data]), words), np.log1p(share(chars, lines)), part(b - a < 30), part(_STOP[data[b - 1]]), 1 - share(line_kinds, lines) * (lines > 0) - (lines == 0), share(different, words), share(top, words),
        share(pair_n - pair_kinds, pair_n), share(capital, words), share(count(_BAR[data]), words), share(count(run), n), share(words, count(_STOP[data]) + 1),
    ])


@dataclass
class Model:
    bounds: list[np.ndarray]
    forest: boosting.Forest

    def score(self, values: np.ndarray) -> np.ndarray:
        return self.forest.probability(boosting.binned(values, self.bounds))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = 20_000, fit_chars: int = 100_000_000, trees: int = 100, depth: int = 4) -> Model:
    """Trees from the labelled rows of ``docs`` (doc_id, text)."""
    known = F.min(F.when(F.col(label).isin(0, 1), F.col(label)))
    rows = labelled_sample(docs, labels, known, fit_rows, fit_chars)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_slices(batches, "text"):
            values = statistics(data, ends)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_y"), *map(pa.array, values.T)], ["doc_id", "_y", *NAMES])

    kind = T.StructType([rows.schema["doc_id"], rows.schema["_y"], *[T.StructField(c, T.DoubleType()) for c in NAMES]])
    table = rows.mapInArrow(measure, kind).toPandas().sort_values(["doc_id", *NAMES], ignore_index=True)
    values = table[NAMES].to_numpy(float).reshape(-1, len(NAMES))
    bounds = boosting.edges(values) if len(values) else [np.zeros(0)] * len(NAMES)
    return Model(bounds, boosting.fit(boosting.binned(values, bounds), table["_y"].to_numpy(float), trees=trees, depth=depth))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted (score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop("score", "predicted")
    schema = T.StructType([*out.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_slices(batches, "text"):
            p = shared.value.score(statistics(data, ends))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema.names)

    return out.mapInArrow(run, schema)
