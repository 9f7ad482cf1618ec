"""Collocations: phrases of two or three words, by best-first branch-and-bound growth.

Texts, with A-Z lower-cased, are cut into pieces at ``.,;:!?`` and line ends, and those into words at blanks and tabs. In each lang (null: ``und``)
f(phrase) is the number of its places inside pieces. A candidate has a = f >= ``least``; a cut into its first k words and the rest, with
l and r places, scores floor(1000000 a a / (l r)), and the cut with the lowest score counts (ties: smallest k). A candidate inside a longer
one that has at least ``inside`` percent of its places is dropped. The result is each lang's best ``top``.

Method. Phrases grow from their prefixes. One pass counts words and one the pairs of words that are frequent enough themselves, as every
word's bound is the same: a phrase that starts with x has a <= f(x) and r >= a, so its score is at most 1000000 a / f(x). From then on counts prune: what grows
from xy scores at most floor(1000000 f(xy) / f(x)), and, read from the other end, what ends in yz at most
floor(1000000 f(yz) / f(z)). So each lang has a frontier of pairs, the best first. A round takes a threshold such that about
``FIRST`` x ``top`` pairs reach it (more in later rounds), and counts in one pass those triples alone that could
reach it by both bounds, or that hold a pair which does and may drop it. Then everything that scores at least the threshold is known, kept or dropped for certain; a
lang is settled once ``top`` kept ones reach it, ties at the end included, or nothing is left below. Other langs go on with a lower threshold.

Words are named by 64-bit hashes (of lang and word) in the counts. That two counted words share one is looked for, and the names are made anew with
another seed if they do, so all counts are exact. The frontier is sent to the tasks in blocks of at most ``BLOCK`` pairs, by the middle
word of the triples to be counted; each block is a pass of its own. Scores are made of decimals of 38 digits: a must be below 10 ** 16.

Defined cases: null and empty texts, and texts without words, add nothing; a null lang is ``und``; repeated rows count each; an empty table gives no
rows; further columns, doc_id too, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinlens.llm.common import mix, runs, text_slices
from twinlens.session import small_side, stored

#: Pairs above the first threshold for each row of the result; four times as many in each later round.
FIRST = 2
#: Pairs that are sent to the tasks at a time, and words: with more frequent words than that, pairs are counted without looking at their words first.
BLOCK, WORDS = 2_000_000, 8_000_000
#: Width of the steps by which thresholds move, of scores from 0 to 1000000.
STEP = 256
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts of one lang: distinct ones, their names, the number of each place's word and whether it follows another one of its piece."""

    def __init__(self, lang: str, data: np.ndarray, bounds: np.ndarray, seed: int):
        low = _LOWER[data]
        # texts are set apart like pieces
        apart = np.full(len(low) + len(bounds), 10, np.uint8)
        apart[np.arange(len(low)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = low
        kind = _KIND[apart]
        a, b = runs(kind == 0)
        offsets = np.concatenate([[0], np.cumsum(b - a)])
        letters = apart[kind == 0]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.lang, self.codes, self.distinct = lang, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        pieces = np.searchsorted(np.flatnonzero(kind == 2), a)
        self.follows = np.concatenate([[False], pieces[1:] == pieces[:-1]]) if len(a) else np.empty(0, bool)
        start = lang.encode() + b"\0"
        self.names = np.fromiter((xxhash.xxh64_intdigest(start + w, seed) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))


def _texts(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Words]:
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            rows = batch.filter(pa.array(code == k))
            for _, data, bounds in text_slices(iter([rows]), "text", 4 << 20):
                yield Words(lang, data, bounds, seed)


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """(name, lang, word, f)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _texts(batches, seed):
            if len(w.codes):
                n = len(w.names)
                word = w.distinct.cast(pa.large_string()).cast(pa.string())
                yield _rows(["name", "lang", "word", "c"], w.names, pa.array([w.lang] * n), word, np.bincount(w.codes, minlength=n))

    counted = docs.mapInArrow(run, "name long, lang string, word string, c long")
    return counted.groupBy("name", "lang", "word").agg(F.sum("c").alias("f"))


def _known(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each name is among the sorted ``known`` ones."""
    at = np.searchsorted(known, names)
    return known[np.minimum(at, len(known) - 1)] == names if len(known) else np.zeros(len(names), bool)


def count_pairs(docs: DataFrame, frequent: np.ndarray | None, seed: int, least: int) -> DataFrame:
    """(x, y, a) of the pairs of words, if given of the ``frequent`` ones (sorted names), that occur at least ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _texts(batches, seed):
            fine = np.ones(len(w.names), bool) if frequent is None else _known(w.names, frequent)
            ok = fine[w.codes]
            at = np.flatnonzero(w.follows[1:] & ok[1:] & ok[:-1])
            if len(at):
                key, c = np.unique(w.codes[at] * len(w.names) + w.codes[at + 1], return_counts=True)
                for s in range(0, len(key), 1 << 18):
                    k = key[s : s + (1 << 18)]
                    yield _rows(["x", "y", "c"], w.names[k // len(w.names)], w.names[k % len(w.names)], c[s : s + (1 << 18)])

    counted = docs.mapInArrow(run, "x long, y long, c long")
    return counted.groupBy("x", "y").agg(F.sum("c").alias("a")).where(F.col("a") >= least)


def pair_name(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(mix(x) + y * np.uint64(0x9E3779B97F4A7C15))


def count_triples(docs: DataFrame, starts: np.ndarray, ends: np.ndarray, own: np.ndarray, blocks: tuple[int, int], seed: int) -> DataFrame:
    """(x, y, z, c), counted in parts, of the triples xyz with xy among ``starts`` and yz among ``ends``, or one of them among ``own``
    (all sorted names of pairs), whose middle word is in the block (number, of). A few others may be counted, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _texts(batches, seed):
            if len(w.codes) < 3:
                continue
            mine = (w.names.view(np.int64) % blocks[1] == blocks[0])[w.codes]
            at = np.flatnonzero(w.follows[1:-1] & w.follows[2:] & mine[1:-1])
            x, y, z = (w.names[w.codes[at + k]] for k in range(3))
            first, second = pair_name(x, y), pair_name(y, z)
            some = _known(first, own) | _known(second, own)
            rest = np.flatnonzero(~some)
            rest = rest[_known(first[rest], starts)]
            some[rest[_known(second[rest], ends)]] = True
            at = at[some]
            if len(at):
                n = len(w.names)
                pair, place = np.unique(w.codes[at] * n + w.codes[at + 1], return_inverse=True)
                key, c = np.unique(place * n + w.codes[at + 2], return_counts=True)
                head = pair[key // n]
                yield _rows(["x", "y", "z", "c"], w.names[head // n], w.names[head % n], w.names[key % n], c)

    return docs.mapInArrow(run, "x long, y long, z long, c long")


def _score(a: str, left: str, right: str):
    big = lambda c: f"cast({c} as decimal(20, 0))"
    return F.expr(f"(1000000 * {big(a)} * {big(a)}) div ({big(left)} * {big(right)})")


def _names(rows: DataFrame, x: str, y: str, blocks: int, block: int, middle: str) -> np.ndarray:
    """Sorted names of the pairs whose middle word is in the block; at most about ``BLOCK`` by the choice of ``blocks``."""
    part = rows.where(F.expr(f"pmod({middle}, {blocks}) = {block}"))
    table = part.select(x, y).toArrow()
    return np.unique(pair_name(*(table.column(k).to_numpy().view(np.uint64) for k in range(2))))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, inside: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score)"""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    seed = 42
    while True:
        words = stored(count_words(docs, seed), "words")
        if not words.groupBy("name").count().where("count > 1").take(1):
            break
        seed += 1
    common = stored(words.where(F.col("f") >= least), "common")
    frequent = None
    if common.count() <= WORDS:
        frequent = np.sort(common.select("name").toArrow().column(0).to_numpy().view(np.uint64))
    counted = stored(count_pairs(docs, frequent, seed, least), "pairs")
    # the words' counts meet the pairs by joins of two tables; words are too many to be sent by way of the driver
    first, second = (common.select(F.col("name").alias(key), "lang", F.col("f").alias(f"f{key}")) for key in ("x", "y"))
    pairs = counted.join(first, "x").join(second.drop("lang"), "y")
    bound = lambda f: F.expr(f"(1000000 * cast(a as decimal(20, 0))) div {f}")
    pairs = stored(pairs.select("lang", "x", "y", "a", "fx", "fy", _score("a", "fx", "fy").alias("score"), bound("fx").alias("grow"), bound("fy").alias("back")), "scored")
    # how many pairs reach each step of the score, at most 3,907 rows a lang
    steps = pairs.groupBy("lang", F.expr(f"score div {STEP}").alias("step")).count()
    reach = F.sum("count").over(W.Window.partitionBy("lang").orderBy(F.desc("step")))
    steps = stored(steps.select("lang", "step", reach.alias("reach")), "steps")
    results, closed, aim = [], None, FIRST * top
    while True:
        theta = steps.groupBy("lang").agg((F.coalesce(F.max(F.when(F.col("reach") >= aim, F.col("step"))), F.lit(0)) * STEP).alias("theta"))
        if closed is not None:
            theta = theta.join(closed, "lang", "left_anti")
        theta = stored(theta, "thresholds")
        if not theta.take(1):
            break
        frontier = pairs.join(small_side(theta), "lang").where("score >= theta or grow >= theta or back >= theta")
        frontier = stored(frontier.withColumn("own", F.col("score") >= F.col("theta")), "frontier")
        blocks = max(1, -(-frontier.count() // BLOCK))
        counts = []
        for block in range(blocks):
            starts = _names(frontier.where("grow >= theta"), "x", "y", blocks, block, "y")
            ends = _names(frontier.where("back >= theta"), "x", "y", blocks, block, "x")
            own = np.union1d(*[_names(frontier.where("own"), "x", "y", blocks, block, m) for m in ("y", "x")])
            part = count_triples(docs, starts, ends, own, (block, blocks), seed).groupBy("x", "y", "z").agg(F.sum("c").alias("a"))
            counts.append(stored(part.where(F.col("a") >= least), "triples"))
        triples = counts[0]
        for c in counts[1:]:
            triples = triples.unionByName(c)
        head = pairs.select("lang", "x", "y", F.col("a").alias("fxy"), "fx")
        tail = pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("fyz"), F.col("fy").alias("fz"))
        scored = triples.join(head, ["x", "y"]).join(tail, ["y", "z"]).withColumns({"s1": _score("a", "fx", "fyz"), "s2": _score("a", "fxy", "fz")})
        cut = F.when(F.col("s1") <= F.col("s2"), F.struct(F.col("fx").alias("l"), F.col("fyz").alias("r"), F.col("s1").alias("score")))
        cut = cut.otherwise(F.struct(F.col("fxy").alias("l"), F.col("fz").alias("r"), F.col("s2").alias("score")))
        longer = scored.withColumn("c", cut).select("lang", "x", "y", "z", "a", "c.*").join(small_side(theta), "lang").where("score >= theta").drop("theta")
        held = triples.select("x", "y", "a").union(triples.select("y", "z", "a")).groupBy("x", "y").agg(F.max("a").alias("most"))
        shorter = frontier.where("own").join(held, ["x", "y"], "left").where(F.expr(f"100 * coalesce(most, 0) < {inside} * a"))
        shorter = shorter.select("lang", "x", "y", F.lit(None).cast("long").alias("z"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"), "score")
        found = stored(longer.unionByName(shorter), "found")
        enough = found.groupBy("lang").count().where(F.col("count") >= top).select("lang")
        settled = stored(enough.union(theta.where("theta = 0").select("lang")).distinct(), "settled")
        results.append(found.join(small_side(settled), "lang", "left_semi"))
        closed = settled if closed is None else closed.unionByName(settled)
        aim *= 4
    schema = "lang string, x long, y long, z long, a long, l long, r long, score long"
    kept = docs.sparkSession.createDataFrame([], schema)
    for r in results:
        kept = kept.unionByName(r)
    for c in ("x", "y", "z"):
        kept = kept.join(common.select(F.col("name").alias(c), F.col("word").alias(f"w{c}")), c, "left")
    kept = kept.withColumn("phrase", F.concat_ws(" ", "wx", "wy", "wz"))
    place = F.row_number().over(W.Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
