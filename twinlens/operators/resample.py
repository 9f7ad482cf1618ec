"""Resampling n rows with replacement, as counts of row ranges.

A replicate is a tree over the row numbers 0 .. n - 1: the root has all n draws, and a node of s rows with m draws gives its first s // 2
rows a Binomial(m, (s // 2) / s) number of them, the quantile at a uniform number that is a hash of (seed, node, replicate). The leaves are then
how often each row was drawn, exactly as for n independent draws. A range is found by walking down to its ends alone, so what is
known of a replicate costs some log(n) splits for each range, wherever it is asked for; no draw is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.operators.ranking import ordered_scan
from twinlens.session import stored

MASK = (1 << 32) - 1
# fixed values: the multipliers of a public 32-bit finalizer
FACTORS = (2246822507, 3266489909)
#: Cells of a group that a task looks at together, and numbers (replicates x ranges) held at a time.
CELLS, HELD = 4096, 1 << 21
#: Counts (rows x replicates) that a task keeps, replicates that are worth a task of their own, and rows that are looked at together.
COUNTS, REPLICATES, ROWS = 1 << 26, (16, 256), 256


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 32-bit values held in 64 bits."""
    h = h ^ (h >> np.uint64(16))
    h = h * np.uint64(FACTORS[0]) & np.uint64(MASK)
    h = h ^ (h >> np.uint64(13))
    h = h * np.uint64(FACTORS[1]) & np.uint64(MASK)
    return h ^ (h >> np.uint64(16))


def _mix32(h: np.ndarray) -> np.ndarray:
    """``mix`` of 32-bit values in place, which wrap around by themselves."""
    for shift, factor in ((16, FACTORS[0]), (13, FACTORS[1])):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    return h


def uniform(seed: int, replicates: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(replicates, nodes) numbers between 0 and 1, of 53 bits from two chains of hashes."""
    chains = []
    for start in (1, 2):
        h = np.full(len(lo), start, np.uint64)
        for word in (np.full(len(lo), seed, np.uint64), lo.astype(np.uint64), lo.astype(np.uint64) >> np.uint64(32), hi.astype(np.uint64), hi.astype(np.uint64) >> np.uint64(32)):
            h = mix((h * np.uint64(31) + (word & np.uint64(MASK))) & np.uint64(MASK))
        chains.append(_mix32((h * np.uint64(31)).astype(np.uint32)[:, None] + replicates.astype(np.uint64).astype(np.uint32)[None, :]))
    out = chains[0] * float(1 << 21)
    out += chains[1] >> np.uint32(11)
    out += 0.5
    out /= float(1 << 53)
    return out.T


def _sums(m: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest k, and P(Binomial(m, p) <= k) from there on, a row for each m.

    Probabilities follow from each other by their ratios, over 12 standard deviations and 40 on both sides, where nothing
    that 53 bits can show lies outside."""
    spread = 12 * np.sqrt(m * p * (1 - p)) + 40
    low, high = np.maximum(0, (m * p - spread).astype(np.int64)), np.minimum(m, (m * p + spread).astype(np.int64) + 1)
    k = low[:, None] + np.arange((high - low).max())
    with np.errstate(divide="ignore", invalid="ignore"):
        ratios = np.where(k < high[:, None], np.log((m[:, None] - k) / (k + 1.0)) + np.log(p / (1 - p)), -np.inf)
    steps = np.concatenate([np.zeros((len(m), 1)), np.cumsum(ratios, 1)], 1)
    sums = np.cumsum(np.exp(steps - steps.max(1, keepdims=True)), 1)
    return low, sums / sums[:, -1:]


def binomial_quantiles(m: np.ndarray, a: np.ndarray, s: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The least k with P(Binomial(m, a / s) <= k) >= u, elementwise; 0 < a < s.

    Equal (m, a, s) share their probabilities. The sums of some m are one sorted list, each m's above those of the one before it."""
    out = np.zeros(len(m), np.int64)
    if not len(m):
        return out
    nodes, kind = np.unique(np.stack([a, s], 1), axis=0, return_inverse=True)
    for x, (left, size) in enumerate(nodes.tolist()):
        here = slice(None) if len(nodes) == 1 else np.flatnonzero(kind.ravel() == x)
        out[here] = _quantiles(m[here], left / size, u[here])
    return out


def _quantiles(m: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    least, most = int(m.min()), int(m.max())
    if most - least < 4 * len(m) + 1024:
        there = np.bincount((m - least).ravel(), minlength=most - least + 1) > 0
        values, nth = np.flatnonzero(there) + least, (np.cumsum(there) - 1)[m - least]
    else:
        values, nth = np.unique(m, return_inverse=True)
        nth = nth.reshape(m.shape)
    width = int(24 * np.sqrt(most * p * (1 - p))) + 84
    step = max(1, (1 << 19) // min(width, most + 1))
    out = np.zeros(m.shape, np.int64)
    for start in range(0, len(values), step):
        low, sums = _sums(values[start : start + step], p)
        keys = (sums + np.arange(len(sums))[:, None]).ravel()
        at = slice(None) if len(values) <= step else np.nonzero((nth >= start) & (nth < start + step))
        own = nth[at] - start
        place = np.searchsorted(keys, own + u[at], "left") - own * sums.shape[1] + low[own]
        out[at] = np.minimum(place, m[at])
    return out


def drawn_below(n: int, limits: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """(replicates, limits): how many of the n draws fall on rows below each of the sorted, distinct ``limits`` (0 to n)."""
    # a row for each node or limit, which are taken and put in whole
    out = np.zeros((len(limits), len(replicates)), np.int64)
    out[limits >= n] = n
    lo, hi = np.array([0]), np.array([n])
    draws, before = np.full((1, len(replicates)), n, np.int64), np.zeros((1, len(replicates)), np.int64)

    def inside(lo, hi):
        return np.searchsorted(limits, hi, "left") > np.searchsorted(limits, lo, "right")

    open_ = inside(lo, hi)
    lo, hi, draws, before = lo[open_], hi[open_], draws[open_], before[open_]
    while len(lo):
        a = (hi - lo) // 2
        mid = lo + a
        u = uniform(seed, replicates, lo, hi).T
        left = np.empty_like(draws)
        # nodes of one depth have two or three sizes
        for size in np.unique(hi - lo).tolist():
            own = np.flatnonzero(hi - lo == size)
            left[own] = _quantiles(draws[own], size // 2 / size, u[own])
        at = np.minimum(np.searchsorted(limits, mid), len(limits) - 1)
        hit = limits[at] == mid
        out[at[hit]] = before[hit] + left[hit]
        # only what goes on is made
        x, y = inside(lo, mid), inside(mid, hi)
        lo, hi = np.concatenate([lo[x], mid[y]]), np.concatenate([mid[x], hi[y]])
        draws, before = np.concatenate([left[x], draws[y] - left[y]]), np.concatenate([before[x], before[y] + left[y]])
    return out.T


def replicate_parts(samples: int, width: int) -> Iterator[np.ndarray]:
    """Replicate numbers, so many at a time that ``width`` ranges of them fit."""
    step = max(1, min(samples, HELD // max(1, width)))
    for start in range(0, samples, step):
        yield np.arange(start, min(start + step, samples))


def row_counts(n: int, rows: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """(replicates, rows): how often each of the ``rows`` was drawn."""
    limits = np.unique(np.concatenate([rows, rows + 1]))
    below = drawn_below(n, limits, replicates, seed)
    return (below.T[np.searchsorted(limits, rows + 1)] - below.T[np.searchsorted(limits, rows)]).T


def bootstrap_draws(spark: SparkSession, n: int, samples: int, seed: int = 2026, block: int = 1 << 16) -> DataFrame:
    """(replicate, row_id, n): how often each drawn row was drawn in each of ``samples`` replicates of n draws with replacement."""
    parts = max(spark.sparkContext.defaultParallelism, min(100_000, n * samples // 4_000_000))
    blocks, step = -(-n // block), max(1, min(64, samples // spark.sparkContext.defaultParallelism))
    jobs = spark.range(0, blocks * -(-samples // step), 1, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.column(0).to_pylist():
                first = job // blocks * step
                rows = np.arange(job % blocks * block, min(n, (job % blocks + 1) * block))
                for part in replicate_parts(min(step, samples - first), len(rows)):
                    count = row_counts(n, rows, part + first, seed)
                    i, j = np.nonzero(count)
                    yield pa.RecordBatch.from_arrays([pa.array(part[i] + first), pa.array(rows[j]), pa.array(count[i, j])], ["replicate", "row_id", "n"])

    return jobs.mapInArrow(run, "replicate long, row_id long, n long")


def cell_draws(df: DataFrame, cells: Sequence[str], samples: int, seed: int = 2026, groups: Sequence[str] = (), step: int = 256) -> DataFrame:
    """(groups, replicate, cells, n): how often rows of each cell were drawn in each replicate of its group.

    Rows count as numbered within their group in the order of the cells, so a cell is a range. Cells are numbered by an ordered scan
    and looked at in blocks, each with ``step`` replicates: a group of any number of cells is many tasks."""
    counted = df.groupBy(*groups, *cells).agg(F.count(F.lit(1)).alias("__n"))
    ranges = ordered_scan(counted, groups, cells, {"__lo": F.col("__n"), "__i": F.lit(1)})
    packed = F.sort_array(F.collect_list(F.struct(F.col("__lo").alias("lo"), F.col("__n").alias("n"), F.struct(*cells).alias("cell"))))
    blocks = ranges.groupBy(*groups, F.expr(f"__i div {CELLS}").alias("__b"), F.col("__lo_all").alias("__size")).agg(packed.alias("__cells"))
    jobs = blocks.withColumn("__first", F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(step))))
    # few rows, each of them long work: not put together by their bytes
    jobs = jobs.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *groups, "__b", "__first")
    kinds = {f.name: f for f in df.schema}
    out = T.StructType([*[kinds[g] for g in groups], T.StructField("replicate", T.LongType()), T.StructField("cell", T.StructType([kinds[c] for c in cells])), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                value = lambda c: row.column(row.schema.get_field_index(c))  # noqa: E731, B023
                listed = value("__cells").flatten()
                lo, n, cell = (listed.field(c) for c in ("lo", "n", "cell"))
                lo, n = lo.to_numpy(), n.to_numpy()
                limits, first = np.append(lo, lo[-1] + n[-1]), value("__first")[0].as_py()
                for part in replicate_parts(min(step, samples - first), len(limits)):
                    count = np.diff(drawn_below(value("__size")[0].as_py(), limits, part + first, seed), axis=1)
                    i, j = np.nonzero(count)
                    own = pa.array(np.zeros(len(i), np.int64))
                    yield pa.RecordBatch.from_arrays([*[value(g).take(own) for g in groups], pa.array(part[i] + first), cell.take(pa.array(j)), pa.array(count[i, j])], out.names)

    return jobs.mapInArrow(run, out).select(*groups, "replicate", "cell.*", "n")


def auroc_draws(long: DataFrame, samples: int, seed: int = 2026, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, replicate, auroc) of the same draws, NaN where one side was not drawn.

    ``long`` has, besides the groups, row_id (of ``size`` rows, numbered in the order of the cells), score and positive (0 or 1). Groups of one size
    have the same draws: a task finds those of some replicates once, as a byte for each row and replicate, and reads all groups in the order
    of their scores, packed to some 4 bytes a row. Where too few replicates of the largest group fit, tasks have ranges of the score instead."""
    largest = long.agg(F.max("size")).first()[0] or 0
    each = min(samples, COUNTS // max(1, largest), max(REPLICATES[0], min(REPLICATES[1], -(-samples // (2 * long.sparkSession.sparkContext.defaultParallelism)))))
    if each < min(samples, REPLICATES[0]):
        return _auroc_by_ranges(long, samples, seed, groups)
    packed, turns = stored(_packed(long, groups), "scores"), -(-samples // each)
    kinds = {f.name: f for f in long.schema}
    out = T.StructType([*[kinds[g] for g in groups], T.StructField("replicate", T.LongType()), T.StructField("auroc", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, key, drawn, of = None, None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                value = lambda c: row.column(row.schema.get_field_index(c))[0].as_py()  # noqa: E731, B023
                turn, size = value("__turn"), value("size")
                if (turn, value("__k")) != key:
                    if open_:
                        yield open_.result(out.names)
                    if (turn, size) != of:
                        open_ = drawn = None  # room for the next
                        drawn, of = counts_of(size, np.arange(turn * each, min(samples, (turn + 1) * each)), seed), (turn, size)
                    key = turn, value("__k")
                    open_ = _Wins(drawn, turn * each, [row.column(row.schema.get_field_index(g)) for g in groups])
                n = value("n")
                positive, new = (np.unpackbits(np.frombuffer(value(c), np.uint8), count=n).astype(bool) for c in ("positive", "new"))
                open_.add(np.frombuffer(value("rows"), np.int32), positive, new, value("first"), value("last"))
        if open_:
            yield open_.result(out.names)

    jobs = packed.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    return jobs.repartitionById(turns, F.col("__turn")).sortWithinPartitions("__turn", "size", "__at").mapInArrow(run, out)


def counts_of(n: int, replicates: np.ndarray, seed: int) -> np.ndarray:
    """(n, replicates): how often each row was drawn, as bytes if they suffice."""
    out = np.zeros((n, len(replicates)), np.uint8)
    for start in range(0, n, 1 << 14):
        rows = np.arange(start, min(n, start + (1 << 14)))
        step = max(1, (1 << 19) // len(rows))
        for first in range(0, len(replicates), step):
            found = row_counts(n, rows, replicates[first : first + step], seed).T
            if found.max() > np.iinfo(out.dtype).max:
                out = out.astype(np.int64)
            out[rows[0] : rows[-1] + 1, first : first + step] = found
    return out


def _packed(long: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, __k, size, n, first, last, rows, positive, new, __at): runs of rows of a group in the order of their scores, ``new`` where a score differs from that before it in the run."""
    keyed = long.select(*groups, F.to_json(F.struct(F.lit(0).alias("_"), *groups)).alias("__k"), F.col("score").cast("double").alias("score"), "positive", "row_id", "size")
    ordered = keyed.repartitionByRange(*groups, "score", "row_id").sortWithinPartitions(*groups, "score", "row_id")
    kinds = {f.name: f for f in keyed.schema}
    fields = [("n", T.IntegerType()), ("first", T.DoubleType()), ("last", T.DoubleType()), ("rows", T.BinaryType()), ("positive", T.BinaryType()), ("new", T.BinaryType())]
    out = T.StructType([*[kinds[g] for g in groups], kinds["__k"], kinds["size"], *[T.StructField(*f) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            names = value("__k").to_numpy(zero_copy_only=False)
            score, positive, row = (value(c).to_numpy(zero_copy_only=False) for c in ("score", "positive", "row_id"))
            cut = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)] if len(names) else [0]
            for start, stop in zip(cut[:-1], cut[1:]):
                x = score[start:stop]
                new = np.concatenate([[True], (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))])
                bits = [np.packbits(b).tobytes() for b in (positive[start:stop] == 1, new)]
                own = batch.slice(start, 1)
                one = [own.column(own.schema.get_field_index(c)) for c in (*groups, "__k", "size")]
                values = [pa.array([stop - start], pa.int32()), pa.array([x[0]]), pa.array([x[-1]]), *[pa.array([b], pa.binary()) for b in (row[start:stop].astype(np.int32).tobytes(), *bits)]]
                yield pa.RecordBatch.from_arrays([*one, *values], out.names)

    return ordered.mapInArrow(run, out).withColumn("__at", F.monotonically_increasing_id())


class _Wins:
    """Pairs of a positive and a negative row that the positive one wins, a tie being half a win, for each replicate; rows come in the order of their scores."""

    def __init__(self, drawn: np.ndarray, first: int, groups: list[pa.Array]):
        self.drawn, self.first, self.groups, self.score = drawn, first, groups, None
        # positive and negative rows, twice the wins, and the rows of the last score, which may go on
        self.p, self.m, self.twice, self.tied_p, self.tied_m = (np.zeros(drawn.shape[1], np.int64) for _ in range(5))

    def _close(self) -> None:
        self.twice += self.tied_p * (2 * self.m + self.tied_m)
        self.p += self.tied_p
        self.m += self.tied_m
        self.tied_p[:] = self.tied_m[:] = 0

    def _tied(self, rows: np.ndarray, positive: np.ndarray) -> None:
        for side, sums in ((rows[positive], self.tied_p), (rows[~positive], self.tied_m)):
            for at in range(0, len(side), 1 << 12):
                sums += self.drawn[side[at : at + (1 << 12)]].sum(0, dtype=np.int64)

    def _between(self, rows: np.ndarray, positive: np.ndarray, start: np.ndarray) -> None:
        """Rows whose scores do not go on elsewhere; ``start`` of each score."""
        count = self.drawn[rows]
        at = np.flatnonzero(positive)
        own = count[at]
        count[at] = 0
        below = np.zeros((len(rows) + 1, count.shape[1]), np.int64 if count.itemsize > 1 else np.int32)
        np.cumsum(count, axis=0, out=below[1:])
        score = np.searchsorted(start, at, "right") - 1
        end = np.append(start[1:], len(rows))
        twice = below[start[score]] + below[end[score]]
        self.p += (sums := own.sum(0, dtype=np.int64))
        self.twice += np.einsum("ij,ij->j", own, twice, dtype=np.int64) + 2 * self.m * sums
        self.m += below[-1]

    def add(self, rows: np.ndarray, positive: np.ndarray, new: np.ndarray, first: float, last: float) -> None:
        start = np.flatnonzero(new)
        if self.score is not None and not (first == self.score or (first != first and self.score != self.score)):
            self._close()
        self.score = last
        end = start[1] if len(start) > 1 else len(rows)
        self._tied(rows[:end], positive[:end])
        at, stop = 1, len(start) - 1  # scores that begin and end here
        while at < stop:
            self._close()
            to = max(at + 1, int(np.searchsorted(start, start[at] + ROWS, "right")) - 1)
            to = min(to, stop)
            a, b = start[at], start[to]
            if to == at + 1:
                self._tied(rows[a:b], positive[a:b])
            else:
                self._between(rows[a:b], positive[a:b], start[at:to] - a)
            at = to
        if stop > 0:
            self._close()
            self._tied(rows[start[-1] :], positive[start[-1] :])

    def result(self, names: list[str]) -> pa.RecordBatch:
        self._close()
        with np.errstate(divide="ignore", invalid="ignore"):
            auroc = self.twice * 0.5 / (self.p.astype(np.float64) * self.m)
        own = pa.array(np.zeros(len(auroc), np.int64))
        return pa.RecordBatch.from_arrays([*[g.take(own) for g in self.groups], pa.array(self.first + np.arange(len(auroc))), pa.array(auroc)], names)


def _auroc_by_ranges(long: DataFrame, samples: int, seed: int, groups: Sequence[str]) -> DataFrame:
    """``auroc_draws`` of large groups. Rows are dealt by ranges of the
    score. A task counts its own pairs for some replicates at a time and gives three sums for each: rows of its lowest score, of its highest one, and those
    between. The first two may go on in a neighbour and are added up there; then sums are carried from range to range."""
    keyed = long.select(*groups, F.to_json(F.struct(F.lit(0).alias("_"), *groups)).alias("__k"), "score", "positive", "row_id", "size")
    ordered = keyed.repartitionByRange(*groups, "score", "row_id").sortWithinPartitions(*groups, "score", "row_id")
    kinds = {f.name: f for f in long.schema}
    fields = [("replicate", T.LongType()), ("score", T.DoubleType()), ("tie", T.BooleanType()), ("p", T.LongType()), ("m", T.LongType()), ("u", T.DoubleType())]
    out = T.StructType([*[kinds[g] for g in groups], *[T.StructField(*f) for f in fields]])

    def sums(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        score, positive, row, size = (rows.column(c).to_numpy() for c in ("score", "positive", "row_id", "size"))
        first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        last = len(first) - 1
        parts = [(0, 1), (1, last), (last, last + 1)] if last else [(0, 1)]
        for part in replicate_parts(samples, 2 * len(row)):
            drawn = row_counts(int(size[0]), row, part, seed)
            p, m = (np.add.reduceat(drawn * side, first, axis=1) for side in (positive, 1 - positive))
            for a, b in parts:
                if a < b:
                    tie = b - a == 1 and a in (0, last)
                    below = np.cumsum(m[:, a:b], 1) - m[:, a:b]
                    u = np.zeros(len(part)) if tie else (p[:, a:b] * (below + m[:, a:b] * 0.5)).sum(1)
                    own = pa.array(np.zeros(len(part), np.int64))
                    values = [part, np.full(len(part), score[first[a]]), np.full(len(part), tie), p[:, a:b].sum(1), m[:, a:b].sum(1), u]
                    yield pa.RecordBatch.from_arrays([*[rows.column(g).combine_chunks().take(own) for g in groups], *[pa.array(v) for v in values]], out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("__k")).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)] if len(names) else [0]
            for start, stop in zip(cut[:-1], cut[1:]):
                if held and names[start] != key:
                    yield from sums(pa.Table.from_batches(held))
                    held = []
                key = names[start]
                held.append(batch.slice(start, stop - start))
        if held:
            yield from sums(pa.Table.from_batches(held))

    pieces = ordered.mapInArrow(run, out).groupBy(*groups, "replicate", "score").agg(F.max("tie").alias("tie"), F.sum("p").alias("p"), F.sum("m").alias("m"), F.sum("u").alias("u"))
    return _carried(pieces, [*groups, "replicate"])


def _carried(pieces: DataFrame, groups: Sequence[str]) -> DataFrame:
    # a few rows for each replicate and task
    before = F.sum("m").over(W.partitionBy(*groups).orderBy("score")) - F.col("m")
    won = F.when(F.col("tie"), F.col("p") * F.col("m") * F.lit(0.5)).otherwise(F.col("u")) + F.col("p") * before
    total = pieces.withColumn("__u", won).groupBy(*groups).agg(F.sum("__u").alias("__u"), F.sum("p").alias("p"), F.sum("m").alias("m"))
    pairs = F.col("p").cast("double") * F.col("m")
    return total.select(*groups, F.when(pairs > 0, F.col("__u") / pairs).otherwise(F.lit(float("nan"))).alias("auroc"))
