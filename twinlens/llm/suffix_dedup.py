"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts earlier are removed.

"Earlier" is a smaller doc_id, then a smaller text key, or the same document and an earlier start; strings never cross documents, and all are
judged on the input.

Method. (1) Every window of ``length`` bytes has one anchor: the place of the least hash among its ``GRAM``-byte strings, which depends
on the window's bytes only, so equal windows have equal anchors at equal offsets. Windows that follow one another under one anchor are a run;
runs are dealt by anchor, so that equal windows meet in one shard. Runs whose bytes are all equal are copies: the later ones are
removed as a whole, first within a stretch of each task, then in the sorted stream of a shard, so a passage that a third of the documents
share is one row of each stretch. (2) Of anchors that have runs of different bytes, one run of each kind goes into suffix arrays: a shard's
bytes are laid out in order of place and sorted by external induced sorting (``induced_sort``), whose queues wait on disk, so a shard may be far
larger than memory. Suffixes with a common prefix of ``length`` are one interval; all but its first place are removed. (3) The removed windows
of a document become spans.

Hot anchors. An anchor whose runs have more than ``HOT`` bytes is not kept together: run content reaches past the text that documents share, so
every document may have its own run under it, and one shard would hold them all. Its runs are dealt by anchor and content to cut the copies,
and the windows of those that are left by the hash of their ``length`` bytes, whose least place is taken before the shuffle; the others are removed.
So no shard has an anchor of more than ``HOT`` bytes, and what a shard keeps in memory is bounded.

Defined cases: a null text is empty; a text shorter than ``length`` is kept; a null doc_id counts as the smallest; repeated rows (equal id and
text) are one document with equal results; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm import induced_sort
from twinlens.llm.common import Hasher, runs, text_slices, utf8
from twinlens.session import drop_folder, scratch_scope, small_side, stored

GRAM = 24
#: Bytes of text whose runs are compared before any shuffle.
STRETCH = 16 << 20
#: Bytes of runs above which the windows of an anchor are dealt by their own hash.
HOT = 512 << 10
#: Bytes of text that are hashed at once.
PART = 1 << 20
_PLACE = np.uint64((1 << 31) - 1)
LEAST = -(1 << 63)


def _minima(values: np.ndarray, span: int) -> np.ndarray:
    """Least of each ``span`` values that follow one another."""
    n = len(values)
    if n < span:
        return np.empty(0, values.dtype)
    blocks = -(-n // span)
    padded = np.full(blocks * span, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    cells = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - span + 1], ahead[span - 1 : n])


def window_runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, content) of the runs; start is relative to the text."""
    gram = min(GRAM, length)
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in [np.int64] * 5)
    h = Hasher(data)
    at = np.arange(n - gram + 1)
    names = h.of(at, at + gram)
    least = _minima((names & ~_PLACE) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & _PLACE).astype(np.int64)
    valid = np.zeros(n - length + 2, bool)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        valid[a : max(a, b - length + 1)] = True
    # an anchor never lies in two texts' windows, as valid windows end within their text
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~valid[1 : len(anchor)] | ~valid[: len(anchor) - 1]]))
    cut = cut[valid[cut]]
    end = np.append(cut[1:], len(anchor))
    stops = np.flatnonzero(~valid)
    end = np.minimum(end, stops[np.minimum(np.searchsorted(stops, cut), len(stops) - 1)])
    text = np.searchsorted(bounds, cut, "right") - 1
    content = h.of(cut, end + length - 1)
    # the whole hash of the anchor deals the runs out: half of it would be shared by chance by ever more anchors as tables grow
    return text, cut - bounds[text], end - cut, names[anchor[cut]].view(np.int64), content.view(np.int64)


_RUN = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("content", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("copy", T.BooleanType())])


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, columns)], _RUN.names)


def _copies(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row has the anchor and the content of the row before it."""
    return np.concatenate([[False], (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])])


def run_table(docs: DataFrame, length: int) -> DataFrame:
    """The runs of all texts. Later copies within a stretch are marked; they need not meet the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
            columns = [c[order] for c in columns]
            same = _copies(columns)
            # repeated rows: the same place is no later copy
            group = np.flatnonzero(~same)
            head = np.repeat(group, np.diff(np.append(group, len(same))))
            again = same & (columns[2] == columns[2][head]) & (columns[3] == columns[3][head]) & (columns[4] == columns[4][head])
            keep = ~again
            return _batch([*[c[keep] for c in columns], (same & keep)[keep]])

        for part, data, bounds in text_slices(batches, "text", PART):
            text, start, n, anchor, content = window_runs(data, bounds, length)
            doc, key = part.column("doc").to_numpy()[text], part.column("text_key").to_numpy()[text]
            waiting.append([anchor, content, doc, key, start, n])
            size += len(data)
            if size > STRETCH:
                yield flush()
                waiting, size = [], 0
        if waiting:
            yield flush()

    rows = docs.where(F.octet_length("text") >= length).select(F.coalesce("doc_id", F.lit(LEAST)).cast("long").alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    return stored(rows.mapInArrow(run, _RUN), "runs")


def _buckets(rows: int, least: float) -> int:
    """Buckets of anchors, a power of two: enough that few of them reach ``least`` runs by chance."""
    return 1 << max(16, int(np.ceil(np.log2(max(1.0, 4 * rows / least)))))


def hot_anchors(table: DataFrame, length: int, most: int) -> DataFrame:
    """The anchors whose runs, copies aside, have more than ``most`` bytes. Buckets of anchors are counted first, so that only anchors of large
    buckets are counted one by one."""
    fresh = table.where(~F.col("copy")).select("anchor", (F.col("n") + length).alias("size"))
    bucket = F.pmod(F.col("anchor"), F.lit(_buckets(table.count(), most / (2 * length)))).alias("bucket")
    large = fresh.groupBy(bucket).agg(F.sum("size").alias("size")).where(F.col("size") > most).select("bucket")
    near = fresh.withColumn("bucket", bucket).join(small_side(large), "bucket", "left_semi")
    return stored(near.groupBy("anchor").agg(F.sum("size").alias("size")).where(F.col("size") > most).select("anchor"), "hot")


def shard_copies(fresh: DataFrame, split: bool = False) -> DataFrame:
    """From runs that are no copies yet: the later copies (copy), and one run of each kind of the anchors with several kinds; with ``split``,
    an anchor's kinds are in several tasks, and one run of each kind of all anchors is returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the stream so far: the first run of the content that was last, whether its anchor already had two kinds
        head: np.ndarray | None = None
        waits = False  # the head is the only kind of its anchor so far and wasn't returned
        for part in batches:
            columns = [part.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if not len(columns[0]):
                continue
            if head is not None:
                columns = [np.concatenate([head[k : k + 1], c]) for k, c in enumerate(columns)]
            same = _copies(columns)
            group = np.flatnonzero(~same)
            first = np.repeat(group, np.diff(np.append(group, len(same))))
            later = same & ~((columns[2] == columns[2][first]) & (columns[3] == columns[3][first]) & (columns[4] == columns[4][first]))
            anchor = columns[0][group]
            joined = anchor[1:] == anchor[:-1]
            several = np.concatenate([[False], joined]) | np.concatenate([joined, [False]]) | split
            out = several.copy()
            if head is not None and not waits:
                out[0] = False  # it was returned before
            if head is None or len(group) > 1:
                waits = not several[-1]
            rows = np.concatenate([group[out], np.flatnonzero(later)])
            flag = np.concatenate([np.zeros(out.sum(), bool), np.ones(later.sum(), bool)])
            if len(rows):
                yield _batch([*[c[rows] for c in columns], flag])
            head = np.array([c[group[-1]] for c in columns], np.int64)

    sorted_ = fresh.repartition("anchor", *["content"] * split).sortWithinPartitions("anchor", "content", "doc", "text_key", "start")
    return stored(sorted_.mapInArrow(run, _RUN), "shards")


def _cut(reps: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of runs, cut from the whole texts."""
    wanted = reps.groupBy("doc", "text_key").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("pieces"))
    texts = docs.where(F.octet_length("text") >= length).select(F.coalesce("doc_id", F.lit(LEAST)).cast("long").alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    schema = T.StructType([*_RUN.fields[:1], *_RUN.fields[2:6], T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in text_slices(batches, "text", PART):
            lists = part.column(part.schema.get_field_index("pieces"))
            piece = lists.flatten()
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            anchor, start, n = [piece.field(k).to_numpy() for k in range(3)]
            a = bounds[owner] + start
            size = n + length - 1
            take = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            body = data[take]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())])
            columns = [anchor, part.column("doc").to_numpy()[owner], part.column("text_key").to_numpy()[owner], start, n]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), binary], schema.names)

    return texts.join(small_side(wanted), ["doc", "text_key"]).dropDuplicates(["doc", "text_key"]).mapInArrow(run, schema)


def shard_suffixes(reps: DataFrame, docs: DataFrame, length: int, shard_bytes: int = 2 << 20) -> DataFrame:
    """(doc, text_key, start, n): runs of windows that stand earlier in another run under their anchor."""
    size = reps.agg(F.sum(F.col("n") + length)).first()[0] or 0
    schema = T.StructType(_RUN.fields[2:6])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        parts, total = [], 0
        symbols = _Growing()
        for part in batches:
            for k, name in enumerate(schema.names):
                columns[k].append(part.column(part.schema.get_field_index(name)).to_numpy())
            data, bounds = utf8(part.column(part.schema.get_field_index("bytes")).cast(pa.large_binary()).view(pa.large_string()))
            ended = np.zeros(len(data) + part.num_rows, np.uint16)
            ended[np.arange(len(data)) + np.repeat(np.arange(part.num_rows), np.diff(bounds))] = data.astype(np.uint16) + 1
            symbols.add(ended)
            parts.append(np.diff(bounds) + 1)
            total += len(ended)
        if not total:
            return
        doc, key, start, n = map(np.concatenate, columns)
        begin = np.concatenate([[0], np.cumsum(np.concatenate(parts))])
        text = symbols.array()
        gone = np.zeros(total, bool)
        carry = np.zeros(0, np.int64)
        for entries in induced_sort.suffixes(text, 257, length):
            near = entries["lcp"] >= length
            at = np.concatenate([carry, entries["at"]])
            near = np.concatenate([np.arange(len(carry)) > 0, near])
            first = np.flatnonzero(~near) if len(near) else near
            if len(carry) == 0 and len(near):
                near[0] = False
                first = np.flatnonzero(~near)
            least = np.minimum.reduceat(at, first)
            mine = np.repeat(least, np.diff(np.append(first, len(at))))
            gone[at[at != mine]] = True
            carry = mine[-1:]  # the least place stands for its interval in the next chunk
        for lo in range(0, len(doc), 1 << 16):
            hi = min(lo + (1 << 16), len(doc))
            a, b = runs(gone[begin[lo] : begin[hi]])
            a = a + begin[lo]
            own = np.searchsorted(begin, a, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(key[own]), pa.array(start[own] + a - begin[own]), pa.array(b + begin[lo] - a)], schema.names)

    cut = _cut(reps, docs, length).repartition(max(1, -(-int(size) // shard_bytes)), "anchor").sortWithinPartitions("doc", "text_key", "start")
    return cut.mapInArrow(run, schema)


def hot_windows(reps: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(doc, text_key, start, n): single windows that stand earlier in another run under their anchor, by the hash of their bytes."""
    schema = T.StructType([_RUN.fields[0], T.StructField("window", T.LongType()), *_RUN.fields[2:5]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            anchor, doc, key, start, n = [part.column(part.schema.get_field_index(c)).to_numpy() for c in ("anchor", "doc", "text_key", "start", "n")]
            data, bounds = utf8(part.column(part.schema.get_field_index("bytes")).cast(pa.large_binary()).view(pa.large_string()))
            own = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            at = bounds[own] + step
            window = Hasher(data).of(at, at + length).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (anchor[own], window, doc[own], key[own], start[own] + step))], schema.names)

    windows = stored(_cut(reps, docs, length).mapInArrow(run, schema), "windows")
    place = F.struct("doc", "text_key", "start")
    # the minima are stored, so that the join can split the rows of a window that very many documents have
    first = windows.groupBy("anchor", "window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    later = windows.join(stored(first, "first"), ["anchor", "window"]).where(F.col("first") < place)
    return later.select("doc", "text_key", "start", F.lit(1).cast("long").alias("n"))


class _Growing:
    """Symbols of a shard; on disk once they are more than memory should hold."""

    def __init__(self, most: int = 256 << 20):
        self.parts, self.size, self.most, self.file = [], 0, most, None

    def add(self, part: np.ndarray) -> None:
        self.parts.append(part)
        self.size += len(part)
        if self.size * part.itemsize > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(np.concatenate(self.parts).tobytes())
            self.parts = []

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts)
        self.file.write(np.concatenate([np.zeros(0, np.uint16), *self.parts]).tobytes())
        self.file.flush()
        return np.memmap(self.file, np.uint16, "r")


def dedup(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_removed, spans (start, end in bytes), kept (the bytes left)."""
    spark = docs.sparkSession
    with scratch_scope(spark) as folder:
        found = run_table(docs, length)
    fresh = found.where(~F.col("copy")).drop("copy")
    place = ["doc", "text_key", "start", "n"]
    gone = stored(found.where("copy").select(*place), "copies")
    anchors = hot_anchors(found, length, hot)
    split = None
    if anchors.take(1):
        anchors = small_side(anchors)
        split = shard_copies(fresh.join(anchors, "anchor", "left_semi"), split=True)
        fresh = fresh.join(anchors, "anchor", "left_anti").select(*fresh.columns)
    shards = shard_copies(fresh)
    # the runs are in the shards and copies now, which are stored themselves
    drop_folder(spark, folder)
    if split is not None:
        gone = gone.union(split.where("copy").select(*place)).union(hot_windows(split.where(~F.col("copy")), docs, length))
    gone = gone.union(shards.where("copy").select(*place)).union(shard_suffixes(shards.where(~F.col("copy")), docs, length))
    gone = gone.groupBy("doc", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("windows"))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LEAST)).cast("long").alias("o_doc"), F.xxhash64("text").alias("o_key"), "text")
    joined = rows.join(gone, (F.col("o_doc") == F.col("doc")) & (F.col("o_key") == F.col("text_key")), "left").select("doc_id", "text", "windows")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in text_slices(batches, "text", PART):
            lists = part.column("windows")
            filled = lists.fill_null(pa.scalar([], lists.type)) if lists.null_count else lists
            piece = filled.flatten()
            owner = np.repeat(np.arange(part.num_rows), np.diff(filled.offsets.to_numpy()))
            start, n = piece.field(0).to_numpy(), piece.field(1).to_numpy()
            a = bounds[owner] + start
            level = np.zeros(len(data) + 1, np.int64)
            np.add.at(level, a, 1)
            np.add.at(level, a + n + length - 1, -1)
            mask = np.cumsum(level)[:-1] > 0
            # spans end with their text
            edge = np.zeros(len(data) + 1, bool)
            edge[bounds] = True
            first = mask.copy()
            first[1:] &= ~mask[:-1] | edge[1:-1]
            last = mask.copy()
            last[:-1] &= ~mask[1:] | edge[1:-1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            of = np.searchsorted(bounds, s, "right") - 1
            ends = np.searchsorted(s, bounds).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(s - bounds[of]), pa.array(e - bounds[of])], ["start", "end"]))
            left = np.concatenate([[0], np.cumsum(~mask)])[bounds]
            kept = data[~mask]
            body = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())])
            size = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(size - np.diff(left)), spans, body], schema.names)

    return joined.mapInArrow(run, schema)
