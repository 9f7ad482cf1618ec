"""Helpers of the operators: batches of whole texts as byte arrays, document keys, held-out rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task looks at together; one longer text is looked at alone and whole.
BATCH_BYTES = 4 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the n + 1 bounds; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds) of runs of rows whose texts have at most ``most`` bytes together, or of one row."""
    for batch in batches:
        data, bounds = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start), data[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start]
            start = stop


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one for each byte, word or sentence) within each pair of bounds; 0 for an empty one."""
    out = np.zeros(len(bounds) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        # reduceat ends a run at the next start, and the runs that are not empty lie end to end
        out[full] = np.add.reduceat(values, bounds[:-1][full], dtype=out.dtype)
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(40))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, known: dict[int, np.ndarray], n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; the longest ones asked for are kept."""
    if base not in known or len(known[base]) <= n:
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        known[base] = p
    return known[base]


class Hasher:
    """64-bit polynomial hashes of any stretches of one byte array; equal bytes have equal hashes wherever they stand."""

    _known: dict[int, np.ndarray] = {}

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(int(_ODD), self._known, n)[:n], out=self.sums[1:])
        self.back = _powers(pow(int(_ODD), -1, 1 << 64), self._known, n)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text, modulo ``parts``, is ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, rows: int, chars: int) -> DataFrame:
    """(doc_id, text, _y) of about ``rows`` documents that have a label, of about ``chars`` characters in all; all, if there are fewer.

    The labels are drawn by the hash of their id before the join, so at most about ``rows`` of them are broadcast and no text is moved."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(label.cast("int").alias("_y")).where("_y is not null")
    draw, whole = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(71)), F.lit(1 << 30)), 1 << 30
    share = min(1.0, rows / max(1, marks.count()))
    joined = docs.select("doc_id", "text").join(F.broadcast(marks.where(draw < int(share * whole))), "doc_id").select("doc_id", "text", "_y")
    size = joined.agg(F.sum(F.length("text"))).first()[0] or 0
    return joined if size <= chars else joined.where(draw < int(share * chars / size * whole))
