"""Language identification by one bit-sliced Bloom filter of byte n-grams for all languages.

A slot of the filter holds one bit for each language, in words of 64. The bitwise AND of the slots of an n-gram is the set of all languages
whose filter contains it; two gathers a word answer for 64 languages at once. A text is decided by how many of its n-grams each
language contains, less what its filter's false positives explain: with n n-grams, h hits and the false-positive rate f of
the language, (h - n f) / (1 - f).

Learning: about ``fit_rows`` labelled rows and ``fit_chars`` characters of each language are drawn by a hash of the id (all, if there are
fewer). An n-gram belongs to a language if its rate there is at least ``share`` times its highest rate in any language; the
``most`` most frequent ones of each language are kept, so the filter has a fixed size.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any learned language every text is ``und``; a text of which no
n-gram is known gets the language of most rows, with score 0; ties go to the language with more rows; all labels are
learned, however many; repeated rows get equal results; all columns of the input stay, replaced where the names
clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm.common import per_text, text_slices
from twinlens.session import stored

#: Bits of a word, and bytes of text that a task looks at together.
WORD, PART = 64, 1 << 20
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class Filter:
    """``slots``: for each word of languages, their set for each slot; ``false``: false-positive rate of each language."""

    names: list[str]
    slots: np.ndarray
    false: np.ndarray

    def languages_of(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        """The set (bit mask) of languages of a word that contain each n-gram."""
        a, b = _slots(grams, self.slots.shape[1])
        return self.slots[word][a] & self.slots[word][b]


def _slots(grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint32(32 - (size.bit_length() - 1))
    return (grams * np.uint32(0x9E3779B1)) >> shift, ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> shift


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-byte n-grams of texts that begin with one space and end with three, and the bounds of each text. Signs and digits count as
    spaces; n-grams that begin with two spaces are left out, which also ends every text."""
    b = _SPACE[data].astype(np.uint32)
    if len(b) < 4:
        return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
    codes = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    keep = (codes & np.uint32(0xFFFF)) != 0x2020
    before = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], before[np.minimum(bounds, len(keep))]


def _padded(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))), F.lit("   ")).alias("_padded"))


def learn(docs: DataFrame, fit_rows: int = 5_000, fit_chars: int = 20_000_000, share: float = 0.5, most: int = 30_000) -> Filter:
    """A filter from the rows of ``docs`` with text and lang."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).orderBy(F.desc("n"), "lang").collect()
    names = [r["lang"] for r in sizes]
    if not names:
        return Filter([], np.zeros((0, 1 << 10), np.uint64), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1 << 30))
    spark, index = docs.sparkSession, {x: k for k, x in enumerate(names)}
    parts = [(r["lang"], int(min(1.0, fit_rows / r["n"], fit_chars / max(1, r["chars"])) * (1 << 30))) for r in sizes]
    part = F.broadcast(spark.createDataFrame(parts, "lang string, _part long"))
    sample = _padded(rows.select("doc_id", "text", "lang").join(part, "lang").where(draw < F.col("_part")), "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, data, bounds in text_slices(batches, "_padded", PART):
            codes, ends = grams(data, bounds)
            lang = np.array([index[x] for x in rows_.column("lang").to_pylist()])
            keys, n = np.unique(np.repeat(lang, np.diff(ends)).astype(np.uint64) << np.uint64(32) | codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(32)).astype(np.int32)), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = stored(sample.mapInArrow(count, "lang int, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "counts")
    table = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"))
    totals = F.broadcast(counts.groupBy("lang").agg(F.sum("n").cast("double").alias("total")))
    # n-grams of one language stay within the drawn text, whose size is bounded
    rated = table.select("gram", F.explode("by").alias("x")).select("gram", "x.lang", "x.n").join(totals, "lang").select("gram", "lang", "n", (F.col("n") / F.col("total")).alias("rate"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "n", "rate")).alias("by"))
    own = best.select("gram", F.explode("by").alias("x"), "best").where((F.col("x.n") > 1) & (F.col("x.rate") >= share * F.col("best"))).select("x.lang", "gram", "x.n")
    slots_bits = max(10, int(np.ceil(np.log2(most * 8))))
    slots, held = np.zeros((-(-len(names) // WORD), 1 << slots_bits), np.uint64), np.zeros(len(names))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = stored(own.withColumn("_place", place).where(F.col("_place") <= most).select("lang", "gram"), "grams")
    for word in range(len(slots)):
        # the driver holds the n-grams of one word of languages at a time
        part = top.where(F.col("lang").between(word * WORD, word * WORD + WORD - 1)).toArrow()
        lang, kept = part["lang"].to_numpy() - word * WORD, part["gram"].to_numpy().astype(np.uint32)
        for at in _slots(kept, slots.shape[1]):
            np.bitwise_or.at(slots[word], at, np.uint64(1) << lang.astype(np.uint64))
    for k in range(len(names)):
        held[k] = ((slots[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).mean()
    return Filter(names, slots, held**2)


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """``docs`` with lang_pred, score (the share of the n-grams that the language explains, 0 to 1) and n_grams."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop("lang_pred", "score", "n_grams", "_padded")
    kept = out.columns
    fields = [*out.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_grams", T.LongType())]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for rows, data, bounds in text_slices(batches, "_padded", PART):
            codes, ends = grams(data, bounds)
            n = np.diff(ends)
            best, score = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows)
            for k in range(len(m.names)):
                if k % WORD == 0:
                    sets = m.languages_of(codes, k // WORD)
                hits = per_text(((sets >> np.uint64(k % WORD)) & np.uint64(1)).astype(np.uint8), ends)
                own = np.clip((hits - n * m.false[k]) / (1 - m.false[k]), 0, None) / np.maximum(n, 1)
                best, score = np.where(own > score, k, best), np.maximum(own, score)
            letters = [any(map(str.isalpha, t)) for t in rows.column("_padded").to_pylist()]
            names = [m.names[b] if m.names and has else "und" for b, has in zip(best, letters, strict=True)]
            value = np.where(letters, np.clip(score, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in kept], pa.array(names, pa.string()), pa.array(value), pa.array(n)], [*kept, "lang_pred", "score", "n_grams"])

    return _padded(out, *[F.col(f"`{c}`") for c in kept]).mapInArrow(predict, T.StructType(fields))
