"""SimHash near-dedup by anchor-point covering.

Fingerprint. A-Z are lower-cased, words are runs without ASCII white space, shingles are ``words`` consecutive words joined by a space (the whole
sequence, if it is shorter), each as often as it occurs. Bit k of the 64 is set if it is set in more than half of the shingles' XXH64 values
(seed 42). Two fingerprints link if at most ``DISTANCE`` bits differ; the group of a document is what links reach, named by its smallest doc_id.

Method. The anchors are the words of a linear covering code: every bit string is within the code's covering radius R of an anchor, its home
(one only, as the codes are perfect). If x and y differ in at most t bits, y is within R + t of x's home. So each distinct fingerprint goes to every
anchor within R + t, and at each anchor the ones at home are compared with all that came. The patterns that lead from a fingerprint to its
anchors depend on its syndrome alone, so they are looked up, not searched.

One code over all 64 bits would need hundreds of copies or leave a tenth of the table at each anchor. The bits are therefore dealt into
blocks with a code each, of which one has to be hit: fingerprints that differ in at most 4 bits differ in at most t_i bits in
some block i whenever the t_i + 1 sum to at least 5. ``FINE`` has 2^18 anchors on two blocks (t = 1: Hamming's code and 7 free bits)
and 2^20 on the third one (t = 0: every word is an anchor, R = 0), 33 copies at most 32 on average. ``FINER`` is for tables beyond ``MANY`` distinct fingerprints: Golay's code and 13
free bits with t = 2, Hamming's code and 13 free bits with t = 1, 2^25 and 2^24 anchors, some 190 copies. Both find every link.

Anchors with many fingerprints at home are cut: the homes are dealt into parts of ``HOMES`` by hash, and what came meets each part; homes are
held by a task, the others pass by. What a task finds is reduced to trees before it leaves, so a group of m alike
fingerprints gives some m links, not m * m. The comparisons inside such a group stay m * m / HOMES rows of one look each.

Defined cases: null, empty and blank texts have fingerprint zero, which links like any other; repeated rows get equal results;
rows with a null doc_id take part, but name no group (a group of such rows alone has a null component_id); an empty table gives none; further
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm.common import runs, text_slices
from twinlens.llm.components import components, forest
from twinlens.session import small_side, stored

DISTANCE = 4
#: Fingerprints at home at one anchor that a task holds at a time.
HOMES = 4096
#: Distinct fingerprints from which on the anchors are dealt more finely.
MANY = 100_000_000
#: Shingles whose hashes are held at a time, and comparisons made at a time.
STEP, LOOKS = 1 << 16, 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Block:
    """``bits`` bits from ``start`` on; the lowest ``length`` of them have a cyclic code with the generator polynomial ``generator``
    and covering radius ``radius``, the others are free. ``differ`` bits may differ."""

    start: int
    bits: int
    length: int
    generator: int
    radius: int
    differ: int

    def column(self, bit: int) -> int:
        """x ** bit modulo the generator; 0 for a free bit."""
        if bit >= self.length:
            return 0
        rest = 1 << bit
        size = self.generator.bit_length()
        while rest.bit_length() >= size:
            rest ^= self.generator << (rest.bit_length() - size)
        return rest

    def ways(self) -> list[np.ndarray]:
        """For each syndrome the patterns of at most radius + differ bits that lead from a word to an anchor, lightest first."""
        out: dict[int, list[int]] = {}
        for weight in range(self.radius + self.differ + 1):
            for places in itertools.combinations(range(self.bits), weight):
                syndrome = 0
                for p in places:
                    syndrome ^= self.column(p)
                out.setdefault(syndrome, []).append(sum(1 << p for p in places))
        return [np.array(out[s], np.uint64) for s in range(len(out))]

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for bit in range(self.length):
            out ^= np.where((words >> np.uint64(bit)) & np.uint64(1) == 1, self.column(bit), 0)
        return out


# fixed values: generators of Hamming's code of 15 bits and Golay's code of 23 bits
HAMMING, GOLAY = 0b10011, 0b101011100011
FINE = (Block(0, 22, 15, HAMMING, 1, 1), Block(22, 22, 15, HAMMING, 1, 1), Block(44, 20, 0, 1, 0, 0))
FINER = (Block(0, 36, 23, GOLAY, 3, 2), Block(36, 28, 15, HAMMING, 1, 1))


def votes(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, lowest bit first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(data: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint of each text."""
    low = _LOWER[data]
    # words of all texts one after the other, each followed by one blank
    apart = np.full(len(low) + len(bounds), 32, np.uint8)
    apart[np.arange(len(low)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = low
    word = ~_SPACE[apart]
    keep = word.copy()
    keep[1:] |= word[:-1]
    a, b = runs(word)
    ends = np.searchsorted(a, bounds[1:] + np.arange(1, len(bounds)))
    text = np.where(word, apart, 32)[keep].astype(np.uint8).tobytes()
    size = b - a + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(len(bounds) - 1, np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    first = 0
    for k, last in enumerate(ends):
        n = last - first
        if n:
            width = min(words, n)
            total, count = np.zeros(64, np.int64), n - width + 1
            for lo in range(first, first + count, STEP):
                hi = min(lo + STEP, first + count)
                cut = zip(at[lo:hi].tolist(), (at[lo + width : hi + width] - 1).tolist())
                total += votes(np.fromiter((xxhash.xxh64_intdigest(text[s:e], 42) for s, e in cut), np.uint64, hi - lo))
            out[k] = powers[2 * total > count].sum()
        first = last
    return out


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) of each row, the fingerprint as a signed number."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in text_slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(data, bounds, words).view(np.int64))], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def covered(prints: DataFrame, blocks: tuple[Block, ...]) -> DataFrame:
    """(cell, fp, home): each fingerprint at every anchor within reach; ``home`` at the nearest one of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = [b.ways() for b in blocks]
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                fp = batch.column(0).slice(start, 8192).to_numpy().view(np.uint64)
                for i, (block, way) in enumerate(zip(blocks, ways)):
                    part = (fp >> np.uint64(block.start)) & np.uint64((1 << block.bits) - 1)
                    syndrome = block.syndromes(part)
                    number = np.array([len(w) for w in way])[syndrome]
                    lists, first = np.concatenate(way), np.cumsum([0] + [len(w) for w in way])[syndrome]
                    own = np.repeat(np.arange(len(fp)), number)
                    step = np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number)
                    anchor = part[own] ^ lists[first[own] + step]
                    cell = (anchor << np.uint64(2)) | np.uint64(i)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp[own].view(np.int64)), pa.array(step == 0)], ["cell", "fp", "home"])

    return prints.select("fp").mapInArrow(run, "cell long, fp long, home boolean")


def _compared(rows: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Trees of the links at each anchor. Rows (cell, part, home, fp) come in order, homes first."""
    last, held = None, np.empty(0, np.uint64)  # the group that the next batch may go on with, and its homes
    for batch in rows:
        if not batch.num_rows:
            continue
        cell, part, home, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        fp = fp.view(np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]), [True]]))
        before = np.concatenate([[0], np.cumsum(home)])
        size, count, flat = np.diff(cut), before[cut[1:]] - before[cut[:-1]], fp[home]
        if last == (cell[0], part[0]):
            flat = np.concatenate([held, flat])
            count[0] += len(held)
        at = np.cumsum(count) - count
        last, held = (cell[-1], part[-1]), flat[at[-1] :]
        # every row meets the homes of its group, so many rows at a time that the looks are bounded
        group = np.repeat(np.arange(len(size)), size)
        looks = np.cumsum(count[group])
        found, start = [], 0
        while start < len(fp):
            stop = max(start + 1, int(np.searchsorted(looks, (looks[start - 1] if start else 0) + LOOKS, "right")))
            n = count[group[start:stop]]
            row = np.repeat(np.arange(start, stop), n)
            other = flat[np.repeat(at[group[start:stop]] - (np.cumsum(n) - n), n) + np.arange(len(row))]
            mine = fp[row]
            near = (np.bitwise_count(mine ^ other) <= distance) & (mine != other)
            if near.any():
                found.append(forest(mine[near].view(np.int64), other[near].view(np.int64)))
            start = stop
        if found:
            member, root = (np.concatenate(x) for x in zip(*found))
            member, root = forest(member, root)
            yield pa.RecordBatch.from_arrays([pa.array(member), pa.array(root)], ["a", "b"])


def links(prints: DataFrame, blocks: tuple[Block, ...], distance: int = DISTANCE, most: int = HOMES) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp``, as many as join what is linked."""
    rows = stored(covered(prints, blocks), "anchors")
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0")
    crowded = small_side(sizes.where(F.col("homes") > most).select("cell", F.ceil(F.col("homes") / most).cast("int").alias("parts")))
    dealt = rows.join(crowded, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # at a crowded anchor a home goes to its part, and everything passes by every part
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    dealt = dealt.select("cell", "part", (F.col("home") & (F.col("part") == mine)).alias("home"), "fp")
    ordered = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", F.desc("home"))
    return ordered.mapInArrow(lambda it: _compared(it, distance), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, distance: int = DISTANCE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    if distance > DISTANCE:
        raise ValueError(f"the anchors are laid out for at most {DISTANCE} bits")
    facts = stored(signed(docs, words), "fingerprints")
    classes = stored(facts.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    found = links(classes, FINE if classes.count() <= MANY else FINER, distance)
    roots = components(found).select(F.col("member").alias("fp"), "root")
    named = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("rows"))
    # only groups of several rows have to be looked up; a row alone is its own group
    several = stored(named.join(least.where("rows > 1"), "root").select(F.col("fp").alias("o_fp"), "component_id", F.lit(True).alias("several")), "groups")
    out = facts.join(small_side(several, 1_000_000), F.col("fp") == F.col("o_fp"), "left")
    component = F.when(F.col("several"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
