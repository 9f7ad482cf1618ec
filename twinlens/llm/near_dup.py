"""MinHash near-dedup with SuperMinHash signatures.

The set of a document is its distinct shingles of ``words`` consecutive words (A-Z lower-cased, words are runs without
ASCII white space); two documents are linked if their sets have a Jaccard similarity of at least ``percent`` / 100. The
group of a document is what links reach, named by the smallest doc_id.

Method. (1) One pass takes from each text its number of shingles, a 128-bit digest of the set and a SuperMinHash signature: each
element puts j + uniform, j = 0, 1, 2 ..., into the slots of its own random permutation, so a slot's minimum has few collisions, and step j
is left out once every slot of the document is below j. Documents of equal digest are one class. (2) Signatures of classes are cut into bands;
classes of an equal band meet in a bucket. With ``ROWS`` x ``BANDS`` slots a pair at 0.8 shares no
bucket with a probability of 5e-6, and a more similar one with less. (3) Verification compares whole sets, taken again from the whole texts, never signatures. Sets whose
sizes alone rule a link out are not compared. In a first round the members of a bucket meet one of them, its pivot. Buckets that then still hold members of several
components, the pivot aside, are open; what open buckets connect is a group. The members of a group, one component after the other, are cut into blocks of
some ``BLOCK`` shingles, and a task takes two blocks, unless all of both are one component already: it counts the elements that sets share by
products of 0/1 matrices and links those pairs that share an open bucket, too. So a pair is compared at most twice, no pair is ever a row, a group of copies is done after the first round, and a task holds two blocks.
(4) Links are grouped by union-find: each task joins its links into trees, and trees that
share a member are hung on the smallest one until nothing changes; no task holds all links.

Defined cases: null, empty and blank texts have no shingle and are linked with nothing; fewer words than ``words``: the whole sequence is
the one shingle; rows with a null doc_id are linked with nothing and have a null component; repeated rows get equal results; an empty table
gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm.common import mix, runs, text_slices, utf8
from twinlens.llm.components import forest
from twinlens.operators.ranking import ordered_scan
from twinlens.session import small_side, stored

ROWS, BANDS = 6, 40
#: Shingles of a block; a member counts as so many more.
BLOCK, MEMBER = 1_000_000, 2_000
SLOTS = ROWS * BANDS
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_names(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit names of words that lie end to end, by XXH64 of the distinct ones."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    names = np.fromiter((xxhash.xxh64_intdigest(w, 9) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return names[coded.indices.to_numpy(zero_copy_only=False)]


def shingles(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit names of the distinct shingles of all texts, sorted within a text; bounds of the texts)."""
    low = _LOWER[data]
    # a word ends at white space and with its text: texts are set apart by one blank each
    apart = np.full(len(low) + len(bounds), 32, np.uint8)
    apart[np.arange(len(low)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = low
    inside = ~_SPACE[apart]
    a, b = runs(inside)
    h = word_names(apart[inside], b - a)
    ends = np.searchsorted(a, bounds[1:] + np.arange(1, len(bounds)))
    n = np.diff(np.concatenate([[0], ends]))
    width = np.minimum(np.maximum(n, 1), words)
    count = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), count)
    first = np.repeat(ends - n - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    name = np.zeros(len(first), np.uint64)
    for k in range(words):
        on = width[owner] > k
        name[on] = mix(name[on] * np.uint64(0x9E3779B97F4A7C15) + h[first[on] + k] + np.uint64(k + 1))
    order = np.lexsort((name, owner))
    name, owner = name[order], owner[order]
    keep = np.ones(len(name), bool)
    keep[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    return name[keep], np.searchsorted(owner[keep], np.arange(len(n) + 1))


def super_min_hash(names: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """(texts, slots) signatures as 32-bit numbers; rows of texts without elements are 0."""
    texts = len(bounds) - 1
    out = np.zeros((texts, slots), np.uint32)
    at = 0
    while at < texts:
        # as many texts as give a bounded number of permutations at once; one text is cut into parts and merged
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 4096, "right")) - 1)
        best = np.full((stop - at) * slots, np.inf)
        for lo in range(bounds[at], bounds[stop], 4096):
            hi = min(lo + 4096, bounds[stop])
            owner = np.searchsorted(bounds[at : stop + 1], np.arange(lo, hi), "right") - 1
            _fill(best, names[lo:hi], owner, slots)
        value = best.reshape(-1, slots)
        value[np.isinf(value)] = 0
        out[at:stop] = mix((value * (1 << 43)).astype(np.uint64)) >> np.uint64(32)
        at = stop
    return out


def _fill(best: np.ndarray, names: np.ndarray, owner: np.ndarray, slots: int) -> None:
    place = np.tile(np.arange(slots, dtype=np.int16), (len(names), 1))
    row, state, base = np.arange(len(names)), names.copy(), owner * slots
    for j in range(slots):
        state = mix(state + np.uint64(0x632BE59BD9B4E019))
        pick = j + ((state >> np.uint64(40)) * np.uint64(slots - j) >> np.uint64(24)).astype(np.int64)
        value = j + (state & np.uint64((1 << 32) - 1)).astype(np.float64) / (1 << 32)
        chosen = place[row, pick]
        place[row, pick] = place[row, j]
        np.minimum.at(best, base + chosen, value)
        if j % 4 == 3 or j < 4:
            # a text whose slots are all below j + 1 can't change any more
            open_ = best.reshape(-1, slots).max(1) > j + 1
            live = open_[base // slots]
            if not live.all():
                row, state, base = row[live], state[live], base[live]
                if not len(row):
                    return


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest, bands) of each row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_slices(batches, "text", 1 << 20):
            names, bounds = shingles(data, ends, words)
            signature = super_min_hash(names, bounds)
            band = np.zeros((len(signature), BANDS), np.uint64)
            for k in range(ROWS):
                band = mix(band * np.uint64(31) + signature[:, k::ROWS].astype(np.uint64) + np.uint64(1))
            band = mix(band + np.arange(1, BANDS + 1, dtype=np.uint64))
            total = np.concatenate([[np.uint64(0)], np.cumsum(names)]), np.concatenate([[np.uint64(0)], np.cumsum(mix(names))])
            sums = np.column_stack([t[bounds[1:]] - t[bounds[:-1]] for t in total])
            digest = pa.array([x.tobytes() for x in sums], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(band) + 1, dtype=np.int32) * BANDS), pa.array(band.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(np.diff(bounds)), digest, lists], schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, schema)


def shingle_names(texts: DataFrame, words: int) -> DataFrame:
    """(member, names): the sorted 64-bit names of the whole sets of ``texts`` (member, text)."""
    schema = T.StructType([texts.schema["member"], T.StructField("names", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_slices(batches, "text", 1 << 20):
            names, bounds = shingles(data, ends, words)
            lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(names.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("member"), lists.cast(pa.list_(pa.int64()))], schema.names)

    return texts.select("member", "text").mapInArrow(run, schema)


def _sets(column: pa.Array) -> list[np.ndarray]:
    flat, bounds = column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def shared_counts(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many elements each two of the sets share: products of 0/1 matrices, some elements at a time; elements of one set alone are left out."""
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(every, return_inverse=True, return_counts=True)
    often = np.flatnonzero(times > 1)
    place = np.full(len(times), -1, np.int64)
    place[often] = np.arange(len(often))
    place = place[at]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, len(often), columns):
        mine = np.flatnonzero((place >= low) & (place < low + columns))
        hit = np.zeros((len(sets), min(columns, len(often) - low)), np.float32)
        hit[owner[mine], place[mine] - low] = 1
        out += np.rint(hit @ hit.T).astype(np.int64)
    return out


def linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are similar enough to ``one``."""
    sizes = np.array([len(x) for x in others])
    every = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * common >= percent * (len(one) + sizes - common)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members whose whole sets (member, names) are similar enough; a pivot that many pairs share is
    split by the engine's skew join."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(sets.withColumnsRenamed({"member": side, "names": f"names_{side}"}), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x, y = (_sets(part.column(part.schema.get_field_index(f"names_{side}"))) for side in ("a", "b"))
                good = [bool(linked(u, [v], percent)[0]) for u, v in zip(x, y, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "names_a", "names_b").mapInArrow(run, pairs.select("a", "b").schema)


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the members of two blocks. ``rows`` (group, left, right, side, member, open, names) come in order of the first three; ``open`` are the open
    buckets of a member."""
    schema = T.StructType([T.StructField("a", rows.schema["member"].dataType), T.StructField("b", rows.schema["member"].dataType)])

    def found(table: pa.Table) -> pa.RecordBatch:
        member, sets = table.column("member").combine_chunks(), _sets(table.column("names").combine_chunks())
        side, size = table.column("side").to_numpy(), np.array([len(s) for s in sets])
        lists = table.column("open").combine_chunks()
        bucket, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(sets)), lists.value_lengths().to_numpy())
        order = np.argsort(bucket, kind="stable")
        bucket, owner = bucket[order], owner[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        meets = np.zeros((len(sets), len(sets)), bool)
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if e - s > 1:
                meets[np.ix_(owner[s:e], owner[s:e])] = True
        if side.any():
            # two blocks: what meets within one is compared where that block meets itself
            meets &= side[:, None] != side[None, :]
        common = shared_counts(sets)
        i, j = np.nonzero(np.triu(meets & (100 * common >= percent * (size[:, None] + size[None, :] - common)), 1))
        # as many links as join what is linked
        first, second = forest(i, j)
        return pa.RecordBatch.from_arrays([member.take(pa.array(first)), member.take(pa.array(second))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("group", "left", "right")]
            cut = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0), [True]]))
            for start, stop in zip(cut[:-1], cut[1:], strict=True):
                now = tuple(int(c[start]) for c in columns)
                if held and now != key:
                    yield found(pa.Table.from_batches(held))
                    held = []
                key = now
                held.append(batch.slice(start, stop - start))
        if held:
            yield found(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def open_groups(buckets: DataFrame, roots: DataFrame | None) -> DataFrame | None:
    """(member, group, root, open) of the members that may still be linked with another component: those that share a bucket with one, the
    bucket's pivot aside, which has met all others. None if there are none."""
    state = buckets.where("member != pivot").select("bucket", "member", "n")
    state = state.withColumn("root", F.col("member")) if roots is None else state.join(roots, "member", "left").withColumn("root", F.coalesce("root", "member"))
    state = stored(state, "state")
    several = state.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("member").alias("least")).where("low != high")
    left = stored(state.join(stored(several.select("bucket", "least"), "several"), "bucket"), "open")
    if not left.take(1):
        return None
    tied = union_find(left.where("member != least").select(F.col("least").alias("a"), F.col("member").alias("b")).distinct())
    each = left.groupBy("member", "root", "n").agg(F.collect_list("bucket").alias("open"))
    return each.join(tied.toDF("member", "top"), "member", "left").withColumn("group", F.xxhash64(F.coalesce("top", "member"))).drop("top")


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the members of each group (see ``open_groups``)."""
    weighed = ordered_scan(members, ["group"], ["root", "member"], {"before": F.col("n") + MEMBER})
    blocks = stored(weighed.withColumn("block", F.expr(f"before div {BLOCK}")).drop("before", "before_all", "n"), "blocks")
    spans = blocks.groupBy("group", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    spans = stored(spans, "spans")
    right = spans.toDF("o_group", "right", "o_low", "o_high")
    pairs = spans.join(right, (F.col("group") == F.col("o_group")) & (F.col("block") <= F.col("right")))
    pairs = pairs.where(~((F.col("low") == F.col("high")) & (F.col("o_low") == F.col("o_high")) & (F.col("low") == F.col("o_low"))))
    pairs = pairs.select("group", F.col("block").alias("left"), "right")
    # a block goes to each pair that it is part of, once
    ends = pairs.select("group", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    rows = blocks.join(small_side(ends, 1_000_000), ["group", "block"]).withColumn("side", (F.col("block") != F.col("left")).cast("int"))
    rows = rows.join(sets, "member").select("group", "left", "right", "side", "member", "open", "names")
    return _block_links(rows.repartition("group", "left", "right").sortWithinPartitions("group", "left", "right"), percent)


def _local_trees(links: DataFrame) -> DataFrame:
    """Links (a, b) as links (member, root) of trees of depth one, made by union-find within each task."""
    kind = links.schema["a"].dataType

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[tuple, tuple] = {}

        def find(x: tuple) -> tuple:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def hung() -> pa.RecordBatch:
            found = [(m, find(m)) for m in up]
            found = [(m, r) for m, r in found if m != r]
            side = lambda k: pa.array([{"doc_id": x[k][0], "text_key": x[k][1]} for x in found], to)
            return pa.RecordBatch.from_arrays([side(0), side(1)], ["member", "root"])

        for part in batches:
            to = part.schema.field(0).type
            for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                a, b = (x["doc_id"], x["text_key"]), (y["doc_id"], y["text_key"])
                up.setdefault(a, a)
                up.setdefault(b, b)
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > 300_000:  # bounded memory; what is cut apart here meets again when trees are joined
                yield hung()
                up.clear()
        if up:
            yield hung()

    return links.select("a", "b").mapInArrow(trees, T.StructType([T.StructField("member", kind), T.StructField("root", kind)]))


def union_find(links: DataFrame) -> DataFrame:
    """(member, root) of the connected components of the links (a, b): every member but the smallest, and the smallest one.

    Tasks make trees of their own links. Then each node hangs its larger neighbours on its smallest one, and each node hangs its smaller
    neighbours and itself on the smallest one, in turn, until all trees are stars on the smallest member."""
    edges = stored(_local_trees(links).distinct(), "trees")
    while True:
        # done when every member has one root and no root hangs on another one
        twice = edges.groupBy("member").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("member")
        hung = edges.select(F.col("root").alias("member")).distinct().join(edges.select("member"), "member", "left_semi")
        if not twice.union(hung).take(1):
            return edges
        both = edges.union(edges.select("root", "member")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = stored(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "trees")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("member"), F.col("m").alias("root"))
        edges = stored(down.union(least.select("u", "m")).distinct(), "trees")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    facts = stored(signatures(docs, words), "signatures")
    own = facts.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    place = F.struct("doc_id", "text_key")
    # stored, as are the full buckets below: then the joins read both sides by a shuffle of their own and can split a hot key's rows
    classes = stored(own.groupBy("digest", "n_shingles").agg(F.min(place).alias("class")), "heads")
    member_of = stored(own.select("digest", "n_shingles", place.alias("member")).join(classes, ["digest", "n_shingles"]).select("member", "class").distinct(), "classes")
    heads = own.join(member_of.where(F.col("member") == F.col("class")).select(F.col("class.doc_id").alias("doc_id"), F.col("class.text_key").alias("text_key")), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    entries = heads.select(place.alias("member"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    full = stored(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("member").alias("pivot")).where("size > 1").select("bucket", "pivot"), "full")
    buckets = stored(entries.join(full, "bucket"), "buckets")
    suspects = buckets.select("member.*").distinct()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(small_side(suspects, 1_000_000), ["doc_id", "text_key"], "left_semi")
    sets = stored(shingle_names(texts.select(place.alias("member"), "text").dropDuplicates(["member"]), words), "sets")
    pivots = buckets.where("member = pivot").select("bucket", F.col("n").alias("m"))
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    pairs = buckets.where("member != pivot").join(pivots, "bucket").where(fits).select(F.least("member", "pivot").alias("a"), F.greatest("member", "pivot").alias("b")).distinct()
    found = stored(_verify(pairs, sets, percent), "links")
    roots = union_find(found) if found.take(1) else None
    rest = open_groups(buckets, roots)
    if rest is not None:
        more = stored(block_links(rest, sets, percent), "links")
        if more.take(1):
            roots = union_find(found.unionByName(more))
    ids = member_of if roots is None else member_of.join(roots.toDF("class", "root"), "class", "left").withColumn("class", F.coalesce("root", "class"))
    # a class and a component are named by their smallest member
    out = ids.select(F.col("member.doc_id").alias("o_doc"), F.col("member.text_key").alias("o_key"), F.col("class.doc_id").alias("component_id"))
    joined = facts.select("doc_id", "text_key", "n_shingles").join(out, (F.col("doc_id") == F.col("o_doc")) & (F.col("text_key") == F.col("o_key")), "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
