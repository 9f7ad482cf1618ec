"""Approximate nearest neighbours by cosine: balanced posting lists under a graph of centroids.

Index. Centroids come from a bounded sample (``fit_rows`` rows, ``fit_values`` numbers): two-means cuts that deal out equal halves, down to one part for
each list; there are rows / ``list_rows`` lists, at most ``max_lists``, so the centroids and their neighbour graph have a fixed size. Every row of the
table goes to its nearest list and, if it lies at the boundary, to further ones whose distance is at most 1 + ``closure`` times the
nearest, ``copies`` in all. Neighbouring lists are put together in blocks of about ``block_rows`` rows; a list that a third of all rows belong
to is cut into many blocks.

Search. A beam walk over the centroid graph gives the lists of a query in order of distance; those farther than ``ratio`` times the nearest
are pruned. The ratio is set on the sample: it is the one at which ``recall`` of the true neighbours there lie in a list that is
searched. A query goes to each block that holds one of its lists, once, with a bit for each list of the block that says whether it is
searched: where many lists are, its numbers are not repeated for each of them. Queries are dealt into blocks, too; a task compares two blocks as
matrices, equal vectors only once and ``HELD`` pairs at a time, and returns the best of each query with exact cosines in double precision on the original
numbers; the best of all blocks are joined in two steps.

Defined cases: rows whose id or vector is null, and vectors that are zero, hold null or non-finite numbers, or have another length than
most, take no part; ties go to the smaller vec_id; a row with the query's vec_id is the query's own; repeated rows count once; fewer candidates
than ``k``: all of them; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.session import stored

LINKS, ENTRIES = 16, 16
#: Pairs that a task compares at a time, numbers of a block of vectors, and blocks of rows at least, so that small tables are many tasks, too.
HELD, BLOCK_VALUES, BLOCKS = 1 << 21, 1 << 22, 64


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>, or array<float> if it is one) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    single = isinstance(df.schema["embedding"].dataType, T.ArrayType) and isinstance(df.schema["embedding"].dataType.elementType, T.FloatType)
    rows = df.where(fine).select("vec_id", F.col("embedding") if single else v.alias("embedding"))
    most = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (most["n"] if most else 0))


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1 if rows else 0)


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that very large or small numbers keep their direction
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    closure: float
    copies: int
    ratio: float = 1.0
    width: int = 1

    def walk(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Cosines to centroids (queries, lists); -inf where the walk did not come. The ``width`` best seen are all expanded."""
        n, k = len(queries), len(self.centroids)
        # one product for all lists takes less than a gather of the pairs that the walk comes to
        near = queries @ self.centroids.T
        if width >= k:  # every list that it comes to is expanded, and the ring leads to all
            return near
        seen = np.full((n, k), -np.inf)
        seen[:, self.entries] = near[:, self.entries]
        unseen = np.ones((n, k), bool)
        unseen[:, self.entries] = False
        unseen = unseen.ravel()
        rows, nodes = np.repeat(np.arange(n), len(self.entries)), np.tile(self.entries, n)
        best = np.full((n, width), -np.inf)
        while len(rows):
            # lists that were not expanded when they came never are: the limit only rises
            fresh = seen[rows, nodes]
            count = np.bincount(rows, minlength=n)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            grid = np.full((n, width + count.max()), -np.inf)
            grid[:, :width] = best
            grid[rows, width + place] = fresh
            best = np.partition(grid, grid.shape[1] - width, axis=1)[:, -width:]
            open_ = fresh >= best[:, 0][rows]
            rows, nodes = rows[open_], nodes[open_]
            came = np.zeros(n * k, bool)
            for at in range(0, len(rows), 1 << 16):
                r, c = rows[at : at + (1 << 16)], nodes[at : at + (1 << 16)]
                came[(r[:, None] * k + self.graph[c]).ravel()] = True
            came &= unseen
            came = np.flatnonzero(came)
            unseen[came] = False
            rows, nodes = np.divmod(came, k)
            seen[rows, nodes] = near[rows, nodes]
        return seen

    def nearest(self, vectors: np.ndarray, width: int, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: lists within ``ratio`` of the nearest distance, at most ``most`` of them for a row."""
        rows, lists = [], []
        for at in range(0, len(vectors), 256):
            seen = self.walk(vectors[at : at + 256], min(width, len(self.centroids)))
            far = np.sqrt(np.maximum(2 - 2 * seen, 0))
            limit = far.min(1, keepdims=True) * ratio + 1e-9
            if most < far.shape[1]:
                limit = np.minimum(limit, np.partition(far, most - 1, axis=1)[:, most - 1, None])
            r, c = np.nonzero(far <= limit)
            if len(r) and np.bincount(r).max() > most:  # of equally far lists at the end the first ones
                order = np.lexsort((c, far[r, c], r))
                r, c = r[order], c[order]
                fine = np.arange(len(r)) - np.searchsorted(r, r) < most
                r, c = r[fine], c[fine]
            rows.append(r + at)
            lists.append(c)
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *lists])


def slices(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _balanced(x: np.ndarray, parts: int) -> np.ndarray:
    """Means of ``parts`` equally filled parts of the rows."""
    todo, out = [(np.arange(len(x)), parts)], []
    while todo:
        rows, n = todo.pop()
        if n == 1 or len(rows) < 2:
            mean = x[rows].mean(0)
            out.append(mean / max(np.linalg.norm(mean), 1e-12))
            continue
        own = x[rows]
        a, b = own[0], own[np.argmin(own @ own[0])]
        for _ in range(6):
            right = own @ (b - a) > 0
            if right.all() or not right.any():
                break
            a, b = own[~right].mean(0), own[right].mean(0)
        order = np.argsort(own @ (b - a), kind="stable")
        cut = len(rows) * (n // 2) // n
        todo += [(rows[order[:cut]], n // 2), (rows[order[cut:]], n - n // 2)]
    return np.array(out)


def fit(vectors: DataFrame, k: int = 5, list_rows: int = 256, max_lists: int = 4096, fit_rows: int = 20_000, fit_values: int = 8_000_000, closure: float = 0.15, copies: int = 2, recall: float = 0.985) -> Index | None:
    """An index of ``usable`` vectors; None without any."""
    n, size = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return None
    share = min(1.0, fit_rows / n, fit_values / size / n)
    drawn = vectors if share >= 1 else vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < max(1, int(share * (1 << 30))))
    table = drawn.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").toArrow()
    if not table.num_rows:
        table = vectors.limit(1).toArrow()
    sample = np.unique(unit(matrix(table.column("embedding"), table.num_rows)), axis=0)
    sample = sample[np.random.default_rng(0).permutation(len(sample))]
    lists = int(min(max(1, -(-n // list_rows)), max_lists, max(1, len(sample) // 8)))
    centroids = _balanced(sample, lists)
    near = centroids @ centroids.T
    np.fill_diagonal(near, -np.inf)
    links = np.argsort(-near, axis=1, kind="stable")[:, : min(LINKS, lists)]
    # a ring keeps every centroid within reach
    graph = np.column_stack([links, (np.arange(lists) + 1) % lists])
    entries = np.unique(np.linspace(0, lists - 1, min(ENTRIES, lists)).astype(int))
    index = Index(centroids, graph, entries, closure, copies)
    asked = sample[: min(300, len(sample))]
    truth = asked @ sample.T
    truth[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(k, len(sample) - 1)
    if lists > 1 and k > 0:
        found = np.argpartition(-truth, k - 1, axis=1)[:, :k]
        rows, owner = index.nearest(sample, 32, 1 + closure, copies)
        far = np.sqrt(np.maximum(2 - 2 * asked @ centroids.T, 0))
        nearest = np.maximum(far.min(1), 1e-9)
        first = np.searchsorted(rows, np.arange(len(sample)))
        last = np.searchsorted(rows, np.arange(len(sample)), "right")
        needed = [[min(far[q, owner[first[v] : last[v]]]) / nearest[q] for v in found[q]] for q in range(len(asked))]
        index.ratio = float(np.quantile(np.array(needed), recall, method="higher"))
        index.width = int((far <= nearest[:, None] * index.ratio).sum(1).max())
    return index


def postings(vectors: DataFrame, index: Index) -> DataFrame:
    """Stored (list, vec_id, embedding): every vector in its lists."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, lists = shared.value.nearest(unit(matrix(batch.column("embedding"), batch.num_rows)), 32, 1 + shared.value.closure, shared.value.copies)
            own = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), own.column("vec_id"), own.column("embedding")], ["list", "vec_id", "embedding"])

    return stored(vectors.select("vec_id", "embedding").mapInArrow(run, T.StructType([T.StructField("list", T.IntegerType()), vectors.schema["vec_id"], vectors.schema["embedding"]])), "postings")


@dataclass
class Layout:
    """Blocks of lists: those of list l are ``first[l]`` and the ``parts[l]`` - 1 after it; block b has lists ``low[b]`` to ``high[b]`` - 1."""

    first: np.ndarray
    parts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, block_rows: int) -> Layout:
        """Lists one after the other up to ``block_rows`` rows; a longer one is cut into equal blocks of its own."""
        first, parts, low, high, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), [], [], block_rows
        for x, n in enumerate(counts.tolist()):
            pieces = -(-n // block_rows) if n else 1
            if not low or pieces > 1 or held + n > block_rows:
                first[x], parts[x] = len(low), pieces
                low += [x] * pieces
                high += [x + 1] * pieces
                held = n if pieces == 1 else block_rows
            else:
                first[x], high[-1], held = len(low) - 1, x + 1, held + n
        return cls(first, parts, np.array(low, np.int64), np.array(high, np.int64))


def _pairs(index: Index, layout: Layout, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(block, probed, vec_id, embedding): each query once for each block it is compared with."""
    rows, found = index.nearest(unit(matrix(batch.column("embedding"), batch.num_rows)), index.width, index.ratio, index.width)
    wanted = np.zeros((batch.num_rows, len(index.centroids)), bool)
    wanted[rows, found] = True
    for block, (low, high) in enumerate(zip(layout.low.tolist(), layout.high.tolist(), strict=True)):
        at = np.flatnonzero(wanted[:, low:high].any(1))
        if len(at):
            own = batch.take(pa.array(at))
            bits = [x.tobytes() for x in np.packbits(wanted[at, low:high], axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block, np.int32)), pa.array(bits, pa.binary()), own.column("vec_id"), own.column("embedding")], ["block", "probed", "vec_id", "embedding"])


def _within(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _best(q: np.ndarray, asked: np.ndarray, wanted: np.ndarray, v: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vec_id, score) of the ``k`` best of each query among rows of the lists it wants; ``wanted`` is (queries, lists)."""
    # equal vectors are compared once; the smallest ids stand for them
    _, first, inverse = np.unique(np.ascontiguousarray(v).view([("", v.dtype)] * v.shape[1]).ravel(), return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    own, n = v[first], len(first)
    named = np.unique(np.stack([inverse, ids], 1), axis=0)
    start = np.searchsorted(named[:, 0], np.arange(n + 1))
    placed = np.unique(np.stack([inverse, lists], 1), axis=0)
    nth = _within(np.bincount(placed[:, 0], minlength=n))
    turns = [(placed[nth == x, 0], placed[nth == x, 1]) for x in range(nth.max() + 1)]
    length, units = np.sqrt((own * own).sum(1)), unit(own)
    need = min(k + 1, n)  # one of them may be the query itself
    # the best of every eighth vector bound the best of all from below
    some = 8 if n >= 16 * need else 1
    step = max(1, HELD // n)
    for at in range(0, len(q), step):
        x, w = q[at : at + step], np.ascontiguousarray(wanted[at : at + step].T)
        near = units @ unit(x).T
        fine = w[turns[0][1]]  # a vector is in one list at least
        for vector, place in turns[1:]:
            fine[vector] |= w[place]
        few = np.where(fine[::some], near[::some], -np.inf).T
        least = np.partition(few, few.shape[1] - need, axis=1)[:, few.shape[1] - need] - 1e-9
        a, i = np.divmod(np.flatnonzero((near >= least) & fine), len(x))
        score = np.empty(len(i))
        for cut in range(0, len(i), 1 << 14):
            r, c = i[cut : cut + (1 << 14)], a[cut : cut + (1 << 14)]
            score[cut : cut + (1 << 14)] = (own[c] * x[r]).sum(1) / (length[c] * np.sqrt((x[r] * x[r]).sum(1)))
        order = np.lexsort((-score, i))
        i, a, score = i[order], a[order], score[order]
        # a query's first k + 1 vectors, and those as near as the last of them
        begin = np.searchsorted(i, i)
        last = score[np.minimum(begin + k, np.searchsorted(i, i, "right") - 1)]
        keep = score >= last
        i, a, score = i[keep], a[keep], score[keep]
        count = np.minimum(start[a + 1] - start[a], k + 1)
        vec, i, score = named[np.repeat(start[a], count) + _within(count), 1], np.repeat(i, count), np.repeat(score, count)
        other = vec != asked[at + i]
        vec, i, score = vec[other], i[other], score[other]
        order = np.lexsort((vec, -score, i))
        vec, i, score = vec[order], i[order], score[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield asked[at + i[top]], vec[top], score[top]


def _block(layout: Layout, k: int):
    def best(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            low, high = (int(x[key[0].as_py()]) for x in (layout.low, layout.high))
            bits = np.frombuffer(b"".join(queries.column("probed").to_pylist()), np.uint8).reshape(queries.num_rows, -1)
            wanted = np.unpackbits(bits, axis=1, count=high - low).astype(bool)
            q, v = matrix(queries.column("embedding"), queries.num_rows), matrix(rows.column("embedding"), rows.num_rows)
            asked, ids, lists = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy(), rows.column("list").to_numpy() - low
            out = list(_best(q, asked, wanted, v, ids, lists, k))
        join = lambda x, t: pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t))
        return pa.table({"query_id": join([x[0] for x in out], np.int64), "vec_id": join([x[1] for x in out], np.int64), "score": join([x[2] for x in out], np.float64)})

    return best


def search(index: Index | None, lists: DataFrame | None, queries: DataFrame, k: int = 5, block_rows: int | None = None, block_queries: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found of each of the ``usable`` queries.

    A block of rows has ``BLOCK_VALUES`` numbers at most, and a ``BLOCKS``-th of the rows if that is less; a block of queries has ``BLOCK_VALUES`` numbers."""
    spark = queries.sparkSession
    if index is None or lists is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = max(1, BLOCK_VALUES // index.centroids.shape[1])
    counts = np.zeros(len(index.centroids), np.int64)
    for x in lists.groupBy("list").count().collect():  # a row for each list at most
        counts[x["list"]] = x["count"]
    layout = Layout.of(counts, block_rows or max(1, min(held, -(-int(counts.sum()) // BLOCKS))))
    total = queries.count()
    turns = max(1, -(-total // (block_queries or held)))
    shared, cuts = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(layout)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield from _pairs(shared.value, cuts.value, batch)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, hashed = batch.column("list").to_numpy(), batch.column("part").to_numpy()
            block = cuts.value.first[own] + hashed % cuts.value.parts[own]
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), *[batch.column(c) for c in ("list", "vec_id", "embedding")]], ["block", "list", "vec_id", "embedding"])

    own = [lists.schema["vec_id"], lists.schema["embedding"]]
    block, part = T.StructField("block", T.IntegerType()), lambda n: F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n)).cast("int")
    # one task for some queries: each of them may be compared with most of the table
    asked = queries.select("vec_id", "embedding").repartition(max(1, min(10_000, -(-total // 256))), "vec_id").dropDuplicates(["vec_id"])
    left = asked.mapInArrow(probe, T.StructType([block, T.StructField("probed", T.BinaryType()), *own])).withColumn("turn", part(turns))
    right = lists.withColumn("part", part(1 << 30)).mapInArrow(placed, T.StructType([block, lists.schema["list"], *own])).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    keys = ["block", "turn"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block(layout, k), "query_id long, vec_id long, score double")

    def joined(df: DataFrame, *by) -> DataFrame:
        rows = F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("far"), "vec_id")))
        return df.groupBy("query_id", *by).agg(F.slice(rows, 1, k).alias("top"))

    spread = joined(best, F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("salt")).select("query_id", F.explode("top").alias("x")).select("query_id", "x.vec_id", (-F.col("x.far")).alias("score"))
    return joined(spread).select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))


def neighbours(df: DataFrame, every: int = 50, k: int = 5, **options) -> DataFrame:
    """The ``k`` nearest found of each row whose vec_id is divisible by ``every``."""
    vectors = usable(df)
    index = fit(vectors, k, **options)
    lists = postings(vectors, index) if index else None
    return search(index, lists, vectors.where(F.pmod("vec_id", F.lit(every)) == 0), k)
