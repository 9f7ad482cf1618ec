"""Merkle manifest of a dataset, kept as a postorder append log.

Leaves. A row's leaf is H of its columns, each as ``-`` if null, else UTF-8 byte count, ``:`` and value; H is sha256 in lowercase
hexadecimal of its inputs end to end, digests as text. The leaves of a group, in the order of their key, are a tree: while
several nodes remain, every ``FAN`` consecutive ones (the last run may be shorter, even one) become their H. The roots of all groups,
in the order of the group (null first, bytewise), are the leaves of one more tree, whose root stands for the dataset.

Method. Nodes are logged in the order in which they complete: a node right after its last child, so a subtree is one run of the
log. A builder takes an aligned block of FAN ** ``LEVELS`` leaves and writes its run in one go; the tops of the blocks are the leaves of
the next builders, so a tree of n leaves takes log(n) / log(FAN ** LEVELS) rounds. No builder knows the others, as the place of a node
follows from the sizes of the subtrees before it, in closed form (``position``). A proof computes the positions of its siblings and reads them from the log:
those inside its block from the block's run by offset, those above by a join on (tree, position), once for each block. A leaf's number in its group comes
from one range sort over all groups, so a group that holds most rows is spread, and texts are read once, by the leaf hashes.

Defined cases: a null column is ``-``, an empty text ``0:``; a null group has a tree of its own, before all others; rows with equal keys are ordered by
their leaf, a null key first; repeated rows are leaves of their own; a group of one row has its leaf as root, and a dataset of one group that
group's root; an empty table gives no rows; further columns are ignored. Keys may be of any type that can be ordered and cast to a string.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.operators.sets import numbered
from twinlens.session import small_side, stored

FAN = 16
#: Levels above the leaves that one builder makes.
LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


def position(level: int, index: int, n: int) -> int:
    """Place in completion order (from 0) of a node of a tree of ``n`` leaves.

    It completes with leaf e - 1, the last one below it. Up to its own level, every node that begins before leaf e is complete by then; of the levels
    above, those whose last leaf came before."""
    e = min((index + 1) * FAN**level, n)
    return sum(-(-e // FAN**k) if k <= level else (e - 1) // FAN**k for k in range(height(n) + 1)) - 1


def H(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def completed(digests: Sequence[str], first: int, base: int, n: int, levels: int = LEVELS) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of what completes above an aligned block: the nodes of level ``base`` from index ``first`` on, up to ``levels``
    levels more, in completion order. The nodes given are among them only if they are leaves."""
    top = min(height(n), base + levels)
    open_: list[list[str]] = [[] for _ in range(levels + 1)]
    for index, digest in enumerate(digests, first):
        level = base
        if base == 0:
            yield 0, index, digest
        while level < top:
            run = open_[level - base]
            run.append(digest)
            if len(run) < FAN and (index + 1) * FAN**level < n:
                break
            digest = H("".join(run))
            run.clear()
            level, index = level + 1, index // FAN
            yield level, index, digest


_NODES = "tree string, n long, level int, idx long, pos long, nodes array<string>, digest string, root boolean"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that follow each other with equal (tree, block), a block at a time."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["tree"], row["block"]):
                if held:
                    yield key, held
                key, held = (row["tree"], row["block"]), []
            held.append(row)
    if held:
        yield key, held


def _built(leaves: DataFrame, base: int, levels: int) -> DataFrame:
    """Log entries above ``leaves`` (tree, n, idx, digest), the nodes of level ``base``: runs of nodes, each named by its last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for (tree, block), rows in _grouped(batches):
            n, first = rows[0]["n"], block * FAN**levels
            made = list(completed([r["digest"] for r in rows], first, base, n, levels))
            runs = [made] if base == 0 else [[x] for x in made]
            out = []
            for r in runs:
                level, index, digest = r[-1]
                out.append({"tree": tree, "n": n, "level": level, "idx": index, "pos": position(*r[0][:2], n), "nodes": [x[2] for x in r], "digest": digest, "root": level == height(n)})
            schema = schema or pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("pos", pa.int64()), ("nodes", pa.list_(pa.string())), ("digest", pa.string()), ("root", pa.bool_())])
            yield pa.RecordBatch.from_pylist(out, schema)

    blocks = leaves.select("tree", F.floor(F.col("idx") / FAN**levels).alias("block"), "idx", "n", "digest")
    return blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx").mapInArrow(run, _NODES)


def append_log(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The log of all trees of ``leaves`` (tree, n, idx, digest): (tree, n, level, idx, pos, nodes, digest, root). ``nodes`` are the digests
    of consecutive positions from ``pos`` on; (level, idx, digest) is the last of them, and ``root`` whether it is the tree's root."""
    base, new = 0, stored(_built(leaves, 0, levels), "log")
    log = new
    while True:
        tops = new.where((F.col("level") == base + levels) & ~F.col("root"))
        if not tops.take(1):
            return log
        base += levels
        new = stored(_built(tops.select("tree", "n", "idx", "digest"), base, levels), "log")
        log = log.unionByName(new)


def _above(log: DataFrame, levels: int) -> DataFrame:
    """(tree, block, upper): the siblings (level, idx, digest) that the proofs of a block of leaves have above it."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, index, n = [], row["idx"], row["n"]
                for level in range(levels, height(n)):
                    first = index // FAN * FAN
                    for sibling in range(first, min(first + FAN, -(-n // FAN**level))):
                        if sibling != index:
                            out.append({"tree": row["tree"], "block": row["idx"], "level": level, "idx": sibling, "pos": position(level, sibling, n)})
                    index //= FAN
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("tree", pa.string()), ("block", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("pos", pa.int64())]))

    asked = log.where((F.col("level") == levels) & ~F.col("root")).select("tree", "n", "idx").mapInArrow(wanted, "tree string, block long, level int, idx long, pos long")
    known = log.select("tree", (F.col("pos") + F.size("nodes") - 1).alias("pos"), "digest")
    return asked.join(known, ["tree", "pos"]).groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("level", "idx", "digest"))).alias("upper"))


def _climb(index: int, n: int, digest_at: Callable[[int, int], str], levels: range) -> list[tuple[str, str]]:
    """(siblings before, siblings after) at each of the levels."""
    out = []
    for level in levels:
        first = index // FAN * FAN
        run = [digest_at(level, s) for s in range(first, min(first + FAN, -(-n // FAN**level)))]
        out.append(("".join(run[: index - first]), "".join(run[index - first + 1 :])))
        index //= FAN
    return out


def _proven(leaves: DataFrame, log: DataFrame, more: DataFrame | None, finish: Callable, schema: T.StructType | str, levels: int) -> DataFrame:
    """``finish(leaf row, run row, path)`` for each leaf, whose path has the siblings (before, after) of each level of its tree.

    ``leaves`` has (tree, idx) and what ``finish`` needs; ``more`` is a frame of further columns for each tree."""
    runs = log.where((F.col("level") == levels) | (F.col("root") & (F.col("level") < levels)))
    runs = runs.select("tree", F.when(F.col("level") == levels, F.col("idx")).otherwise(F.lit(0)).alias("block"), "n", "pos", "nodes")
    runs = runs.join(small_side(stored(_above(log, levels), "upper"), 20_000), ["tree", "block"], "left")
    if more is not None:
        runs = runs.join(small_side(more, 20_000), "tree")
    rows = leaves.select("tree", F.floor(F.col("idx") / FAN**levels).alias("block"), "idx", F.struct(*[c for c in leaves.columns if c not in ("tree", "idx")]).alias("leaf"))
    extra = [c for c in runs.columns if c not in ("tree", "block")]
    # a block's run comes first, then its leaves
    both = rows.unionByName(runs.select("tree", "block", F.lit(-1).cast("long").alias("idx"), F.struct(*extra).alias("run")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(parsed)
        for (_, block), found in _grouped(batches):
            head, n = found[0]["run"], found[0]["run"]["n"]
            nodes, upper = head["nodes"], {(u["level"], u["idx"]): u["digest"] for u in head["upper"] or ()}
            inside, total = min(levels, height(n)), height(n)
            path_above = _climb(block, n, lambda level, s: upper.get((level, s), ""), range(levels, total))
            # the leaves of a run share its siblings
            in_run = functools.cache(lambda level, s: nodes[position(level, s, n) - head["pos"]])
            out = [finish(row["leaf"], head, _climb(row["idx"], n, in_run, range(inside)) + path_above) for row in found[1:]]
            for start in range(0, len(out), 1024):
                yield pa.RecordBatch.from_pylist(out[start : start + 1024], kind)

    parsed = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx").mapInArrow(run, parsed)


def folded(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = H(before + leaf + after)
    return leaf


def leaf_of(*columns: Column) -> Column:
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``idx`` and ``n``: place in the tree and its size."""
    placed = stored(numbered(rows.orderBy("tree", *order), "place"), "placed")
    sizes = placed.groupBy("tree").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    joined = placed.join(small_side(sizes, 1_000_000), "tree")
    return joined.select(*rows.columns, (F.col("place") - F.col("start")).alias("idx"), "n")


def manifest(docs: DataFrame, columns: Sequence[str], group: str, key: str, check: Column | None = None, given: Sequence[Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """A row for each row of ``docs``: ``key``, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is H of the siblings on the way to the root, level by level, left to right. Where ``check`` holds, the proof is tried with
    the leaf of the columns ``given`` in place of the row's own (an alleged copy of the row); ``folded_root`` is what comes out."""
    own = leaf_of(*[F.col(c) for c in columns])
    alleged = own if check is None else F.when(check, leaf_of(*given)).otherwise(own)
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    # the last column sets repeated rows apart, so that even they can be dealt to several tasks
    leaves = stored(docs.select(tree.alias("tree"), F.col(key).alias("key"), own.alias("digest"), alleged.alias("alleged"), F.monotonically_increasing_id().alias("tie")), "leaves")
    placed = stored(_placed(leaves, "key", "digest", "tie").drop("tie"), "placed")
    log = append_log(placed.select("tree", "n", "idx", "digest"), levels)
    subroots = stored(log.where("root").select(F.col("tree").alias("name"), "digest"), "subroots")
    crowns = stored(_placed(subroots.select(F.lit("").alias("tree"), "name", "digest"), "name"), "crowns")
    crown_log = append_log(crowns.select("tree", "n", "idx", "digest"), levels)
    root = stored(crown_log.where("root").select("tree", F.col("digest").alias("root")), "root")

    def crown(leaf: dict, head: dict, path: list) -> dict:
        return {"tree": leaf["name"], "subroot": leaf["digest"], "root": head["root"], "path": [{"before": b, "after": a} for b, a in path]}

    ways = stored(_proven(crowns, crown_log, root, crown, "tree string, subroot string, root string, path array<struct<before: string, after: string>>", levels), "ways")
    kind = docs.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], T.StructField("verified", T.BooleanType())])

    def prove(leaf: dict, head: dict, path: list) -> dict:
        path = path + [(w["before"], w["after"]) for w in head["path"]]
        result = folded(leaf["alleged"], path)
        proof = H("".join(b + a for b, a in path))
        return {key: leaf["key"], "leaf": leaf["digest"], "subroot": head["subroot"], "root": head["root"], "proof_sha256": proof, "folded_root": result, "verified": result == head["root"]}

    return _proven(placed, log, ways, prove, out, levels)
