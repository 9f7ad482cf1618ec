"""Connected components of links between 64-bit names.

Tasks reduce their own links to trees; trees that share a member are then hung on the smallest one until every member has one
root and no root hangs on another one. No task holds all links, and a hot member's neighbours meet as minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.session import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, roots) of the links a - b: every name but the smallest one of its tree, and that one."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    top = np.arange(len(names))
    while len(i):
        x, y = top[i], top[j]
        open_ = x != y
        if not open_.any():
            break
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = top[top]
            if (up == top).all():
                break
            top = up
    hung = np.flatnonzero(top != np.arange(len(names)))
    return names[hung], names[top[hung]]


def trees(links: DataFrame) -> DataFrame:
    """(member, root) of trees made of the links (a, b) of each batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            member, root = forest(part.column(0).to_numpy(), part.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(member, pa.int64()), pa.array(root, pa.int64())], ["member", "root"])

    return links.select("a", "b").where("a is not null and b is not null and a != b").mapInArrow(run, "member long, root long")


def components(links: DataFrame) -> DataFrame:
    """(member, root) of the components of the links (a, b), both long: every member but the smallest one, and the smallest."""
    edges = stored(trees(links).distinct(), "trees")
    while True:
        twice = edges.groupBy("member").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("member")
        hung = edges.select(F.col("root").alias("member")).distinct().join(edges.select("member"), "member", "left_semi")
        if not twice.union(hung).take(1):
            return edges
        # each name hangs its larger neighbours on the smallest one, then its smaller ones and itself
        both = edges.union(edges.select("root", "member")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = stored(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "trees")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("member"), F.col("m").alias("root"))
        edges = stored(down.union(least.select("u", "m")).distinct(), "trees")
