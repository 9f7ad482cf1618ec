"""Aggregates. All combine before the shuffle, so a hot key costs one row per task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.session import small_side, small_table


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def number(c: Column) -> Column:
    """NaN as null, so that plain aggregates skip it."""
    return F.when(~F.isnan(c.cast("double")), c)


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, mode): most frequent value as text, the smallest on ties; nulls do not count."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"), F.struct(*[F.col(x) if x == c else F.lit(None).cast(df.schema[x].dataType).alias(x) for x in cols]).alias("v")) for c in cols]
    )
    counts = df.select(F.explode(pairs).alias("p")).filter("p.text is not null").groupBy("p.column", "p.v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("rank"), "v")).alias("best"))
    return best.select("column", "best.v")


def fill_with_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls become the mode of their column. The modes are one row of constants."""
    m = modes(df, cols)
    one = small_side(m.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.col(f"v.{c}"))).alias(f"__m_{c}") for c in cols]))
    filled = df.join(one, F.lit(True), "left").withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in cols})
    return filled.select(*df.columns)


def row_mean(*cols: Column) -> Column:
    """Mean over columns of one row, nulls skipped; null if all are null."""
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return F.when(n > 0, total / n)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): N / (C * n) per class. The class table is small, so the totals are
    taken over its few rows and not over the data again."""
    counts = small_side(value_counts(df, label))
    totals = counts.groupBy().agg(F.sum("n").alias("__total"), F.count(F.lit(1)).alias("__classes"))
    weight = F.col("__total").cast("double") / (F.col("__classes") * F.col("n"))
    return counts.join(F.broadcast(totals), F.lit(True)).select(label, "n", weight.alias("weight"))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """w1 / w0 of a 0/1 label, which is n0 / n1."""
    one = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    return df.groupBy().agg(((F.count(F.lit(1)) - one).cast("double") / one).alias("pos_weight"))


def multilabel_weights(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, weight): N / (L * positives)."""
    sums = df.groupBy().agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in labels])
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("long").alias("positives")) for c in labels])
    return sums.select("n", F.explode(rows).alias("r")).select(
        "r.label", "r.positives", (F.col("n").cast("double") / (len(labels) * F.col("r.positives"))).alias("weight")
    )


def pivot_one(df: DataFrame, index: Sequence[str], column: str, value: str, names: Sequence) -> DataFrame:
    """Wide form of one value; fails when a cell has two rows."""
    return pivot_many(df, index, column, [value], names, lambda v, n: str(n))


def pivot_many(df: DataFrame, index, column: str, values: Sequence[str], names: Sequence, label=lambda v, n: f"{v}_{n}") -> DataFrame:
    """Wide form of several values, columns ``value_name``; fails when a cell has two rows.

    Conditional aggregates over an explicit list of names: one combining pass, no job to
    discover the names.
    """
    outs, guards = [], []
    for n in names:
        hit = F.col(column) == F.lit(n)
        guards.append(F.count(F.when(hit, 1)))
        outs += [F.max(F.when(hit, F.col(v))).alias(label(v, n)) for v in values]
    agg = df.groupBy(*index).agg(*outs, F.greatest(*guards, F.lit(0)).alias("__most"))
    ok = F.assert_true(F.col("__most") <= 1, "pivot cell with two rows").cast("string")
    return agg.filter(F.coalesce(ok, F.lit("")) == "").drop("__most")


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order: a minimum of structs, not a sort per key."""
    others = [c for c in df.columns if c not in keys and c not in order]
    lead = [F.col(c) for c in order if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*lead, *others)).alias("__b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__b.{c}").alias(c) for c in df.columns])


def any_nonzero(cols: Sequence[str]) -> Column:
    """``abnormal`` when any column differs from 0 (a missing value does), else ``normal``."""
    differs = F.exists(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: ~x.eqNullSafe(F.lit(0.0)))
    return F.when(differs, "abnormal").otherwise("normal")


def frequent_labels(df: DataFrame, key: str, labels: Column, least: int) -> DataFrame:
    """Rows that hold at least one label (of an array column) counted ``least`` times or more.

    Labels are counted in one pass. When the frequent ones are few, each row's array is tested in place and no row moves; otherwise
    exploded labels meet them and collapse per key."""
    rows = df.select("*", labels.alias("__labels"))
    long = rows.select(key, F.explode("__labels").alias("__label"))
    side, table = small_table(long.groupBy("__label").count().filter(F.col("count") >= least).select("__label"))
    if table is None:
        return df.join(long.join(side, "__label", "left_semi").select(key).distinct(), key, "left_semi")
    shared, names = df.sparkSession.sparkContext.broadcast(table.column(0).to_pylist()), df.columns

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in batches:
            lists = b.column(b.num_columns - 1)
            flat = lists.flatten()
            known = pa.array(shared.value, flat.type) if known is None else known
            keep = np.zeros(b.num_rows, bool)
            keep[pc.list_parent_indices(lists).filter(pc.is_in(flat, value_set=known)).to_numpy()] = True
            yield b.select(names).filter(pa.array(keep))

    return rows.mapInArrow(tested, df.schema)
