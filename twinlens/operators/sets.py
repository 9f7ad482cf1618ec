"""Sorts, limits and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.operators.ranking import order_hash
from twinlens.session import stored


class UnseenLabels(ValueError):
    pass


def category_rank(c: Column, order: Sequence[str]) -> Column:
    """Place in a fixed order, 1-based; unknown values sort last."""
    at = F.array_position(F.array(*[F.lit(o) for o in order]), c)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def numbered(df: DataFrame, out: str = "position") -> DataFrame:
    """0-based positions of a sorted frame. Rows are numbered within their partition and shifted by the
    rows of the partitions before, so the sort stays parallel; only one count per partition meets in one task."""
    rows = stored(df.withColumn("__m", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__m", 33)
    counts = rows.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__p", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    joined = rows.withColumn("__p", part).join(offsets, "__p")
    return joined.withColumn(out, within + F.col("__before")).select(*df.columns, out)


def first_valid(df: DataFrame, valid: Column, key: str, k: int, seed=42) -> DataFrame:
    """The first k valid rows in hash order (a top-k, not a sort of the table)."""
    return df.filter(valid).withColumn("__h", order_hash(seed, F.col(key))).orderBy("__h", key).limit(k).drop("__h")


def union_all(*frames: DataFrame, missing: bool = False) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=missing)
    return out


def unseen_labels(train: DataFrame, other: DataFrame, label: str) -> DataFrame:
    """Labels of ``other`` that do not occur in ``train``."""
    text = F.col(label).cast("string").alias(label)
    return other.select(text).distinct().join(train.select(text), label, "left_anti")


def require_seen(train: DataFrame, other: DataFrame, label: str, name: str) -> None:
    bad = [r[0] for r in unseen_labels(train, other, label).limit(20).collect()]
    if bad:
        raise UnseenLabels(f"{name} has labels unseen in train: {sorted(bad)}")


def label_vocabulary(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct labels over several columns, as text; one scan."""
    texts = F.array(*[F.col(c).cast("string") for c in cols])
    return df.select(F.explode(texts).alias("label")).filter("label is not null").distinct()
