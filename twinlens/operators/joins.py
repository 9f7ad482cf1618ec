"""Keyed joins. Physical strategies are left to the optimizer and AQE, which sees real
sizes and splits skewed partitions; nothing here forces a broadcast of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.strings import stem


class JoinError(ValueError):
    """A join that must be one-to-one, or labels that must agree, are not."""


def modalities(text: DataFrame, image: DataFrame, text_id: str, image_id: str) -> DataFrame:
    """Inner join of two tables on their ids without extensions; both ids are dropped."""
    left = text.withColumn("__key", stem(F.col(text_id).cast("string"))).drop(text_id)
    right = image.withColumn("__key", stem(F.col(image_id).cast("string"))).drop(image_id)
    return left.join(right, "__key").drop("__key")


def attach_embeddings(labels: DataFrame, embeddings: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join without duplicate rows. With a unique key in ``on`` the embedding side is
    made unique by that key, so whole rows with long vectors are not compared."""
    unique = embeddings.dropDuplicates(list(on))
    return labels.dropDuplicates().join(unique, list(on), "left")


def natural(a: DataFrame, b: DataFrame) -> DataFrame:
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise JoinError("no shared column")
    return a.join(b, shared)


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that fails when a key occurs twice on either side.

    The counts of both sides ride along in the join (one count per key, combined before
    the shuffle), so the check costs no extra job and runs with the result.
    """
    a, b = unique_by(a, keys), unique_by(b, keys)
    return a.join(b, list(keys), how)


def unique_by(df: DataFrame, keys: Sequence[str], message: str = "duplicate join key") -> DataFrame:
    """``df`` with a run-time check: one row per key, else the job fails.

    One aggregate that is combined before the shuffle; the same partitioning then serves
    the join on the keys.
    """
    others = [c for c in df.columns if c not in keys]
    row = F.first(F.struct(*others)) if others else F.first(F.lit(1))
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), row.alias("__row"))
    ok = F.coalesce(F.assert_true(F.col("__n") == 1, message).cast("string"), F.lit(""))
    agg = agg.filter(ok == "")
    return agg.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def paired_predictions(a: DataFrame, b: DataFrame, key: str = "sample_id", label: str = "y_true") -> DataFrame:
    """Rows of two methods side by side (suffixes _a and _b), failing on unequal labels."""

    def side(df, s):
        return unique_by(df, [key]).select(key, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != key])

    joined = side(a, "a").join(side(b, "b"), key)
    same = F.assert_true(F.col(f"{label}_a").eqNullSafe(F.col(f"{label}_b")), "prediction tables disagree on the labels")
    checked = joined.filter(F.coalesce(same.cast("string"), F.lit("")) == "")
    return checked.withColumnRenamed(f"{label}_a", label).drop(f"{label}_b")


def keep_present(df: DataFrame, manifest: DataFrame, name: str) -> DataFrame:
    """Semi join: rows whose file is in the manifest."""
    return df.join(manifest.select(F.col("name").alias(name)), name, "left_semi")


def unreferenced(manifest: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """Anti join: files that no row names."""
    return manifest.join(df.select(F.col(name).alias("name")), "name", "left_anti")


def still_missing(df: DataFrame, manifest: DataFrame, name: str) -> DataFrame:
    """Anti join for a resumed run: every row whose file is not there yet, holes included."""
    return df.join(manifest.select(F.col("name").alias(name)), name, "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """Adds ``value`` from a dictionary table (key, value); AQE broadcasts it if it is small."""
    joined = df.join(table.select(key, value), key, "left")
    return joined if default is None else joined.withColumn(value, F.coalesce(F.col(value), default))


def by_line(*files: DataFrame) -> DataFrame:
    """Columns of several line-numbered files side by side; each has ``line``."""
    out = files[0]
    for f in files[1:]:
        out = out.join(f, "line")
    return out
