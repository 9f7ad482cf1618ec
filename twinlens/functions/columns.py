"""Column selection, fallbacks and null filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_positions(df: DataFrame, *ranges: tuple[int, int]) -> DataFrame:
    """Columns by half-open position ranges, in the given order."""
    return df.select(*[c for a, b in ranges for c in df.columns[a:b]])


def rename_with(df: DataFrame, rename: Callable[[str], str]) -> DataFrame:
    return df.withColumnsRenamed({c: rename(c) for c in df.columns})


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def with_suffix(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` plus the columns that end in ``suffix``, with the suffix cut off."""
    named = [F.col(c).alias(c.removesuffix(suffix)) for c in df.columns if c.endswith(suffix)]
    return df.select(*keep, *named)


def first_existing(df: DataFrame, wanted: str, candidates: Sequence[str]) -> str:
    """``wanted`` if present, else the first candidate that is a column."""
    for name in (wanted, *candidates):
        if name in df.columns:
            return name
    raise ValueError(f"none of {[wanted, *candidates]} in {df.columns}")


def with_default(df: DataFrame, name: str, value) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def not_missing(df: DataFrame, name: str) -> Column:
    """Not null and, for floating types, not NaN; float arrays hold no null and no NaN."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.isNotNull() & ~F.isnan(c)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x))
    return c.isNotNull()


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [not_missing(df, c) for c in subset]))


def not_blank(name: str) -> Column:
    """Holds a character that is no white space; null is blank."""
    return F.coalesce(F.col(name).rlike(r"\S"), F.lit(False))


def drop_uncertain(df: DataFrame, labels: Sequence[str], mark: int = -1) -> DataFrame:
    """Drops a row with ``mark`` in any label; a missing label passes and becomes 0."""
    sure = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(0)) != mark for c in labels])
    return df.filter(sure).fillna(0, list(labels))


def valid_asset(df: DataFrame, manifest: DataFrame, has_file: str, url: str, name: str) -> DataFrame:
    """Rows that claim a file, have a usable URL and whose file is present and not empty.

    ``manifest`` has (name, length) as given by ``sources.files.manifest``.
    """
    usable = F.col(has_file) & F.col(url).isNotNull() & ~F.trim(F.col(url)).isin("", "nan")
    present = manifest.filter(F.col("length") > 0).select(F.col("name").alias(name))
    return df.filter(usable).join(present, name, "left_semi")


def parse_vector(text: Column) -> Column:
    """A list literal such as ``[0.1, 2]`` as array<double>; anything else is null."""
    return F.from_json(text, T.ArrayType(T.DoubleType()))


def expand_vector(df: DataFrame, name: str, size: int, prefix: str, first: int = 1) -> DataFrame:
    """One column per element (``prefix`` + number), the vector itself dropped."""
    spread = [F.get(F.col(name), i).alias(f"{prefix}{i + first}") for i in range(size)]
    return df.select(*[c for c in df.columns if c != name], *spread)
