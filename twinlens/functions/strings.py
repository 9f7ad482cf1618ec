"""Keys, paths and labels as string expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Image extensions that are cut from keys.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tiff")


def stem(c: Column) -> Column:
    """Up to the first dot."""
    return F.substring_index(c, ".", 1)


def drop_image_extension(c: Column) -> Column:
    alternatives = "|".join(e.lstrip(".") for e in IMAGE_EXTENSIONS)
    return F.regexp_replace(c, rf"\.({alternatives})", "")


def padded_image_id(c: Column, width: int = 12, suffix: str = ".jpg") -> Column:
    """Shorter ids are zero-padded and get the suffix; others stay as they are."""
    s = c.cast("string")
    return F.when(F.length(s) < width, F.concat(F.lpad(s, width, "0"), F.lit(suffix))).otherwise(s)


def join_path(folder: str, c: Column) -> Column:
    """Absolute paths win over the folder."""
    return F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), c))


def last_part(c: Column, sep: str = "/") -> Column:
    return F.element_at(F.split(c, sep), -1)


def first_part(c: Column, sep: str = "/") -> Column:
    return F.element_at(F.split(c, sep), 1)


def ensure_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), c).otherwise(F.concat(c, F.lit(suffix)))


def repair_double_extension(df: DataFrame, name: str, ext: str = ".jpg") -> DataFrame:
    """``a.jpg.jpg`` becomes ``a.jpg`` unless a clean ``a.jpg`` exists, which then wins.

    One combining aggregate per clean name; the other columns come from the winner.
    """
    doubled = F.col(name).endswith(ext + ext)
    clean = F.when(doubled, F.substring(name, 1, F.length(name) - len(ext))).otherwise(F.col(name))
    others = [c for c in df.columns if c != name]
    marked = df.select(clean.alias(name), doubled.cast("int").alias("__d"), *others)
    best = F.min(F.struct("__d", *others)).alias("__best")
    return marked.groupBy(name).agg(best).select(name, *[F.col(f"__best.{c}").alias(c) for c in others])


def resolve_extension(df: DataFrame, name: str, manifest: DataFrame, out: str) -> DataFrame:
    """Names without a dot get the name of the file with that stem, if there is one.

    Several files with one stem: the alphabetically first. ``manifest`` has (name, length).
    """
    files = manifest.groupBy(stem(F.col("name")).alias("__stem")).agg(F.min("name").alias("__file"))
    bare = ~F.contains(F.col(name), F.lit("."))
    joined = df.withColumn("__key", F.when(bare, F.col(name))).join(files, F.col("__key") == F.col("__stem"), "left")
    return joined.select(*df.columns, F.coalesce("__file", name).alias(out))


def digits_after(c: Column, word: str) -> Column:
    return F.regexp_extract(c, rf"{word}(\d+)", 1)


def cut_image_phrase(c: Column) -> Column:
    """Removes the phrase ``in the imageN`` with an optional question mark and blanks."""
    return F.trim(F.regexp_replace(c, r"\s*in the image\d+\s*\??\s*", " "))


def from_first(c: Column, mark: str) -> Column:
    """From the first ``mark`` on; empty when it is absent."""
    at = F.locate(mark, c)
    return F.when(at > 0, F.substring(c, at, F.length(c))).otherwise(F.lit(""))


def split_labels(c: Column) -> Column:
    """Comma list to trimmed parts."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x))


def display_key(backbone: Column, method: Column) -> Column:
    return F.concat(F.upper(backbone), F.lit(" - "), method)


def map_values(c: Column, table: Mapping, default: Column | None = None) -> Column:
    """Chain of equalities; values that are not in the table give ``default`` (itself if None)."""
    out = c if default is None else default
    for k, v in reversed(list(table.items())):
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def model_slug(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def remove_literal(c: Column, text: str) -> Column:
    return F.replace(c, F.lit(text), F.lit(""))


def active_labels(names: Sequence[str], default: str = "No Finding") -> Column:
    """Names of the columns that equal 1, comma separated; ``default`` when none does."""
    found = F.array_compact(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in names]))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(F.lit(default))
