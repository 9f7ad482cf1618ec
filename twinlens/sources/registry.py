"""Where each dataset keeps its key, text, label and split columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Columns of one dataset's label table; ``split`` may be absent."""

    path: str
    sample_id: str
    image_ref: str
    text: str
    label: str
    split: str | None = None


def canonical(df: DataFrame, layout: Layout) -> DataFrame:
    def s(c):
        return F.col(c).cast("string")

    split = s(layout.split) if layout.split else F.lit("train")
    return df.select(
        s(layout.sample_id).alias("sample_id"),
        s(layout.image_ref).alias("image_ref"),
        s(layout.text).alias("text"),
        s(layout.label).alias("label"),
        split.alias("split"),
    )


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_all(spark: SparkSession, layouts: Mapping[str, Layout], read: Callable[[str], DataFrame]) -> DataFrame:
    """Canonical rows of every dataset whose path exists, tagged with ``dataset``."""
    found = [
        canonical(read(one.path), one).withColumn("dataset", F.lit(name))
        for name, one in layouts.items()
        if one.path and exists(spark, one.path)
    ]
    if not found:
        raise FileNotFoundError("no dataset of the registry is present")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
