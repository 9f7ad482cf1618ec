"""Tables to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.functions.vectors import argmax
from twinlens.operators.joins import keep_present
from twinlens.operators.sampling import fixed_sample
from twinlens.session import scratch_path

METRIC_COLUMNS = ["model", "dataset", "backbone", "fusion_method", "accuracy", "f1_score", "auc"]


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """``mode='ignore'`` keeps an output that is already there."""
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""'}
    exact = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**options, **exact).csv(path)


def spread_predictions(df: DataFrame, classes: int, key: str = "sample_id") -> DataFrame:
    """key, y_true, y_pred, prob_0.. and, if present, gate_text and gate_image."""
    cols = [F.col(key), F.col("y_true"), argmax(F.col("probs")).alias("y_pred")]
    cols += [F.get("probs", F.lit(i)).alias(f"prob_{i}") for i in range(classes)]
    if "gates" in df.columns:
        cols += [F.get("gates", F.lit(0)).alias("gate_text"), F.get("gates", F.lit(1)).alias("gate_image")]
    return df.select(*cols)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """One metrics row per run, in the fixed column order."""
    metrics.select(*METRIC_COLUMNS).write.mode("append").option("header", True).csv(path)


def write_params(df: DataFrame, path: str) -> None:
    df.select("name", "shape", "values").write.mode("errorifexists").parquet(path)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, shape array<int>, values array<double>").parquet(path)


def rewrite(spark: SparkSession, path: str, change, read, write) -> DataFrame:
    """Result of ``change(read(path))`` written beside ``path``, then put in its place.

    The input is never overwritten while it is read: the new table is complete before the
    old folder is renamed away, and a failure leaves the old one.
    """
    fresh, old = f"{path}.new", f"{path}.old"
    write(change(read(path)), fresh)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(at(path), at(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(at(fresh), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"cannot move {fresh}")
    fs.delete(at(old), True)
    return read(path)


def sample_bundle(
    df: DataFrame, manifest: DataFrame, key: str, asset: str, text: str, label: str, candidates: int = 20, k: int = 10
) -> DataFrame:
    """Up to k of the sampled candidates whose asset is present: key, asset, text, label."""
    picked = keep_present(fixed_sample(df, key, candidates), manifest, asset)
    return fixed_sample(picked, key, k).select(key, asset, text, label)


def write_bundle(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def scratch_csv(df: DataFrame, name: str, sep: str = ",") -> str:
    path = scratch_path(df.sparkSession, name)
    write_csv(df, path, sep)
    return path


def write_per_name(df: DataFrame, path: str, name: str) -> None:
    """One CSV file per value of ``name``, called after it; for small result tables.

    Spark writes a folder per value; its single file is then moved to its name.
    """
    spark = df.sparkSession
    parts = f"{path}.parts"
    df.repartition(name).write.partitionBy(name).option("header", True).csv(parts)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at(path))
    for folder in fs.listStatus(at(parts)):
        if folder.isDirectory():
            value = folder.getPath().getName().split("=", 1)[1]
            for f in fs.listStatus(folder.getPath()):
                if f.getPath().getName().endswith(".csv"):
                    fs.rename(f.getPath(), at(f"{path}/{value}"))
    fs.delete(at(parts), True)
