"""Session, shared scratch folder and size-checked broadcast."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "twinlens", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benches; clusters bring their own configuration."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per expression
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_root: dict[str, str] = {}
_scope: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="twinlens-")
        atexit.register(shutil.rmtree, _local_root[app], ignore_errors=True)
    return _local_root[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    scope = f"{_scope}/" if _scope else ""
    return f"{shared_root(spark)}/twinlens-{spark.sparkContext.applicationId}/{scope}{uuid.uuid4().hex}/{name}"


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Within it, scratch tables go to one folder (its path is given), for a caller that knows when to ``drop_folder`` it."""
    global _scope
    before, _scope = _scope, f"scope-{uuid.uuid4().hex}"
    try:
        yield f"{shared_root(spark)}/twinlens-{spark.sparkContext.applicationId}/{_scope}"
    finally:
        _scope = before


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; for the end of a job, when no frame is needed any more."""
    drop_folder(spark, f"{shared_root(spark)}/twinlens-{spark.sparkContext.applicationId}")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: for results that
    several jobs use, with column pruning and independent of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_side(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` as a broadcast side if it is proven small, else ``df`` itself.

    At most ``max_rows + 1`` rows are read. When they fit, the result is a driver-held
    constant (so it is also evaluated once) with a broadcast hint; when they do not,
    the caller's join runs as a shuffle join on the unchanged frame.
    """
    return small_table(df, max_rows, max_bytes)[0]


def small_table(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20):
    """(``small_side`` of the frame, its rows as an Arrow table or None if it is not small)."""
    # the limit keeps a wrong guess about the size from reaching the driver
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > max_bytes:
        return df, None
    return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema)), table


def collect_few(df: DataFrame, most: int = 10_000) -> list:
    """All rows of a frame that must be small, such as a vocabulary; fails when it is not."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where a small table is needed")
    return rows


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, as ``--py-files`` would; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="twinlens-code-"), "twinlens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
