"""Delimited, line and list files as tables. Schemas are explicit: no inference pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinlens.session import small_side, small_table

# Text columns hold line breaks and quotes. Empty fields are null, quoted or not.
CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "nullValue": "", "emptyValue": ""}


def read_csv(spark: SparkSession, path, schema: str, sep: str = ",", multiline: bool = True) -> DataFrame:
    """Delimited files with a header. Big files are read in splits, with line breaks in quoted fields too; ``multiline=False`` saves the
    pass that looks for them."""
    if multiline:
        return read_quoted(spark, path, schema, sep)
    return spark.read.options(**dict(CSV_OPTIONS, multiLine=False, sep=sep)).schema(schema).csv(path)


def read_quoted(spark: SparkSession, path, schema: str, sep: str = ",") -> DataFrame:
    """Delimited files with a header whose quoted fields may hold line breaks, read in splits like any text.

    A line begins a record if the quotes before it in its file are even in number. One pass counts the quotes of each split and sums them up over the
    splits before, so a task knows how its splits begin; a second one cuts the lines of a split into records. What a split leaves open at its
    ends, two pieces at most, is put together by file. Lines end with a line feed, with or without a carriage return; fields with quotes must be
    quoted, and quotes in them doubled.
    """
    at = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*at, "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("f", "s").agg(F.sum(quotes).alias("q"))
    # one row per split of the files
    before = F.coalesce(F.sum("q").over(W.partitionBy("f").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts, table = small_table(counts.select(F.xxhash64("f", "s").alias("k"), (before % 2).cast("int").alias("odd")), 4_000_000)
    if table is None:
        raise ValueError("more than 4,000,000 splits; raise spark.sql.files.maxPartitionBytes")
    cut = lines.join(starts, F.xxhash64("f", "s") == F.col("k")).select("f", "s", "odd", "value").mapInArrow(_records, "f string, s long, number int, begins boolean, whole boolean, text string")
    texts = cut.where("whole").select("text")
    if pc.any(pc.equal(table.column("odd"), 1)).as_py():
        pieces = cut.where("not whole").withColumn("r", F.sum(F.col("begins").cast("int")).over(W.partitionBy("f").orderBy("s", "number")))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("s", "number", "text"))), lambda p: p["text"])
        texts = texts.unionByName(pieces.groupBy("f", "r").agg(F.array_join(parts, "\n").alias("text")).select("text"))
    ended = F.when(F.col("text").endswith("\r"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_OPTIONS.items() if k != "header"}
    return texts.select(ended.alias("text")).where("text != ''").select(F.from_csv("text", schema, options | {"sep": sep}).alias("r")).select("r.*")


#: Bytes of lines that a task turns into records together; a longer line is taken alone.
LINES_TOGETHER = 1 << 20


def _few_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("value")).to_numpy(), dtype=np.int64)
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + LINES_TOGETHER, "right")))
            yield batch.slice(start, stop - start)
            start, before = stop, ends[stop - 1]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the pieces that a split leaves open: at its start (number 0) and at its end (number 1). Lines come in the order of their split; a
    file's first record, the header, is left out. Beside a batch of lines, memory goes to ``LINES_TOGETHER`` bytes of them and to the record that is open."""
    names = ["f", "s", "number", "begins", "whole", "text"]
    split, held, begins, header = None, None, False, False
    for batch in _few_lines(batches):
        out: list[tuple] = []
        columns = [c.to_pylist() for c in batch.columns]
        for f, s, odd, line in zip(*columns, strict=True):
            if (f, s) != split:
                if held:
                    out.append((*split, 1 if begins else 0, begins, False, "\n".join(held)))
                split, held, begins, header = (f, s), [] if odd else None, False, s == 0
            closes = line.count('"') % 2 == 1
            if held is None:
                if closes:
                    held, begins = [line], True
                elif header:
                    header = False
                else:
                    out.append((f, s, 0, True, True, line))
            else:
                held.append(line)
                if closes:
                    if header:
                        header = False
                    else:
                        out.append((f, s, 0, begins, begins, "\n".join(held)))
                    held = None
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], _RECORD)
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*split, 1 if begins else 0, begins, False, "\n".join(held)), strict=True))], _RECORD)


_RECORD = pa.schema([("f", pa.string()), ("s", pa.int64()), ("number", pa.int32()), ("begins", pa.bool_()), ("whole", pa.bool_()), ("text", pa.string())])


def read_tsv(spark: SparkSession, path, schema, multiline: bool = False) -> DataFrame:
    return read_csv(spark, path, schema, "\t", multiline)


def read_lines(spark: SparkSession, path, name: str) -> DataFrame:
    """Headerless one-column file."""
    return spark.read.text(path).withColumnRenamed("value", name)


def read_numbered_lines(spark: SparkSession, path, name: str) -> DataFrame:
    """(line, name): 0-based line numbers over all files, in the order of their names.

    Large files are read in splits as usual: lines are numbered inside a split, and the
    split's first number comes from the line counts of the splits before it.
    """
    at = [F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__s")]
    lines = spark.read.text(path).select(*at, F.col("value").alias(name), F.monotonically_increasing_id().alias("__m"))
    counts = lines.groupBy("__f", "__s").agg(F.count(F.lit(1)).alias("__n"))
    # one row per split of the files
    starts = counts.select(
        F.col("__f").alias("__of"), F.col("__s").alias("__os"), (F.sum("__n").over(W.orderBy("__f", "__s")) - F.col("__n")).alias("__start")
    )
    starts = small_side(starts)
    inside = F.row_number().over(W.partitionBy("__f", "__s").orderBy("__m"))
    numbered = lines.withColumn("__r", inside).join(starts, (F.col("__f") == F.col("__of")) & (F.col("__s") == F.col("__os")))
    return numbered.select((F.col("__start") + F.col("__r") - 1).alias("line"), name)


def read_alternating(spark: SparkSession, path, first: str = "question", second: str = "answer") -> DataFrame:
    """(pair, first, second): even lines are questions, odd lines answers, stripped."""
    lines = read_numbered_lines(spark, path, "text").withColumn("text", F.btrim("text", F.lit(" \t\r\n")))
    return lines.groupBy(F.expr("line div 2").alias("pair")).agg(
        F.max(F.when(F.col("line") % 2 == 0, F.col("text"))).alias(first),
        F.max(F.when(F.col("line") % 2 == 1, F.col("text"))).alias(second),
    )


def prune(df: DataFrame, needed: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Needed columns plus those optional ones that exist; the scan reads nothing else."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.select(*needed, *[c for c in optional if c in df.columns])


def read_many(spark: SparkSession, pattern: str, schema) -> DataFrame:
    """All files of a glob as one table, with ``file_name``."""
    df = read_csv(spark, pattern, schema, multiline=False)
    return df.select("*", F.col("_metadata.file_name").alias("file_name"))


def run_of_file(name: Column, suffix: str) -> list[Column]:
    """dataset, backbone and method of ``dataset_backbone_method<suffix>``; the method keeps its underscores."""
    parts = F.split(F.regexp_replace(name, f"{suffix}$", ""), "_", 3)
    return [parts[0].alias("dataset"), parts[1].alias("backbone"), parts[2].alias("method")]


def model_of_file(name: Column, suffix: str, markers: Sequence[str]) -> list[Column]:
    """dataset and model, split at the last family marker; fails when no marker is found.

    Markers are tried in order, e.g. ``["_alpha-", "_beta-"]``.
    """
    stem = F.regexp_replace(name, f"{suffix}$", "")
    dataset, model = F.lit(None).cast("string"), F.lit(None).cast("string")
    for m in reversed(list(markers)):
        hit = F.contains(stem, F.lit(m))
        dataset = F.when(hit, F.regexp_extract(stem, f"^(.*){m}", 1)).otherwise(dataset)
        model = F.when(hit, F.concat(F.lit(m[1:]), F.substring_index(stem, m, -1))).otherwise(model)
    known = F.when(dataset.isNotNull(), dataset).otherwise(F.raise_error(F.concat(F.lit("no model marker in "), name)).cast("string"))
    return [known.alias("dataset"), model.alias("model")]


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, length) of the files of a folder; contents are not read and empty files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def gather_vectors(df: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Wide float columns to one array per prefix, in file order; fails if a prefix has none.

    ``groups`` maps prefix to the name of the array column.
    """
    arrays, used = [], set()
    for prefix, name in groups.items():
        cols = [c for c in df.columns if c.startswith(prefix)]
        if not cols:
            raise ValueError(f"no column starts with {prefix!r}")
        used |= set(cols)
        arrays.append(F.array(*[F.col(c) for c in cols]).alias(name))
    return df.select(*[c for c in df.columns if c not in used], *arrays)


def rename_numbered(df: DataFrame, prefix: str = "image_") -> DataFrame:
    """Columns named 0..d-1 become ``image_0`` and so on."""
    return df.withColumnsRenamed({c: f"{prefix}{int(c)}" for c in df.columns if c.isdigit()})
