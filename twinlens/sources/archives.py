"""Members of zip and tar files as rows, read by seeking.

An archive's directory (of a zip) or chain of headers (of a tar) is listed by one task as rows (path, name, place, size); members are then dealt
to tasks in ranges of about ``CHUNK`` bytes, and a task seeks to its own members. So an archive of any size is many tasks, and no value
holds more than one member. A compressed tar cannot be sought in: one task reads it from front to back.
"""

from __future__ import annotations

import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.operators.ranking import ordered_scan

#: Packed bytes of the members that a task reads, and bytes and rows that leave it together.
CHUNK, OUT_BYTES, OUT_ROWS = 64 << 20, 32 << 20, 1000
_ENTRY = "path string, name string, at long, packed long, size long, method int, crc long"
_FIELDS = [("path", pa.string()), ("name", pa.string()), ("at", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("method", pa.int32()), ("crc", pa.int64())]
# fixed values of the zip format: signature and length of a member's own header, the two usual methods
ZIP_MARK, ZIP_HEADER, STORED, DEFLATED = b"PK\x03\x04", 30, 0, 8
#: Method of a member that must be read from the front.
STREAM = -1


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path, any that Arrow knows, and the path in it; a plain path is a local or mounted one."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def opened(path: str):
    """A file that can be sought in."""
    store, inner = place(path)
    return store.open_input_file(inner)


def open_files(spark: SparkSession, path) -> DataFrame:
    """(path) of archive files; their content is not read here."""
    return spark.read.format("binaryFile").load(path).select("path")


def _zip_entries(path: str) -> Iterator[tuple]:
    with opened(path) as f, zipfile.ZipFile(f) as z:
        for m in z.infolist():
            if not m.is_dir():
                if m.compress_type not in (STORED, DEFLATED) or m.flag_bits & 1:
                    raise ValueError(f"{path}: {m.filename} is encrypted or packed by method {m.compress_type}")
                yield path, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC


def _tar_entries(path: str) -> Iterator[tuple]:
    with opened(path) as f:
        try:
            archive = tarfile.open(fileobj=f, mode="r:")
        except tarfile.ReadError:
            # packed as a whole: one entry stands for all members
            yield path, "", 0, f.size(), f.size(), STREAM, 0
            return
        with archive:
            for m in archive:
                if m.isfile():
                    yield (path, m.name, m.offset_data, m.size, m.size, STORED, -1) if not m.issparse() else (path, m.name, m.offset, m.size, m.size, STREAM, 0)


def entries(archives: DataFrame, kind: str) -> DataFrame:
    """(path, name, at, packed, size, method, crc) of the members of the archives (path)."""
    listed = {"zip": _zip_entries, "tar": _tar_entries}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = []
                for entry in listed(path):
                    held.append(entry)
                    if len(held) == 10_000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return archives.select("path").distinct().mapInArrow(run, _ENTRY)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _content(f, entry: dict) -> Iterator[tuple[str, bytes]]:
    if entry["method"] == STREAM:
        with opened(entry["path"]) as whole, tarfile.open(fileobj=whole, mode="r|*") as archive:
            for m in archive:
                if m.isfile() and entry["name"] in ("", m.name):
                    yield m.name, archive.extractfile(m).read()
        return
    f.seek(entry["at"])
    if entry["crc"] < 0:
        yield entry["name"], f.read(entry["size"])
        return
    head = f.read(ZIP_HEADER)
    if head[:4] != ZIP_MARK:
        raise ValueError(f"{entry['path']}: no member at {entry['at']}")
    # the header's own lengths of name and extra field lie before the data
    f.seek(entry["at"] + ZIP_HEADER + sum(struct.unpack("<HH", head[26:30])))
    data = f.read(entry["packed"])
    if entry["method"] == DEFLATED:
        data = zlib.decompress(data, -zlib.MAX_WBITS)
    if zlib.crc32(data) != entry["crc"]:
        raise ValueError(f"{entry['path']}: {entry['name']} is damaged")
    yield entry["name"], data


def read(found: DataFrame, chunk: int | None = None) -> DataFrame:
    """(file_path, data) of the members that ``found`` lists."""
    chunk = chunk or CHUNK
    ranged = ordered_scan(found, [], ["path", "at"], {"before": F.col("packed") + 512})
    ranged = ranged.withColumn("part", F.expr(f"before div {chunk}"))
    parts = (ranged.agg(F.max("part")).first()[0] or 0) + 1
    dealt = ranged.select("part", "path", "name", "at", "packed", "size", "method", "crc").repartitionByRange(parts, "part").sortWithinPartitions("path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, f, names, parts_, size = None, None, [], [], 0
        for batch in batches:
            for entry in batch.to_pylist():
                if entry["path"] != at:
                    if f is not None:
                        f.close()
                    at, f = entry["path"], opened(entry["path"])
                for name, data in _content(f, entry):
                    names.append(name)
                    parts_.append(data)
                    size += len(data)
                    if len(names) >= OUT_ROWS or size >= OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts_, pa.binary())], ["file_path", "data"])
                        names, parts_, size = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts_, pa.binary())], ["file_path", "data"])
        if f is not None:
            f.close()

    return dealt.mapInArrow(run, "file_path string, data binary")


def members(archives: DataFrame, kind: str) -> DataFrame:
    """(file_path, data) of all members of the zip or tar files (path)."""
    return read(entries(archives, kind))


def named(archives: DataFrame, kind: str, wanted: DataFrame, key: str) -> DataFrame:
    """(file_path, data) of the members that ``wanted`` names; others are listed, but not read. A packed tar is read whole."""
    names = wanted.select(F.col(key).alias("name")).distinct()
    listed = entries(archives, kind)
    found = listed.join(names, "name", "left_semi").unionByName(listed.where(f"method = {STREAM} and name = ''"))
    return read(found).join(names.withColumnRenamed("name", "file_path"), "file_path", "left_semi")


def zip_texts(archives: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``wanted`` with the text of its member; null when no archive has it."""
    texts = named(archives, "zip", wanted, key).select(F.col("file_path").alias(key), F.decode("data", "UTF-8").alias("text"))
    return wanted.join(texts, key, "left")


def tar_subset(archives: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, data) of the tar members that ``wanted`` names."""
    return named(archives, "tar", wanted, key).withColumnRenamed("file_path", key)
