"""Distributed embedding of texts and images with a pluggable encoder.

Rows stay in their partition: a task loads the encoder once, encodes its batches and
emits the rows with their vectors. Nothing is gathered and nothing has to be made unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.functions.text import wrap
from twinlens.functions.vectors import l2_normalize, let, masked_mean_pool


class Encoder(Protocol):
    """What a model wrapper offers; missing inputs are None and give None."""

    def encode_text(self, texts: Sequence[str | None]) -> list: ...

    def encode_image(self, images: Sequence[bytes | None]) -> list: ...


def hashed_words(text: Column, dims: int) -> Column:
    """Counts of the words between spaces in ``dims`` hash buckets, in built-in functions; null for a null text.

    The buckets are bound once; a count is what the array loses when its bucket is taken out."""
    words = F.filter(F.split(F.lower(text), " "), lambda w: w != "")
    buckets = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"), F.lit(dims)))
    return let(buckets, lambda b: F.when(b.isNotNull(), F.array(*[(F.size(b) - F.size(F.array_remove(b, d))).cast("double") for d in range(dims)])))


def nibble_counts(data: Column) -> Column:
    """Counts of the upper half of each byte, in built-in functions; null for a null value."""
    upper = F.regexp_replace(F.hex(data), "(.).", "$1")
    count = lambda u, d: (F.length(u) - F.length(F.replace(u, F.lit(d), F.lit("")))).cast("double")
    return let(upper, lambda u: F.when(u.isNotNull(), F.array(*[count(u, d) for d in "0123456789ABCDEF"])))


def unit(v: Column) -> Column:
    """A vector at unit length; null stays null, and a zero vector gives NaN."""
    return let(v, l2_normalize)


def fused(text: Column, image: Column) -> Column:
    """Mean of the vectors that are present."""
    zero = lambda v: F.transform(v, lambda _: F.lit(0.0))

    def pooled(t: Column, i: Column) -> Column:
        mask = F.array(t.isNotNull().cast("double"), i.isNotNull().cast("double"))
        return let(F.array(F.coalesce(t, zero(i)), F.coalesce(i, zero(t))), lambda tokens: masked_mean_pool(tokens, mask))

    return let(text, lambda t: let(image, lambda i: pooled(t, i)))


class HashingEncoder:
    """Default encoder without a model: hashed word counts, and shares of byte values."""

    def __init__(self, dims: int = 16):
        self.dims = dims
        self.buckets: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        b = self.buckets.get(word)
        if b is None:
            b = int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % self.dims
            if len(self.buckets) < 1_000_000:
                self.buckets[word] = b
        return b

    def encode_text(self, texts):
        out = []
        for t in texts:
            ids = None if t is None else [self.bucket(w) for w in t.lower().split(" ") if w]
            out.append(None if ids is None else np.bincount(ids, minlength=self.dims).astype(float))
        return out

    def encode_image(self, images):
        """Counts of the upper half of each byte, folded to the dimension."""
        out = []
        for data in images:
            if data is None:
                out.append(None)
                continue
            counts = np.bincount(np.frombuffer(data, np.uint8) >> 4, minlength=16).astype(float)
            out.append(np.resize(np.append(counts, np.zeros(max(0, self.dims - 16))), self.dims) if self.dims != 16 else counts)
        return out


def _unit(v):
    if v is None:
        return None
    n = float(np.sqrt((v * v).sum()))
    return (v / n).tolist() if n > 0 else [float("nan")] * len(v)


def _vectors(frame: pd.DataFrame, encoder: Encoder, text: str | None, image: str | None, unit: bool) -> dict:
    post = _unit if unit else (lambda v: None if v is None else np.asarray(v).tolist())
    out = {}
    if text:
        out["text_emb"] = [post(v) for v in encoder.encode_text(frame[text].where(frame[text].notna(), None).tolist())]
    if image:
        raw = [None if x is None or isinstance(x, float) else bytes(x) for x in frame[image]]
        out["image_emb"] = [post(v) for v in encoder.encode_image(raw)]
    return out


def encode(
    df: DataFrame,
    keep: Sequence[str],
    make: Callable[[], Encoder],
    text: str | None = None,
    image: str | None = None,
    batch: int = 256,
    unit: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """``keep`` plus ``text_emb`` and / or ``image_emb`` (array<double>, unit length).

    ``partitions`` spreads the rows first, for encoders that are slow against a shuffle.
    """
    inputs = [c for c in (text, image) if c]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    extra = [f"{n} array<double>" for n, c in (("text_emb", text), ("image_emb", image)) if c]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for frame in frames:
            cols: dict[str, list] = {}
            for at in range(0, len(frame), batch):
                for name, vs in _vectors(frame.iloc[at : at + batch], encoder, text, image, unit).items():
                    cols.setdefault(name, []).extend(vs)
            yield frame[list(keep)].assign(**cols)

    rows = df.select(*keep, *[c for c in inputs if c not in keep])
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, ", ".join([kept, *extra]))


def encode_fused(
    df: DataFrame, keep: Sequence[str], make: Callable[[], Encoder], text: str, image: str, wrapper: tuple[str, str], batch: int = 256
) -> DataFrame:
    """One vector per row: the wrapped text and the image are two token vectors, pooled
    over those that are present."""
    wrapped = df.withColumn("__text", wrap(F.col(text), wrapper))
    parts = encode(wrapped, keep, make, "__text", image, batch, unit=False)
    return parts.select(*keep, fused(F.col("text_emb"), F.col("image_emb")).alias("embedding"))


def encode_images(spark: SparkSession, path: str, make: Callable[[], Encoder], glob: str = "*") -> DataFrame:
    """(ImageName, image_emb) of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("ImageName"), "content")
    return encode(named, ["ImageName"], make, image="content")
