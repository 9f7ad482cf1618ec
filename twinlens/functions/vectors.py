"""Embedding vectors as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, body) -> Column:
    """``body`` with ``value`` bound once. A lambda evaluates every outer expression again
    for each element, so sums over the vector must be bound before they are used inside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector gives NaN in every place, as division by its norm does."""
    scaled = lambda n: F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(F.lit(float("nan"))))
    return let(norm(v), scaled)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def softmax(v: Column) -> Column:
    def spread(e):
        return let(total(e), lambda t: F.transform(e, lambda x: x / t))

    shifted = let(F.array_max(as_double(v)), lambda top: F.transform(as_double(v), lambda x: F.exp(x - top)))
    return let(shifted, spread)


def sigmoid(v: Column) -> Column:
    return F.transform(as_double(v), lambda x: 1.0 / (1.0 + F.exp(-x)))


def argmax(v: Column) -> Column:
    """0-based; ties go to the lowest index."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def onehot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("int"))


def threshold(v: Column, at: float = 0.5) -> Column:
    return F.transform(v, lambda x: (x > at).cast("int"))


def zero_like(v: Column) -> Column:
    return F.transform(as_double(v), lambda x: F.lit(0.0))


def masked_mean_pool(tokens: Column, mask: Column, floor: float = 1e-9) -> Column:
    """Mean of the token vectors (array of arrays) whose mask is 1; denominator at least ``floor``."""
    width = F.size(tokens[0])
    zero = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    weighted = F.zip_with(tokens, mask, lambda t, m: F.transform(as_double(t), lambda x: x * m))
    sums = F.aggregate(weighted, zero, lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    kept = F.greatest(total(mask.cast("array<double>")), F.lit(floor))
    return let(kept, lambda n: F.transform(sums, lambda x: x / n))


def mean_pool(tokens: Column) -> Column:
    return masked_mean_pool(tokens, F.transform(tokens, lambda _: F.lit(1.0)))


def multi_hot(parts: Column, vocabulary: list[str]) -> Column:
    """0/1 per vocabulary entry, for a vocabulary fixed on the training rows."""
    return F.array(*[F.array_contains(parts, w).cast("int") for w in vocabulary])


def hot_labels(df: DataFrame, key: str, labels: str, train: DataFrame) -> DataFrame:
    """(key, label, hot = 1): the labels of each row that the vocabulary of ``train`` has; all others are 0.

    The vocabulary is a joined table, so it may be of any size, and zeros are not written out."""
    vocabulary = train.select(F.explode(labels).alias("label")).distinct()
    pairs = df.select(key, F.explode(F.array_distinct(labels)).alias("label"))
    return pairs.join(vocabulary, "label", "left_semi").select(key, "label", F.lit(1).alias("hot"))


def label_index(train: DataFrame, label: str) -> DataFrame:
    """(label, index): sorted distinct training labels as strings, numbered from 0 without gathering them in one task."""
    from twinlens.operators.sets import numbered

    names = train.select(F.col(label).cast("string").alias("label")).filter("label is not null").distinct()
    return numbered(names.orderBy("label"), "index").withColumn("index", F.col("index").cast("int"))
