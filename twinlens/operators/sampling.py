"""Splits and samples in the order of a keyed hash.

The result depends only on the key and the seed, never on partitioning. A cut inside a
stratum is found from hash-bucket counts; the table itself is neither sorted nor
shuffled: each row is compared with the cut of its stratum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinlens.operators.ranking import hash_bucket, null_safe, number_rows, order_hash
from twinlens.session import small_side, small_table


def ceil_percent(n: Column, percent: int) -> Column:
    """ceil(n * percent / 100) in integers."""
    return F.floor((n * percent + 99) / 100).cast("long")


COARSE, FINE = 2, 5
SORT_ROWS = 1_000_000


def hash_cuts(df: DataFrame, key: str, cuts: dict[str, Column], strata: Sequence[str] = (), seed=42) -> DataFrame:
    """One row per stratum: (digest, key) of the k-th row for every named cut.

    Each value of ``cuts`` is a column over ``n``, the size of the stratum. Counts over 256
    hash buckets tell in which bucket a cut falls; a bucket with too many rows to sort is
    counted again over 4096 finer ones; only the rows of the last bucket are ordered. Each
    pass reads key and strata columns and shuffles counts.
    """
    cols = list(strata)
    base = df.select(*cols, F.col(key).alias("__k"), order_hash(seed, F.col(key)).alias("__h"))
    counts = base.groupBy(*cols, hash_bucket(F.col("__h"), COARSE).alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    whole = W.partitionBy(*cols, F.lit(0))
    # both windows share one shuffle of the counts
    counts = counts.withColumn("n", F.sum("__c").over(whole)).withColumn("__cum", F.sum("__c").over(whole.orderBy("__b")))
    wanted = [F.struct(F.lit(name).alias("part"), k.cast("long").alias("k")) for name, k in cuts.items()]
    counts = counts.withColumn("__w", F.explode(F.array(*wanted))).select(*cols, "__b", "__c", "__cum", "__w.part", "__w.k")
    (hits, known), digits = _bucket_of_cut(counts, cols), COARSE
    if known is None or max(known.column("__size").to_pylist(), default=0) > SORT_ROWS:
        inside = _rows_of_cuts(base, hits, cols, COARSE).withColumnRenamed("__left", "k")
        finer = inside.groupBy(*cols, "part", "k", hash_bucket(F.col("__h"), FINE).alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
        finer = finer.withColumn("__cum", F.sum("__c").over(W.partitionBy(*cols, "part").orderBy("__b")))
        hits, digits = _bucket_of_cut(finer, cols)[0], FINE
    edge = _rows_of_cuts(base, hits, cols, digits)
    rank = F.row_number().over(W.partitionBy(*cols, "part").orderBy("__h", "__k"))
    found = edge.withColumn("__r", rank).filter(F.col("__r") == F.col("__left"))
    per_cut = [
        F.max(F.when(F.col("part") == name, F.struct(F.col("__h").alias("h"), F.col("__k").alias("k")))).alias(f"__cut_{i}")
        for i, name in enumerate(cuts)
    ]
    cut = found.groupBy(*[F.col(c).alias(f"__s_{c}") for c in cols]).agg(*per_cut)
    ends = [F.col(f"__cut_{i}.{f}").alias(f"__cut_{i}{f}") for i in range(len(cuts)) for f in "hk"]
    return cut.select(*[f"__s_{c}" for c in cols], *ends)


def _bucket_of_cut(counts: DataFrame, cols: Sequence[str]):
    """From (strata, part, k, bucket, count, running count): the bucket with the k-th row, its
    size and the rank left in it; as ``small_table``."""
    hit = counts.filter((F.col("k") <= F.col("__cum")) & (F.col("k") > F.col("__cum") - F.col("__c")))
    return small_table(
        hit.select(
            *[F.col(c).alias(f"__c_{c}") for c in cols],
            F.col("__b").alias("__cb"), "part", F.col("__c").alias("__size"), (F.col("k") - F.col("__cum") + F.col("__c")).alias("__left"),
        )
    )


def _rows_of_cuts(base: DataFrame, hits: DataFrame, cols: Sequence[str], digits: int) -> DataFrame:
    placed = base.withColumn("__b", hash_bucket(F.col("__h"), digits))
    on = (placed["__b"] == hits["__cb"]) & null_safe(placed, hits, [(c, f"__c_{c}") for c in cols])
    return placed.join(hits, on).select(*cols, "part", "__h", "__k", "__left")


def _within(i: int, key: str, seed) -> Column:
    h, cut_h, cut_k = order_hash(seed, F.col(key)), F.col(f"__cut_{i}h"), F.col(f"__cut_{i}k")
    return F.coalesce((h < cut_h) | ((h == cut_h) & (F.col(key) <= cut_k)), F.lit(False))


def split_by_hash(
    df: DataFrame,
    key: str,
    parts: Sequence[tuple[str, int]],
    strata: Sequence[str] = (),
    seed=42,
    rest: str = "train",
    out: str = "split",
    min_stratum: int = 2,
) -> DataFrame:
    """Adds ``out``: the named parts take ceil(percent) of every stratum, ``rest`` the others.

    A stratum with fewer than ``min_stratum`` rows stays whole in ``rest``.
    """
    cuts, total = {}, 0
    for name, percent in parts:
        total += percent
        cuts[name] = F.when(F.col("n") >= min_stratum, ceil_percent(F.col("n"), total)).otherwise(F.lit(0))
    table = small_side(hash_cuts(df, key, cuts, strata, seed))
    joined = df.join(table, null_safe(df, table, [(c, f"__s_{c}") for c in strata]), "left")
    label = F.lit(rest)
    for i, (name, _) in reversed(list(enumerate(parts))):
        label = F.when(_within(i, key, seed), F.lit(name)).otherwise(label)
    return joined.withColumn(out, label).select(*[c for c in df.columns if c != out], out)


def stratified_subset(df: DataFrame, key: str, percent: int, strata: Sequence[str], seed=42) -> DataFrame:
    """ceil(percent) of every stratum; unchanged when percent is not inside (0, 100)."""
    if not 0 < percent < 100:
        return df
    marked = split_by_hash(df, key, [("in", percent)], strata, seed, rest="out", out="__in", min_stratum=1)
    return marked.filter(F.col("__in") == "in").drop("__in")


def fixed_sample(df: DataFrame, key: str, n: int, seed=42, top_limit: int = 10_000) -> DataFrame:
    """min(n, rows) rows, the first in the order of (hash, key, hash of the whole row).

    ``top_limit`` changes the plan, not the result: above it the rows before the cut are kept in place and only
    those that share the cut's key are ordered."""
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    if n <= top_limit:
        return df.withColumn("__h", order_hash(seed, F.col(key))).orderBy("__h", key, whole).limit(n).select(*df.columns)
    cuts = small_side(hash_cuts(df, key, {"in": F.least(F.col("n"), F.lit(n))}, (), seed))
    marked = df.join(cuts, F.lit(True), "left").filter(_within(0, key, seed))
    at_cut = F.col(key) == F.col("__cut_0k")
    before = marked.filter(~at_cut).select(*df.columns)
    left = n - before.count()
    last = marked.filter(at_cut).select(*df.columns)
    # equal keys at the cut: as many as are missing, in the order of the whole row
    last = last.withColumn("__w", whole).orderBy("__w").limit(max(0, left)).drop("__w")
    return before.unionByName(last)


def route_split(
    df: DataFrame, key: str, val_percent: int | None = None, strata: Sequence[str] = (), seed=42
) -> DataFrame:
    """Keeps a given ``val`` split; without one, cuts ``val_percent`` out of ``train``.

    Rows whose split is none of train, val and test are left out, as in a three-way filter.
    """
    known = df.filter(F.col("split").isin("train", "val", "test"))
    has_val = bool(df.filter(F.col("split") == "val").limit(1).count())
    if has_val or not val_percent:
        return known
    train = known.filter(F.col("split") == "train")
    cut = split_by_hash(train, key, [("val", val_percent)], strata, seed, min_stratum=1)
    return cut.unionByName(known.filter(F.col("split") == "test"))


__all__ = [
    "fixed_sample",
    "hash_cuts",
    "number_rows",
    "route_split",
    "split_by_hash",
    "stratified_subset",
]
