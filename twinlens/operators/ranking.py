"""Exact ranks, numbers and quantiles that never sort a whole group in one task.

All helpers use the same two-level idea: rows fall into many parts, hash buckets or ranges of the order, the parts' totals
are accumulated, and only rows of one part are ordered together. A group that holds a third of the table is spread over its parts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinlens.session import small_side, stored

def order_hash(seed, *keys: Column) -> Column:
    """Hex md5 of ``seed|key...``: the stable random order used for every sample."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_bucket(digest: Column, digits: int = 3) -> Column:
    """Leading hex digits: buckets of equal size that follow the order of the digest."""
    return F.substring(digest, 1, digits)


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def number_rows(df: DataFrame, key: str, within: Sequence[str] = (), out: str = "row_id", seed="row") -> DataFrame:
    """0-based dense numbers in the order (``within`` columns, md5(seed|key), key).

    ``within`` must have few distinct values. Two aggregates of counts give the offset
    of each (within, bucket); only the rows of one bucket are sorted together.
    """
    cols = list(within)
    base = df.withColumn("__h", order_hash(seed, F.col(key))).withColumn("__b", hash_bucket(F.col("__h")))
    counts = base.groupBy(*cols, "__b").agg(F.count(F.lit(1)).alias("__n"))
    inner = W.partitionBy(*cols, F.lit(0)).orderBy("__b")
    per_bucket = counts.withColumn("__before", F.sum("__n").over(inner) - F.col("__n"))
    if cols:
        # one row per combination of the few ``within`` values
        totals = counts.groupBy(*cols).agg(F.sum("__n").alias("__t"))
        totals = totals.withColumn("__start", F.sum("__t").over(W.orderBy(*cols)) - F.col("__t"))
        totals = totals.select(*[F.col(c).alias(f"__g_{c}") for c in cols], "__start")
        cond = null_safe(per_bucket, totals, [(c, f"__g_{c}") for c in cols])
        per_bucket = per_bucket.join(totals, cond).withColumn("__before", F.col("__before") + F.col("__start"))
    offsets = small_side(
        per_bucket.select(*[F.col(c).alias(f"__o_{c}") for c in cols], F.col("__b").alias("__ob"), "__before"),
        max_rows=2_000_000,
    )
    cond = (base["__b"] == offsets["__ob"]) & null_safe(base, offsets, [(c, f"__o_{c}") for c in cols])
    rank = F.row_number().over(W.partitionBy(*cols, "__b").orderBy("__h", key))
    return (
        base.withColumn("__r", rank)
        .join(offsets, cond)
        .withColumn(out, F.col("__before") + F.col("__r") - 1)
        .select(*df.columns, out)
    )


def ordered_scan(df: DataFrame, groups: Sequence[str], order: Sequence, sums: Mapping[str, Column], maxima: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` with running totals of its groups in the given order: for each of ``sums`` the total of the rows before (``name``)
    and of the whole group (``name_all``), for each of ``maxima`` the largest value of the rows before (null for the first).

    Rows are dealt to tasks by ranges of (groups, order), so a group of any size is spread over as many tasks as it needs; only the
    totals of a group in each task, a row each, are accumulated in one place. Equal rows may come in any order."""
    cols, maxima = list(groups), dict(maxima or {})
    parts = {**{f"__s_{k}": v for k, v in sums.items()}, **{f"__x_{k}": v for k, v in maxima.items()}}
    rows = df.select(*df.columns, *[v.alias(k) for k, v in parts.items()])
    rows = stored(rows.repartitionByRange(*cols, *order).sortWithinPartitions(*cols, *order).withColumn("__scan_m", F.monotonically_increasing_id()), "scan")
    rows = rows.withColumn("__scan_p", F.shiftright("__scan_m", 33))
    fold = lambda k: F.sum(k) if k.startswith("__s_") else F.max(k)
    totals = rows.groupBy(*cols, "__scan_p").agg(*[fold(k).alias(k) for k in parts])
    whole = W.partitionBy(*cols, F.lit(0))
    earlier = whole.orderBy("__scan_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__scan_g_{c}") for c in cols], F.col("__scan_p").alias("__scan_q"), *[fold(k).over(earlier).alias(f"__b{k}") for k in parts], *[F.sum(k).over(whole).alias(f"__t{k}") for k in parts if k.startswith("__s_")]
    )
    offsets = small_side(offsets)
    joined = rows.join(offsets, (rows["__scan_p"] == offsets["__scan_q"]) & null_safe(rows, offsets, [(c, f"__scan_g_{c}") for c in cols]))
    inner = W.partitionBy("__scan_p", *cols).orderBy("__scan_m").rowsBetween(W.unboundedPreceding, -1)
    out = []
    for k in sums:
        out += [(F.coalesce(f"__b__s_{k}", F.lit(0)) + F.coalesce(F.sum(f"__s_{k}").over(inner), F.lit(0))).alias(k), F.col(f"__t__s_{k}").alias(f"{k}_all")]
    out += [F.greatest(f"__b__x_{k}", F.max(f"__x_{k}").over(inner)).alias(k) for k in maxima]
    return joined.select(*df.columns, *out)


#: Distinct values of one quantile's bracket that are put in order in one place, and pieces that a larger one is cut into.
FEW, PIECES = 10_000, 64


def _bracketed(rows: DataFrame, goals: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(groups, q, __k, __c): how often each value of a goal's bracket occurs, and, with a null ``__k``, the values below it."""
    goal = small_side(goals.select(*[F.col(c).alias(f"__l_{c}") for c in cols], "q", "__a", "__z"))
    near = rows.join(goal, null_safe(rows, goal, [(c, f"__l_{c}") for c in cols])).filter(F.col("__v") <= F.col("__z"))
    kept = F.when(F.col("__v") >= F.col("__a"), F.col("__v"))
    return near.groupBy(*cols, "q", kept.alias("__k")).agg(F.count(F.lit(1)).alias("__c"))


def _with_goals(counts: DataFrame, goals: DataFrame, cols: Sequence[str], *values: str) -> DataFrame:
    side = small_side(goals.select(*[F.col(c).alias(f"__l_{c}") for c in cols], F.col("q").alias("__lq"), *values))
    joined = counts.join(side, (counts["q"] == side["__lq"]) & null_safe(counts, side, [(c, f"__l_{c}") for c in cols]))
    return joined.select(*counts.columns, *values)


def _narrowed(counts: DataFrame, goals: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``counts`` with each bracket cut down to the pieces that hold its wanted ranks; what lies below adds to the null row."""
    by = [*cols, "q"]
    marks = [(i + 1) / PIECES for i in range(PIECES - 1)]
    cuts = counts.filter("__k is not null").groupBy(*by).agg(F.percentile_approx("__k", marks, 10_000).alias("__cuts"))
    placed = _with_goals(counts, cuts, cols, "__cuts").withColumn("__b", F.when(F.col("__k").isNull(), -1).otherwise(F.size(F.filter("__cuts", lambda x: x < F.col("__k")))))
    # at most PIECES + 1 rows for each goal
    sums = placed.groupBy(*by, "__b").agg(F.sum("__c").alias("__n"))
    sums = sums.withColumn("__to", F.sum("__n").over(W.partitionBy(*by).orderBy("__b")))
    sums = _with_goals(sums, goals, cols, "__r0", "__r1")
    ends = sums.groupBy(*by).agg(F.min(F.when(F.col("__to") > F.col("__r0"), F.col("__b"))).alias("__b0"), F.min(F.when(F.col("__to") > F.col("__r1"), F.col("__b"))).alias("__b1"))
    cut = _with_goals(placed, ends, cols, "__b0", "__b1").filter(F.col("__b") <= F.col("__b1"))
    return cut.groupBy(*by, F.when(F.col("__b") >= F.col("__b0"), F.col("__k")).alias("__k")).agg(F.sum("__c").alias("__c"))


def exact_quantiles(
    df: DataFrame, value: str, qs: Sequence[float], groups: Sequence[str] = (), accuracy: int = 10_000, few: int = FEW
) -> DataFrame:
    """(groups, q, value): quantiles with linear interpolation; nulls and NaN are ignored.

    Selection in rounds, for all quantiles and groups at once. A sketch gives each quantile a bracket; one pass counts what lies below and how
    often each value in it occurs. A bracket that turns out to miss a wanted rank is opened on that side and counted again. A bracket
    with more than ``few`` distinct values is cut into ``PIECES`` at its own quantiles and only the pieces with the wanted ranks stay, until few are
    left; these rounds read the counts, not the rows. The last step orders at most ``few`` values of one quantile in one place.
    """
    cols = list(groups)
    by = [*cols, "q"]
    margin = 4.0 / accuracy
    marked = [min(1.0, max(0.0, q + shift)) for shift in (-margin, margin) for q in qs]
    v = F.col(value).cast("double")
    rows = df.select(*cols, v.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    sketch = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", marked, accuracy).alias("__s"))
    each = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(i).alias("i")) for i, q in enumerate(qs)]))
    goals = sketch.withColumn("__m", each).withColumn("q", F.col("__m.q"))
    # q * (n - 1) is rounded so that an exact rank is not missed by one part in 1e16
    goals = goals.withColumn("__pos", F.round(F.col("q") * (F.col("__n") - 1), 9))
    whole = F.col("__n") <= few
    low, high = F.get("__s", F.col("__m.i")), F.get("__s", F.col("__m.i") + len(qs))
    inf = lambda sign: F.lit(float(f"{sign}inf"))
    goals = goals.select(
        *by, "__pos", F.floor("__pos").alias("__r0"), F.ceil("__pos").alias("__r1"), F.when(whole, inf("-")).otherwise(low).alias("__a"), F.when(whole, inf("")).otherwise(high).alias("__z")
    )
    goals = stored(goals, "goals")
    counts, todo = None, goals
    while True:
        new = stored(_bracketed(rows, todo, cols), "counts")
        below, inside = F.sum(F.when(F.col("__k").isNull(), F.col("__c")).otherwise(0)), F.sum("__c")
        found = new.groupBy(*by).agg(below.alias("__under"), inside.alias("__upto"))
        state = _with_goals(found, todo, cols, "__pos", "__r0", "__r1", "__a", "__z")
        left, right = F.col("__under") > F.col("__r0"), F.col("__upto") <= F.col("__r1")
        missed = state.filter(left | right).withColumn("__a", F.when(left, inf("-")).otherwise(F.col("__a"))).withColumn("__z", F.when(right, inf("")).otherwise(F.col("__z")))
        missed = stored(missed.select(*goals.columns), "goals")
        again = bool(missed.take(1))
        if again:
            gone = missed.select(*[F.col(c).alias(f"__l_{c}") for c in by])
            new = new.join(gone, null_safe(new, gone, [(c, f"__l_{c}") for c in by]), "left_anti")
        counts = new if counts is None else counts.unionByName(new)
        if not again:
            break
        todo = missed
    while counts.groupBy(*by).agg(F.count("__k").alias("__d")).filter(F.col("__d") > few).take(1):
        counts = stored(_narrowed(counts, goals, cols), "counts")
    cum = F.sum("__c").over(W.partitionBy(*by).orderBy(F.col("__k").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    ranked = _with_goals(counts.withColumn("__cum", cum), goals, cols, "__pos", "__r0", "__r1")
    at = lambda r: F.min(F.when(F.col("__cum") > F.col(r), F.col("__k")))
    part = F.first("__pos") - F.first("__r0")
    ends = ranked.groupBy(*by).agg(at("__r0").alias("__x"), at("__r1").alias("__y"), part.alias("__f"))
    return ends.select(*by, (F.col("__x") + (F.col("__y") - F.col("__x")) * F.col("__f")).alias("value"))
