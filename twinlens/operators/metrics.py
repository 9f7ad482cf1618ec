"""Classification metrics as aggregates.

Everything that depends on (true, predicted) only starts from the confusion counts, one
map-side combined aggregate; rank metrics run on distinct scores spread over buckets.
``groups`` columns evaluate many tables (methods, replicates) in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinlens.operators.ranking import exact_quantiles, ordered_scan


def confusion(df: DataFrame, y: str = "y_true", p: str = "y_pred", groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(*groups, F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(n.cast("long").alias("n"))


def dense_confusion(counts: DataFrame) -> DataFrame:
    """All label pairs, absent ones with 0, of ``counts`` (y_true, y_pred, n); labels are few."""
    names = counts.select(F.explode(F.array("y_true", "y_pred")).alias("l")).groupBy().agg(F.array_sort(F.collect_set("l")).alias("labels"))
    grid = names.select("labels", F.explode("labels").alias("y_true")).select("y_true", F.explode("labels").alias("y_pred"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_counts(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, label, tp, support, predicted) from confusion counts, over labels seen on either side."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )
    return (
        counts.select(*groups, F.explode(sides).alias("s"))
        .groupBy(*groups, F.col("s.label").alias("label"))
        .agg(*[F.sum(f"s.{c}").cast("long").alias(c) for c in ("tp", "support", "predicted")])
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where undefined."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def class_report(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    c = class_counts(counts, groups)
    return c.select(
        *groups,
        "label",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "predicted",
        "tp",
    )


def summary(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n, accuracy, macro_f1, weighted_precision, weighted_recall, weighted_f1, micro_f1)."""
    r = class_report(counts, groups)
    n = F.sum("support")

    def weighted(c):
        return F.sum(F.col(c) * F.col("support")) / n

    micro = 2.0 * F.sum("tp") / (F.sum("support") + F.sum("predicted"))
    return r.groupBy(*groups).agg(
        n.cast("long").alias("n"),
        (F.sum("tp").cast("double") / n).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
        micro.alias("micro_f1"),
    )


def auroc(df: DataFrame, score: str, positive: str, groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(groups, auroc): rank-sum with average ranks for ties; NaN where one class is absent.

    Rows first collapse to distinct scores; the negatives below each come from an ordered scan, so a group of any size is spread."""
    cols = list(groups)
    w = F.col(weight) if weight else F.lit(1)
    pos = F.sum(F.when(F.col(positive) == 1, w).otherwise(F.lit(0))).alias("__p")
    neg = F.sum(F.when(F.col(positive) == 1, F.lit(0)).otherwise(w)).alias("__n")
    points = ordered_scan(df.groupBy(*cols, score).agg(pos, neg), cols, [score], {"__below": F.col("__n")})
    won = F.col("__p") * (F.col("__below") + F.col("__n") * F.lit(0.5))
    total = points.groupBy(*cols).agg(F.sum(won).alias("__u"), F.sum("__p").alias("__p"), F.sum("__n").alias("__n"))
    pairs = F.col("__p").cast("double") * F.col("__n")
    return total.select(*cols, F.when(pairs > 0, F.col("__u") / pairs).otherwise(F.lit(float("nan"))).alias("auroc"))


def one_vs_rest(df: DataFrame, probs: str = "probs", y: str = "y_true") -> DataFrame:
    """One row per (row, class): adds ``label``, ``score`` and ``positive``."""
    out = df.select("*", F.posexplode(probs).alias("label", "score"))
    return out.withColumn("positive", (F.col(y) == F.col("label")).cast("int"))


def auroc_macro(df: DataFrame, probs: str = "probs", y: str = "y_true", groups: Sequence[str] = ()) -> DataFrame:
    """Mean of the one-vs-rest AUROC over classes; NaN as soon as one class is undefined."""
    rows = one_vs_rest(df.select(*groups, y, probs), probs, y)
    return auroc(rows, "score", "positive", [*groups, "label"]).groupBy(*groups).agg(F.avg("auroc").alias("auroc"))


def auroc_hard(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per class (TPR + TNR) / 2 of hard predictions; null where undefined."""
    c = class_counts(counts, groups)
    total = F.sum("support").over(W.partitionBy(*groups, F.lit(0)))
    c = c.withColumn("n", total)
    neg = F.col("n") - F.col("support")
    tnr = (neg - (F.col("predicted") - F.col("tp"))).cast("double") / neg
    tpr = F.col("tp").cast("double") / F.col("support")
    ok = (F.col("support") > 0) & (neg > 0)
    return c.select(*groups, "label", F.when(ok, (tpr + tnr) / 2).alias("auroc"))


def roc_points(df: DataFrame, score: str, positive: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, threshold, fpr, tpr): one row per distinct score, highest first."""
    cols = list(groups)
    pos = F.sum(F.when(F.col(positive) == 1, 1).otherwise(0)).alias("p")
    neg = F.sum(F.when(F.col(positive) == 1, 0).otherwise(1)).alias("n")
    counts = df.groupBy(*cols, score).agg(pos, neg)
    points = ordered_scan(counts, cols, [F.col(score).desc()], {"__p": F.col("p"), "__n": F.col("n")})
    share = lambda own, c: (F.col(c) + F.col(own)).cast("double") / F.col(f"{c}_all")
    return points.select(*cols, F.col(score).alias("threshold"), share("n", "__n").alias("fpr"), share("p", "__p").alias("tpr"))


def multilabel_summary(df: DataFrame, pairs: Sequence[tuple[str, str]], groups: Sequence[str] = ()) -> DataFrame:
    """Subset accuracy and macro-F1 over (true, predicted) 0/1 column pairs; one aggregate."""
    same = F.lit(True)
    for t, p in pairs:
        same = same & (F.col(t) == F.col(p))
    sums = [F.avg(same.cast("double")).alias("subset_accuracy"), F.count(F.lit(1)).alias("n")]
    for i, (t, p) in enumerate(pairs):
        sums += [F.sum(F.col(t) * F.col(p)).alias(f"__h{i}"), F.sum(F.col(t) + F.col(p)).alias(f"__s{i}")]
    agg = df.groupBy(*groups).agg(*sums)
    f1 = sum((ratio(2 * F.col(f"__h{i}"), F.col(f"__s{i}")) for i in range(len(pairs))), F.lit(0.0)) / len(pairs)
    return agg.select(*groups, "n", "subset_accuracy", f1.alias("macro_f1"))


def cross_entropy(probs: Column, y: Column) -> Column:
    """-log p of the true class (0-based index)."""
    return -F.log(F.get(probs, y.cast("int")))


def contrastive_hinge(fused: Column, text: Column, image: Column, y: Column) -> Column:
    """relu(CE of the fused output - smaller of the two unimodal CEs), per row."""
    best = F.least(cross_entropy(text, y), cross_entropy(image, y))
    return F.greatest(cross_entropy(fused, y) - best, F.lit(0.0))


def weighted_cross_entropy(df: DataFrame, probs: str, y: str, weight: str, groups: Sequence[str] = ()) -> DataFrame:
    nll = cross_entropy(F.col(probs), F.col(y))
    return df.groupBy(*groups).agg((F.sum(F.col(weight) * nll) / F.sum(weight)).alias("weighted_ce"))


def latency_profile(df: DataFrame, millis: str, tokens: str, groups: Sequence[str] = ()) -> DataFrame:
    """p50 / p95 latency, samples and tokens per second; null token counts are ignored."""
    q = exact_quantiles(df, millis, [0.5, 0.95], groups)
    wide = q.groupBy(*groups).agg(
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50_ms"),
        F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95_ms"),
    )
    seconds = F.sum(millis) / 1000.0
    sums = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) / seconds).alias("samples_per_s"),
        (F.sum(tokens) / seconds).alias("tokens_per_s"),
        F.avg(tokens).alias("mean_tokens"),
    )
    return sums.join(wide, list(groups))


def parameter_count(params: DataFrame) -> DataFrame:
    """Count and size in MB of a parameter table (name, shape, values) held in 4-byte floats."""
    n = F.sum(F.size("values").cast("long"))
    return params.groupBy().agg(n.alias("parameters"), (n * 4 / F.lit(1024.0 * 1024.0)).alias("size_mb"))
