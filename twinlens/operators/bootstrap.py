"""Percentile bootstrap of prediction tables.

A replicate is a tree of binomial splits (``resample``), so what depends on (true, predicted) costs the cells of the table and
the ranges of a score order, never a row for each draw. ``groups`` columns, such as dataset, backbone and method, evaluate many tables in one
chain of jobs; all of them, and both methods of a pair, see the same draws of the same numbered rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.operators import metrics as M
from twinlens.operators.joins import unique_by
from twinlens.operators.ranking import order_hash, ordered_scan
from twinlens.operators.resample import auroc_draws, cell_draws
from twinlens.session import stored

# The pairs of methods that are compared.
COMPARISONS = [
    ("gated_attention", "mlp_late"),
    ("mcr_late", "mlp_late"),
    ("gated_attention", "mlp_early"),
    ("i2moe", "mlp_early"),
    ("i2moe", "mlp_late"),
]


def numbered(df: DataFrame, key: str, cells: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``row_id``, from 0 within its group in the order (cells, hash of the key, key), and ``size``, the group's rows."""
    hashed = df.withColumn("__h", order_hash("row", F.col(key)))
    placed = ordered_scan(hashed, groups, [*cells, "__h", key], {"row_id": F.lit(1)})
    return placed.drop("__h").withColumnRenamed("row_id_all", "size")


def class_scores(rows: DataFrame, groups: Sequence[str], probs: str = "probs") -> DataFrame:
    """(groups, row_id, size, label, score, positive): the one-vs-rest scores of numbered rows, for two classes those of ``prob_1`` alone."""
    long = M.one_vs_rest(rows.select(*groups, "row_id", "size", "y_true", F.col(probs).alias("probs")))
    return long.filter((F.size("probs") != 2) | (F.col("label") == 1)).select(*groups, "row_id", "size", "label", "score", "positive")


def accuracy_f1_draws(df: DataFrame, samples: int, seed=2026, y: str = "y_true", p: str = "y_pred", groups: Sequence[str] = ()) -> DataFrame:
    """(groups, replicate, accuracy, macro_f1)."""
    counts = cell_draws(df, [y, p], samples, seed, groups).withColumnsRenamed({y: "y_true", p: "y_pred"})
    return M.summary(counts, [*groups, "replicate"]).select(*groups, "replicate", "accuracy", "macro_f1")


def macro_auroc_draws(long: DataFrame, samples: int, seed=2026, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, replicate, auroc): mean over the labels of ``class_scores``, NaN as soon as one is undefined."""
    per_class = auroc_draws(long, samples, seed, [*groups, "label"])
    return per_class.groupBy(*groups, "replicate").agg(F.avg("auroc").alias("auroc"))


def point_auroc(long: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, auroc) of ``class_scores``."""
    per_class = M.auroc(long, "score", "positive", [*groups, "label"])
    return per_class.groupBy(*groups).agg(F.avg("auroc").alias("auroc"))


def interval(draws: DataFrame, metrics: Sequence[str], groups: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """(groups, metric, ci_low, ci_high) over replicates; NaN replicates are dropped.

    The number of replicates bounds each group, so the plain percentile aggregate fits.
    """
    tail = (1 - level) / 2
    long = draws.select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("s"))
    v = F.when(~F.isnan("s.v"), F.col("s.v"))
    return long.groupBy(*groups, F.col("s.metric").alias("metric")).agg(
        F.percentile(v, tail).alias("ci_low"), F.percentile(v, 1 - tail).alias("ci_high")
    )


def _unpivoted(df: DataFrame, groups: Sequence[str], metrics: Sequence[str], value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(value)) for m in metrics])
    return df.select(*groups, F.explode(pairs).alias("s")).select(*groups, "s.*")


def _together(points: DataFrame, intervals: DataFrame, groups: Sequence[str], samples: int) -> DataFrame:
    """Points with their intervals; groups may be null."""
    right = intervals.withColumnsRenamed({c: f"__r_{c}" for c in [*groups, "metric"]})
    same = points["metric"] == right["__r_metric"]
    for g in groups:
        same = same & points[g].eqNullSafe(right[f"__r_{g}"])
    return points.join(right, same).select(*points.columns, "ci_low", "ci_high", F.lit(samples).alias("bootstrap_samples"))


def metric_intervals(df: DataFrame, key: str, samples: int, seed=2026, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, metric, estimate, ci_low, ci_high, bootstrap_samples) for tables with y_true, y_pred, probs.

    The table is read several times, so it should be a stored one.
    """
    long = class_scores(numbered(df, key, ["y_true", "y_pred"], groups), groups)
    base = _unpivoted(M.summary(M.confusion(df, groups=groups), groups), groups, ["accuracy", "macro_f1"], "estimate")
    point = base.unionByName(_unpivoted(point_auroc(long, groups), groups, ["auroc"], "estimate"))
    a = interval(accuracy_f1_draws(df, samples, seed, groups=groups), ["accuracy", "macro_f1"], groups)
    b = interval(macro_auroc_draws(long, samples, seed, groups), ["auroc"], groups)
    return _together(point, a.unionByName(b), groups, samples)


class CaseCountError(ValueError):
    pass


def answer_intervals(
    df: DataFrame, samples: int, seed=2026, y: str = "y_true", p: str = "y_pred", groups: Sequence[str] = (), expected: int | None = None, partial: bool = False
) -> DataFrame:
    """As ``metric_intervals`` for parsed answers: no scores, hence no AUROC; with ``n_test``, the rows of each case.

    ``groups`` name a case (dataset and model). With ``expected`` another number of cases is an error, unless ``partial`` says that
    some may be missing.
    """
    if expected is not None and not partial:
        found = df.select(*groups).distinct().count() if groups else int(bool(df.take(1)))
        if found != expected:
            raise CaseCountError(f"expected {expected} cases, found {found}; pass partial=True for a part of them")
    est = M.summary(M.confusion(df, y, p, groups), groups)
    point = _unpivoted(est, [*groups, "n"], ["accuracy", "macro_f1"], "estimate").withColumnRenamed("n", "n_test")
    out = _together(point, interval(accuracy_f1_draws(df, samples, seed, y, p, groups), ["accuracy", "macro_f1"], groups), groups, samples)
    return out.select(*groups, "metric", "estimate", "ci_low", "ci_high", "bootstrap_samples", "n_test")


SIDES = ("a", "b")


def paired_differences(pairs: DataFrame, samples: int, seed=2026, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, metric, difference, ci_low, ci_high, bootstrap_samples) of two methods scored on the same draws.

    ``pairs`` has y_true, y_pred_a, y_pred_b: a cell is the triple, so both methods see
    exactly the same resample.
    """
    triple = ["y_true", "y_pred_a", "y_pred_b"]
    both = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"y_pred_{s}").alias("y_pred")) for s in SIDES])).alias("s")

    def differences(counts: DataFrame, by: Sequence[str]) -> DataFrame:
        cells = counts.select(*by, "y_true", both, "n").groupBy(*by, "s.side", "y_true", "s.y_pred").agg(F.sum("n").alias("n"))
        side = M.summary(cells, [*by, "side"])
        of = lambda m, s: F.max(F.when(F.col("side") == s, F.col(m)))
        # means may be added up in any order, which is no difference
        return side.groupBy(*by).agg(*[F.round(of(m, "a") - of(m, "b"), 14).alias(m) for m in ("accuracy", "macro_f1")])

    draws = differences(cell_draws(pairs, triple, samples, seed, groups), [*groups, "replicate"])
    whole = differences(pairs.groupBy(*groups, *triple).agg(F.count(F.lit(1)).alias("n")), groups)
    return _together(_unpivoted(whole, groups, ["accuracy", "macro_f1"], "difference"), interval(draws, ["accuracy", "macro_f1"], groups), groups, samples)


def paired_auroc_difference(pairs: DataFrame, key: str, samples: int, seed=2026, groups: Sequence[str] = ()) -> DataFrame:
    """The AUROC row of ``paired_differences``; ``pairs`` also has probs_a and probs_b."""
    rows = numbered(pairs, key, ["y_true", "y_pred_a", "y_pred_b"], groups)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"probs_{s}").alias("probs")) for s in SIDES])).alias("s")
    each = rows.select(*groups, "row_id", "size", "y_true", sides).select(*groups, "row_id", "size", "y_true", "s.*")
    long = stored(class_scores(each, [*groups, "side"]), "scores")

    def difference(found: DataFrame, by: Sequence[str]) -> DataFrame:
        of = lambda s: F.max(F.when(F.col("side") == s, F.col("auroc")))
        return found.groupBy(*by).agg((of("a") - of("b")).alias("auroc"))

    draws = difference(macro_auroc_draws(long, samples, seed, [*groups, "side"]), [*groups, "replicate"])
    point = difference(point_auroc(long, [*groups, "side"]), groups)
    return _together(_unpivoted(point, groups, ["auroc"], "difference"), interval(draws, ["auroc"], groups), groups, samples)


SETTING = ["dataset", "backbone"]


def compare_runs(runs: DataFrame, samples: int, key: str = "sample_id", seed=2026) -> DataFrame:
    """(dataset, backbone, comparison, metric, difference, ci_low, ci_high, bootstrap_samples) of the fixed comparisons,
    for every setting that has both methods, in one chain of jobs.

    ``runs`` has dataset, backbone, method, the key, y_true, y_pred and probs. A key may occur once in a run, and two runs must agree on y_true.
    """
    names = F.broadcast(runs.sparkSession.createDataFrame(COMPARISONS, "method_a string, method_b string"))
    rows = unique_by(runs.select(*SETTING, "method", key, "y_true", "y_pred", "probs"), [*SETTING, "method", key])
    side = lambda s: rows.withColumnsRenamed({c: f"{c}_{s}" for c in ("method", "y_true", "y_pred", "probs")})
    both = side("a").join(names, "method_a").join(side("b"), [*SETTING, "method_b", key])
    same = F.assert_true(F.col("y_true_a").eqNullSafe(F.col("y_true_b")), "prediction tables disagree on the labels")
    both = both.filter(F.coalesce(same.cast("string"), F.lit("")) == "").withColumn("comparison", F.concat_ws(" - ", "method_a", "method_b"))
    pairs = stored(both.select(*SETTING, "comparison", key, F.col("y_true_a").alias("y_true"), *[f"{c}_{s}" for c in ("y_pred", "probs") for s in SIDES]), "pairs")
    if not pairs.take(1):
        raise ValueError("no setting has both methods of a comparison")
    groups = [*SETTING, "comparison"]
    return paired_differences(pairs, samples, seed, groups).unionByName(paired_auroc_difference(pairs, key, samples, seed, groups))

