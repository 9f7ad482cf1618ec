"""Report tables from metric, interval and cost tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions.answers import inverted_label
from twinlens.functions.columns import with_default
from twinlens.functions.formats import interval_cell
from twinlens.functions.strings import display_key, map_values
from twinlens.operators import metrics as M
from twinlens.operators.aggregates import pivot_many
from twinlens.operators.joins import one_to_one
from twinlens.operators.ranking import ordered_scan
from twinlens.operators.sets import category_rank, union_all

KEYS = ["dataset", "backbone", "method"]

# Order and names in the tables.
METHOD_LABELS = {
    "image_only": "Image-only probe",
    "text_only": "Text-only probe",
    "linear": "Linear concat",
    "mlp_early": "Early MLP",
    "mlp_late": "Late MLP",
    "gated_attention": "Gated attention",
    "mcr_late": "MCR late",
    "i2moe": "I²MoE",
}
METHOD_ORDER = list(METHOD_LABELS)
BOOT_METRICS = ["accuracy", "macro_f1", "auroc"]
ARCHITECTURES = {
    "Torch_Early_Fusion_H0": "Linear Probe",
    "Torch_Early_Fusion_H[128]": "MLP Early Fusion",
    "Torch_Late_Fusion_H[128]": "MLP Late Fusion",
}
ZERO_SHOT_FAMILY, FUSION_FAMILY = "Direct zero-shot MLLM", "Frozen-embedding fusion"
FAMILY_ORDER = ["Direct MLLM", "Embedding fusion"]
COST_AXES = [
    ("latency_p50_ms", "estimate_macro_f1"),
    ("flops_per_sample", "estimate_accuracy"),
    ("trainable_parameters", "estimate_macro_f1"),
    ("peak_gpu_memory_mb", "estimate_macro_f1"),
]


def with_intervals(metrics: DataFrame, boot: DataFrame) -> DataFrame:
    """One row per run: metrics, interval columns and the method's label."""
    wide = pivot_many(boot, KEYS, "metric", ["estimate", "ci_low", "ci_high"], BOOT_METRICS)
    return one_to_one(metrics, wide, KEYS).withColumn("method_label", map_values(F.col("method"), METHOD_LABELS))


def performance(metrics: DataFrame, boot: DataFrame) -> DataFrame:
    table = with_intervals(metrics, boot)
    cells = [
        interval_cell(F.col(f"estimate_{m}"), F.col(f"ci_low_{m}"), F.col(f"ci_high_{m}")).alias(title)
        for m, title in (("accuracy", "Accuracy"), ("macro_f1", "Macro-F1"))
    ]
    rest = [c for c in ("epochs_run", "n_test") if c in table.columns]
    return table.select("dataset", "backbone", "method_label", *cells, *rest).orderBy("dataset", "backbone", "method_label")


def all_models(metrics: DataFrame, zero_shot: DataFrame) -> DataFrame:
    """Both families under one set of names."""
    fusion = metrics.select(
        "dataset", F.lit(FUSION_FAMILY).alias("model_family"), F.col("backbone").alias("model"), F.col("method").alias("evaluation"),
        "accuracy", F.col("f1_score").alias("macro_f1"),
    )
    direct = zero_shot.select(
        "dataset", F.lit(ZERO_SHOT_FAMILY).alias("model_family"), F.col("backbone").alias("model"), F.col("fusion_method").alias("evaluation"),
        "accuracy", F.col("f1_score").alias("macro_f1"),
    )
    return union_all(fusion, direct)


def efficiency(table: DataFrame, costs: DataFrame) -> DataFrame:
    """``table`` from ``with_intervals`` joined one to one with the cost of each run."""
    joined = one_to_one(table, costs, KEYS)
    return joined.select(
        "dataset", "backbone", "method_label", F.col("estimate_macro_f1").alias("macro_f1"), "trainable_parameters",
        "flops_per_sample", "latency_p50_ms", "peak_gpu_memory_mb",
    ).orderBy("dataset", "backbone", "method_label")


def combined_cost(table: DataFrame, costs: DataFrame, profiles: DataFrame) -> DataFrame:
    """One cost table over both families; direct models have no FLOPs."""
    names = ["model_family", "dataset", "model", "method", "accuracy", "macro_f1", "trainable_parameters", "flops_per_sample", "latency_p50_ms", "peak_gpu_memory_mb"]
    fusion = one_to_one(table, costs, KEYS).select(
        F.lit(FAMILY_ORDER[1]).alias("model_family"), "dataset", F.col("backbone").alias("model"), F.col("method_label").alias("method"),
        F.col("estimate_accuracy").alias("accuracy"), F.col("estimate_macro_f1").alias("macro_f1"), *names[6:],
    )
    direct = profiles.select(
        F.lit(FAMILY_ORDER[0]).alias("model_family"), "dataset", "model", F.lit("Zero-shot").alias("method"), "accuracy", "macro_f1",
        F.col("parameter_count").alias("trainable_parameters"), "latency_p50_ms", "peak_gpu_memory_mb",
    )
    both = union_all(direct, fusion, missing=True).select(*names)
    return both.orderBy(category_rank(F.col("model_family"), FAMILY_ORDER), "dataset", "model", "method")


def zero_shot_profile(profiles: DataFrame, results: DataFrame) -> DataFrame:
    """Profiles joined one to one with the results of the same (dataset, model)."""
    named = results.drop("model").withColumnsRenamed({"backbone": "model", "f1_score": "macro_f1"})
    report = one_to_one(profiles, named.select("dataset", "model", "accuracy", "macro_f1"), ["dataset", "model"])
    return report.orderBy("dataset", "model")


def summary_pivot(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per dataset, one column per (metric, architecture)."""
    df = with_default(results, "backbone", "clip")
    named = map_values(F.col("model"), ARCHITECTURES)
    df = df.withColumn("architecture", display_key(F.col("backbone"), named))
    return pivot_many(df, ["dataset"], "architecture", ["accuracy", "f1_score", "auc"], columns)


def frontier(points: DataFrame, groups: Sequence[str], cost: str, quality: str) -> DataFrame:
    """Adds ``on_frontier``: no other point of the group is at least as good on both axes
    and better on one.

    Points collapse to the best quality per cost; the best quality at lower cost comes from an ordered scan, so a group of any size is spread.
    """
    cols = list(groups)
    best = points.groupBy(*cols, cost).agg(F.max(quality).alias(quality))
    rising = ordered_scan(best, cols, [cost], {}, {"__top": F.col(quality)}).filter(F.col("__top").isNull() | (F.col(quality) > F.col("__top")))
    front = rising.drop("__top").withColumn("on_frontier", F.lit(True))
    joined = points.join(front, [*cols, cost, quality], "left")
    return joined.select(*points.columns, F.coalesce("on_frontier", F.lit(False)).alias("on_frontier"))


def cost_points(table: DataFrame, costs: DataFrame, axes=COST_AXES) -> DataFrame:
    """(dataset, backbone, method, axis, cost, quality, on_frontier) over the cost axes."""
    joined = one_to_one(table, costs, KEYS)
    rows = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("cost"), F.col(q).cast("double").alias("quality")) for c, q in axes])
    long = joined.select(*KEYS, F.explode(rows).alias("p")).select(*KEYS, "p.*")
    marked = frontier(long, ["dataset", "backbone", "axis"], "cost", "quality")
    return marked.orderBy("dataset", "backbone", "axis", category_rank(F.col("method"), METHOD_ORDER))


def corrected(answers: DataFrame, raw: str, truth: str, groups: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(answers with ``parsed``, metrics) after reading the answers with swapped meanings.

    Answers that cannot be read stay null and do not enter the metrics; count them in the
    first table.
    """
    fixed = answers.withColumn("parsed", inverted_label(F.col(raw)))
    return fixed, summarized(fixed, truth, groups)


def summarized(fixed: DataFrame, truth: str, groups: Sequence[str] = ()) -> DataFrame:
    """Metrics rows of corrected answers."""
    counts = M.confusion(fixed.filter("parsed is not null"), truth, "parsed", groups)
    return M.summary(counts, groups).select(
        *groups, F.lit("Zero-Shot LLM").alias("model"), F.lit("Zero-Shot").alias("fusion_method"), "accuracy",
        F.col("macro_f1").alias("f1_score"), F.lit(0.0).alias("auc"), "n",
    )
