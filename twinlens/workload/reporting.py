"""Report queries over runs made of order lines and orders."""

from pyspark.sql import functions as F

from twinlens.plans import reports as R
from twinlens.session import scratch_path
from twinlens.sources import sinks as K
from twinlens.workload.base import query, r, rs, table
from twinlens.workload.language import ANSWER_SQL, answered
from twinlens.workload.relational import KEYS, RUNS_SQL, runs

MET_SQL = f"""met AS (SELECT dataset, backbone, method, avg(l_discount) AS accuracy, avg(l_tax) AS f1_score, avg(l_quantity) / 50 AS auc, count(*) AS n_test FROM runs GROUP BY 1, 2, 3),
    wide AS (SELECT dataset, backbone, method, avg(l_discount) AS e_acc, min(l_discount) AS lo_acc, max(l_discount) AS hi_acc, avg(l_tax) AS e_f1, min(l_tax) AS lo_f1, max(l_tax) AS hi_f1 FROM runs GROUP BY 1, 2, 3),
    cost AS (SELECT dataset, backbone, method, CAST(sum(l_quantity) AS BIGINT) AS trainable_parameters, max(l_extendedprice) AS flops_per_sample, min(l_extendedprice) AS latency_p50_ms, min(l_quantity) + count(*) AS peak_gpu_memory_mb FROM runs GROUP BY 1, 2, 3)"""
ALL_SQL = f"WITH {RUNS_SQL}, {MET_SQL}"
LABEL_SQL = "CASE method " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.METHOD_LABELS.items()) + " END"


def metrics(spark, sf):
    return runs(spark, sf).groupBy(*KEYS).agg(
        F.avg("l_discount").alias("accuracy"), F.avg("l_tax").alias("f1_score"), (F.avg("l_quantity") / 50).alias("auc"), F.count(F.lit(1)).alias("n_test")
    )


def boot(spark, sf):
    cols = {"accuracy": F.col("l_discount"), "macro_f1": F.col("l_tax"), "auroc": F.col("l_quantity") / 50}
    long = F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("v")) for m, c in cols.items()])
    rows = runs(spark, sf).select(*KEYS, F.explode(long).alias("s")).select(*KEYS, "s.metric", "s.v")
    return rows.groupBy(*KEYS, "metric").agg(F.avg("v").alias("estimate"), F.min("v").alias("ci_low"), F.max("v").alias("ci_high"))


def costs(spark, sf):
    return runs(spark, sf).groupBy(*KEYS).agg(
        F.sum("l_quantity").cast("long").alias("trainable_parameters"), F.max("l_extendedprice").alias("flops_per_sample"),
        F.min("l_extendedprice").alias("latency_p50_ms"), (F.min("l_quantity") + F.count(F.lit(1))).alias("peak_gpu_memory_mb"),
    )


DIRECT_SQL = """dir AS (SELECT o_orderstatus AS dataset, o_orderpriority AS backbone, avg(o_totalprice) / 1000000 AS accuracy, avg(o_totalprice) / 2000000 AS f1_score,
    count(*) AS n, min(o_totalprice) AS p50, max(o_totalprice) AS peak FROM orders GROUP BY 1, 2)"""


def direct(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("backbone")).agg(
        (F.avg(price) / 1000000).alias("accuracy"), (F.avg(price) / 2000000).alias("f1_score"), F.count(F.lit(1)).alias("n"),
        F.min(price).alias("p50"), F.max(price).alias("peak"),
    )


def results(df):
    return df.select(F.lit("Zero-Shot LLM").alias("model"), "dataset", "backbone", F.lit("Zero-Shot").alias("fusion_method"), "accuracy", "f1_score", F.lit(0.0).alias("auc"))


def profiles(df):
    return df.select(
        "dataset", F.col("backbone").alias("model"), F.col("n").alias("parameter_count"), F.col("p50").alias("latency_p50_ms"), F.col("peak").alias("peak_gpu_memory_mb"),
    )


def cell_sql(m: str) -> str:
    return f"printf('%.3f [%.3f, %.3f]', e_{m}, lo_{m}, hi_{m})"


@query(
    "rpt_performance_ci",
    f"""{ALL_SQL} SELECT dataset, backbone, {LABEL_SQL} AS method_label, {cell_sql('acc')} AS Accuracy, {cell_sql('f1')} AS "Macro-F1", n_test FROM met JOIN wide USING (dataset, backbone, method)""",
)
def rpt_performance_ci(spark, sf):
    return R.performance(metrics(spark, sf), boot(spark, sf))


@query(
    "rpt_all_models",
    f"""{ALL_SQL}, {DIRECT_SQL} SELECT dataset, '{R.FUSION_FAMILY}' AS model_family, backbone AS model, method AS evaluation, {rs('accuracy')} AS accuracy, {rs('f1_score')} AS macro_f1 FROM met
        UNION ALL SELECT dataset, '{R.ZERO_SHOT_FAMILY}', backbone, 'Zero-Shot', {rs('accuracy')}, {rs('f1_score')} FROM dir""",
)
def rpt_all_models(spark, sf):
    out = R.all_models(metrics(spark, sf), results(direct(spark, sf)))
    return out.withColumns({c: r(F.col(c)) for c in ("accuracy", "macro_f1")})


@query(
    "rpt_efficiency",
    f"""{ALL_SQL} SELECT dataset, backbone, {LABEL_SQL} AS method_label, {rs('e_f1')} AS macro_f1, trainable_parameters, flops_per_sample, latency_p50_ms, peak_gpu_memory_mb
        FROM wide JOIN cost USING (dataset, backbone, method)""",
)
def rpt_efficiency(spark, sf):
    out = R.efficiency(R.with_intervals(metrics(spark, sf), boot(spark, sf)), costs(spark, sf))
    return out.withColumn("macro_f1", r(F.col("macro_f1")))


@query(
    "rpt_combined_cost",
    f"""{ALL_SQL}, {DIRECT_SQL} SELECT '{R.FAMILY_ORDER[0]}' AS model_family, dataset, backbone AS model, 'Zero-shot' AS method, {rs('accuracy')} AS accuracy, {rs('f1_score')} AS macro_f1,
        n AS trainable_parameters, CAST(NULL AS DOUBLE) AS flops_per_sample, p50 AS latency_p50_ms, peak AS peak_gpu_memory_mb FROM dir
        UNION ALL SELECT '{R.FAMILY_ORDER[1]}', dataset, backbone, {LABEL_SQL}, {rs('e_acc')}, {rs('e_f1')}, trainable_parameters, flops_per_sample, latency_p50_ms, peak_gpu_memory_mb
        FROM wide JOIN cost USING (dataset, backbone, method)""",
)
def rpt_combined_cost(spark, sf):
    d = direct(spark, sf)
    prof = R.zero_shot_profile(profiles(d), results(d))
    out = R.combined_cost(R.with_intervals(metrics(spark, sf), boot(spark, sf)), costs(spark, sf), prof)
    return out.withColumns({c: r(F.col(c)) for c in ("accuracy", "macro_f1")})


@query(
    "rpt_zero_shot_profile",
    f"""WITH {DIRECT_SQL} SELECT dataset, backbone AS model, n AS parameter_count, p50 AS latency_p50_ms, peak AS peak_gpu_memory_mb, {rs('accuracy')} AS accuracy, {rs('f1_score')} AS macro_f1 FROM dir""",
)
def rpt_zero_shot_profile(spark, sf):
    d = direct(spark, sf)
    out = R.zero_shot_profile(profiles(d), results(d))
    return out.withColumns({c: r(F.col(c)) for c in ("accuracy", "macro_f1")})


MODELS = ["Torch_Early_Fusion_H0", "Torch_Early_Fusion_H[128]", "Torch_Late_Fusion_H[128]"]
COLUMNS = [f"{b} - {n}" for b in ("F", "O") for n in R.ARCHITECTURES.values()]
MODEL_SQL = f"mod AS (SELECT dataset, backbone, {list(R.ARCHITECTURES.values())}[CASE WHEN method = 'linear' THEN 1 WHEN method = 'mlp_early' THEN 2 ELSE 3 END] AS name, accuracy, f1_score, auc FROM met WHERE method IN ('linear', 'mlp_early', 'mlp_late'))"


@query(
    "rpt_summary_pivot",
    f"{ALL_SQL}, {MODEL_SQL} SELECT dataset, "
    + ", ".join(f"""{rs(f"max(CASE WHEN backbone || ' - ' || name = '{c}' THEN {v} END)")} AS "{v}_{c}" """ for c in COLUMNS for v in ("accuracy", "f1_score", "auc"))
    + " FROM mod GROUP BY 1",
)
def rpt_summary_pivot(spark, sf):
    m = metrics(spark, sf).filter(F.col("method").isin("linear", "mlp_early", "mlp_late"))
    model = F.when(F.col("method") == "linear", MODELS[0]).when(F.col("method") == "mlp_early", MODELS[1]).otherwise(MODELS[2])
    df = m.select(model.alias("model"), "dataset", F.lower("backbone").alias("backbone"), "accuracy", "f1_score", "auc")
    wide = R.summary_pivot(df, COLUMNS)
    return wide.select("dataset", *[r(F.col(f"`{c}`")).alias(c) for c in wide.columns[1:]])


POINTS_SQL = """pts AS (SELECT l_returnflag AS dataset, l_suppkey AS supplier, sum(l_quantity) AS cost, round(avg(l_discount), 6) AS quality FROM lineitem GROUP BY 1, 2)"""


@query(
    "rpt_pareto_frontier",
    f"""WITH {POINTS_SQL} SELECT dataset, supplier, cost, quality, NOT EXISTS (SELECT 1 FROM pts q WHERE q.dataset = p.dataset AND q.cost <= p.cost AND q.quality >= p.quality
        AND (q.cost < p.cost OR q.quality > p.quality)) AS on_frontier FROM pts p""",
)
def rpt_pareto_frontier(spark, sf):
    pts = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("supplier")).agg(
        F.sum("l_quantity").alias("cost"), F.round(F.avg("l_discount"), 6).alias("quality")
    )
    return R.frontier(pts, ["dataset"], "cost", "quality")


@query(
    "rpt_cost_points",
    f"""{ALL_SQL}, j AS (SELECT * FROM wide JOIN cost USING (dataset, backbone, method)),
        pts AS (SELECT dataset, backbone, method, 'latency_p50_ms' AS axis, latency_p50_ms AS cost, round(e_f1, 6) AS quality FROM j UNION ALL SELECT dataset, backbone, method, 'flops_per_sample', flops_per_sample, round(e_acc, 6) FROM j
                UNION ALL SELECT dataset, backbone, method, 'trainable_parameters', CAST(trainable_parameters AS DOUBLE), round(e_f1, 6) FROM j UNION ALL SELECT dataset, backbone, method, 'peak_gpu_memory_mb', peak_gpu_memory_mb, round(e_f1, 6) FROM j)
        SELECT *, NOT EXISTS (SELECT 1 FROM pts q WHERE q.dataset = p.dataset AND q.backbone = p.backbone AND q.axis = p.axis AND q.cost <= p.cost AND q.quality >= p.quality AND (q.cost < p.cost OR q.quality > p.quality)) AS on_frontier FROM pts p""",
)
def rpt_cost_points(spark, sf):
    rounded = {c: F.round(c, 6) for c in ("estimate_macro_f1", "estimate_accuracy")}
    return R.cost_points(R.with_intervals(metrics(spark, sf), boot(spark, sf)).withColumns(rounded), costs(spark, sf))


@query(
    "rpt_corrected_metrics",
    f"""WITH {ANSWER_SQL}, a AS (SELECT p_type AS dataset, p_partkey % 2 AS truth, CASE WHEN regexp_matches(word, '^0\\b') THEN 1 WHEN regexp_matches(word, '^1\\b') THEN 0
            WHEN regexp_matches(lower(word), '\\breal\\b') THEN 1 WHEN regexp_matches(lower(word), '\\bfake\\b') THEN 0 END AS parsed FROM ans),
        k AS (SELECT dataset, label, sum(tp) AS tp, sum(s) AS s FROM (SELECT dataset, truth AS label, CASE WHEN truth = parsed THEN 1 ELSE 0 END AS tp, 1 AS s FROM a WHERE parsed IS NOT NULL
            UNION ALL SELECT dataset, parsed, 0, 1 FROM a WHERE parsed IS NOT NULL) GROUP BY 1, 2)
        SELECT dataset, 'Zero-Shot LLM' AS model, 'Zero-Shot' AS fusion_method, {rs('sum(tp) / (sum(s) / 2)')} AS accuracy, {rs('avg(2 * tp / s)')} AS f1_score, CAST(0 AS DOUBLE) AS auc, CAST(sum(s) / 2 AS BIGINT) AS n FROM k GROUP BY 1""",
)
def rpt_corrected_metrics(spark, sf):
    """The saved answers are read again, and both saved tables, answers and metrics, are rewritten in place."""
    df = answered(spark, sf).select(F.col("p_type").alias("dataset"), "word", (F.col("p_partkey") % 2).cast("int").alias("truth"))
    answers, metrics = scratch_path(spark, "answers"), scratch_path(spark, "metrics")
    _, m = R.corrected(df.withColumn("word", F.lit("0")), "word", "truth", ["dataset"])
    df.withColumn("parsed", F.lit(None).cast("int")).write.parquet(answers)
    m.write.parquet(metrics)
    read, write = spark.read.parquet, lambda frame, path: frame.write.parquet(path)
    fixed = K.rewrite(spark, answers, lambda a: R.corrected(a.drop("parsed"), "word", "truth", ["dataset"])[0], read, write)
    m = K.rewrite(spark, metrics, lambda _: R.summarized(fixed, "truth", ["dataset"]), read, write)
    return m.withColumns({c: r(F.col(c)) for c in ("accuracy", "f1_score")})
