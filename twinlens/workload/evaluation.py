"""Metrics, bootstrap intervals and the flagship report."""

from pyspark.sql import functions as F

from twinlens.operators import bootstrap as B
from twinlens.operators import joins as J
from twinlens.operators import metrics as M
from twinlens.operators import resample as R
from twinlens.operators.aggregates import class_weights
from twinlens.operators.sets import union_all
from twinlens.session import stored
from twinlens.workload.base import query, r, rs, table
from twinlens.workload.predictions import PAIR_SQL, PRED_SQL, SPLIT_SQL, labelled, pred_sql, predictions

#: Replicates of the published study.
DRAWS = 2000

REPORT_SQL = """k AS (SELECT label, sum(tp) AS tp, sum(sup) AS sup, sum(pre) AS pre FROM (
        SELECT y_true AS label, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS tp, 1 AS sup, 0 AS pre FROM pred
        UNION ALL SELECT y_pred, 0, 0, 1 FROM pred) GROUP BY label),
    rep AS (SELECT label, CASE WHEN pre > 0 THEN tp / pre ELSE 0 END AS prec, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rec,
                   2 * tp / (sup + pre) AS f1, sup, tp, pre FROM k)"""


@query(
    "entry_centroid_report",
    f"""{PRED_SQL}, {REPORT_SQL} SELECT label, {rs('prec')} AS "precision", {rs('rec')} AS recall, {rs('f1')} AS f1, CAST(sup AS BIGINT) AS support FROM rep""",
)
def entry_centroid_report(spark, sf):
    rep = M.class_report(M.confusion(predictions(spark, sf)))
    return rep.select("label", *[r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("met_accuracy", f"{PRED_SQL} SELECT {rs('avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n FROM pred")
def met_accuracy(spark, sf):
    s = M.summary(M.confusion(predictions(spark, sf)))
    return s.select(r(F.col("accuracy")).alias("accuracy"), "n")


@query(
    "met_confusion",
    f"""{PRED_SQL}, v AS (SELECT DISTINCT y_true AS l FROM pred UNION SELECT y_pred FROM pred)
        SELECT a.l AS y_true, b.l AS y_pred, (SELECT count(*) FROM pred WHERE pred.y_true = a.l AND pred.y_pred = b.l) AS n FROM v a, v b""",
)
def met_confusion(spark, sf):
    return M.dense_confusion(M.confusion(predictions(spark, sf)))


@query("met_macro_f1", f"{PRED_SQL}, {REPORT_SQL} SELECT {rs('avg(f1)')} AS macro_f1 FROM rep")
def met_macro_f1(spark, sf):
    return M.summary(M.confusion(predictions(spark, sf))).select(r(F.col("macro_f1")).alias("macro_f1"))


@query(
    "met_weighted_prf",
    f"""{PRED_SQL}, {REPORT_SQL} SELECT {rs('sum(prec * sup) / sum(sup)')} AS weighted_precision,
        {rs('sum(rec * sup) / sum(sup)')} AS weighted_recall, {rs('sum(f1 * sup) / sum(sup)')} AS weighted_f1 FROM rep""",
)
def met_weighted_prf(spark, sf):
    s = M.summary(M.confusion(predictions(spark, sf)))
    return s.select(*[r(F.col(c)).alias(c) for c in ("weighted_precision", "weighted_recall", "weighted_f1")])


# two label columns of one table as truth and answer: a hot pair of cells on whole documents
DOC_PAIR_SQL = "pred AS (SELECT l.quality AS y_true, l.toxic AS y_pred FROM labels l)"


@query("met_micro_f1", f"WITH {DOC_PAIR_SQL}, {REPORT_SQL} SELECT {rs('2.0 * sum(tp) / (sum(sup) + sum(pre))')} AS micro_f1 FROM rep")
def met_micro_f1(spark, sf):
    df = table(spark, sf, "labels")
    return M.summary(M.confusion(df, "quality", "toxic")).select(r(F.col("micro_f1")).alias("micro_f1"))


def auroc_sql(src: str, score: str, positive: str, groups: str = "") -> str:
    part = f"PARTITION BY {groups}" if groups else ""
    by = f"PARTITION BY {groups}, {score}" if groups else f"PARTITION BY {score}"
    gsel, gby = (f"{groups}, ", f"GROUP BY {groups}") if groups else ("", "")
    return f"""SELECT {gsel} CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2.0) / (p * CAST(n AS DOUBLE)) ELSE CAST('NaN' AS DOUBLE) END AS auroc FROM (
        SELECT {gsel} sum(CASE WHEN pos = 1 THEN rk ELSE 0.0 END) AS rs, sum(pos) AS p, count(*) - sum(pos) AS n FROM (
          SELECT {gsel} {positive} AS pos, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({by}) - 1) / 2.0 AS rk FROM {src}) x {gby}) y"""


LINE_SQL = "(SELECT l_shipdate, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag, l_extendedprice AS price, l_discount AS d FROM lineitem) li"


@query(
    "met_auroc_binary",
    f"SELECT {rs('a.auroc')} AS auroc_price, {rs('b.auroc')} AS auroc_discount FROM ({auroc_sql(LINE_SQL, 'price', 'flag')}) a, ({auroc_sql(LINE_SQL, 'd', 'flag')}) b",
)
def met_auroc_binary(spark, sf):
    flag = F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("flag")
    scores = F.array(
        F.struct(F.lit("price").alias("g"), F.col("l_extendedprice").alias("s")),
        F.struct(F.lit("discount").alias("g"), F.col("l_discount").alias("s")),
    )
    rows = table(spark, sf, "lineitem").select(flag, F.explode(scores).alias("x")).select("flag", "x.g", "x.s")
    a = M.auroc(rows, "s", "flag", ["g"])
    return a.groupBy().agg(*[r(F.max(F.when(F.col("g") == g, F.col("auroc")))).alias(f"auroc_{g}") for g in ("price", "discount")])


OVR_SQL = "(SELECT sample_id, y_true, c - 1 AS label, probs[c] AS score, CASE WHEN y_true = c - 1 THEN 1 ELSE 0 END AS pos FROM pred, (SELECT unnest(range(1, 11)) AS c) cc) ovr"


@query("met_auroc_ovr", f"{PRED_SQL} SELECT {rs('avg(auroc)')} AS auroc FROM ({auroc_sql(OVR_SQL, 'score', 'pos', 'label')}) z")
def met_auroc_ovr(spark, sf):
    return M.auroc_macro(predictions(spark, sf)).select(r(F.col("auroc")).alias("auroc"))


@query(
    "met_auroc_hard",
    f"""{PRED_SQL}, {REPORT_SQL} SELECT label, {rs('(tp / sup + ((n - sup) - (pre - tp)) / (n - sup)) / 2')} AS auroc
        FROM rep, (SELECT sum(sup) AS n FROM rep) t WHERE sup > 0 AND sup < n""",
)
def met_auroc_hard(spark, sf):
    a = M.auroc_hard(M.confusion(predictions(spark, sf)))
    return a.filter("auroc is not null").select("label", r(F.col("auroc")).alias("auroc"))


@query(
    "met_roc_points",
    f"""SELECT DISTINCT {rs('price')} AS threshold, {rs('sum(1 - flag) OVER w / CAST(sum(1 - flag) OVER () AS DOUBLE)')} AS fpr,
               {rs('sum(flag) OVER w / CAST(sum(flag) OVER () AS DOUBLE)')} AS tpr FROM {LINE_SQL} WINDOW w AS (ORDER BY price DESC)""",
)
def met_roc_points(spark, sf):
    df = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("flag"), F.col("l_extendedprice").alias("price"))
    return M.roc_points(df, "price", "flag").select(*[r(F.col(c)).alias(c) for c in ("threshold", "fpr", "tpr")])


@query(
    "met_class_report",
    f"""WITH pred AS (SELECT lang AS y_true, CASE WHEN quality = 1 THEN lang ELSE 'en' END AS y_pred FROM documents LEFT JOIN labels USING (doc_id)), {REPORT_SQL}
        SELECT label, {rs('prec')} AS "precision", {rs('rec')} AS recall, {rs('f1')} AS f1, CAST(sup AS BIGINT) AS support FROM rep""",
)
def met_class_report(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    df = df.withColumn("answer", F.when(F.col("quality") == 1, F.col("lang")).otherwise("en"))
    rep = M.class_report(M.confusion(df, "lang", "answer"))
    return rep.select("label", *[r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "met_multilabel",
    f"""WITH t AS (SELECT quality AS t1, toxic AS t2, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS p1, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS p2
                   FROM labels JOIN documents USING (doc_id))
        SELECT count(*) AS n, {rs('avg(CASE WHEN t1 = p1 AND t2 = p2 THEN 1.0 ELSE 0.0 END)')} AS subset_accuracy,
               {rs('(2 * sum(t1 * p1) / sum(t1 + p1) + 2 * sum(t2 * p2) / sum(t2 + p2)) / 2')} AS macro_f1 FROM t""",
)
def met_multilabel(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    df = df.select(
        F.col("quality").alias("t1"), F.col("toxic").alias("t2"),
        F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("p1"), F.when(F.col("lang") == "en", 1).otherwise(0).alias("p2"),
    )
    m = M.multilabel_summary(df, [("t1", "p1"), ("t2", "p2")])
    return m.select("n", r(F.col("subset_accuracy")).alias("subset_accuracy"), r(F.col("macro_f1")).alias("macro_f1"))


@query(
    "met_weighted_ce",
    f"""{PRED_SQL}, w AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * CAST(count(*) AS DOUBLE)) AS w FROM sp WHERE split = 'train' GROUP BY label)
        SELECT {rs('sum(w * -ln(probs[y_true + 1])) / sum(w)')} AS weighted_ce FROM pred JOIN w ON label = y_true""",
)
def met_weighted_ce(spark, sf):
    weights = class_weights(labelled(spark, sf).filter("split = 'train'"), "label").select(F.col("label").alias("y_true"), "weight")
    df = predictions(spark, sf).join(weights, "y_true")
    return M.weighted_cross_entropy(df, "probs", "y_true", "weight").select(r(F.col("weighted_ce")).alias("weighted_ce"))


TRIPLE_SQL = f"WITH {SPLIT_SQL}, {pred_sql('pa')}, {pred_sql('pb', 1, 32)}, {pred_sql('pc', 33, 64)}"


@query(
    "met_contrastive_hinge",
    f"""{TRIPLE_SQL} SELECT sample_id, {rs('greatest(-ln(pa.probs[pa.y_true + 1]) - least(-ln(pb.probs[pa.y_true + 1]), -ln(pc.probs[pa.y_true + 1])), 0)')} AS hinge
        FROM pa JOIN pb USING (sample_id) JOIN pc USING (sample_id)""",
)
def met_contrastive_hinge(spark, sf):
    image = predictions(spark, sf, 1, 32).select("sample_id", F.col("probs").alias("image"))
    text = predictions(spark, sf, 33, 64).select("sample_id", F.col("probs").alias("text"))
    df = predictions(spark, sf).join(image, "sample_id").join(text, "sample_id")
    return df.select("sample_id", r(M.contrastive_hinge(F.col("probs"), F.col("text"), F.col("image"), F.col("y_true"))).alias("hinge"))


@query(
    "met_latency_profile",
    f"""SELECT event_type, count(*) AS n, {rs('quantile_cont(value, 0.5)')} AS p50_ms, {rs('quantile_cont(value, 0.95)')} AS p95_ms,
               {rs('count(*) / (sum(value) / 1000)')} AS samples_per_s, {rs('sum(k) / (sum(value) / 1000)')} AS tokens_per_s, {rs('avg(k)')} AS mean_tokens
        FROM (SELECT event_type, value, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events) GROUP BY 1""",
)
def met_latency_profile(spark, sf):
    df = table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).try_cast("double"))
    p = M.latency_profile(df, "value", "k", ["event_type"])
    return p.select("event_type", "n", *[r(F.col(c)).alias(c) for c in ("p50_ms", "p95_ms", "samples_per_s", "tokens_per_s", "mean_tokens")])


# Bootstrap

NUMBERED_SQL = "num AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY y_true, y_pred, md5('row|' || sample_id), sample_id) - 1 AS row_id, count(*) OVER () AS n_rows FROM pred)"
#: Levels of the draw tree that the SQL spells out: 2 ** 12 rows.
TREE = 12


def mixed_sql(x: str) -> str:
    a, b = R.FACTORS
    return f"list_transform(list_transform(list_transform([{x}], lambda v: (xor(v, v >> 16) * {a}) & {R.MASK}), lambda v: (xor(v, v >> 13) * {b}) & {R.MASK}), lambda v: xor(v, v >> 16))[1]"


def draws_sql(cells: str = "row_id", samples: int = DRAWS, seed: int = 2026) -> str:
    """CTEs that end in dr(replicate, row_id), a row for each draw: the tree of binomial splits over the rows of ``num``. Nodes inside a
    cell are left as they are, and their draws stand for the first row of the node."""
    chain = lambda start: "list_reduce([{0}, {3}, lo & {1}, lo >> 32, hi & {1}, hi >> 32]::UBIGINT[], lambda h, w: {2})".format(start, R.MASK, mixed_sql(f"((h * 31 + w) & {R.MASK})"), seed)
    out = [
        f"lim AS MATERIALIZED (SELECT list(x ORDER BY x) AS xs FROM (SELECT min(row_id) AS x FROM num GROUP BY {cells}))",
        f"t0 AS MATERIALIZED (SELECT unnest(range(0, {samples})) AS replicate, 0::BIGINT AS lo, n AS hi, n AS m FROM (SELECT max(n_rows) AS n FROM num))",
    ]
    for k in range(TREE):
        last = lambda c: mixed_sql(f"((({c} * 31)::UBIGINT + replicate::UBIGINT) & {R.MASK})")
        out += [
            f"n{k} AS MATERIALIZED (SELECT lo, hi, (hi - lo) // 2 AS a, hi - lo AS s, {chain(1)} AS c1, {chain(2)} AS c2 FROM (SELECT DISTINCT lo, hi FROM t{k}) d, lim WHERE len(list_filter(xs, lambda x: x > lo AND x < hi)) > 0)",
            f"s{k} AS MATERIALIZED (SELECT replicate, lo, hi, m, a, s, ((({last('c1')}) << 21) + (({last('c2')}) >> 11) + 0.5::DOUBLE) / 9007199254740992.0::DOUBLE AS u FROM t{k} JOIN n{k} USING (lo, hi))",
            f"""c{k} AS MATERIALIZED (SELECT m, a, s, list(cdf ORDER BY k) AS cdfs FROM (
                SELECT m, a, s, k, sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(a / s) + (m - k) * ln(1 - a / s))) OVER (PARTITION BY m, a, s ORDER BY k) AS cdf
                FROM (SELECT DISTINCT m, a, s FROM s{k}) p, LATERAL (SELECT unnest(range(0, m + 1)) AS k) z) GROUP BY ALL)""",
            f"q{k} AS MATERIALIZED (SELECT s{k}.*, least(m, len(list_filter(cdfs, lambda x: x < u))) AS l FROM s{k} JOIN c{k} USING (m, a, s))",
            f"t{k + 1} AS MATERIALIZED (SELECT replicate, lo, lo + a AS hi, l AS m FROM q{k} WHERE l > 0 UNION ALL SELECT replicate, lo + a, hi, m - l FROM q{k} WHERE m > l)",
        ]
    closed = " UNION ALL ".join(f"SELECT replicate, lo, m FROM t{k} ANTI JOIN n{k} USING (lo, hi)" for k in range(TREE))
    out.append(f"dr AS (SELECT replicate, lo AS row_id FROM ({closed}) z, LATERAL (SELECT unnest(range(0, m))) y)")
    return ",\n        ".join(out)


def f1_sql(src: str, p: str = "y_pred") -> str:
    """Accuracy and macro-F1 per replicate of a drawn table."""
    return f"""(SELECT replicate, sum(tp) / sum(sup) AS accuracy, avg(2 * tp / (sup + pre)) AS macro_f1 FROM (
        SELECT replicate, label, sum(tp) AS tp, sum(sup) AS sup, sum(pre) AS pre FROM (
          SELECT replicate, y_true AS label, CASE WHEN y_true = {p} THEN 1 ELSE 0 END AS tp, 1 AS sup, 0 AS pre FROM {src}
          UNION ALL SELECT replicate, {p}, 0, 0, 1 FROM {src}) u GROUP BY 1, 2) v GROUP BY 1)"""


@query(
    "smp_bootstrap_draws",
    f"{PRED_SQL}, {NUMBERED_SQL}, {draws_sql()} SELECT replicate, row_id, count(*) AS n FROM dr GROUP BY 1, 2",
)
def smp_bootstrap_draws(spark, sf):
    return R.bootstrap_draws(spark, predictions(spark, sf).count(), DRAWS)


DRAWN = "dn AS (SELECT dr.replicate, num.* FROM dr JOIN num USING (row_id))"


@query(
    "bst_metric_ci",
    f"""{PRED_SQL}, {NUMBERED_SQL}, {draws_sql()}, {DRAWN}, af AS {f1_sql('dn')},
        ov AS (SELECT replicate, c - 1 AS label, probs[c] AS score, CASE WHEN y_true = c - 1 THEN 1 ELSE 0 END AS pos FROM dn, (SELECT unnest(range(1, 11)) AS c) cc),
        au AS (SELECT replicate, avg(auroc) AS auroc FROM ({auroc_sql('ov', 'score', 'pos', 'replicate, label')}) z GROUP BY 1),
        ci AS (SELECT 'accuracy' AS metric, quantile_cont(accuracy, 0.025) AS lo, quantile_cont(accuracy, 0.975) AS hi FROM af
               UNION ALL SELECT 'macro_f1', quantile_cont(macro_f1, 0.025), quantile_cont(macro_f1, 0.975) FROM af
               UNION ALL SELECT 'auroc', quantile_cont(auroc, 0.025), quantile_cont(auroc, 0.975) FROM au WHERE NOT isnan(auroc)),
        one AS (SELECT 0 AS replicate, * FROM pred),
        est AS (SELECT 'accuracy' AS metric, accuracy AS e FROM {f1_sql('one')} UNION ALL SELECT 'macro_f1', macro_f1 FROM {f1_sql('one')}
                UNION ALL SELECT 'auroc', avg(auroc) FROM ({auroc_sql(OVR_SQL, 'score', 'pos', 'label')}) q)
        SELECT metric, {rs('e')} AS estimate, {rs('lo')} AS ci_low, {rs('hi')} AS ci_high, {DRAWS} AS bootstrap_samples FROM est JOIN ci USING (metric)""",
)
def bst_metric_ci(spark, sf):
    ci = B.metric_intervals(stored(predictions(spark, sf)), "sample_id", DRAWS)
    return ci.select("metric", *[r(F.col(c)).alias(c) for c in ("estimate", "ci_low", "ci_high")], "bootstrap_samples")


PAIRED = (
    f"""{PAIR_SQL}, pred AS (SELECT sample_id, pa.y_true, pa.y_pred AS y_pred_a, pb.y_pred AS y_pred_b FROM pa JOIN pb USING (sample_id)),
        num AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY y_true, y_pred_a, y_pred_b, md5('row|' || sample_id), sample_id) - 1 AS row_id, count(*) OVER () AS n_rows FROM pred),
        {draws_sql('y_true, y_pred_a, y_pred_b')}, {DRAWN}, one AS (SELECT 0 AS replicate, * FROM pred),
        df AS (SELECT a.accuracy - b.accuracy AS accuracy, a.macro_f1 - b.macro_f1 AS macro_f1 FROM {f1_sql('dn', 'y_pred_a')} a JOIN {f1_sql('dn', 'y_pred_b')} b USING (replicate)),
        pt AS (SELECT a.accuracy - b.accuracy AS accuracy, a.macro_f1 - b.macro_f1 AS macro_f1 FROM {f1_sql('one', 'y_pred_a')} a JOIN {f1_sql('one', 'y_pred_b')} b USING (replicate))
        SELECT 'accuracy' AS metric, {rs('(SELECT accuracy FROM pt)')} AS difference, {rs('quantile_cont(accuracy, 0.025)')} AS ci_low, {rs('quantile_cont(accuracy, 0.975)')} AS ci_high, {DRAWS} AS bootstrap_samples FROM df
        UNION ALL SELECT 'macro_f1', {rs('(SELECT macro_f1 FROM pt)')}, {rs('quantile_cont(macro_f1, 0.025)')}, {rs('quantile_cont(macro_f1, 0.975)')}, {DRAWS} FROM df"""
)


@query("bst_paired_difference", PAIRED)
def bst_paired_difference(spark, sf):
    pairs = stored(J.paired_predictions(predictions(spark, sf), predictions(spark, sf, 1, 32)))
    d = B.paired_differences(pairs, DRAWS)
    return d.select("metric", *[r(F.col(c)).alias(c) for c in ("difference", "ci_low", "ci_high")], "bootstrap_samples")


def _auroc_draw_sql(side: str) -> str:
    ov = f"""(SELECT replicate, c - 1 AS label, probs_{side}[c] AS score, CASE WHEN y_true = c - 1 THEN 1 ELSE 0 END AS pos FROM dn, (SELECT unnest(range(1, 11)) AS c) cc) ov"""
    return f"(SELECT replicate, avg(auroc) AS auroc FROM ({auroc_sql(ov, 'score', 'pos', 'replicate, label')}) z GROUP BY 1)"


def _auroc_point_sql(side: str) -> str:
    ov = f"""(SELECT c - 1 AS label, probs_{side}[c] AS score, CASE WHEN y_true = c - 1 THEN 1 ELSE 0 END AS pos FROM pred, (SELECT unnest(range(1, 11)) AS c) cc) ov"""
    return f"(SELECT avg(auroc) FROM ({auroc_sql(ov, 'score', 'pos', 'label')}) z)"


PAIRED_AUROC = (
    f"""{PAIR_SQL}, pred AS (SELECT sample_id, pa.y_true, pa.y_pred AS y_pred_a, pb.y_pred AS y_pred_b, pa.probs AS probs_a, pb.probs AS probs_b FROM pa JOIN pb USING (sample_id)),
        num AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY y_true, y_pred_a, y_pred_b, md5('row|' || sample_id), sample_id) - 1 AS row_id, count(*) OVER () AS n_rows FROM pred),
        {draws_sql()}, {DRAWN},
        df AS (SELECT a.auroc - b.auroc AS d FROM {_auroc_draw_sql('a')} a JOIN {_auroc_draw_sql('b')} b USING (replicate))
        SELECT 'auroc' AS metric, {rs(_auroc_point_sql('a') + ' - ' + _auroc_point_sql('b'))} AS difference, {rs('quantile_cont(d, 0.025)')} AS ci_low,
               {rs('quantile_cont(d, 0.975)')} AS ci_high, {DRAWS} AS bootstrap_samples FROM df WHERE NOT isnan(d)"""
)


@query("bst_paired_auroc", PAIRED_AUROC)
def bst_paired_auroc(spark, sf):
    pairs = stored(J.paired_predictions(predictions(spark, sf), predictions(spark, sf, 1, 32)))
    d = B.paired_auroc_difference(pairs, "sample_id", DRAWS)
    return d.select("metric", *[r(F.col(c)).alias(c) for c in ("difference", "ci_low", "ci_high")], "bootstrap_samples")


# dimensions of the vector that stand for the methods of one setting
RUNS = {"mlp_late": (1, 64), "gated_attention": (1, 32), "mcr_late": (33, 64), "mlp_early": (1, 48), "i2moe": (17, 64)}


def comparison_sql(a: str, b: str) -> str:
    """The two queries above for another pair of methods."""
    own = f"{pred_sql('pa', *RUNS[a])}, {pred_sql('pb', *RUNS[b])}"
    parts = [sql.replace(PAIR_SQL, f"WITH {SPLIT_SQL}, {own}") for sql in (PAIRED, PAIRED_AUROC)]
    return " UNION ALL ".join(f"SELECT 'shared' AS dataset, 'vectors' AS backbone, '{a} - {b}' AS comparison, * FROM ({p})" for p in parts)


@query("bst_comparisons", " UNION ALL ".join(comparison_sql(a, b) for a, b in B.COMPARISONS if a in RUNS and b in RUNS))
def bst_comparisons(spark, sf):
    tag = lambda m: [F.lit("shared").alias("dataset"), F.lit("vectors").alias("backbone"), F.lit(m).alias("method")]
    runs = [predictions(spark, sf, *dims).select(*tag(m), "*") for m, dims in RUNS.items()]
    d = B.compare_runs(stored(union_all(*runs)), DRAWS)
    return d.select("dataset", "backbone", "comparison", "metric", *[r(F.col(c)).alias(c) for c in ("difference", "ci_low", "ci_high")], "bootstrap_samples")


ANSWER_SQL = "pred AS (SELECT doc_id AS sample_id, lang AS y_true, CASE WHEN n_chars > 400 THEN lang ELSE 'en' END AS y_pred FROM documents)"


@query(
    "bst_answer_ci",
    f"""WITH {ANSWER_SQL}, {NUMBERED_SQL}, {draws_sql('y_true, y_pred')}, {DRAWN}, af AS {f1_sql('dn')}, one AS (SELECT 0 AS replicate, * FROM pred), pt AS {f1_sql('one')}
        SELECT 'accuracy' AS metric, {rs('(SELECT accuracy FROM pt)')} AS estimate, {rs('quantile_cont(accuracy, 0.025)')} AS ci_low, {rs('quantile_cont(accuracy, 0.975)')} AS ci_high,
               {DRAWS} AS bootstrap_samples, (SELECT count(*) FROM pred) AS n_test FROM af
        UNION ALL SELECT 'macro_f1', {rs('(SELECT macro_f1 FROM pt)')}, {rs('quantile_cont(macro_f1, 0.025)')}, {rs('quantile_cont(macro_f1, 0.975)')}, {DRAWS}, (SELECT count(*) FROM pred) FROM af""",
)
def bst_answer_ci(spark, sf):
    df = table(spark, sf, "documents").select(
        F.col("lang").alias("y_true"), F.when(F.col("n_chars") > 400, F.col("lang")).otherwise("en").alias("y_pred")
    )
    ci = B.answer_intervals(df, DRAWS)
    return ci.select("metric", *[r(F.col(c)).alias(c) for c in ("estimate", "ci_low", "ci_high")], "bootstrap_samples", "n_test")
