"""Joins, aggregates, splits and samples."""

from pyspark.sql import functions as F

from twinlens.functions import columns as C
from twinlens.functions import numbers as N
from twinlens.functions import prompt_texts as P
from twinlens.operators import aggregates as A
from twinlens.operators import joins as J
from twinlens.operators import sampling as S
from twinlens.operators.ranking import exact_quantiles
from twinlens.workload.base import query, r, rs, table
from twinlens.workload.basic import epi_sql, page_files
from twinlens.workload.predictions import PAIR_SQL, predictions

# Joins


@query(
    "jn_modalities_inner",
    f"SELECT d.lang, d.n_chars, e.label, {rs('CAST(e.embedding[1] AS DOUBLE)')} AS first FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id",
)
def jn_modalities_inner(spark, sf):
    text = table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("image_id"), "lang", "n_chars")
    image = table(spark, sf, "embeddings").select(
        F.concat(F.col("vec_id").cast("string"), F.lit(".jpg")).alias("ImageName"), "label", r(F.get("embedding", F.lit(0)).cast("double")).alias("first")
    )
    return J.modalities(text, image, "image_id", "ImageName")


@query(
    "jn_labels_left_emb",
    f"SELECT d.doc_id, d.lang, e.label, {rs('CAST(e.embedding[64] AS DOUBLE)')} AS last FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id",
)
def jn_labels_left_emb(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", r(F.get("embedding", F.lit(63)).cast("double")).alias("last"))
    # the encoder's padded shards repeat rows; the join makes them unique again
    return J.attach_embeddings(docs.unionByName(docs), emb.unionByName(emb), ["doc_id"])


@query("jn_natural", "SELECT * FROM (SELECT doc_id, lang, source FROM documents) a NATURAL JOIN labels")
def jn_natural(spark, sf):
    return J.natural(table(spark, sf, "documents").select("doc_id", "lang", "source"), table(spark, sf, "labels"))


@query(
    "jn_weekly_series",
    f"""WITH e AS (SELECT {epi_sql('ts')} AS week, count(*) AS n_events FROM events GROUP BY 1),
             v AS (SELECT {epi_sql('ts')} AS week, {rs('sum(value)')} AS total FROM events WHERE event_type <> 'error' GROUP BY 1)
        SELECT week, n_events, total FROM e JOIN v USING (week)""",
)
def jn_weekly_series(spark, sf):
    ev = table(spark, sf, "events").select(N.epiweek(F.to_date("ts")).alias("week"), "value", "event_type")
    a = ev.groupBy("week").agg(F.count(F.lit(1)).alias("n_events"))
    b = ev.filter("event_type <> 'error'").groupBy("week").agg(r(F.sum("value")).alias("total"))
    return a.join(b, "week")


STATIC_SQL = """st AS (SELECT s_nationkey AS k, count(*) AS n_sup, CASE WHEN max(s_acctbal) > 9000 THEN 'big' ELSE 'small' END AS size FROM supplier WHERE s_acctbal > 0 GROUP BY 1)"""


def static(spark, sf):
    return table(spark, sf, "supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n_sup"), F.when(F.max("s_acctbal") > 9000, "big").otherwise("small").alias("size")
    )


def mode_sql(src: str, col: str) -> str:
    return f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    "jn_static_right",
    f"""WITH {STATIC_SQL}, j AS (SELECT c_custkey, n_sup, size FROM st RIGHT JOIN customer ON k = c_nationkey)
        SELECT c_custkey, coalesce(n_sup, {mode_sql('j', 'n_sup')}) AS n_sup, coalesce(size, {mode_sql('j', 'size')}) AS size FROM j""",
)
def jn_static_right(spark, sf):
    labels = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    joined = static(spark, sf).join(labels, "k", "right").select("c_custkey", "n_sup", "size")
    return A.fill_with_mode(joined, ["n_sup", "size"])


@query(
    "jn_manifest_week",
    f"""WITH l AS (SELECT {epi_sql('l_shipdate')} AS week, count(*) AS cases FROM lineitem GROUP BY 1)
        SELECT o_orderkey || '_' || {epi_sql('o_orderdate')} || '.tiff' AS file, week, cases FROM orders JOIN l ON week = {epi_sql('o_orderdate')}""",
)
def jn_manifest_week(spark, sf):
    files = table(spark, sf, "orders").select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit("_"), N.epiweek(F.to_date("o_orderdate")).cast("string"), F.lit(".tiff")).alias("file")
    )
    labels = table(spark, sf, "lineitem").groupBy(N.epiweek(F.to_date("l_shipdate")).alias("week")).agg(F.count(F.lit(1)).alias("cases"))
    files = files.withColumn("week", F.regexp_extract("file", r"_(\d+)\.", 1).cast("int"))
    return files.join(labels, "week").select("file", "week", "cases")


RUNS_SQL = f"""runs AS (SELECT l_returnflag AS dataset, l_linestatus AS backbone, CASE l_linenumber WHEN 1 THEN 'image_only' WHEN 2 THEN 'text_only' WHEN 3 THEN 'linear'
        WHEN 4 THEN 'mlp_early' WHEN 5 THEN 'mlp_late' WHEN 6 THEN 'gated_attention' WHEN 7 THEN 'mcr_late' END AS method, l_discount, l_tax, l_quantity, l_extendedprice FROM lineitem)"""

METHODS = ["image_only", "text_only", "linear", "mlp_early", "mlp_late", "gated_attention", "mcr_late", "i2moe"]


def runs(spark, sf):
    """Order lines as single outcomes of runs keyed by (dataset, backbone, method)."""
    method = F.get(F.array(*[F.lit(m) for m in METHODS]), F.col("l_linenumber") - 1)
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("backbone"), method.alias("method"),
        "l_discount", "l_tax", "l_quantity", "l_extendedprice",
    )


KEYS = ["dataset", "backbone", "method"]


@query(
    "jn_one_to_one",
    f"""WITH {RUNS_SQL}, a AS (SELECT dataset, backbone, method, {rs('avg(l_discount)')} AS d FROM runs GROUP BY 1, 2, 3),
             b AS (SELECT dataset, backbone, method, {rs('avg(l_tax)')} AS t FROM runs GROUP BY 1, 2, 3)
        SELECT * FROM a JOIN b USING (dataset, backbone, method)""",
)
def jn_one_to_one(spark, sf):
    a = runs(spark, sf).groupBy(*KEYS).agg(r(F.avg("l_discount")).alias("d"))
    b = runs(spark, sf).groupBy(*KEYS).agg(r(F.avg("l_tax")).alias("t"))
    return J.one_to_one(a, b, KEYS)


@query("jn_paired_predictions", f"{PAIR_SQL} SELECT sample_id, pa.y_true, pa.y_pred AS y_pred_a, pb.y_pred AS y_pred_b FROM pa JOIN pb USING (sample_id)")
def jn_paired_predictions(spark, sf):
    pairs = J.paired_predictions(predictions(spark, sf), predictions(spark, sf, 1, 32))
    return pairs.select("sample_id", "y_true", "y_pred_a", "y_pred_b")


@query(
    "jn_features_labels",
    f"SELECT e.vec_id, d.lang, {rs('CAST(e.embedding[2] AS DOUBLE)')} AS f FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.lang IN ('en', 'fr')",
)
def jn_features_labels(spark, sf):
    from twinlens.functions.strings import drop_image_extension

    feats = table(spark, sf, "embeddings").select(
        "vec_id", drop_image_extension(F.concat(F.col("vec_id").cast("string"), F.lit(".png"))).alias("k"), r(F.get("embedding", F.lit(1)).cast("double")).alias("f")
    )
    labels = table(spark, sf, "documents").filter(F.col("lang").isin("en", "fr")).select(F.col("doc_id").cast("string").alias("k"), "lang")
    return feats.join(labels, "k").select("vec_id", "lang", "f")


@query("jn_semi_manifest", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT page_id FROM pages)")
def jn_semi_manifest(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("name"))
    return J.keep_present(docs, page_files(spark, sf), "name").select("doc_id", "lang")


@query("jn_anti_unreferenced", "SELECT CAST(page_id AS VARCHAR) || '.jpg' AS name, CAST(length(html) AS BIGINT) AS length FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def jn_anti_unreferenced(spark, sf):
    labels = table(spark, sf, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"))
    return J.unreferenced(page_files(spark, sf), labels, "image")


@query("jn_anti_resume", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages WHERE url LIKE 'https%')")
def jn_anti_resume(spark, sf):
    done = table(spark, sf, "pages").filter(F.col("url").startswith("https")).select(F.col("page_id").alias("name"))
    return J.still_missing(table(spark, sf, "documents").select("doc_id", "source"), done, "doc_id")


@query("jn_broadcast_lookup", "SELECT c_custkey, coalesce(r_name, 'elsewhere') AS r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def jn_broadcast_lookup(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    df = J.lookup(df, table(spark, sf, "nation"), "n_nationkey", "n_regionkey").withColumnRenamed("n_regionkey", "r_regionkey")
    regions = table(spark, sf, "region").filter("r_name <> 'ASIA'")
    return J.lookup(df, regions, "r_regionkey", "r_name", F.lit("elsewhere")).select("c_custkey", "r_name")


# Aggregates


@query("agg_value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def agg_value_counts(spark, sf):
    return A.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "agg_split_distribution",
    """SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'train' ELSE 'test' END AS split, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def agg_split_distribution(spark, sf):
    split = F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"), "train").otherwise("test")
    return A.value_counts(table(spark, sf, "lineitem").select(split.alias("split"), F.col("l_returnflag").alias("label")), "split", "label")


@query("agg_distinct", "SELECT DISTINCT l_partkey FROM lineitem ORDER BY 1")
def agg_distinct(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey").distinct().orderBy("l_partkey")


@query("agg_profile", f"SELECT l_linestatus AS split, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, {rs('avg(l_quantity)')} AS mean FROM lineitem GROUP BY 1")
def agg_profile(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.min(q).alias("low"), F.max(q).alias("high"), r(F.avg(q)).alias("mean")
    )


QS = [0.025, 0.25, 0.5, 0.975]


@query(
    "agg_quantile",
    " UNION ALL ".join(f"SELECT l_returnflag, CAST({q} AS DOUBLE) AS q, {rs(f'quantile_cont(l_extendedprice, {q})')} AS value FROM lineitem GROUP BY 1" for q in QS),
)
def agg_quantile(spark, sf):
    out = exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", QS, ["l_returnflag"])
    return out.select("l_returnflag", "q", r(F.col("value")).alias("value"))


@query(
    "agg_nan_aware",
    f"""WITH t AS (SELECT event_type, CASE WHEN value > 100 THEN NULL ELSE value END AS v FROM events)
        SELECT event_type, {rs('sum(v)')} AS total, {rs('avg(v)')} AS mean, {rs('quantile_cont(v, 0.9)')} AS q90 FROM t GROUP BY 1""",
)
def agg_nan_aware(spark, sf):
    v = F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value"))
    df = table(spark, sf, "events").select("event_type", v.alias("v"))
    q = exact_quantiles(df, "v", [0.9], ["event_type"]).select("event_type", r(F.col("value")).alias("q90"))
    clean = A.number(F.col("v"))
    return df.groupBy("event_type").agg(r(F.sum(clean)).alias("total"), r(F.avg(clean)).alias("mean")).join(q, "event_type")


@query("agg_median", f"SELECT {rs('median(o_totalprice)')} AS median FROM orders")
def agg_median(spark, sf):
    return exact_quantiles(table(spark, sf, "orders"), "o_totalprice", [0.5]).select(r(F.col("value")).alias("median"))


@query(
    "agg_mode_impute",
    f"""WITH p AS (SELECT p_partkey, nullif(p_size, 7) AS size, nullif(p_type, 'ECONOMY') AS type FROM part)
        SELECT p_partkey, coalesce(size, {mode_sql('p', 'size')}) AS size, coalesce(type, {mode_sql('p', 'type')}) AS type FROM p""",
)
def agg_mode_impute(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("size"), F.nullif("p_type", F.lit("ECONOMY")).alias("type"))
    return A.fill_with_mode(df, ["size", "type"])


@query(
    "agg_row_mean",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {rs('(coalesce(nullif(l_discount, 0), 0) + coalesce(nullif(l_tax, 0), 0) + l_quantity) / (1 + CAST(l_discount <> 0 AS INTEGER) + CAST(l_tax <> 0 AS INTEGER))')} AS mean FROM lineitem""",
)
def agg_row_mean(spark, sf):
    zero = F.lit(0.0)
    cols = [F.nullif("l_discount", zero), F.nullif("l_tax", zero), F.col("l_quantity")]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(A.row_mean(*cols)).alias("mean"))


@query(
    "agg_class_weights",
    f"""SELECT label, count(*) AS n, {rs('sum(count(*)) OVER () / (count(*) OVER () * CAST(count(*) AS DOUBLE))')} AS weight FROM embeddings GROUP BY label""",
)
def agg_class_weights(spark, sf):
    return A.class_weights(table(spark, sf, "embeddings"), "label").select("label", "n", r(F.col("weight")).alias("weight"))


@query("agg_pos_weight", f"SELECT {rs('sum(1 - toxic) / CAST(sum(toxic) AS DOUBLE)')} AS pos_weight FROM labels")
def agg_pos_weight(spark, sf):
    return A.positive_weight(table(spark, sf, "labels"), "toxic").select(r(F.col("pos_weight")).alias("pos_weight"))


@query(
    "agg_multilabel_weights",
    f"""SELECT 'quality' AS label, CAST(sum(quality) AS BIGINT) AS positives, {rs('count(*) / (2.0 * sum(quality))')} AS weight FROM labels
        UNION ALL SELECT 'toxic', CAST(sum(toxic) AS BIGINT), {rs('count(*) / (2.0 * sum(toxic))')} FROM labels""",
)
def agg_multilabel_weights(spark, sf):
    return A.multilabel_weights(table(spark, sf, "labels"), ["quality", "toxic"]).select("label", "positives", r(F.col("weight")).alias("weight"))


STATUS_SQL = f"w AS (SELECT {epi_sql('o_orderdate')} AS week, o_orderstatus AS s, count(*) AS n, max(o_totalprice) AS v FROM orders GROUP BY 1, 2)"


def status_weeks(spark, sf):
    df = table(spark, sf, "orders").select(N.epiweek(F.to_date("o_orderdate")).alias("week"), F.col("o_orderstatus").alias("s"), "o_totalprice")
    return df.groupBy("week", "s").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("v"))


@query("agg_pivot", f"WITH {STATUS_SQL} SELECT week, " + ", ".join(f"max(CASE WHEN s = '{x}' THEN n END) AS {x}" for x in "FOP") + " FROM w GROUP BY 1")
def agg_pivot(spark, sf):
    return A.pivot_one(status_weeks(spark, sf), ["week"], "s", "n", ["F", "O", "P"])


@query(
    "agg_pivot_multi",
    f"WITH {STATUS_SQL} SELECT week, " + ", ".join(f"max(CASE WHEN s = '{x}' THEN {c} END) AS {c}_{x}" for x in "FOP" for c in "nv") + " FROM w GROUP BY 1",
)
def agg_pivot_multi(spark, sf):
    return A.pivot_many(status_weeks(spark, sf), ["week"], "s", ["n", "v"], ["F", "O", "P"])


@query("agg_unpivot", f"WITH {STATUS_SQL}, p AS (SELECT week, " + ", ".join(f"coalesce(max(CASE WHEN s = '{x}' THEN n END), 0) AS {x}" for x in "FOP") + " FROM w GROUP BY 1) SELECT week, city, cases FROM p UNPIVOT (cases FOR city IN (F, O, P))")
def agg_unpivot(spark, sf):
    wide = A.pivot_one(status_weeks(spark, sf), ["week"], "s", "n", ["F", "O", "P"]).fillna(0)
    return A.unpivot(wide, ["week"], ["F", "O", "P"], "city", "cases")


@query(
    "agg_dedupe_first",
    """SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
)
def agg_dedupe_first(spark, sf):
    return A.dedupe_first(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])


FLAG_COLUMNS = P.NORMALITY_COLUMNS
FLAGS_SQL = ", ".join(f"CASE WHEN p_size = {3 * i + 1} THEN 1 ELSE 0 END AS {c}" for i, c in enumerate(FLAG_COLUMNS))


@query("agg_any_flag", f"SELECT p_partkey, CASE WHEN {' + '.join(FLAG_COLUMNS)} > 0 THEN 'abnormal' ELSE 'normal' END AS normality FROM (SELECT p_partkey, {FLAGS_SQL} FROM part)")
def agg_any_flag(spark, sf):
    flags = [F.when(F.col("p_size") == 3 * i + 1, 1).otherwise(0).alias(c) for i, c in enumerate(FLAG_COLUMNS)]
    df = table(spark, sf, "part").select("p_partkey", *flags)
    return df.select("p_partkey", A.any_nonzero(FLAG_COLUMNS).alias("normality"))


# Splits and samples


def split_sql(src: str, key: str, strata: str, first: str, percent: int, second: str = "", percent2: int = 0, least: int = 2) -> str:
    part = f"PARTITION BY {strata}" if strata else ""
    rn = f"row_number() OVER ({part} ORDER BY md5('42|' || {key}), {key}) * 100"
    n = f"count(*) OVER ({part})"
    more = f"WHEN {n} >= {least} AND {rn} <= {n} * {percent + percent2} + 99 THEN '{second}'" if second else ""
    return f"CASE WHEN {n} >= {least} AND {rn} <= {n} * {percent} + 99 THEN '{first}' {more} ELSE 'train' END"


@query("smp_stratified_split", f"SELECT o_orderkey, o_orderpriority, {split_sql('orders', 'o_orderkey', 'o_orderpriority', 'test', 20)} AS split FROM orders")
def smp_stratified_split(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return S.split_by_hash(df, "o_orderkey", [("test", 20)], ["o_orderpriority"])


@query(
    "smp_stratified_subset",
    f"SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, {split_sql('documents', 'doc_id', 'lang, source', 'in', 30, least=1)} AS s FROM documents) WHERE s = 'in'",
)
def smp_stratified_subset(spark, sf):
    return S.stratified_subset(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id", 30, ["lang", "source"])


@query("smp_three_way", f"SELECT event_id, event_type, {split_sql('events', 'event_id', 'event_type', 'test', 20, 'val', 20)} AS split FROM events")
def smp_three_way(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type")
    return S.split_by_hash(df, "event_id", [("test", 20), ("val", 20)], ["event_type"])


@query(
    "smp_split_router",
    f"""WITH d AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'test' ELSE 'train' END AS split FROM documents)
        SELECT doc_id, {split_sql('d', 'doc_id', '', 'val', 10, least=1)} AS split FROM d WHERE split = 'train' UNION ALL SELECT doc_id, split FROM d WHERE split = 'test'""",
)
def smp_split_router(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "es", "test").otherwise("train").alias("split"))
    return S.route_split(df, "doc_id", 10)


@query("smp_random_split", f"SELECT vec_id, {split_sql('embeddings', 'vec_id', '', 'test', 30)} AS split FROM embeddings")
def smp_random_split(spark, sf):
    return S.split_by_hash(table(spark, sf, "embeddings").select("vec_id"), "vec_id", [("test", 30)])


@query("smp_fixed_n", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 20")
def smp_fixed_n(spark, sf):
    return S.fixed_sample(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 20)
