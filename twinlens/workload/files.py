"""Sources and sinks: tables written to the shared folder and read back."""

import io
import tarfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from twinlens.operators import joins as J
from twinlens.session import scratch_path, stored
from twinlens.sources import archives as Z
from twinlens.sources import files as S
from twinlens.sources import registry as G
from twinlens.sources import sinks as K
from twinlens.workload.base import query, r, rs, table
from twinlens.workload.predictions import PRED_SQL, predictions
from twinlens.workload.relational import KEYS, METHODS, RUNS_SQL, runs
from twinlens.workload.vectors import long_sql


@query("src_csv", "SELECT doc_id, lang, n_chars, md5(text) AS text FROM documents")
def src_csv(spark, sf):
    path = K.scratch_csv(table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text"), "documents.csv")
    df = S.read_csv(spark, path, "doc_id long, lang string, n_chars long, text string")
    return df.select("doc_id", "lang", "n_chars", F.md5("text").alias("text"))


@query("src_tsv", "SELECT event_id, event_type, value, props FROM events")
def src_tsv(spark, sf):
    path = K.scratch_csv(table(spark, sf, "events").select("event_id", "event_type", "value", "props"), "events.tsv", "\t")
    return S.read_tsv(spark, path, "event_id long, event_type string, value double, props string")


@query("src_headerless", "SELECT p_name AS questions, count(*) AS n FROM part GROUP BY 1")
def src_headerless(spark, sf):
    path = scratch_path(spark, "questions")
    table(spark, sf, "part").select("p_name").write.text(path)
    return S.read_lines(spark, path, "questions").groupBy("questions").agg(F.count(F.lit(1)).alias("n"))


@query("src_alternating_lines", "SELECT 'what is part ' || p_partkey || '?' AS question, p_name || ', ' || p_type AS answer FROM part")
def src_alternating_lines(spark, sf):
    path = scratch_path(spark, "qa")
    question = F.concat(F.lit("  what is part "), F.col("p_partkey").cast("string"), F.lit("? "))
    pairs = table(spark, sf, "part").select(F.concat(question, F.lit("\n"), F.concat_ws(", ", "p_name", "p_type")).alias("value"))
    pairs.write.text(path)
    return S.read_alternating(spark, path).select("question", "answer")


@query("src_pruned_optional", "SELECT conv_id, role, turn FROM conversations")
def src_pruned_optional(spark, sf):
    return S.prune(table(spark, sf, "conversations"), ["conv_id", "role"], ["turn", "parsed"])


def run_files(spark, sf):
    """One small result file per run, named dataset_backbone_method_results.csv."""
    path = scratch_path(spark, "results")
    name = F.concat(F.concat_ws("_", *KEYS), F.lit("_results.csv")).alias("file")
    agg = runs(spark, sf).groupBy(*KEYS).agg(r(F.avg("l_discount")).alias("accuracy"), F.count(F.lit(1)).alias("n_test"))
    K.write_per_name(agg.select(name, "accuracy", "n_test"), path, "file")
    return path


RUN_SQL = f"WITH {RUNS_SQL}, m AS (SELECT dataset, backbone, method, {rs('avg(l_discount)')} AS accuracy, count(*) AS n_test FROM runs GROUP BY 1, 2, 3)"


@query("src_glob_union", f"{RUN_SQL} SELECT accuracy, n_test FROM m")
def src_glob_union(spark, sf):
    return S.read_many(spark, f"{run_files(spark, sf)}/*_results.csv", "accuracy double, n_test long").drop("file_name")


@query(
    "src_filename_metadata",
    f"{RUN_SQL} SELECT dataset, backbone, method, accuracy, dataset || '_' || backbone AS family, 'linear-' || method AS model FROM m",
)
def src_filename_metadata(spark, sf):
    df = S.read_many(spark, f"{run_files(spark, sf)}/*_results.csv", "accuracy double, n_test long")
    df = df.select(*S.run_of_file(F.col("file_name"), "_results.csv"), "accuracy")
    # the other naming scheme: dataset_family-model
    other = F.concat("dataset", F.lit("_"), "backbone", F.lit("_linear-"), "method", F.lit("_predictions.csv"))
    family, model = S.model_of_file(other, "_predictions.csv", ["_mlp-", "_linear-"])
    return df.select(*KEYS, "accuracy", family.alias("family"), model.alias("model"))


@query("src_file_manifest", f"{RUN_SQL} SELECT dataset || '_' || backbone || '_' || method || '_results.csv' AS name, true AS filled FROM m")
def src_file_manifest(spark, sf):
    return S.manifest(spark, run_files(spark, sf), "*.csv").select("name", (F.col("length") > 0).alias("filled"))


def zip_of(names, texts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in zip(names, texts):
            z.writestr(name, text)
    return out.getvalue()


def tar_of(names, texts) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, text in zip(names, texts):
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def archive_files(rows, pack, suffix):
    """(path) of archive files in the shared folder, one for each batch of rows (name, text)."""
    folder = scratch_path(rows.sparkSession, "archives")

    def run(frames):
        for f in frames:
            path = f"{folder}/{uuid.uuid4().hex}{suffix}"
            store, inner = Z.place(path)
            store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(inner) as out:
                out.write(pack(f["name"], f["text"]))
            yield pd.DataFrame({"path": [path]})

    return stored(rows.select("name", "text").mapInPandas(run, "path string"), "paths")


def member_names(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", "lang", "text", F.concat(F.lit("files/p"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name")
    )


@query("src_zip_text", "SELECT doc_id, CASE WHEN lang <> 'de' THEN md5(text) END AS text FROM documents")
def src_zip_text(spark, sf):
    docs = member_names(spark, sf)
    archives = archive_files(docs.filter("lang <> 'de'"), zip_of, ".zip")
    return Z.zip_texts(archives, docs.select("doc_id", "name"), "name").select("doc_id", F.md5("text").alias("text"))


@query("src_tar_subset", "SELECT 'files/p' || doc_id || '.txt' AS name, md5(text) AS data FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def src_tar_subset(spark, sf):
    docs = member_names(spark, sf)
    archives = archive_files(docs, tar_of, ".tar")
    wanted = table(spark, sf, "labels").join(docs.select("doc_id", "name"), "doc_id")
    return Z.tar_subset(archives, wanted, "name").select("name", F.md5("data").alias("data"))


@query(
    "src_wide_to_array",
    f"SELECT vec_id, 'image' AS side, pos, {rs('v')} AS v FROM {long_sql(1, 32)} UNION ALL SELECT vec_id, 'text', pos, {rs('v')} FROM {long_sql(33, 64)}",
)
def src_wide_to_array(spark, sf):
    names = [f"img_emb_{i}" for i in range(32)] + [f"text_emb_{i}" for i in range(32)]
    wide = table(spark, sf, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    path = K.scratch_csv(wide, "embeddings.csv")
    df = S.read_csv(spark, path, "vec_id long, " + ", ".join(f"{n} double" for n in names), multiline=False)
    df = S.gather_vectors(df, {"img_emb_": "image", "text_emb_": "text"})
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("e")) for s in ("image", "text")])
    out = df.select("vec_id", F.explode(sides).alias("s")).select("vec_id", "s.side", F.posexplode("s.e").alias("pos", "v"))
    return out.select("vec_id", "side", "pos", r(F.col("v")).alias("v"))


@query(
    "src_registry",
    """SELECT 'documents' AS dataset, CAST(doc_id AS VARCHAR) AS sample_id, source AS image_ref, md5(text) AS text, lang AS label, 'train' AS split FROM documents
       UNION ALL SELECT 'dialogues', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), md5(text), role, 'train' FROM conversations
       UNION ALL SELECT 'parts', CAST(p_partkey AS VARCHAR), p_brand, md5(p_name), p_type, CAST(p_size AS VARCHAR) FROM part""",
)
def src_registry(spark, sf):
    layouts = {
        "documents": G.Layout(f"{sf}/documents.parquet", "doc_id", "source", "text", "lang"),
        "dialogues": G.Layout(f"{sf}/conversations.parquet", "conv_id", "turn", "text", "role"),
        "parts": G.Layout(f"{sf}/part.parquet", "p_partkey", "p_brand", "p_name", "p_type", "p_size"),
        "absent": G.Layout(f"{sf}/absent.parquet", "id", "image", "text", "label"),
        "not configured": G.Layout("", "id", "image", "text", "label"),
    }
    return G.load_all(spark, layouts, spark.read.parquet).withColumn("text", F.md5("text"))


# Line-number joins


@query(
    "jn_line_number",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_name AS ingredients FROM lineitem JOIN (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS line FROM part) ON l_partkey = line""",
)
def jn_line_number(spark, sf):
    path = scratch_path(spark, "ingredients")
    table(spark, sf, "part").orderBy("p_partkey").select("p_name").write.text(path)
    lines = S.read_numbered_lines(spark, path, "ingredients")
    index = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("line"))
    return index.join(lines, "line").drop("line")


@query("jn_positional", "SELECT c_name AS name, c_mktsegment AS segment FROM customer")
def jn_positional(spark, sf):
    df, files = table(spark, sf, "customer").orderBy("c_custkey"), []
    for c, name in (("c_name", "name"), ("c_mktsegment", "segment")):
        path = scratch_path(spark, name)
        df.select(c).write.text(path)
        files.append(S.read_numbered_lines(spark, path, name))
    return J.by_line(*files).select("name", "segment")


# Sinks


@query("snk_csv_roundtrip", "SELECT page_id, url, md5(html) AS html FROM pages")
def snk_csv_roundtrip(spark, sf):
    path = K.scratch_csv(table(spark, sf, "pages"), "pages.csv")
    return S.read_csv(spark, path, "page_id long, url string, html string").select("page_id", "url", F.md5("html").alias("html"))


@query("snk_predictions", f"{PRED_SQL} SELECT sample_id, y_true, y_pred, " + ", ".join(f"{rs(f'probs[{i + 1}]')} AS prob_{i}" for i in range(10)) + " FROM pred")
def snk_predictions(spark, sf):
    wide = K.spread_predictions(predictions(spark, sf), 10)
    path = K.scratch_csv(wide, "predictions.csv")
    schema = "sample_id long, y_true int, y_pred int, " + ", ".join(f"prob_{i} double" for i in range(10))
    df = S.read_csv(spark, path, schema, multiline=False)
    return df.select("sample_id", "y_true", "y_pred", *[r(F.col(f"prob_{i}")).alias(f"prob_{i}") for i in range(10)])


@query(
    "snk_metrics_row",
    f"""{RUN_SQL} SELECT 'Zero-Shot LLM' AS model, dataset, backbone, 'Zero-Shot' AS fusion_method, accuracy, accuracy AS f1_score, CAST(0 AS DOUBLE) AS auc FROM m""",
)
def snk_metrics_row(spark, sf):
    path = scratch_path(spark, "metrics.csv")
    m = stored(runs(spark, sf).groupBy(*KEYS).agg(r(F.avg("l_discount")).alias("accuracy")), "metrics")
    for method in METHODS:  # one append per method, as runs end one by one
        row = m.filter(F.col("method") == method).select(
            "dataset", "backbone", F.lit("Zero-Shot LLM").alias("model"), F.lit("Zero-Shot").alias("fusion_method"), "accuracy",
            F.col("accuracy").alias("f1_score"), F.lit(0.0).alias("auc"),
        )
        K.append_metrics(row, path)
    return S.read_csv(spark, path, "model string, dataset string, backbone string, fusion_method string, accuracy double, f1_score double, auc double", multiline=False)


@query("snk_ignore_existing", "SELECT c_custkey, c_mktsegment FROM customer")
def snk_ignore_existing(spark, sf):
    """A second run with the same output path leaves the first output alone."""
    path = scratch_path(spark, "once.csv")
    first = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    K.write_csv(first, path, mode="ignore")
    K.write_csv(first.filter("c_custkey < 0"), path, mode="ignore")
    return S.read_csv(spark, path, "c_custkey long, c_mktsegment string", multiline=False)


@query("snk_rewrite", "SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL AND NOT (quality = 0 AND toxic = 1)")
def snk_rewrite(spark, sf):
    """Labels cleaned in place: the table at the path is read, filtered and put back."""
    path = scratch_path(spark, "labels.csv")
    read = lambda p: S.read_csv(spark, p, "doc_id long, quality int, toxic int", multiline=False)
    K.write_csv(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), path)
    clean = lambda df: df.filter("quality is not null and not (quality = 0 and toxic = 1)")
    return K.rewrite(spark, path, clean, read, K.write_csv)


@query(
    "snk_sample_bundle",
    """WITH c AS (SELECT doc_id, lang, source FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 20)
       SELECT doc_id, doc_id || '.jpg' AS image, source AS text, lang AS label FROM c WHERE doc_id IN (SELECT doc_id FROM labels) ORDER BY md5('42|' || doc_id), doc_id LIMIT 10""",
)
def snk_sample_bundle(spark, sf):
    image = F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))
    docs = table(spark, sf, "documents").select("doc_id", image.alias("image"), F.col("source").alias("text"), F.col("lang").alias("label"))
    present = table(spark, sf, "labels").select(image.alias("name"))
    path = scratch_path(spark, "bundle")
    K.write_bundle(K.sample_bundle(docs, present, "doc_id", "image", "text", "label"), path)
    return spark.read.schema("doc_id long, image string, text string, label string").json(path)
