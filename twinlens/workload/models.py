"""Encoders, generators, fusion heads and classic models."""

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from twinlens.functions import prompt_texts as P
from twinlens.functions import vectors as V
from twinlens.functions.text import wrap
from twinlens.plans import classic as K
from twinlens.plans import encode as E
from twinlens.plans import generate as G
from twinlens.plans import heads as H
from twinlens.plans import train as TR
from twinlens.operators.sampling import split_by_hash
from twinlens.session import collect_few, scratch_path, stored
from twinlens.sources import sinks
from twinlens.workload.base import query, r, rs, table
from twinlens.workload.evaluation import auroc_sql
from twinlens.workload.predictions import SPLIT_SQL, labelled

DIMS = 16


TEXT_SQL = f"""(SELECT doc_id, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % {DIMS} AS pos, CAST(count(*) AS DOUBLE) AS n
    FROM (SELECT doc_id, unnest(string_split(lower({{text}}), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2)"""
BYTES_SQL = "(SELECT page_id, regexp_extract_all(hex(encode(html)), '(.)(.)', 1) AS h FROM pages)"
IMAGE_SQL = f"(SELECT page_id, CAST('0x' || d AS INTEGER) AS pos, CAST(count(*) AS DOUBLE) AS n FROM (SELECT page_id, unnest(h) AS d FROM {BYTES_SQL}) GROUP BY 1, 2)"


def unit_sql(src: str, key: str) -> str:
    return f"SELECT {key}, CAST(pos AS INTEGER) AS pos, {rs(f'n / sqrt(sum(n * n) OVER (PARTITION BY {key}))')} AS v FROM {src}"


def long(df, key, col):
    return df.select(key, F.posexplode(col).alias("pos", "v")).filter("v <> 0").select(key, "pos", r(F.col("v")).alias("v"))


@query(
    "emb_dual_encode",
    f"""SELECT doc_id, 'text' AS side, pos, v FROM ({unit_sql(TEXT_SQL.format(text='text'), 'doc_id')})
        UNION ALL SELECT page_id, 'image', pos, v FROM ({unit_sql(IMAGE_SQL, 'page_id')}) WHERE page_id IN (SELECT doc_id FROM documents)""",
)
def emb_dual_encode(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.encode("html", "UTF-8").alias("image"))
    rows = table(spark, sf, "documents").select("doc_id", "text").join(pages, "doc_id", "left")
    e = rows.select("doc_id", E.unit(E.hashed_words(F.col("text"), DIMS)).alias("text_emb"), E.unit(E.nibble_counts(F.col("image"))).alias("image_emb"))
    side = lambda n, c: F.struct(F.lit(n).alias("side"), F.col(c).alias("e"))
    both = e.select("doc_id", F.explode(F.array(side("text", "text_emb"), side("image", "image_emb"))).alias("s"))
    out = both.select("doc_id", "s.side", F.posexplode("s.e").alias("pos", "v")).filter("v <> 0")
    return out.select("doc_id", "side", "pos", r(F.col("v")).alias("v"))


WRAPPED = f"'{P.QUESTION_WRAPPER[0]}' || text || '{P.QUESTION_WRAPPER[1]}'"


@query(
    "emb_fused_encode",
    f"""WITH a AS {TEXT_SQL.format(text=WRAPPED)}, b AS (SELECT page_id AS doc_id, pos, n FROM {IMAGE_SQL} WHERE page_id IN (SELECT doc_id FROM documents))
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, {rs('sum(n) / CASE WHEN doc_id IN (SELECT page_id FROM pages) THEN 2 ELSE 1 END')} AS v
        FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""",
)
def emb_fused_encode(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.encode("html", "UTF-8").alias("image"))
    rows = table(spark, sf, "documents").select("doc_id", "text").join(pages, "doc_id", "left")
    text, image = E.hashed_words(wrap(F.col("text"), P.QUESTION_WRAPPER), DIMS), E.nibble_counts(F.col("image"))
    return long(rows.select("doc_id", E.fused(text, image).alias("embedding")), "doc_id", "embedding")


@query("emb_image_only", f"SELECT page_id, pos, v FROM ({unit_sql(IMAGE_SQL, 'page_id')})")
def emb_image_only(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("image"))
    return long(pages.select("page_id", E.unit(E.nibble_counts(F.col("image"))).alias("image_emb")), "page_id", "image_emb")


@query(
    "gen_token_probs",
    f"""WITH s AS (SELECT user_id, event_type, avg(value) / 50 AS x FROM events GROUP BY 1, 2), p AS (SELECT user_id, event_type, exp(x) / sum(exp(x)) OVER (PARTITION BY user_id) AS p FROM s)
        SELECT user_id, {rs("max(CASE WHEN event_type = 'click' THEN p END)")} AS click, {rs("max(CASE WHEN event_type = 'view' THEN p END)")} AS "view", CAST(NULL AS DOUBLE) AS absent FROM p GROUP BY 1""",
)
def gen_token_probs(spark, sf):
    mean = table(spark, sf, "events").groupBy("user_id", "event_type").agg((F.avg("value") / 50).alias("x"))
    # one token is stored with a leading blank, as tokenizers do
    token = F.when(F.col("event_type") == "view", " view").otherwise(F.col("event_type"))
    scores = mean.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(token.alias("t"), "x"))).alias("m"))
    probs = [r(G.token_probability(F.col("m"), t)).alias(t) for t in ("click", "view", "absent")]
    return scores.select("user_id", *probs)


# Fusion heads: first half of the vector as image, second half as text


def experiment(spark, sf, sample=None):
    df = labelled(spark, sf).select(
        "vec_id", "label", "split", F.slice("embedding", 1, 32).alias("image"), F.slice("embedding", 33, 32).alias("text")
    )
    return TR.Experiment(df, "vec_id", "label", "text", "image", sample)


LR = 3e-3


def first_step_sql(low: int, high: int) -> str:
    """One full-batch step from zero parameters, then the scores of the test rows.

    At zero all classes have probability 1/C, so the gradient is a weighted sum of inputs;
    the first Adam step moves every parameter by lr * g / (|g| + eps).
    """
    return f"""(WITH {SPLIT_SQL}, va AS (SELECT *, CASE WHEN split = 'train' AND row_number() OVER (PARTITION BY split ORDER BY md5('42|' || vec_id), vec_id) * 100
          <= count(*) OVER (PARTITION BY split) * 10 + 99 THEN 'val' ELSE split END AS part FROM sp),
        lo AS (SELECT vec_id, label, part, u.i AS pos, CASE WHEN u.i = 0 THEN 1.0 ELSE CAST(embedding[u.i] AS DOUBLE) END AS x
               FROM va, (SELECT unnest([0] || range({low}, {high + 1})) AS i) u),
        w AS (SELECT label AS c, sum(count(*)) OVER () / (count(*) OVER () * CAST(count(*) AS DOUBLE)) AS w, count(*) OVER () AS k FROM va WHERE part = 'train' GROUP BY 1),
        sw AS (SELECT sum(w) AS sw FROM va JOIN w ON c = label WHERE part = 'train'),
        g AS (SELECT cls.c, lo.pos, sum(own.w * (1.0 / own.k - CASE WHEN cls.c = lo.label THEN 1 ELSE 0 END) * lo.x) / (SELECT sw FROM sw) AS g
              FROM lo JOIN w own ON own.c = lo.label, w cls WHERE lo.part = 'train' GROUP BY 1, 2),
        z AS (SELECT vec_id, label, g.c, sum(x * -{LR} * g / (abs(g) + 1e-8)) AS z FROM lo JOIN g USING (pos) WHERE part = 'test' GROUP BY 1, 2, 3),
        p AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM z)
        SELECT CAST(vec_id AS BIGINT) AS sample_id, label AS y_true, CAST(first(c ORDER BY p DESC, c) AS INTEGER) AS y_pred, {rs('max(p)', 8)} AS top FROM p GROUP BY 1, 2)"""


def first_step(spark, sf, method):
    e = experiment(spark, sf)
    spec = H.Spec(method, 32, 32, 10)
    zero = {k: np.zeros(v) for k, v in spec.shapes().items()}
    _, predictions = e.run(TR.Options(method, epochs=1, lr=LR, batch_size=1 << 30), start=(zero, {}))
    return predictions.select("sample_id", "y_true", "y_pred", r(F.array_max("probs"), 8).alias("top"))


@query("fus_unimodal", f"SELECT *, 'image_only' AS method FROM {first_step_sql(1, 32)} UNION ALL SELECT *, 'text_only' FROM {first_step_sql(33, 64)}")
def fus_unimodal(spark, sf):
    parts = [first_step(spark, sf, m).withColumn("method", F.lit(m)) for m in ("image_only", "text_only")]
    return parts[0].unionByName(parts[1])


@query("fus_linear", f"SELECT * FROM {first_step_sql(1, 64)}")
def fus_linear(spark, sf):
    return first_step(spark, sf, "linear")


SINGLE_SQL = f"""{SPLIT_SQL}, va AS (SELECT vec_id, label, embedding, CASE WHEN split = 'train' AND row_number() OVER (PARTITION BY split ORDER BY md5('42|' || vec_id), vec_id) * 100
        <= count(*) OVER (PARTITION BY split) * 10 + 99 THEN 'val' ELSE split END AS part FROM sp),
    lo AS MATERIALIZED (SELECT vec_id, part, u.i AS pos, CASE WHEN u.i = 0 THEN 1.0 ELSE CAST(embedding[u.i] AS DOUBLE) END AS x FROM va, (SELECT unnest(range(0, 65)) AS i) u),
    w AS (SELECT label AS c, sum(count(*)) OVER () / (count(*) OVER () * CAST(count(*) AS DOUBLE)) AS w FROM va WHERE part = 'train' GROUP BY 1),
    t AS MATERIALIZED (SELECT vec_id, part, cls.c, CASE WHEN cls.c = label THEN 1.0 ELSE 0.0 END AS y, own.w AS lw, own.w / sum(own.w) OVER (PARTITION BY part, cls.c) AS wt FROM va JOIN w own ON own.c = label, w cls)"""

BOTH_SQL = """d AS (SELECT e.vec_id, e.embedding, l.quality, l.toxic FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id),
    n AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) * 100 AS rn, count(*) OVER () AS n FROM d),
    va AS (SELECT vec_id, embedding, quality, toxic, CASE WHEN rn <= n * 20 + 99 THEN 'test' WHEN rn <= n * 30 + 99 THEN 'val' ELSE 'train' END AS part FROM n),
    lo AS MATERIALIZED (SELECT vec_id, part, u.i AS pos, CASE WHEN u.i = 0 THEN 1.0 ELSE CAST(embedding[u.i] AS DOUBLE) END AS x FROM va, (SELECT unnest(range(0, 65)) AS i) u),
    y AS (SELECT vec_id, part, 0 AS c, CAST(quality AS DOUBLE) AS y FROM va UNION ALL SELECT vec_id, part, 1, toxic FROM va),
    w AS (SELECT c, count(*) / (2 * sum(y)) AS w FROM y WHERE part = 'train' GROUP BY 1),
    t AS MATERIALIZED (SELECT vec_id, part, y.c, y, w AS lw, w / (count(*) OVER (PARTITION BY part)) AS wt FROM y JOIN w ON w.c = y.c)"""


def epochs_sql(epochs: int, lr: float, multi: bool) -> str:
    """CTEs that train a linear head from zero on lo (inputs) and t (targets): full-batch
    gradients, Adam, and after each epoch the loss and macro-F1 of the validation part."""
    p = "1 / (1 + exp(-z))" if multi else "exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id)"
    loss = "sum(wt * -(y * ln(p) + (1 - y) * ln(1 - p)))" if multi else "sum(CASE WHEN y = 1 THEN wt * -ln(p) ELSE 0 END)"
    hit = "CAST(p > 0.5 AS INTEGER)" if multi else "CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) = 1 AS INTEGER)"
    out = ["th0 AS (SELECT DISTINCT c, pos, 0.0 AS th, 0.0 AS m, 0.0 AS v FROM t, (SELECT DISTINCT pos FROM lo) q)"]
    for e in range(1, epochs + 1):
        for part, k in (("train", e - 1), ("val", e)):
            if part == "val":
                out.append(f"g{e} AS MATERIALIZED (SELECT c, pos, sum(wt * (p - y) * x) AS g FROM p_train{e} JOIN lo USING (vec_id) GROUP BY 1, 2)")
                m, v = "0.9 * m + 0.1 * g", "0.999 * v + 0.001 * g * g"
                out.append(f"th{e} AS MATERIALIZED (SELECT c, pos, th - {lr} * (({m}) / (1 - 0.9 ** {e})) / (sqrt(({v}) / (1 - 0.999 ** {e})) + 1e-8) AS th, {m} AS m, {v} AS v FROM th{e - 1} JOIN g{e} USING (c, pos))")
            z = f"SELECT lo.vec_id, c, sum(x * th) AS z FROM lo JOIN th{k} USING (pos) WHERE part = '{part}' GROUP BY 1, 2"
            out.append(f"p_{part}{e} AS MATERIALIZED (SELECT vec_id, c, y, wt, {p} AS p FROM ({z}) JOIN t USING (vec_id, c))")
        out.append(f"""log{e} AS MATERIALIZED (SELECT {e} AS epoch, (SELECT {loss} FROM p_train{e}) {'/ 2' if multi else ''} AS train_loss, (SELECT {loss} FROM p_val{e}) {'/ 2' if multi else ''} AS val_loss,
            (SELECT avg(2 * tp / s) FROM (SELECT c, sum(h * y) AS tp, sum(h + y) AS s FROM (SELECT c, y, {hit} AS h FROM p_val{e}) GROUP BY 1) WHERE s > 0) AS f1)""")
    out.append("log AS (" + " UNION ALL ".join(f"SELECT * FROM log{e}" for e in range(1, epochs + 1)) + ")")
    order = "val_loss" if multi else "f1 DESC"
    out.append(f"best AS (SELECT epoch FROM log ORDER BY {order}, epoch LIMIT 1)")
    out.append("th AS (" + " UNION ALL ".join(f"SELECT c, pos, th FROM th{e} WHERE {e} = (SELECT epoch FROM best)" for e in range(1, epochs + 1)) + ")")
    out.append(f"scored AS MATERIALIZED (SELECT vec_id, c, {p} AS p FROM (SELECT lo.vec_id, c, sum(x * th) AS z FROM lo JOIN th USING (pos) WHERE part = 'test' GROUP BY 1, 2))")
    return ", ".join(out)


EPOCHS = 4
SINGLE_RUN = f"WITH {SINGLE_SQL}, {epochs_sql(EPOCHS, 0.05, False)}"
BOTH_RUN = f"WITH {BOTH_SQL}, {epochs_sql(EPOCHS, 0.05, True)}"


def zero_start(method, outputs, loss="ce"):
    spec = H.Spec(method, 32, 32, outputs, loss=loss)
    return {k: np.zeros(v) for k, v in spec.shapes().items()}, {}


def trained_linear(spark, sf):
    e = experiment(spark, sf)
    model, predictions = e.run(TR.Options("linear", epochs=EPOCHS, lr=0.05, batch_size=1 << 30), start=zero_start("linear", 10))
    return e, model, predictions


@query(
    "fus_train",
    f"{SINGLE_RUN} SELECT CAST(epoch AS INTEGER) AS epoch, {rs('train_loss')} AS train_loss, {rs('val_loss')} AS val_loss, {rs('f1')} AS val_macro_f1, epoch = (SELECT epoch FROM best) AS kept FROM log",
)
def fus_train(spark, sf):
    """The training log of the linear head: one row per epoch, the kept one marked."""
    _, model, _ = trained_linear(spark, sf)
    rows = [(h["epoch"], h["train_loss"], h["loss"], h["macro_f1"], h["epoch"] == model.epochs_run) for h in model.history]
    log = spark.createDataFrame(rows, "epoch int, train_loss double, val_loss double, val_macro_f1 double, kept boolean")
    return log.withColumns({c: r(F.col(c)) for c in ("train_loss", "val_loss", "val_macro_f1")})


@query(
    "fus_score",
    f"""WITH m AS (SELECT label AS c, u.i AS pos, avg(CAST(embedding[u.i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u GROUP BY 1, 2),
        z AS (SELECT vec_id, c, sum(CAST(embedding[pos] AS DOUBLE) * m) AS z FROM embeddings, m GROUP BY 1, 2),
        p AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM z)
        SELECT vec_id AS sample_id, CAST(first(c ORDER BY p DESC, c) AS INTEGER) AS y_pred, {rs('max(p)')} AS top FROM p GROUP BY 1""",
)
def fus_score(spark, sf):
    """A linear head whose weights are the class means: saved, restored, and run on the whole table."""
    rows = table(spark, sf, "embeddings")
    means = rows.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector(V.as_double(F.col("embedding"))))).alias("m"))
    found = collect_few(means.orderBy("label"))
    image_first = np.array([x["m"] for x in found])
    weight = np.hstack([image_first[:, 32:], image_first[:, :32]])
    spec = H.Spec("linear", 32, 32, len(found))
    model = TR.Model(spec, [str(x["label"]) for x in found], {"classifier.weight": weight, "classifier.bias": np.zeros(len(found))}, {})
    path = scratch_path(spark, "params")
    sinks.write_params(model.table(spark), path)
    restored = TR.Model.from_table(sinks.read_params(spark, path), spec, model.labels)
    scored = restored.score(rows.select(F.col("vec_id").alias("sample_id"), F.slice("embedding", 33, 32).alias("text_emb"), F.slice("embedding", 1, 32).alias("image_emb")))
    return scored.select("sample_id", V.argmax(F.col("probs")).alias("y_pred"), r(F.array_max("probs")).alias("top"))


FRAMEWORK_SQL = """pred AS (SELECT va.vec_id, label AS y_true, c AS y_pred FROM va JOIN (SELECT vec_id, first(c ORDER BY p DESC, c) AS c FROM scored GROUP BY 1) USING (vec_id)),
    k AS (SELECT label, sum(tp) AS tp, sum(s) AS s FROM (SELECT y_true AS label, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS tp, 1 AS s FROM pred UNION ALL SELECT y_pred, 0, 1 FROM pred) GROUP BY 1),
    ovr AS (SELECT c AS label, round(p, 12) AS score, CASE WHEN c = va.label THEN 1 ELSE 0 END AS pos FROM scored JOIN va USING (vec_id))"""


@query(
    "fus_framework",
    f"""{SINGLE_RUN}, {FRAMEWORK_SQL} SELECT 'linear' AS model, 'vectors' AS dataset, 'shared' AS backbone, 'linear' AS method, 42 AS seed,
        CAST((SELECT epoch FROM best) AS INTEGER) AS epochs_run, (SELECT count(*) FROM va WHERE part = 'train') AS n_train, (SELECT count(*) FROM va WHERE part = 'val') AS n_val,
        (SELECT CAST(count(DISTINCT label) AS INTEGER) FROM va WHERE part = 'train') AS n_classes, {rs('(SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FROM pred)')} AS accuracy, {rs('(SELECT avg(2 * tp / s) FROM k)')} AS f1_score,
        {rs(f"(SELECT avg(auroc) FROM ({auroc_sql('ovr', 'score', 'pos', 'label')}) q)")} AS auc, (SELECT count(*) FROM pred) AS n_test""",
)
def fus_framework(spark, sf):
    """Load, drop missing, split, train, score, evaluate."""
    e, model, predictions = trained_linear(spark, sf)
    rounded = predictions.withColumn("probs", F.transform("probs", lambda p: F.round(p, 12)))
    m = e.run_row(model, rounded, "linear", "vectors", "shared")
    return m.withColumns({c: r(F.col(c)) for c in ("accuracy", "f1_score", "auc")})


@query(
    "fus_multilabel",
    f"""{BOTH_RUN} SELECT vec_id AS sample_id, max(CASE WHEN c = 0 THEN CAST(p > 0.5 AS INTEGER) END) AS quality, max(CASE WHEN c = 1 THEN CAST(p > 0.5 AS INTEGER) END) AS toxic,
        {rs('sum(p)')} AS total FROM scored GROUP BY 1""",
)
def fus_multilabel(spark, sf):
    """quality and toxic of the labelled vectors, thresholded at 0.5; the lowest loss is kept."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), F.array("quality", "toxic").cast("array<double>").alias("y"))
    rows = table(spark, sf, "embeddings").join(labels, "vec_id").select(
        F.col("vec_id").alias("sample_id"), "y", F.slice("embedding", 33, 32).alias("text_emb"), F.slice("embedding", 1, 32).alias("image_emb")
    )
    rows = stored(split_by_hash(rows, "sample_id", [("test", 20), ("val", 10)]))
    part = {s: rows.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")}
    options = TR.Options("linear", epochs=EPOCHS, lr=0.05, batch_size=1 << 30, loss="bce")
    model = TR.fit(part["train"], part["val"], ["quality", "toxic"], options, start=zero_start("linear", 2, "bce"))
    hot = V.threshold(F.col("probs"))
    total = r(F.get("probs", F.lit(0)) + F.get("probs", F.lit(1)))
    return model.score(part["test"]).select("sample_id", F.get(hot, F.lit(0)).alias("quality"), F.get(hot, F.lit(1)).alias("toxic"), total.alias("total"))


@query(
    "ml_knn",
    f"""WITH {SPLIT_SQL}, n AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])), 9), t.vec_id) AS rk
             FROM sp q JOIN sp t ON q.split = 'test' AND t.split = 'train'),
             c AS (SELECT vec_id, label, count(*) AS k FROM n WHERE rk <= 5 GROUP BY 1, 2)
        SELECT vec_id, first(label ORDER BY k DESC, label) AS vote FROM c GROUP BY 1""",
)
def ml_knn(spark, sf):
    rows = labelled(spark, sf)
    return K.knn(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "vec_id", "embedding", "label", pivots=16)


#: Squarings that leave one axis of the covariance: its 2 ** 20th power.
SQUARINGS = 20


def axis_sql(name: str, source: str) -> str:
    """CTEs that end in ``name``(i, j, v), the projection on the largest axis of ``source``(i, j, v)."""
    scaled = lambda src: f"SELECT i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v FROM ({src})"
    out = [f"{name}_0 AS MATERIALIZED ({scaled(f'SELECT i, j, v FROM {source}')})"]
    for k in range(1, SQUARINGS + 1):
        product = f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}_{k - 1} a JOIN {name}_{k - 1} b ON a.j = b.i GROUP BY 1, 2"
        out.append(f"{name}_{k} AS MATERIALIZED ({scaled(product)})")
    out.append(f"{name} AS (SELECT * FROM {name}_{SQUARINGS})")
    return ", ".join(out)


@query(
    "ml_pca",
    f"""WITH {SPLIT_SQL}, lo AS (SELECT vec_id, split, u.i AS pos, CAST(embedding[u.i] AS DOUBLE) AS v FROM sp, (SELECT unnest(range(1, 65)) AS i) u),
        mu AS (SELECT pos, avg(v) AS m FROM lo WHERE split = 'train' GROUP BY 1),
        x AS MATERIALIZED (SELECT vec_id, split, pos, v - m AS v FROM lo JOIN mu USING (pos)),
        cov AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, sum(a.v * b.v) AS v FROM x a JOIN x b USING (vec_id) WHERE a.split = 'train' GROUP BY 1, 2),
        {axis_sql('one', 'cov')}, rest AS MATERIALIZED (SELECT cov.i, cov.j, cov.v - one.v * (SELECT sum(c.v * o.v) FROM cov c JOIN one o USING (i, j)) AS v FROM cov JOIN one USING (i, j)),
        {axis_sql('two', 'rest')}, both_ AS (SELECT 1 AS k, * FROM one UNION ALL SELECT 2, * FROM two),
        size AS (SELECT a.vec_id, k, sqrt(greatest(0, sum(a.v * p.v * b.v))) AS s FROM both_ p JOIN x a ON a.pos = p.i JOIN x b ON b.pos = p.j AND a.vec_id = b.vec_id WHERE a.split = 'test' GROUP BY 1, 2)
        SELECT vec_id, {rs('max(CASE WHEN k = 1 THEN s END)')} AS pc1, {rs('max(CASE WHEN k = 2 THEN s END)')} AS pc2 FROM size GROUP BY 1""",
)
def ml_pca(spark, sf):
    """Test rows on two axes of the training rows; the sign of an axis is free, so its size counts."""
    rows = labelled(spark, sf)
    out = K.principal_components(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "embedding", 2, ["vec_id"])
    return out.select("vec_id", *[r(F.abs(F.get("components", F.lit(i)))).alias(f"pc{i + 1}") for i in range(2)])


@query(
    "snk_model_params",
    f"SELECT 'mean.' || label AS name, CAST(u.i - 1 AS INTEGER) AS pos, {rs('avg(CAST(embedding[u.i] AS DOUBLE))')} AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u GROUP BY 1, 2",
)
def snk_model_params(spark, sf):
    """Class means as a parameter table, written and read back."""
    long_ = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = long_.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"])
    params = means.groupBy("label").agg(values.alias("values"))
    params = params.select(F.concat(F.lit("mean."), F.col("label").cast("string")).alias("name"), F.array(F.size("values")).alias("shape"), "values")
    path = scratch_path(spark, "params")
    sinks.write_params(params, path)
    return sinks.read_params(spark, path).select("name", F.posexplode("values").alias("pos", "value")).withColumn("value", r(F.col("value")))


@query("met_param_count", f"SELECT count(DISTINCT label) * 64 AS parameters, {rs('count(DISTINCT label) * 64 * 4 / 1048576.0')} AS size_mb FROM embeddings")
def met_param_count(spark, sf):
    from twinlens.operators.metrics import parameter_count

    long_ = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = long_.groupBy("label", "pos").agg(F.avg("v").alias("m")).groupBy("label").agg(F.collect_list("m").alias("values"))
    return parameter_count(means).select("parameters", r(F.col("size_mb")).alias("size_mb"))
