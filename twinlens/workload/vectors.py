"""Embedding vector functions."""

from pyspark.sql import functions as F

from twinlens.functions import strings as S
from twinlens.functions import vectors as V
from twinlens.workload.base import query, r, rs, table


def image():
    return F.slice("embedding", 1, 32)


def text():
    return F.slice("embedding", 33, 32)


def exploded(df, vec, keys=("vec_id",), digits=6):
    out = df.select(*keys, F.posexplode(vec).alias("pos", "v"))
    return out.select(*keys, "pos", r(F.col("v"), digits).alias("v"))


def long_sql(low=1, high=64):
    return f"(SELECT vec_id, label, CAST(u.i - {low} AS INTEGER) AS pos, CAST(embedding[u.i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range({low}, {high + 1})) AS i) u)"


@query("arr_l2_normalize", f"SELECT vec_id, pos, {rs('v / sqrt(sum(v * v) OVER (PARTITION BY vec_id))')} AS v FROM {long_sql(1, 32)}")
def arr_l2_normalize(spark, sf):
    return exploded(table(spark, sf, "embeddings"), V.l2_normalize(image()))


@query(
    "arr_masked_mean_pool",
    f"""SELECT vec_id, CAST(pos % 16 AS INTEGER) AS pos, {rs('sum(CASE WHEN pos // 16 <= label % 4 THEN v ELSE 0 END) / greatest(max(label % 4 + 1), 0.000000001)')} AS v
        FROM {long_sql()} GROUP BY 1, 2""",
)
def arr_masked_mean_pool(spark, sf):
    # 4 tokens of 16 dimensions; the label says how many tokens are real
    tokens = F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)])
    mask = F.array(*[F.when(F.lit(i) <= F.col("label") % 4, 1).otherwise(0) for i in range(4)])
    return exploded(table(spark, sf, "embeddings"), V.masked_mean_pool(tokens, mask))


@query("arr_concat", f"SELECT vec_id, CAST((pos + 32) % 64 AS INTEGER) AS pos, {rs('v')} AS v FROM {long_sql()}")
def arr_concat(spark, sf):
    return exploded(table(spark, sf, "embeddings"), F.concat(text(), image()).cast("array<double>"))


@query(
    "arr_softmax",
    f"""SELECT vec_id, pos, {rs('e / sum(e) OVER (PARTITION BY vec_id)')} AS v, {rs('1 / (1 + exp(-v))')} AS sig FROM (SELECT vec_id, pos, v, exp(v) AS e FROM {long_sql()})""",
)
def arr_softmax(spark, sf):
    both = F.arrays_zip(V.softmax(F.col("embedding")).alias("p"), V.sigmoid(F.col("embedding")).alias("s"))
    out = table(spark, sf, "embeddings").select("vec_id", F.posexplode(both).alias("pos", "x"))
    return out.select("vec_id", "pos", r(F.col("x.p")).alias("v"), r(F.col("x.s")).alias("sig"))


@query(
    "arr_cosine",
    f"""SELECT a.vec_id, {rs('sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)))')} AS cosine, {rs('sqrt(sum((a.v - b.v) * (a.v - b.v)))')} AS distance
        FROM {long_sql(1, 32)} a JOIN {long_sql(33, 64)} b ON a.vec_id = b.vec_id AND a.pos = b.pos GROUP BY 1""",
)
def arr_cosine(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r(V.cosine(image(), text())).alias("cosine"), r(V.euclidean(image(), text())).alias("distance"))


@query(
    "arr_multi_hot",
    """WITH v AS (SELECT DISTINCT w FROM (SELECT unnest([p_type, p_name]) AS w, p_size FROM part) WHERE p_size <= 40)
       SELECT DISTINCT p_partkey, w AS label, 1 AS hot FROM (SELECT p_partkey, unnest([p_type, p_name]) AS w FROM part) JOIN v USING (w)""",
)
def arr_multi_hot(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", S.split_labels(F.concat_ws(", ", "p_type", "p_name")).alias("labels"))
    return V.hot_labels(df, "p_partkey", "labels", df.filter("p_size <= 40"))


@query(
    "arr_label_index",
    """SELECT p_partkey, CAST(p_size AS VARCHAR) AS label, i AS "index" FROM part JOIN
       (SELECT s, CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS s FROM part)) ON s = CAST(p_size AS VARCHAR)""",
)
def arr_label_index(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("label"))
    return df.join(V.label_index(df, "label"), "label").select("p_partkey", "label", "index")


@query("arr_zero_modality", f"SELECT vec_id, pos, {rs('CASE WHEN pos < 32 THEN 0.0 ELSE v END')} AS v FROM {long_sql()}")
def arr_zero_modality(spark, sf):
    return exploded(table(spark, sf, "embeddings"), F.concat(V.zero_like(image()), text().cast("array<double>")))


@query(
    "arr_onehot_argmax",
    f"SELECT vec_id, pos, CAST(pos = first_value(pos) OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS INTEGER) AS hot FROM {long_sql()}",
)
def arr_onehot_argmax(spark, sf):
    hot = V.onehot(V.argmax(F.col("embedding")), 64)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(hot).alias("pos", "hot"))


@query("arr_threshold", f"SELECT vec_id, pos, CAST(v > 0.1 AS INTEGER) AS hot FROM {long_sql()}")
def arr_threshold(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(V.threshold(V.as_double(F.col("embedding")), 0.1)).alias("pos", "hot"))
