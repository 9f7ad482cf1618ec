"""The prediction table that metric, bootstrap and report queries evaluate.

A nearest-mean scorer on ``embeddings``: hash split by label, class means on the training
rows, scores by dot product with the unit mean, softmax. The means are classes x
dimensions numbers; scoring is a map over rows, with no shuffle.
"""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from twinlens.functions import vectors as V
from twinlens.operators.sampling import split_by_hash
from twinlens.session import small_side
from twinlens.workload.base import table

# SQL of the same table: pred(sample_id, y_true, y_pred, label_prob list) for a slice of dimensions
SPLIT_SQL = """sp AS (SELECT vec_id, label, embedding,
    CASE WHEN count(*) OVER (PARTITION BY label) >= 2
          AND row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) * 100 <= count(*) OVER (PARTITION BY label) * 20 + 99
         THEN 'test' ELSE 'train' END AS split FROM embeddings)"""


def pred_sql(name: str = "pred", low: int = 1, high: int = 64) -> str:
    """CTEs, to follow WITH and the split CTE."""
    return f"""{name}_d AS (SELECT vec_id, label, split, u.pos, CAST(embedding[u.pos] AS DOUBLE) AS v FROM sp, (SELECT unnest(range({low}, {high + 1})) AS pos) u),
    {name}_m AS (SELECT label AS c, pos, avg(v) AS m FROM {name}_d WHERE split = 'train' GROUP BY 1, 2),
    {name}_n AS (SELECT c, sqrt(sum(m * m)) AS norm FROM {name}_m GROUP BY 1),
    {name}_s AS (SELECT d.vec_id, d.label, m.c, sum(d.v * m.m) / max(n.norm) AS s FROM {name}_d d JOIN {name}_m m USING (pos) JOIN {name}_n n ON m.c = n.c WHERE d.split = 'test' GROUP BY 1, 2, 3),
    {name}_e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM {name}_s),
    {name}_p AS (SELECT vec_id AS sample_id, label AS y_true, c, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM {name}_e),
    {name} AS (SELECT sample_id, y_true, list(p ORDER BY c) AS probs, CAST(list_position(list(p ORDER BY c), max(p)) - 1 AS INTEGER) AS y_pred FROM {name}_p GROUP BY 1, 2)"""


PRED_SQL = f"WITH {SPLIT_SQL}, {pred_sql()}"
PAIR_SQL = f"WITH {SPLIT_SQL}, {pred_sql('pa')}, {pred_sql('pb', 1, 32)}"


def labelled(spark, sf):
    return split_by_hash(table(spark, sf, "embeddings"), "vec_id", [("test", 20)], ["label"])


def predictions(spark, sf, low: int = 1, high: int = 64):
    """(sample_id, y_true, y_pred, probs) on the test rows; dimensions low..high, 1-based."""
    rows = labelled(spark, sf).withColumn("x", F.slice("embedding", low, high - low + 1))
    means = (
        rows.filter("split = 'train'")
        .groupBy("label")
        .agg(vector_to_array(Summarizer.mean(array_to_vector(V.as_double(F.col("x"))))).alias("m"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("label", "m", V.norm(F.col("m")).alias("norm"))))
    model = small_side(means.groupBy().agg(ordered.alias("model")), max_rows=1)
    score = F.transform("model", lambda c: V.dot(F.col("x"), c["m"]) / c["norm"])
    probs = F.transform(V.softmax(score), lambda p: F.round(p, 9))
    return (
        rows.filter("split = 'test'")
        .join(model, F.lit(True))
        .select(F.col("vec_id").alias("sample_id"), F.col("label").alias("y_true"), probs.alias("probs"))
        .select("sample_id", "y_true", V.argmax(F.col("probs")).alias("y_pred"), "probs")
    )
