import pytest
from pyspark.errors import PySparkException

from pyspark.sql import functions as F

from twinlens.operators import aggregates as A
from twinlens.operators import joins as J
from twinlens.plans import reports as R


def test_one_to_one_rejects_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "k int, b double")
    with pytest.raises(PySparkException, match="duplicate join key"):
        J.one_to_one(a, b, ["k"]).collect()
    with pytest.raises(PySparkException, match="duplicate join key"):
        J.one_to_one(b, a, ["k"]).collect()
    assert J.one_to_one(a, b.filter("b > 1"), ["k"]).count() == 2


def test_pairs_reject_unequal_labels(spark):
    a = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "sample_id int, y_true int, y_pred int")
    assert J.paired_predictions(a, a).columns == ["sample_id", "y_true", "y_pred_a", "y_pred_b"]
    b = a.withColumn("y_true", F.lit(1))
    with pytest.raises(PySparkException, match="disagree"):
        J.paired_predictions(a, b).collect()


def test_pivot_rejects_duplicates(spark):
    df = spark.createDataFrame([("d", "a", 1), ("d", "a", 2)], "k string, c string, v int")
    with pytest.raises(PySparkException, match="two rows"):
        A.pivot_one(df, ["k"], "c", "v", ["a"]).collect()


def test_natural_join_needs_a_shared_column(spark):
    with pytest.raises(J.JoinError):
        J.natural(spark.range(1), spark.createDataFrame([(1,)], "other int"))


def test_resume_covers_holes(spark):
    df = spark.createDataFrame([(f"{i}.jpg",) for i in range(5)], "image string")
    done = spark.createDataFrame([("0.jpg", 1), ("3.jpg", 1)], "name string, length int")
    assert {r["image"] for r in J.still_missing(df, done, "image").collect()} == {"1.jpg", "2.jpg", "4.jpg"}


def test_modes_and_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (2, "b"), (None, None)], "n int, s string")
    out = A.fill_with_mode(df, ["n", "s"]).collect()
    assert (1, "a") in {(r["n"], r["s"]) for r in out}


def test_class_weights_sum_to_rows(spark):
    df = spark.createDataFrame([(i % 3 % 2,) for i in range(20)], "label int")
    w = A.class_weights(df, "label").collect()
    assert sum(r["n"] * r["weight"] for r in w) == pytest.approx(20)


def test_frontier_keeps_equal_points(spark):
    pts = [("g", 1.0, 1.0), ("g", 1.0, 1.0), ("g", 2.0, 1.0), ("g", 2.0, 3.0), ("g", 3.0, 2.0), ("h", 9.0, 0.0)]
    rows = R.frontier(spark.createDataFrame(pts, "g string, c double, q double"), ["g"], "c", "q").collect()
    assert sorted((r["g"], r["c"], r["q"], r["on_frontier"]) for r in rows) == [
        ("g", 1.0, 1.0, True), ("g", 1.0, 1.0, True), ("g", 2.0, 1.0, False), ("g", 2.0, 3.0, True), ("g", 3.0, 2.0, False), ("h", 9.0, 0.0, True)
    ]
