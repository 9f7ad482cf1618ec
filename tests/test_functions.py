import datetime
import math

import pytest

from pyspark.sql import functions as F

from twinlens.functions import answers as Y
from twinlens.functions import columns as C
from twinlens.functions import numbers as N
from twinlens.functions import prompt_texts as P
from twinlens.functions import strings as S
from twinlens.functions import text as T
from twinlens.functions import vectors as V


def one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "day, week",
    [("2016-01-03", 201601), ("2016-01-02", 201552), ("2015-01-03", 201453), ("2018-12-30", 201901), ("2015-12-31", 201552), ("01/03/2016", 201601)],
)
def test_epiweek(spark, day, week):
    assert one(spark, day, "string", N.epiweek_from_text) == week
    if day[2] != "/":
        assert one(spark, datetime.date.fromisoformat(day), "date", N.epiweek) == week


def test_parse_epiweek(spark):
    assert one(spark, "2018/w07", "string", N.parse_epiweek) == 201807


@pytest.mark.parametrize("text, value", [("5O", 50.0), ("7,5", 7.5), ("Não", None), (None, None), ("x", None)])
def test_dirty_number(spark, text, value):
    assert one(spark, text, "string", N.dirty_number) == value


def test_recodes_send_null_to_zero(spark):
    for fn in (N.any_grade, N.three_grades):
        assert one(spark, None, "int", fn) == 0
    assert [one(spark, g, "int", N.three_grades) for g in range(5)] == [0, 1, 1, 1, 2]


ANSWERS = ["1", " 0 (Fake)", "No diabetic retinopathy", "no dr", "it is real", "", "fakery", "2 times 1", "+1", "Positive"]


def test_strict_answers(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ANSWERS)], "i int, a string")
    labels = F.array(F.lit("0"), F.lit("1"))
    got = {r["a"]: (r["x"], r["y"]) for r in df.select("a", Y.strict_label(F.col("a"), labels, "fakeddit").alias("x"), Y.strict_label(F.col("a"), labels, "BRSET").alias("y")).collect()}
    assert got["1"] == ("1", "1") and got[" 0 (Fake)"] == ("0", "0")
    assert got["No diabetic retinopathy"][1] == "0" and got["no dr"][1] == "0"  # negative phrase first
    assert got["it is real"][0] == "1" and got["Positive"][1] == "1"
    assert got[""] == (None, None) and got["fakery"][0] is None  # whole words only
    assert got["2 times 1"] == ("1", "1")  # the leading number is no label, the word is


def test_labels_are_literal_words(spark):
    labels = F.array(F.lit("c++ code"), F.lit("rice"), F.lit("rice cake"))
    assert one(spark, "I see C++ code here", "string", lambda c: Y.strict_label(c, labels)) == "c++ code"
    assert one(spark, "a rice cake", "string", lambda c: Y.strict_label(c, labels)) == "rice"
    assert one(spark, "price", "string", lambda c: Y.strict_label(c, labels)) is None
    assert one(spark, "price", "string", lambda c: Y.substring_label(c, labels)) == "rice"


@pytest.mark.parametrize("text, value", [("0", 1), (" 1 (Fake)", 0), ("Real!", 1), ("FAKE news", 0), ("10", None), ("realistic", None)])
def test_inverted_answers(spark, text, value):
    assert one(spark, text, "string", Y.inverted_label) == value


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], "array<float>", V.l2_normalize) == [0.6, 0.8]
    assert all(math.isnan(x) for x in one(spark, [0.0, 0.0], "array<double>", V.l2_normalize))
    assert one(spark, [1.0, 5.0, 5.0], "array<double>", V.argmax) == 1
    assert sum(one(spark, [1000.0, 1001.0], "array<double>", V.softmax)) == pytest.approx(1)
    pooled = lambda c: V.masked_mean_pool(c, F.array(F.lit(0), F.lit(0)))
    assert one(spark, [[1.0], [2.0]], "array<array<double>>", pooled) == [0.0]
    pooled = lambda c: V.masked_mean_pool(c, F.array(F.lit(1), F.lit(0)))
    assert one(spark, [[1.0], [2.0]], "array<array<double>>", pooled) == [1.0]


def test_plain_mean_pool_and_numbered_columns(spark):
    from twinlens.sources.files import rename_numbered

    assert one(spark, [[1.0, 4.0], [3.0, 0.0]], "array<array<double>>", V.mean_pool) == [2.0, 2.0]
    assert rename_numbered(spark.range(1).selectExpr("id as ImageName", "1 as `0`", "2 as `10`")).columns == ["ImageName", "image_0", "image_10"]


def test_wrappers(spark):
    assert one(spark, "hi", "string", lambda c: T.wrap(c, P.QUESTION_WRAPPER)) == "Question: hi Answer:"
    assert one(spark, "hi", "string", lambda c: T.wrap(c, P.CHAT_WRAPPER)) == "<image>\nUSER: hi\nASSISTANT:"


def test_label_index_uses_string_order(spark):
    df = spark.createDataFrame([(2,), (10,), (1,), (0,), (10,)], "label int")
    assert {r["label"]: r["index"] for r in V.label_index(df, "label").collect()} == {"0": 0, "1": 1, "10": 2, "2": 3}


def test_missing_values(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0]), (None, [1.0, 2.0]), (4, None)], "a int, v array<double>")
    assert [r["a"] for r in C.drop_missing(df, ["a", "v"]).collect()] == [2]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert C.first_existing(df, "x", ["y", "b"]) == "b"
    with pytest.raises(ValueError):
        C.first_existing(df, "x", ["y"])
    assert one(spark, "[1, 2.5]", "string", C.parse_vector) == [1.0, 2.5]
    assert one(spark, "oops", "string", C.parse_vector) is None


def test_double_extension_keeps_the_clean_file(spark):
    df = spark.createDataFrame([("a.jpg.jpg", 1), ("a.jpg", 2), ("b.jpg.jpg", 3)], "name string, v int")
    assert {r["name"]: r["v"] for r in S.repair_double_extension(df, "name").collect()} == {"a.jpg": 2, "b.jpg": 3}


def test_padded_ids(spark):
    assert one(spark, 42, "long", S.padded_image_id) == "000000000042.jpg"
    assert one(spark, 123456789012, "long", S.padded_image_id) == "123456789012"


def test_image_phrase(spark):
    assert one(spark, "what is left of the cup in the image12 ?", "string", S.cut_image_phrase) == "what is left of the cup"


def test_template_table(spark):
    rows = T.template_table(spark).collect()
    assert len(rows) == 31 and len({(r["dataset"], r["task"], r["strategy"]) for r in rows}) == 31
    by = {(r["dataset"], r["task"], r["strategy"]): r["template"] for r in rows}
    cot = by["brset", "binary_dr", "cot"]
    assert P.RULE_MARK not in cot and cot.endswith('"Answer: no".') and "\n\n\n" not in cot
    assert by["brset", "binary_dr", "role"] == P.ROLE + "\n\n" + P.BINARY
    for (_, _, strategy), text in by.items():
        assert text == text.strip()


def test_dispatch_falls_back(spark):
    rows = [(1, "BRSET", "Glaucoma", "cot"), (2, "mbrset", "amd", "base"), (3, "brset", "binary_dr", "role")]
    df = spark.createDataFrame(rows, "i int, d string, t string, s string")
    got = {r["i"]: r["template"] for r in T.dispatch(df, "d", "t", "s").collect()}
    assert got[1] == P.GLAUCOMA and got[2] is None and got[3].startswith(P.ROLE)


def test_null_phrases(spark):
    cols = ["sex", "age", "dm_time", "educational_level", *[c for c, _, _ in P.HISTORY_FLAGS]]
    df = spark.createDataFrame([tuple([None] * len(cols))], ", ".join(f"{c} double" for c in cols))
    text = df.select(T.patient_description()).first()[0]
    assert text.startswith("A sex not reported patient with age not reported, with no reported diabetes duration, not using insulin")
    assert text.endswith("The patient is with no educational level reported.")


def test_row_functions_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("0",), ("1",), ("real",)], "a string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a string").parquet(str(tmp_path / "in")).select(Y.inverted_label(F.col("a")).alias("y"))
    q = stream.writeStream.format("memory").queryName("parsed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["y"] for r in spark.table("parsed").collect()) == [0, 1, 1]
