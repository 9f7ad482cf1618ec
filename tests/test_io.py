import io
import random
import tarfile
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from pyspark.sql import functions as F

from twinlens import session
from twinlens.plans import encode as E
from twinlens.plans import generate as G
from twinlens.operators.search import words_in_texts
from twinlens.sources import archives as Z
from twinlens.sources import files as S
from twinlens.sources import registry as R
from twinlens.sources import sinks as K


def test_small_side_has_another_way(spark):
    df = spark.range(100)
    assert session.small_side(df, max_rows=99) is df
    assert session.small_side(df, max_rows=100, max_bytes=10) is df
    small = session.small_side(df, max_rows=100)
    assert small is not df and small.count() == 100
    with pytest.raises(ValueError):
        session.collect_few(df, 99)


def test_csv_keeps_breaks_quotes_and_nulls(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nsecond line'), (2, ""), (3, None), (4, "back\\slash"), (5, "  ")]
    df = spark.createDataFrame(rows, "id int, t string")
    K.write_csv(df, str(tmp_path / "x"))
    assert sorted(tuple(r) for r in S.read_csv(spark, str(tmp_path / "x"), "id int, t string").collect()) == [(i, t or None) for i, t in rows]


def test_records_take_few_lines_at_a_time(monkeypatch):
    def records(lines):
        n = len(lines)
        batch = pa.record_batch({"f": pa.array(["x"] * n), "s": pa.array([0] * n, pa.int64()), "odd": pa.array([0] * n, pa.int32()), "value": pa.array(lines)})
        return S._records(iter([batch]))

    tracemalloc.start()
    rows = sum(b.num_rows for b in records(["h", *["y" * 10_000] * 3000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and peak < 10_000_000
    lines = ["h", "a,b", '"open', "", 'still",c', "", "d", '"left', "open"]
    whole = [r for b in records(lines) for r in b.to_pylist()]
    assert [(r["text"], r["whole"]) for r in whole] == [("a,b", True), ('"open\n\nstill",c', True), ("", True), ("d", True), ('"left\nopen', False)]
    for most in (1, 5, 9):
        monkeypatch.setattr(S, "LINES_TOGETHER", most)
        assert [r for b in records(lines) for r in b.to_pylist()] == whole


def test_ignore_keeps_the_first_output(spark, tmp_path):
    path = str(tmp_path / "x")
    K.write_csv(spark.range(3), path)
    K.write_csv(spark.range(9), path, mode="ignore")
    assert S.read_csv(spark, path, "id long").count() == 3


def test_rewrite_in_place(spark, tmp_path):
    path = str(tmp_path / "labels")
    read = lambda p: S.read_csv(spark, p, "id long")
    K.write_csv(spark.range(5), path)
    out = K.rewrite(spark, path, lambda df: df.filter("id > 1"), read, K.write_csv)
    assert out.count() == 3 and not (tmp_path / "labels.old").exists() and not (tmp_path / "labels.new").exists()


def test_line_numbers_span_files_and_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"a{i}" for i in range(50)) + "\n")
    (tmp_path / "b.txt").write_text("b0\nb1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        rows = S.read_numbered_lines(spark, str(tmp_path), "t").orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["t"] for r in rows] == [f"a{i}" for i in range(50)] + ["b0", "b1"]
    assert [r["line"] for r in rows] == list(range(52))


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("files/a.txt", "Ä text")
        z.writestr("files/b.txt", "b")
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        info = tarfile.TarInfo("m/1.bin")
        info.size = 3
        t.addfile(info, io.BytesIO(b"xyz"))
    wanted = spark.createDataFrame([("files/a.txt",), ("files/none.txt",)], "p string")
    got = {r["p"]: r["text"] for r in Z.zip_texts(Z.open_files(spark, str(tmp_path / "x.zip")), wanted, "p").collect()}
    assert got == {"files/a.txt": "Ä text", "files/none.txt": None}
    members = Z.tar_subset(Z.open_files(spark, str(tmp_path / "x.tar")), spark.createDataFrame([("m/1.bin",)], "p string"), "p")
    assert [bytes(r["data"]) for r in members.collect()] == [b"xyz"]


def test_manifest_and_images(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8abc")
    (tmp_path / "b.jpg").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"no image")
    rows = {r["name"]: r["length"] for r in S.manifest(spark, str(tmp_path), "*.jpg").collect()}
    assert rows == {"a.jpg": 5}  # a file without content counts as absent
    emb = {r["ImageName"]: r["image_emb"] for r in E.encode_images(spark, str(tmp_path), E.HashingEncoder, "*.jpg").collect()}
    assert sum(x * x for x in emb["a.jpg"]) == pytest.approx(1)


def test_model_of_file_needs_a_marker(spark):
    df = spark.createDataFrame([("posts_med-x_alpha-4b_predictions.csv",)], "f string")
    got = df.select(*S.model_of_file(F.col("f"), "_predictions.csv", ["_beta-", "_alpha-"])).first()
    assert tuple(got) == ("posts_med-x", "alpha-4b")
    with pytest.raises(PySparkException, match="no model marker"):
        df.select(*S.model_of_file(F.col("f"), "_predictions.csv", ["_beta-"])).collect()


def test_run_of_file_keeps_underscores(spark):
    df = spark.createDataFrame([("d_b_gated_attention_results.csv",)], "f string")
    assert tuple(df.select(*S.run_of_file(F.col("f"), "_results.csv")).first()) == ("d", "b", "gated_attention")


def test_missing_columns_and_registry(spark):
    with pytest.raises(ValueError, match="missing"):
        S.prune(spark.range(1), ["id", "x"])
    with pytest.raises(ValueError, match="no column"):
        S.gather_vectors(spark.range(1), {"text_emb_": "text"})
    with pytest.raises(FileNotFoundError):
        R.load_all(spark, {"a": R.Layout("/nowhere/a", "i", "i", "i", "i")}, spark.read.parquet)


def test_failed_batches_answer_nothing(spark):
    # a local class travels to the workers by value
    class Moody:
        """Fails for a whole batch when one prompt says so."""

        def generate(self, prompts, images):
            if any("boom" in p for p in prompts):
                raise RuntimeError("timeout while generating")
            return [p.upper() if i is None else f"{p}+image" for p, i in zip(prompts, images)]

    rows = [(1, "a", None), (2, "boom", None), (3, "c", b"x"), (4, "d", None)]
    df = spark.createDataFrame(rows, "id int, p string, i binary").coalesce(1)
    got = {r["id"]: (r["raw_answer"], r["error"], r["attempts"]) for r in G.generate(df, ["id"], Moody, "p", "i", batch=2, tries=2, pause=0.0).collect()}
    error = "timeout while generating"
    assert got == {1: ("", error, 2), 2: ("", error, 2), 3: ("c+image", None, 1), 4: ("D", None, 1)}


def test_waits():
    assert [G.wait_seconds("429", a) for a in (1, 2, 5, 9)] == [2, 4, 32, 60]
    assert G.wait_seconds("Timeout", 4) == 5 and [G.wait_seconds("other", a) for a in (1, 3)] == [1, 4]


def test_token_probability(spark):
    df = spark.createDataFrame([({"yes": 1.0, " yes": 3.0, "\nno": 0.0},)], "m map<string,double>")
    import math

    total = sum(math.exp(x) for x in (1, 3, 0))
    row = df.select(*[G.token_probability(F.col("m"), t).alias(t) for t in ("yes", "no", "maybe")]).first()
    assert row["yes"] == pytest.approx(math.exp(3) / total) and row["no"] == pytest.approx(1 / total) and row["maybe"] is None


def test_encoder_skips_missing_inputs(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, b"\x01")], "id int, t string, i binary")
    got = {r["id"]: r for r in E.encode(df, ["id"], E.HashingEncoder, "t", "i", batch=1).collect()}
    assert got[1]["image_emb"] is None and got[2]["text_emb"] is None
    fused = {r["id"]: r["embedding"] for r in E.encode_fused(df, ["id"], E.HashingEncoder, "t", "i", ("", "")).collect()}
    assert sum(fused[2]) == 1.0


def quoted_field(rng, wide=60):
    """(value, as written)"""
    kind = rng.random()
    if kind < 0.3:
        return (f"plain{rng.random()}",) * 2
    if kind < 0.35:
        return None, ""
    text = "".join(rng.choice('ab, "\n\r;é') for _ in range(rng.randint(1, wide)))
    return text, '"' + text.replace('"', '""') + '"'


@pytest.mark.parametrize(("size", "wide"), [("700", 900), ("4096", 60), ("128m", 60)])
def test_line_breaks_in_quotes_are_read_in_splits(spark, tmp_path, size, wide):
    """Also with records that are longer than a split, and lines that end with a carriage return."""
    rng, truth = random.Random(wide), {}
    for name, n, end in (("a", 200, "\n"), ("b", 80, "\r\n"), ("c", 0, "\n"), ("d", 1, "")):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            f.write("id,x,y" + (end or "\n"))
            for _ in range(n):
                (x, a), (y, b) = quoted_field(rng, wide), quoted_field(rng, wide)
                truth[len(truth)] = (x, y)
                f.write(f"{len(truth) - 1},{a},{b}{end}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = S.read_csv(spark, str(tmp_path), "id long, x string, y string")
        assert size == "128m" or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert {r["id"]: (r["x"], r["y"]) for r in df.collect()} == truth
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_archives_are_read_in_ranges(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(60):
            z.writestr(f"f/{i}.txt", f"té{i}" * i)
        z.writestr("folder/", "")
    content = {(("long" * 40 if i % 7 == 0 else "m") + f"/{i}"): (str(i) * i).encode() for i in range(60)}
    for mode, name in (("w", "x.tar"), ("w:gz", "x.tar.gz")):
        with tarfile.open(tmp_path / name, mode) as t:
            for member, data in content.items():
                info = tarfile.TarInfo(member)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    listed = Z.read(Z.entries(Z.open_files(spark, str(tmp_path / "x.zip")), "zip"), 2000)
    assert listed.rdd.getNumPartitions() > 5
    assert {r["file_path"]: bytes(r["data"]).decode() for r in listed.collect()} == {f"f/{i}.txt": f"té{i}" * i for i in range(60)}
    # a packed tar cannot be sought in, but is read all the same
    for name in ("x.tar", "x.tar.gz"):
        files = Z.open_files(spark, str(tmp_path / name))
        assert {r["file_path"]: bytes(r["data"]) for r in Z.members(files, "tar").collect()} == content
        one = Z.tar_subset(files, spark.createDataFrame([("m/11",), ("none",)], "p string"), "p").collect()
        assert [(r["p"], bytes(r["data"])) for r in one] == [("m/11", b"11" * 11)]


def test_a_damaged_member_is_an_error(spark, tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.txt", "some text")
    data = bytearray(path.read_bytes())
    data[data.index(b"some")] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        Z.members(Z.open_files(spark, str(path)), "zip").collect()


@pytest.mark.parametrize("most", [1000, 0])
def test_words_in_texts(spark, most):
    """By an automaton, and, for a vocabulary that is too large to be sent, by a join."""
    texts = ["Red ring, redder", None, "", "ab", "a", "Ünï red", "no", "xred ring"]
    words = ["red", "RED", "ring", "a", "ab", "red ring", "Ünï", "", "zzz", None, "dde"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, label string")
    got = sorted((r["id"], r["label"]) for r in words_in_texts(df, "id", "text", spark.createDataFrame([(w,) for w in words + words], "w string"), most).collect())
    assert got == sorted((i, w) for i, t in enumerate(texts) if t is not None for w in words if w is not None and w.lower() in t.lower())
