"""Every stage of the corpus pipeline on its own input against brute force, and the whole run."""

import numpy as np
import pytest
from test_native import brute_contamination, brute_lines
from test_pairs import components

import corpus_pipeline as pipeline
from twinlens.llm import pieces
from twinlens.session import stored

JUNK = [None, "", "12345 !!! ---", "\n\n", "qzxv wkqj xxqz vvkq zzqx jjqk wwxz qqvx"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(-k - 1, t, None, "junk", 0) for k, t in enumerate(JUNK)], docs.schema)
    twice = docs.where("doc_id < 2")
    frames = [stored(docs.unionByName(junk).unionByName(twice))]
    for _, stage in pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], sf)))
    return [[r.asDict() for r in f.orderBy("doc_id").collect()] for f in frames], docs.columns


def test_names_and_columns(stages):
    rows, columns = stages
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dup", "decontamination", "sentencepiece"]
    assert all(list(r) == columns for stage in rows[:-1] for r in stage)


def test_language_stage_keeps_prose_and_drops_the_rest(stages):
    rows, _ = stages
    before, after = rows[0], rows[1]
    kept = {r["doc_id"] for r in after}
    assert kept == {r["doc_id"] for r in before if r["doc_id"] >= 0}
    assert all(r["lang"] for r in after)


def test_line_stage(stages):
    rows, _ = stages
    unique = list({r["doc_id"]: r for r in rows[1]}.values())
    gone = brute_lines([r["text"] for r in unique], 40)
    want = {}
    for r, g in zip(unique, gone, strict=True):
        parts = r["text"].split("\n")
        visible = {k for k, p in enumerate(parts) if p.strip(" \t\r\f\v")}
        if g != visible or not g:
            want[r["doc_id"]] = "\n".join(p for k, p in enumerate(parts) if k not in g)
    assert {r["doc_id"]: r["text"] for r in rows[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2])


def test_near_duplicate_stage(stages):
    rows, _ = stages
    unique = sorted({r["doc_id"]: r for r in rows[2]}.values(), key=lambda r: r["doc_id"])
    groups, _ = components([r["text"] for r in unique], 5, 80)
    assert [r["doc_id"] for r in rows[3]] == [unique[k]["doc_id"] for k in sorted(set(groups))]


def test_decontamination_stage(stages, spark, sf):
    rows, _ = stages
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_contamination([r["text"] for r in rows[3]], items, 10)
    assert [r["doc_id"] for r in rows[4]] == [r["doc_id"] for r, h in zip(rows[3], hits, strict=True) if not h[1]]


def test_token_stage(stages):
    rows, _ = stages
    vocabulary = pieces.load(pipeline.model_file())
    assert all(r["same"] for r in rows[5])
    for a, b in zip(rows[4], rows[5], strict=True):
        assert (a["doc_id"], a["text"]) == (b["doc_id"], vocabulary.decode(np.array(b["ids"])))


def test_run_is_the_stages_in_order(stages, spark, sf):
    docs = {r["doc_id"] for r in stages[0][5]}
    out = {r["doc_id"] for r in pipeline.run(spark, sf).select("doc_id").collect()}
    assert out == docs
    assert pipeline.ORACLE_SQL is None


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, sf))
        assert docs.count() == 0


def test_columns_of_any_name_go_along(spark, sf):
    """Also such as operators use themselves."""
    names = ["score", "lang_pred", "n_lines", "kept", "text_key", "o_id", "O_KEY", "term", "_padded", "ids"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    frame = stored(docs.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names]))
    for _, stage in pipeline.STAGES[:-1]:
        frame = stored(stage(spark, frame, sf))
        assert frame.columns == [*docs.columns, *names]
        rows = frame.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    assert pipeline.STAGES[-1][1](spark, frame, sf).columns == ["doc_id", "lang", "source", "n_ids", "ids", "same"]
