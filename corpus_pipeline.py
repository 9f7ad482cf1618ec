"""The corpus pipeline: documents to token ids in five stages.

Each stage takes all its predecessor kept. ``run`` writes every stage's rows to the shared folder and reads them again.

1. language_id: documents without a letter, or whose n-grams no learned language explains, go; a missing lang is filled in.
2. line_dedup: later copies of repeated line runs are cut out; documents of which nothing visible is left go.
3. near_dup: one document of each group of near-duplicates stays.
4. decontamination: documents with a benchmark phrase go.
5. sentencepiece: token ids, decoded again as a check.

Odd inputs: a null, empty or blank text, or one without a letter, goes in the first stage; a null lang is filled in, other nulls stay; rows with a
null doc_id pass every stage, but are grouped with no other row; of rows that are repeated as they are one stays after the third stage; of equal
texts the smallest doc_id stays; texts may be of any length; an empty table gives empty tables. Columns beside those of documents go along unchanged under any name, up to the last stage,
whose result has doc_id, lang, source, n_ids, ids and same.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm import language_id, near_dup, pieces
from twinlens.llm.decontamination import contamination
from twinlens.llm.line_dedup import dedup_lines
from twinlens.llm.q_models import model_file
from twinlens.session import drop_folder, scratch_scope, ship, small_side, stored

#: Least share of a text's n-grams that its language must explain. Prose lies above 0.6, strings of signs or of random letters below 0.2.
LEAST_SCORE = 0.25
#: SQL can express neither the n-gram filters nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` less the documents named by (doc_id, text_key)."""
    keys = small_side(keys.select(F.col("doc_id").alias("o_id"), F.col("text_key").alias("o_key")).distinct(), 1_000_000)
    return docs.join(keys, docs["doc_id"].eqNullSafe(F.col("o_id")) & (F.xxhash64(docs["text"]) == F.col("o_key")), "left_anti")


_folders: dict[str, str] = {}
#: Columns that the stages work on; any others are set aside under names that no operator uses.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage(fn):
    """A stage keeps its tables in a folder of its own, which the next stage of the application drops: by then its rows
    are written."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        app = spark.sparkContext.applicationId
        if app in _folders:
            drop_folder(spark, _folders.pop(app))
        aside = {c: f"_aside_{k}" for k, c in enumerate(c for c in docs.columns if c not in COLUMNS)}
        with scratch_scope(spark) as folder:
            out = fn(spark, docs.withColumnsRenamed(aside), sf_dir)
        _folders[app] = folder
        return out.withColumnsRenamed({new: c for c, new in aside.items()})

    return run_stage


@stage
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = language_id.identify(docs, language_id.learn(docs))
    fine = out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return fine.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = stored(near_dup.near_duplicates(docs), "groups")
    rest = _without(docs, found.where(~F.col("kept")))
    # rows that are repeated as they are count as one document, too; they are few, so only they are shuffled
    twice = found.where("kept and doc_id is not null").groupBy("doc_id", "text_key").count().where("count > 1")
    again = rest.join(small_side(twice.select(F.col("doc_id").alias("o_id"), F.col("text_key").alias("o_key"))), (F.col("doc_id") == F.col("o_id")) & (F.xxhash64("text") == F.col("o_key")), "left_semi")
    return _without(rest, twice).unionByName(again.dropDuplicates(["doc_id", "text"]))


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hit = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0")
    return _without(docs, hit)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select("doc_id", "lang", "source", "text")
    return pieces.encode(docs, pieces.load(model_file()), check=True, texts=False).select("doc_id", "lang", "source", "n_ids", "ids", "same")


STAGES = [("language_id", languages), ("line_dedup", lines), ("near_dup", near_duplicates), ("decontamination", decontaminated), ("sentencepiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stored(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
