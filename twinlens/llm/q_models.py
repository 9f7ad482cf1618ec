"""Queries of the operators that learn."""

import os

from pyspark.sql import functions as F

from twinlens.llm import language_id, pieces, quality, toxicity
from twinlens.llm.common import held_out
from twinlens.llm.queries import query, table


@query("op1_language_id")
def language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "n_grams")


@query("op2_quality")
def quality_score(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.learn(docs.where(~held_out(F.col("doc_id"), 5, 0)), table(spark, sf, "labels"))
    return quality.score(docs, model, 0.3).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


@query("op8_toxicity")
def toxic_score(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.learn(docs.where(~held_out(F.col("doc_id"), 5, 0)), table(spark, sf, "labels"))
    out = toxicity.score(docs, model, 0.5)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", F.col("worst.start").alias("worst_start"), F.col("worst.end").alias("worst_end"))


def model_file() -> str:
    """``PIECE_MODEL``, or the public model of this machine."""
    return os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@query("op6_sentencepiece")
def encoded(spark, sf):
    return pieces.encode(table(spark, sf, "documents").select("doc_id", "text"), pieces.load(model_file()), check=True, texts=False)
