"""Finding many words in texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.session import small_table

#: Characters at the start of a word by which a large vocabulary meets the texts.
START = 3


def words_in_texts(df: DataFrame, key: str, text: str, vocabulary: DataFrame, most: int = 200_000) -> DataFrame:
    """(key, label): the words of ``vocabulary`` (one column) that a row's text contains anywhere, without regard to case; each once for a row.

    A vocabulary of at most ``most`` words is sent to the tasks, which walk once through each text with an automaton of all words. A larger
    one is joined: words meet the texts that have their first ``START`` characters, and those pairs are tested. Null texts contain nothing, null words are in
    no text, and the empty word is in every text.
    """
    words = vocabulary.toDF("label").where("label is not null").distinct().withColumn("low", F.lower("label"))
    rows = df.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).where("text is not null")
    _, table = small_table(words, most)
    if table is None:
        return _joined(rows, words).withColumnRenamed("key", key)
    by: dict[str, list[str]] = {}
    for label, low in zip(*(table.column(c).to_pylist() for c in ("label", "low")), strict=True):
        by.setdefault(low, []).append(label)
    shared = df.sparkSession.sparkContext.broadcast(by)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = shared.value
        automaton = ahocorasick.Automaton()
        for low in known:
            if low:
                automaton.add_word(low, low)
        automaton.make_automaton()
        always = known.get("", [])
        for batch in batches:
            place, label = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = {low for _, low in automaton.iter(t)} if len(automaton) else set()
                hits = [w for low in found for w in known[low]] + always
                place += [i] * len(hits)
                label += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(place, np.int64))), pa.array(label, pa.string())], ["key", "label"])

    return rows.mapInArrow(run, f"key {kind}, label string").distinct().withColumnRenamed("key", key)


def _joined(rows: DataFrame, words: DataFrame) -> DataFrame:
    # places are counted in characters; a start that is shorter than START is a whole word
    places = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))
    starts = F.flatten(F.transform(places, lambda p: F.transform(F.array(*[F.lit(n) for n in range(1, START + 1)]), lambda n: F.substring(F.col("text"), p, n))))
    grams = rows.select("key", F.explode(F.array_distinct(F.array_append(starts, F.lit("")))).alias("start"))
    met = grams.join(words.withColumn("start", F.substring("low", 1, START)), "start").select("key", "label", "low").distinct()
    return met.join(rows, "key").where(F.contains("text", "low")).select("key", "label").distinct()
