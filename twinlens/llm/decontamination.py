"""Benchmark decontamination: a positional inverted index of training text, searched for the phrases of test items.

Words are runs of ``WORD`` after A-Z become a-z. A window is ``window`` consecutive words of an item; an item of fewer words is
one window. A document word inside any occurrence of a window is hit.

Method. (1) Postings (document, term, position) of every document word that some item has, stored without a shuffle; the
length of a document is the position of an end mark. (2) Document-wide counts of the terms; a window holding a term that no
document has is out. (3) Each window names its two rarest terms. Only the postings of these are read; each is
shifted by its place in the item, so that all terms of one occurrence agree on (document, item, shift), and the
two shifted lists are intersected. (4) For what is left, the terms of the whole item are looked up in the index at
their places; full windows among the places found are exact phrases. ``proximity`` uses the same index and the same
rarest-first order for words that stand close together in any order.

Defined cases: null and empty texts have no words; repeated rows get equal results; documents with a null id are
documents; an item with a null id counts under the empty string; items without words and empty tables hit nothing; further
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.session import small_side, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands after the last word; no word holds this character.
END = "\x00"
DOC = ["doc_id", "text_key"]


def words(text: Column) -> Column:
    """The words of a text in order; none for a null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, -1), "")


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item, place, term, n): the words of the items."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w"))
    # items that share an id keep their own places
    rows = rows.select(F.struct("item_id", F.xxhash64("w").alias("key")).alias("item"), "w").dropDuplicates(["item"])
    return rows.select("item", F.size("w").alias("n"), F.posexplode("w").alias("place", "term"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (doc_id, text_key, term, pos) of the terms, and of the end mark. ``term`` is a 64-bit name; the
    words themselves are compared, too."""
    vocabulary = terms.select("term").union(terms.sparkSession.createDataFrame([(END,)], "term string")).distinct()
    vocabulary = small_side(vocabulary.select(F.xxhash64("term").alias("name"), F.col("term").alias("spelled")), 2_000_000)
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "word"))
    hits = tokens.join(vocabulary, (F.xxhash64("word") == F.col("name")) & (F.col("word") == F.col("spelled")))
    return stored(hits.select(*DOC, F.col("name").alias("term"), "pos"), "postings")


def _same_doc(df: DataFrame, prefix: str = "o_") -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(prefix + c)) for c in DOC))


def rarest(terms: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """(item, rare): for each window that can occur, the places of its two rarest terms (one, if it has one word)."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = terms.join(df, "term", "left").select("item", "n", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "place").alias("x"))
    item = known.groupBy("item", "n").agg(F.sort_array(F.collect_list(F.struct("x.place", "x.df"))).alias("xs"))
    span = F.least(F.lit(window), F.col("n"))
    starts = item.select("item", "xs", F.explode(F.sequence(F.lit(1), F.col("n") - span + 1)).alias("s"), span.alias("span"))
    one = starts.select("item", F.transform(F.slice("xs", F.col("s"), F.col("span")), lambda x: F.struct(x["df"].alias("df"), x["place"].alias("place"))).alias("w"))
    return one.where(F.forall("w", lambda x: x["df"] > 0)).select("item", F.transform(F.slice(F.sort_array("w"), 1, 2), lambda x: x["place"]).alias("rare")).distinct()


def phrases(index: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, item, pos): each exact occurrence of a window, ``pos`` being its first word."""
    terms = stored(terms.select("item", "n", "place", F.xxhash64("term").alias("term")), "terms")
    rare = stored(rarest(terms, index, window), "rare")
    anchors = rare.select("item", F.explode("rare").alias("place")).distinct().join(terms.select("item", "place", "term"), ["item", "place"])
    shifted = index.join(small_side(anchors), "term").select(*DOC, "item", (F.col("pos") - F.col("place")).alias("shift"), "place")
    found = shifted.groupBy(*DOC, "item", "shift").agg(F.collect_set("place").alias("places"))
    wanted = rare.groupBy("item").agg(F.collect_list("rare").alias("wanted"))
    found = found.join(small_side(wanted), "item").where(F.exists("wanted", lambda w: F.size(F.array_except(w, F.col("places"))) == 0))
    found = stored(found.select(*DOC, "item", "shift"), "candidates")
    # every term of the item at its place beside the candidate
    probes = found.join(small_side(terms), "item").select(F.col("doc_id").alias("o_doc_id"), F.col("text_key").alias("o_text_key"), "item", "n", "shift", "place", F.col("term").alias("o_term"))
    probes = small_side(probes, 1_000_000)
    there = index.join(probes, _same_doc(index) & (F.col("term") == F.col("o_term")) & (F.col("pos") == F.col("shift") + F.col("place")))
    lines = there.groupBy(*DOC, "item", "n", "shift").agg(F.collect_set("place").alias("places"))
    span = F.least(F.lit(window), F.col("n"))
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - span), lambda s: F.size(F.array_except(F.sequence(s, s + span - 1), F.col("places"))) == 0)
    return lines.select(*DOC, "item", span.alias("span"), F.explode(starts).alias("start"), "shift").select(*DOC, "item", "span", (F.col("shift") + F.col("start")).alias("pos"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_key, n_words, n_hit, n_items, items (sorted strings)."""
    terms = item_terms(benchmark)
    index = build_index(docs, terms)
    at = phrases(index, terms, window)
    hits = at.groupBy(*DOC, F.col("item.item_id").alias("item_id")).agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("pos", F.col("pos") + F.col("span") - 1)))).alias("hit"))
    hits = hits.groupBy(F.col("doc_id").alias("o_doc_id"), F.col("text_key").alias("o_text_key")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items")
    )
    ends = index.where(F.col("term") == F.xxhash64(F.lit(END))).select(*DOC, F.col("pos").cast("long").alias("n_words"))
    out = ends.join(hits, _same_doc(ends), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(*DOC, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"))


def proximity(docs: DataFrame, benchmark: DataFrame, window: int = 10, slack: int = 20) -> DataFrame:
    """(doc_id, text_key, item_id): documents in which all different terms of some window stand, in any order, at most
    ``slack`` words from the window's rarest term."""
    terms = item_terms(benchmark)
    index = build_index(docs, terms)
    named = stored(terms.select("item", "n", "place", F.xxhash64("term").alias("term")), "terms")
    rare = rarest(named, index, window)
    span = F.least(F.lit(window), F.col("n"))
    by_item = named.groupBy("item", "n").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("xs"))
    by_item = by_item.select("item", F.explode(F.sequence(F.lit(1), F.col("n") - span + 1)).alias("s"), "xs", span.alias("span"))
    windows = by_item.select("item", "s", F.array_distinct(F.transform(F.slice("xs", F.col("s"), F.col("span")), lambda x: x["term"])).alias("needs"))
    anchors = rare.select("item", F.get("rare", F.lit(0)).alias("place")).distinct().join(named.select("item", "place", "term"), ["item", "place"])
    windows = windows.join(anchors, "item").where((F.col("place") >= F.col("s") - 1) & F.array_contains("needs", F.col("term")))
    windows = windows.select("item", "needs", "term").distinct()
    near = index.join(small_side(windows), "term").select(*DOC, "item", "needs", F.col("pos").alias("centre"))
    block = lambda c: F.floor(c / slack)
    near = near.select(F.col("doc_id").alias("o_doc_id"), F.col("text_key").alias("o_text_key"), "item", "needs", "centre", F.explode(F.sequence(block(F.col("centre")) - 1, block(F.col("centre")) + 1)).alias("block"))
    pairs = near.join(index.withColumn("o_block", block(F.col("pos"))), _same_doc(index) & (F.col("block") == F.col("o_block")))
    pairs = pairs.where((F.abs(F.col("pos") - F.col("centre")) <= slack) & F.array_contains("needs", F.col("term")))
    full = pairs.groupBy(*DOC, "item", "needs", "centre").agg(F.size(F.collect_set("term")).alias("have")).where(F.col("have") == F.size("needs"))
    return full.select(*DOC, F.col("item.item_id").alias("item_id")).distinct()
