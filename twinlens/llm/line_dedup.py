"""Line dedup: repeated runs of lines, found by a suffix array over line names.

The lines of a document that are not blank form its sequence. A run is *long* if its lines have at least
``min_chars`` characters together. A line goes if it lies in a long run whose lines stand, in the same order, at an
earlier place (smaller doc_id, then smaller text key, or the same document and an earlier line). Blank lines stay.

Method. Prefix doubling: level 0 names a line by its earliest place in the corpus, level k names 2^k lines by the pair of
the two names of level k - 1, so that suffixes with equal names at level k share a prefix of 2^k lines (an interval
of the suffix array whose common prefix is that long). A long run that cannot lose a line of its end or its start
has at most ``min_chars`` lines, so the doubling ends at log2(min_chars). Two overlapping names cover any length between
two levels (the interval of exactly that common prefix); its earliest member stays. Suffixes whose name occurs once
are given up at once: nothing longer that begins there can occur twice.

Defined cases: null and empty texts come back as they are with counts 0; a null doc_id is smallest; repeated rows (equal
doc_id and text) are one document and all get the same result; a table without rows gives none; further columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.session import stored

PLACE = ["doc_id", "text_key", "line"]
OTHER = ["o_doc", "o_key", "o_line"]


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(content: Column) -> Column:
    # stops at the first character that is not blank
    return F.ltrim(content, F.lit(" \t\r\f\v")) == ""


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)))


def line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line that is not blank: its place, ``at`` (its number in the whole text), ``digest``, and ``fore`` /
    ``back``: how many lines the shortest long run has that starts / ends here, or null."""
    rows = (
        docs.where(F.col("text").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(split_lines(F.col("text"))).alias("at", "content"))
        .where(~_blank(F.col("content")))
        .select("doc_id", "text_key", "at", F.unhex(F.md5(F.col("content").cast("binary"))).alias("digest"), F.length("content").cast("long").alias("chars"))
        .repartition("doc_id", "text_key")
        # repeated rows are one document; the rows of a document are together already, so this moves nothing
        .groupBy("doc_id", "text_key", "at")
        .agg(F.min(F.struct("digest", "chars")).alias("x"))
        .select("doc_id", "text_key", "at", "x.*")
    )
    doc = Window.partitionBy("doc_id", "text_key")
    upto = doc.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"line": F.count(F.lit(1)).over(upto) - 1, "after": F.sum("chars").over(upto), "total": F.sum("chars").over(doc)})
    rows = rows.withColumn("before", F.col("after") - F.col("chars"))
    fore = F.count(F.lit(1)).over(doc.orderBy("before").rangeBetween(0, min_chars - 1))
    back = F.count(F.lit(1)).over(doc.orderBy("after").rangeBetween(1 - min_chars, 0))
    return rows.select(
        *PLACE,
        "at",
        "digest",
        F.when(F.col("total") - F.col("before") >= min_chars, fore).alias("fore"),
        F.when(F.col("after") >= min_chars, back).alias("back"),
    )


def _earliest(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` without rows whose keys occur once, and with the earliest place of equal keys. The minimum is taken
    before the shuffle, so a line that a third of the documents share is one row of each task; the minima are stored, so that the
    join reads both sides by its own shuffle and can split the rows of such a line over tasks."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*PLACE)).alias(name), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return df.join(stored(first, "first"), keys)


def repeated_runs(lines: DataFrame, min_chars: int) -> DataFrame:
    """From a ``line_table``: the later copies of the shortest long runs, as the place of the first line, ``n_lines``,
    and ``source``, the place of the earliest copy."""
    levels, width = [stored(_earliest(lines.select(*PLACE, "digest"), ["digest"], "name").select(*PLACE, "name"), "names")], 1
    while width * 2 <= min_chars:
        # the name `width` lines on; a suffix that ends before has no name of this length
        on = levels[-1].select("doc_id", "text_key", F.col("line") - width, "name").toDF(*OTHER, "second")
        pairs = levels[-1].withColumnRenamed("name", "first").join(on, _same(PLACE, OTHER)).drop(*OTHER)
        names = stored(_earliest(pairs, ["first", "second"], "name").select(*PLACE, "name"), "names")
        if not names.take(1):
            break
        levels.append(names)
        width *= 2
    starts = lines.where("fore is not null").select(*PLACE, F.col("fore").alias("n_lines"))
    ends = lines.where("back is not null").select("doc_id", "text_key", (F.col("line") - F.col("back") + 1).alias("line"), F.col("back").alias("n_lines"))
    spans = starts.union(ends)
    found = []
    for k, names in enumerate(levels):
        # a run of m lines is two names of the largest power of two up to m, the second one ending with the run
        width = 1 << k
        own = spans.where(F.col("n_lines").between(width, 2 * width - 1)).join(names.toDF(*OTHER, "first"), _same(PLACE, OTHER)).drop(*OTHER)
        if k:
            own = own.withColumn("tail", F.col("line") + F.col("n_lines") - width)
            own = own.join(names.toDF(*OTHER, "second"), _same(["doc_id", "text_key", "tail"], OTHER)).drop(*OTHER, "tail")
        else:
            own = own.withColumn("second", F.col("first"))
        found.append(_earliest(stored(own, "runs"), ["n_lines", "first", "second"], "source").where(F.col("source") < F.struct(*PLACE)).select(*PLACE, "n_lines", "source"))
    return stored(reduce(DataFrame.union, found), "found")


def dedup_lines(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """``docs`` with the text that is left, and ``n_lines`` (not blank), ``n_removed`` and ``removed_at`` (line numbers
    from 0 in the whole text). Columns of these names in ``docs`` are replaced."""
    lines = stored(line_table(docs, min_chars), "lines")
    found = repeated_runs(lines, min_chars)
    covered = found.select("doc_id", "text_key", F.explode(F.sequence("line", F.col("line") + F.col("n_lines") - 1)).alias("line")).toDF(*OTHER).distinct()
    gone = covered.join(lines.select(*PLACE, "at"), _same(PLACE, OTHER)).groupBy(*OTHER[:2]).agg(F.sort_array(F.collect_list("at")).alias("o_gone"))
    source = docs.drop("n_lines", "n_removed", "removed_at", *OTHER, "o_gone", "o_text").withColumn("o_text", F.xxhash64("text"))
    joined = source.join(gone, _same(["doc_id", "o_text"], OTHER[:2]), "left")
    parts = split_lines(F.col("text"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("o_gone")), lambda i: F.get(parts, i))
    return joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(parts, lambda x: ~_blank(x)))).cast("long"),
            "n_removed": F.coalesce(F.size("o_gone"), F.lit(0)).cast("long"),
            "removed_at": F.coalesce("o_gone", F.array().cast("array<int>")),
            "text": F.when(F.col("o_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        }
    ).drop(*OTHER, "o_gone", "o_text")
