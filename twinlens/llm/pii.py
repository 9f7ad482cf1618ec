"""Personal data: exact base kinds, and further spans that boosted trees select among high-recall candidates.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of fixed patterns, less those that fail their check
(parts up to 255, Luhn, number of digits). They always stay. Further generators propose spans that the base patterns miss:
spelled-out addresses (``spelled``), numbers in groups without a plus sign (``number``) and long mixed strings (``secret``).

Method. Every candidate, base ones and those that failed their check included, has eight small features of its format and its
context. A candidate counts as personal data for the training if it passed its check or a cue word with a sign of assignment stands
right before it, or it is an address spelled with brackets; both count as its ``cue``. The table of (features, count, positives) over all documents has at most ``CELLS`` rows by construction; boosted trees are
fitted on it and become a CASE expression, so scoring is plain SQL. Documents of odd hash are kept from the fit and give, for each
generator, the lowest score with a precision of ``precision``. Of the candidates that lie in no base span those with a cue are always added, as they
are positive themselves however many others look like them; those without one are added if their score is not below that of their generator.

The patterns are the stated ones in a form with the same matches that never backtracks over a long run: possessive repeats, and a match
may begin inside a run only where the match before has ended.

Defined cases: a null text is empty and has no span; repeated rows give repeated results; empty tables give none; with no candidates
nothing is added; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.llm import boosting
from twinlens.session import stored

BASE = ["email", "ip", "card", "phone"]
MORE = ["spelled", "number", "secret"]
#: The base patterns, and those of the generators.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]++ ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z]{2,}+",
    "number": r"(?<![0-9A-Za-z+])(?<![0-9][.,\x20-])\(?[0-9]{2,5}\)?(?:[\x20.-]?[0-9]{2,5}){1,4}(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[0-9A-Za-z]{20,}+",
}
#: A character that every match has, so that other texts are not searched.
NEEDS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9]", "phone": "[+][0-9]", "spelled": "(?: |[{(\\[])at(?: |[})\\]])", "number": "[0-9][0-9]", "secret": "[0-9]"}
CUE = r"(?i)(?:mail|tel|phone|fax|mobile|card|iban|account|ip|host|token|key|secret|password|passwd|pwd)\w*[\"']?\s{0,2}[:=]\s{0,2}[\"'(<]?$"
#: A spelled address that needs no cue.
BRACKETS = r"[\[({](?:at|dot)[\])}]"
KINDS = BASE + MORE
FEATURES = ["kind", "digits", "length", "letters", "marks", "before", "after", "cue"]
SIZES = [7, 8, 8, 3, 8, 5, 5, 2]
#: Bound of the table that reaches the driver.
CELLS = int(np.prod(SIZES))


def _found(kind: str) -> Column:
    """Array of (start, end, body, before, after) of all matches in ``text``; positions in code points."""
    text, pattern = F.col("text"), PATTERN[kind]
    gaps, bodies = F.col(f"gaps_{kind}"), F.col(f"bodies_{kind}")
    rows = F.zip_with(F.arrays_zip(F.slice(gaps, 1, F.size(bodies)).alias("gap"), F.slice(gaps, 2, F.size(bodies)).alias("next")), bodies, lambda g, b: F.struct(g["gap"].alias("gap"), g["next"].alias("next"), b.alias("body")))
    none = F.array().cast("array<struct<s:int,e:int,body:string,before:string,after:string>>")

    def step(acc, x):
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["body"])
        one = F.struct(start.alias("s"), end.alias("e"), x["body"].alias("body"), F.right(x["gap"], F.lit(24)).alias("before"), F.left(x["next"], F.lit(1)).alias("after"))
        return F.struct(end.alias("pos"), F.array_append(acc["out"], one).alias("out"))

    return F.aggregate(rows, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])


def _passes(kind: str, body: Column) -> Column:
    digits = F.regexp_replace(body, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return body.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        number = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
        return F.length(digits).between(13, 19) & (F.aggregate(number, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(False)


def _side(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike(r"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]$"), 3).otherwise(4)


def _bucket(n: Column, bounds: list[int]) -> Column:
    out = F.lit(len(bounds))
    for k, b in reversed(list(enumerate(bounds))):
        out = F.when(n <= b, k).otherwise(out)
    return out


def _features(kind: str, x: Column) -> Column:
    body = x["body"]
    digits, letters = F.length(F.regexp_replace(body, "[^0-9]", "")), F.length(F.regexp_replace(body, "[^A-Za-z]", ""))
    marks = F.length(F.regexp_replace(body, "[^ ().-]", ""))
    return F.struct(
        x["s"].alias("s"),
        x["e"].alias("e"),
        F.lit(KINDS.index(kind)).alias("kind"),
        _bucket(digits, [0, 4, 6, 8, 10, 12, 15]).alias("digits"),
        _bucket(F.length(body), [8, 12, 16, 20, 28, 36, 48]).alias("length"),
        F.when(letters == 0, 0).when(letters < digits, 1).otherwise(2).alias("letters"),
        F.least(marks, F.lit(7)).alias("marks"),
        _side(F.right(x["before"], F.lit(1))).alias("before"),
        _side(x["after"]).alias("after"),
        (x["before"].rlike(CUE) | (body.rlike(BRACKETS) if kind == "spelled" else F.lit(False))).cast("int").alias("cue"),
        _passes(kind, body).alias("passed"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, ``odd`` (kept from the fit) and ``found``, all candidates with features."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        has = F.col("text").rlike(NEEDS[kind])
        df = df.withColumns(
            {f"bodies_{kind}": F.when(has, F.regexp_extract_all("text", F.lit(PATTERN[kind]), F.lit(0))).otherwise(none)}
        ).withColumns({f"gaps_{kind}": F.when(F.size(f"bodies_{kind}") > 0, F.split("text", PATTERN[kind], -1)).otherwise(none)})
    odd = (F.pmod(F.xxhash64("text", F.lit(9)), F.lit(2)) == 1).alias("odd")
    df = df.select("doc_id", odd, *[_found(k).alias(k) for k in KINDS])
    return df.select("doc_id", "odd", F.concat(*[F.transform(k, partial(_features, k)) for k in KINDS]).alias("found"))


def _case(forest: boosting.Forest, at: str) -> str:
    """The margin of a forest as a SQL expression over the fields of ``at``."""

    def node(t: int, i: int) -> str:
        inner = forest.feature.shape[1]
        if i >= inner:
            return f"{forest.value[t, i - inner]:.9f}D"
        if forest.threshold[t, i] == 255:
            return node(t, 2 * i + 1)
        return f"if({at}.{FEATURES[forest.feature[t, i]]} <= {forest.threshold[t, i]}, {node(t, 2 * i + 1)}, {node(t, 2 * i + 2)})"

    return " + ".join([f"{forest.base:.9f}D", *(node(t, 0) for t in range(len(forest.feature)) if forest.value[t].any())])


def fit(found: DataFrame, precision: float = 0.9, trees: int = 12, depth: int = 3) -> tuple[boosting.Forest, dict[int, float]]:
    """Trees over the counted cells of even documents, and the lowest margin of each generator that holds the precision on odd ones, for
    candidates without a cue."""
    cell = found.select("odd", F.explode("found").alias("x")).select("odd", *[F.col(f"x.{c}") for c in FEATURES], (F.col("x.passed") | (F.col("x.cue") == 1)).cast("int").alias("y"))
    table = cell.groupBy("odd", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).toPandas()
    bins = table[FEATURES].to_numpy(np.uint8).reshape(-1, len(FEATURES))
    n, good = table["n"].to_numpy(float), table["y"].to_numpy(float)
    train = ~table["odd"].to_numpy(bool)
    # the cue gives the label, so the trees see only the formats that it goes with: they are for candidates that have none
    seen = bins.copy()
    seen[:, FEATURES.index("cue")] = 0
    both = np.concatenate([seen[train], seen[train]])
    forest = boosting.fit(both, np.repeat([1.0, 0.0], train.sum()), np.concatenate([good[train], (n - good)[train]]), trees, depth, rate=0.5)
    margin, limits = forest.margin(seen), {}
    for kind in range(len(BASE), len(KINDS)):
        own = ~train & (bins[:, 0] == kind)
        order = np.argsort(-margin[own], kind="stable")
        hits, all_ = good[own][order].cumsum(), n[own][order].cumsum()
        last = np.append(np.diff(margin[own][order]) != 0, True)[: len(order)]
        fine = np.flatnonzero((hits >= precision * all_) & last)
        if len(fine):
            limits[kind] = float(margin[own][order][fine[-1]])
    return forest, limits


def find(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """A row for each row of ``docs``: doc_id and ``spans``, an array of (kind, s, e, base) by kind and start."""
    found = stored(candidates(docs), "candidates")
    forest, limits = fit(found, precision)
    base = F.filter("found", lambda x: x["passed"])
    df = found.withColumn("base", base)
    chosen = F.filter("found", lambda x: (x["kind"] >= len(BASE)) & ~F.exists("base", lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"])))
    scored = df.select("doc_id", "base", chosen.alias("more"))
    above = " or ".join(f"(x.kind = {k} and {_case(forest, 'x')} >= {least - 1e-6:.9f}D)" for k, least in limits.items()) or "false"
    scored = scored.withColumn("more", F.expr(f"filter(more, x -> x.cue = 1 or {above})"))
    name = F.array(*[F.lit(k) for k in KINDS])
    as_span = lambda flag: lambda x: F.struct(x["kind"].alias("rank"), x["s"].alias("s"), x["e"].alias("e"), F.get(name, x["kind"]).alias("kind"), F.lit(flag).alias("base"))
    return scored.select("doc_id", F.array_sort(F.concat(F.transform("base", as_span(True)), F.transform("more", as_span(False)))).alias("spans"))


def redact(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """``docs`` with each span of its text replaced by ``<kind>``; overlapping spans go together, under the first one's kind.

    The found spans are joined by document id and text, so repeated rows are redacted alike."""
    spans = find(docs.select("doc_id", "text").distinct().withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("k"))), precision)
    spans = spans.select(F.col("doc_id.doc_id").alias("o_id"), F.col("doc_id.k").alias("o_key"), F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))).alias("o_spans"))

    def step(acc, x):
        clear = x["s"] >= acc["pos"]
        gap = F.substring(F.col("text"), acc["pos"] + 1, x["s"] - acc["pos"])
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(clear, F.concat(acc["out"], gap, F.lit("<"), x["kind"], F.lit(">"))).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate("o_spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["pos"] + 1, F.length("text"))))
    out = docs.join(spans, docs["doc_id"].eqNullSafe(F.col("o_id")) & (F.xxhash64(docs["text"]) == F.col("o_key")), "left")
    return out.withColumn("text", F.when(F.size("o_spans") > 0, whole).otherwise(F.col("text"))).drop("o_id", "o_key", "o_spans")
