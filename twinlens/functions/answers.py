"""Generated answers to labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that name the two classes, tried in this order.
AUTHENTICITY_WORDS = (("0", "fake"), ("1", "real"))
RETINOPATHY_WORDS = (
    ("0", "no diabetic retinopathy|no dr|negative"),
    ("1", "diabetic retinopathy|dr|positive"),
)
# The datasets with words of their own.
DATASET_WORDS: Mapping[str, tuple] = {"fakeddit": AUTHENTICITY_WORDS, "brset": RETINOPATHY_WORDS, "mbrset": RETINOPATHY_WORDS}

LEADING_NUMBER = r"^\s*([+-]?\d+(?:\.\d+)?)\b"


def _clean(answer: Column) -> Column:
    return F.lower(F.trim(answer))


def _quoted(label: Column) -> Column:
    """Regular-expression text that matches the label literally."""
    return F.regexp_replace(F.lower(label), r"([^\p{L}\p{N}_\s])", r"\\$1")


def strict_label(answer: Column, labels: Column, dataset: str | None = None) -> Column:
    """A leading number that is a label, then the words of the dataset, then the first label
    (in the order of the array ``labels``) that occurs as a whole word; else null."""
    text = _clean(answer)
    number = F.regexp_extract(text, LEADING_NUMBER, 1)
    steps = [F.when(number != "", F.get(F.filter(labels, lambda x: F.lower(x) == number), F.lit(0)))]
    for label, words in DATASET_WORDS.get((dataset or "").lower(), ()):
        steps.append(F.when(text.rlike(rf"\b({words})\b"), F.lit(label)))
    whole = F.filter(labels, lambda x: F.rlike(text, F.concat(F.lit(r"(^|\W)"), _quoted(x), F.lit(r"(\W|$)"))))
    steps.append(F.get(whole, F.lit(0)))
    return F.coalesce(*steps)


def substring_label(answer: Column, labels: Column) -> Column:
    """First label whose text occurs anywhere in the answer, else the first label."""
    text = F.lower(answer)
    return F.coalesce(F.get(F.filter(labels, lambda x: F.contains(text, F.lower(x))), F.lit(0)), F.get(labels, F.lit(0)))


def inverted_label(answer: Column) -> Column:
    """Answers to the prompt with swapped meanings: a leading 0 is 1 and a leading 1 is 0,
    then the word real is 1 and fake is 0; else null."""
    text = _clean(answer)
    digit = F.regexp_extract(text, r"^\s*([01])\b", 1)
    return (
        F.when(digit == "0", 1)
        .when(digit == "1", 0)
        .when(text.rlike(r"\breal\b"), 1)
        .when(text.rlike(r"\bfake\b"), 0)
    )


def named_labels(answer: Column, names: Sequence[str]) -> list[Column]:
    """One 0/1 column per name that occurs in the answer."""
    text = F.lower(answer)
    return [F.contains(text, F.lit(n.lower())).cast("int").alias(n) for n in names]


def vocabulary_labels(answer: Column, vocabulary: Column) -> Column:
    """0/1 per entry of the vocabulary array that occurs in the answer."""
    text = F.lower(answer)
    return F.transform(vocabulary, lambda w: F.contains(text, F.lower(w)).cast("int"))
