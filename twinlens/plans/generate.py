"""Distributed text generation with a pluggable generator, and token probabilities."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.vectors import let

# Longest wait, wait after a timeout, first waits after a rate limit and another error.
LONGEST, TIMEOUT_WAIT, RATE_START, ERROR_START = 60.0, 5.0, 2.0, 1.0


class Generator(Protocol):
    """``images`` holds None where a row has no image: such a prompt is text only."""

    def generate(self, prompts: Sequence[str], images: Sequence[bytes | None]) -> list[str]: ...


class EchoGenerator:
    """Deterministic stand-in for a model: the last word of the prompt, marked when text only."""

    def generate(self, prompts, images):
        return [("" if i is not None else "text:") + p.split(" ")[-1] for p, i in zip(prompts, images)]


def wait_seconds(error: str, attempt: int) -> float:
    """Exponential after a rate limit or an unknown error, constant after a timeout."""
    if "429" in error:
        return min(LONGEST, RATE_START * 2 ** (attempt - 1))
    if "timeout" in error.lower():
        return TIMEOUT_WAIT
    return min(LONGEST, ERROR_START * 2 ** (attempt - 1))


def _answers(generator: Generator, prompts: list, images: list, tries: int, pause: float):
    """(answers, error, attempts): a batch that fails to the end gives empty answers."""
    error = None
    for attempt in range(1, tries + 1):
        try:
            return generator.generate(prompts, images), None, attempt
        except Exception as e:  # noqa: BLE001 - any failure of a model call is an answer row
            error = str(e)
            if attempt < tries:
                time.sleep(pause * wait_seconds(error, attempt))
    return [""] * len(prompts), error, tries


def generate(
    df: DataFrame,
    keep: Sequence[str],
    make: Callable[[], Generator],
    prompt: str,
    image: str | None = None,
    batch: int = 4,
    tries: int = 1,
    pause: float = 1.0,
    partitions: int | None = None,
) -> DataFrame:
    """``keep`` plus raw_answer, error and attempts. ``pause`` scales the waits of a retry;
    ``partitions`` spreads the rows first, for models that are slow against a shuffle."""
    inputs = [prompt] + ([image] if image else [])
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make()
        for frame in frames:
            prompts, images = frame[prompt].tolist(), [None] * len(frame)
            if image:
                images = [None if x is None or isinstance(x, float) else bytes(x) for x in frame[image]]
            texts, errors, attempts = [], [], []
            for at in range(0, len(prompts), batch):
                part = prompts[at : at + batch]
                answers, error, tried = _answers(generator, part, images[at : at + batch], tries, pause)
                texts += answers
                errors += [error] * len(part)
                attempts += [tried] * len(part)
            yield frame[list(keep)].assign(raw_answer=texts, error=errors, attempts=attempts)

    schema = f"{kept}, raw_answer string, error string, attempts int"
    rows = df.select(*keep, *[c for c in inputs if c not in keep])
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, schema)


def token_probability(scores: Column, token: str) -> Column:
    """Softmax probability of an answer token in a map of token scores: the largest over
    the plain, blank-led and newline-led forms that are single tokens, null if none is."""
    # scores are shifted by the largest, and the sum is bound once for the three lookups
    values = F.map_values(scores)
    forms = F.array(*[F.element_at(scores, lead + token) for lead in ("", " ", "\n")])

    def share(top):
        total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return F.array_max(F.transform(F.array_compact(forms), lambda x: F.exp(x - top))) / total

    return let(F.array_max(values), share)
