"""Language identification by rank-order profiles of character n-grams.

A profile is the ranked list of the most frequent n-grams of a language. A document is given the
language whose profile is nearest to the document's own ranked list by the out-of-place distance:
the sum, over the document's n-grams, of the difference of the two ranks, or ``size`` where the
profile lacks the n-gram.

N-grams have one to three code points. They are taken from the lower-cased text in which every
run of non-letters is one space, with a space at both ends; a space may only stand first or last,
so no n-gram spans two words. Ties in frequency go to the smaller n-gram code.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.llm.common import bound_batches, slices

#: Ranks in a profile, of a language and of a document.
SIZE = 400
UNDETERMINED = "und"
#: Distinct n-grams a task holds before it passes its counts on.
HELD = 1_000_000
SPACE = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_codes(text: str | None) -> np.ndarray:
    """All n-grams of a text as integers: 21 bits a code point. Empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    line = np.full(len(points) + 2, SPACE, np.int64)
    line[1:-1][letter] = points[letter]
    blank = line == SPACE
    line = line[~blank | np.append(True, ~blank[:-1])]
    one = line[line != SPACE]
    two = (line[:-1] << 21) | line[1:]
    inner = line[1:-1] != SPACE
    three = ((line[:-2] << 42) | (line[1:-1] << 21) | line[2:])[inner]
    return np.concatenate([one, two, three])


def ranked(codes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent codes, most frequent first, smaller code first on ties."""
    values, counts = np.unique(codes, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:size]]


def _merge(old: tuple | None, codes: np.ndarray, counts: np.ndarray) -> tuple:
    if old is not None:
        codes, counts = np.concatenate([old[0], codes]), np.concatenate([old[1], counts])
    values, where = np.unique(codes, return_inverse=True)
    return values, np.bincount(where, weights=counts, minlength=len(values)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple] = {}

    def flush():
        for lang, (codes, counts) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                names=["lang", "code", "n"],
            )
        held.clear()

    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
        for start, end in slices(texts):
            own = langs[start:end]
            for lang in set(own):
                codes = np.concatenate([gram_codes(texts[start + i]) for i in np.flatnonzero(own == lang)])
                held[lang] = _merge(held.get(lang), *np.unique(codes, return_counts=True))
            if sum(len(codes) for codes, _ in held.values()) > HELD:
                yield from flush()
    yield from flush()


def learn(df: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> DataFrame:
    """Profiles ``(lang, code, place)`` from every row with a language and a text.

    Counts cover all rows. Tasks sum up what they read, so the shuffle carries distinct n-grams
    and the ranking sees at most ``size`` rows of a language from each task.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    counts = (
        rows.mapInArrow(_count, "lang string, code bigint, n bigint")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return (
        counts.withColumn("rank", F.row_number().over(by_rank))
        .where(F.col("rank") <= size)  # on the rank itself, so that tasks drop what cannot be in it
        .select("lang", "code", (F.col("rank") - 1).alias("place"))
    )


class Profiles:
    """The profiles of all languages as one table of ranks: a row for each n-gram of any profile."""

    def __init__(self, rows, size: int = SIZE):
        self.size = size
        self.langs = sorted({r["lang"] for r in rows})
        self.codes = np.array(sorted({r["code"] for r in rows}), np.int64)
        self.places = np.full((len(self.codes), len(self.langs)), -1, np.int32)
        for r in rows:
            self.places[np.searchsorted(self.codes, r["code"]), self.langs.index(r["lang"])] = r["place"]

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The nearest language and its score: 1 at distance 0, 0 if no n-gram is shared.

        Equal distances go to the language first in order of code points.
        """
        own = ranked(gram_codes(text), self.size)
        if not len(own) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        there = self.places[at]
        found = (self.codes[at] == own)[:, None] & (there >= 0)
        out = np.where(found, np.abs(there - np.arange(len(own))[:, None]), self.size).sum(axis=0)
        best = int(np.argmin(out))
        return self.langs[best], 1.0 - float(out[best]) / (self.size * len(own))


def identify(df: DataFrame, profiles: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row.

    ``profiles`` holds at most ``size`` rows a language and goes to the tasks whole. A null text,
    one without a letter, or an empty set of profiles gives ``und`` with score 0. Columns of the
    input with these two names are replaced; all others, nulls and repeated rows included, stay.
    """
    bound_batches(df.sparkSession)
    known = Profiles(profiles.collect(), size)
    shared = df.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("lang_pred string, score double")
    def near(series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.nearest(t) for t in series], columns=["lang_pred", "score"])

    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    return (
        df.withColumn("_near", near(F.col(text)))
        .select(*[F.col(f"`{c}`") for c in kept], "_near.lang_pred", "_near.score")
    )
