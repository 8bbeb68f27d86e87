"""Toxic spans by a linear-chain CRF, and document scores from its marginals.

Labels are given for documents, the tagger needs them for tokens. A token of a toxic document is
labelled toxic where the documents that hold its word are toxic more often than not: the share is
smoothed from the word back over its prefixes to the share of all documents, so an unseen word is
judged by its beginning. The CRF learns words, prefixes and the order of tags from these tokens;
forward-backward marginals of a document's tokens give the features of a logistic document score.

Everything is learned from a sample of at most ``max_labelled`` labelled rows (those of smallest
hash), which is small enough for one broadcast of ids; word statistics cover the whole sample and
are counted in Spark. Scoring reads every text whole.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm import crf
from phrasemill.llm.common import bound_batches, slices, stage

MAX_LABELLED = 20_000
#: Windows of tokens that the CRF is fitted on; those of smallest hash.
MAX_WINDOWS = 8_000
#: A clean window in so many is kept for the fit; windows with a toxic token all are.
CLEAN_SHARE = 40
PREFIXES = (7, 6, 5, 4, 3)
#: Rows that the smoothing of a share weighs as much as.
PRIOR_ROWS = 3.0
#: Least log-likelihood ratio of a word or prefix that counts as a sign.
EVIDENCE = 15.0
THRESHOLD = 0.7
#: Keys that a task counts until it sends them, and words whose values it keeps; workers keep this memory.
HELD, RECENT = 150_000, 60_000
WORD = re.compile(r"\w+")
SCORES = "score double, n_toxic double, spans array<struct<start:int,end:int,prob:double>>"


def keys(word: str) -> list[str]:
    """A word and its proper prefixes, the word first; prefixes end in a dash."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies = Counter(), Counter()

    def flush():
        names = [*tallies[0], *(k for k in tallies[1] if k not in tallies[0])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([t[k] for k in names], pa.int64()) for t in reversed(tallies))],
            names=["key", "toxic", "clean"],
        )
        for t in tallies:
            t.clear()

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = set(WORD.findall(text.lower()))
            tallies[label].update({k for w in words for k in keys(w)})
            if sum(map(len, tallies)) > HELD:
                yield from flush()
    yield from flush()


@dataclass
class Signs:
    """Share of toxic documents by word and prefix."""

    rate: float
    counts: dict[str, tuple[int, int]]

    def share(self, word: str) -> float:
        value = self.rate
        for key in reversed(keys(word)):
            toxic, clean = self.counts.get(key, (0, 0))
            value = (toxic + PRIOR_ROWS * value) / (toxic + clean + PRIOR_ROWS)
        return value


def signs(sample: DataFrame) -> Signs:
    """Count the documents of each word and prefix, and keep what says something about toxicity.

    Kept are keys of strong evidence and, of every other key that starts like one of them, the
    frequent ones. Both sets come from the bounded sample.
    """
    total = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic or not clean:
        return Signs(0.0 if clean or not toxic else 1.0, {})
    rate = toxic / (toxic + clean)
    counts = stage(
        sample.select("text", "label").mapInArrow(_count_keys, "key string, toxic bigint, clean bigint")
        .groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic + clean >= 3"),
        "toxic-keys",
    )
    n = F.col("toxic") + F.col("clean")
    gain = lambda part, of: F.when(part > 0, part * F.log(part / (n * F.lit(of)))).otherwise(0.0)
    strong = counts.where((2 * (gain(F.col("toxic"), rate) + gain(F.col("clean"), 1 - rate)) >= EVIDENCE)
                          & (F.col("toxic") >= 2 * rate * n))
    found = {r["key"]: (r["toxic"], r["clean"]) for r in strong.collect()}
    starts = counts.sparkSession.createDataFrame([(s,) for s in sorted({k[:3] for k in found})], "start string")
    near = counts.join(F.broadcast(starts), F.substring("key", 1, 3) == F.col("start"), "left_semi")
    return Signs(rate, {r["key"]: (r["toxic"], r["clean"]) for r in near.collect()} | found)


def _windows(known: Signs):
    """A task that cuts sample texts into windows and tags their tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = lru_cache(maxsize=RECENT)(known.share)
        for batch in batches:
            words_out, tags_out = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                for i in range(0, len(words), crf.WINDOW):
                    part = words[i : i + crf.WINDOW]
                    words_out.append(part)
                    tags_out.append([int(label == 1 and share(w) >= 0.5) for w in part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(words_out, pa.list_(pa.string())), pa.array(tags_out, pa.list_(pa.int64()))],
                names=["words", "tags"],
            )

    return cut


@dataclass
class Model:
    """Weights of the tagger by feature, and of the document score."""

    weight: dict[str, float]
    bias: float
    step: np.ndarray
    first: np.ndarray
    logit: np.ndarray = field(default_factory=lambda: np.zeros(6))

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weight.get(k, 0.0) for k in keys(word))


def fit_tagger(sample: DataFrame, known: Signs, max_windows: int = MAX_WINDOWS) -> Model:
    """Fit the CRF on windows with toxic tokens and a share of the others."""
    cut = sample.select("text", "label").mapInArrow(_windows(known), "words array<string>, tags array<bigint>")
    rank = F.xxhash64("words", "tags")
    chosen = (
        cut.where(F.array_contains("tags", 1) | (F.pmod(rank, F.lit(CLEAN_SHARE)) == 0))
        .withColumn("rank", F.xxhash64(rank)).orderBy("rank", "words").limit(max_windows)
        .select("words", "tags").collect()
    )
    # features: the bias and every key that the statistics know
    names = {k: i + 1 for i, k in enumerate(sorted(known.counts))}
    flat, owner, gold = array("i"), array("i"), array("i")
    for row in chosen:
        for word, tag in zip(row["words"], row["tags"], strict=True):
            ids = [0, *(names[k] for k in keys(word) if k in names)]
            flat.extend(ids)
            owner.extend([len(gold)] * len(ids))
            gold.append(tag)
    weight, step, first = crf.fit(
        np.array(flat), np.array(owner), [len(r["words"]) for r in chosen], np.array(gold), len(names) + 1
    )
    return Model({k: float(weight[i]) for k, i in names.items()}, float(weight[0]), step, first)


class Tagger:
    """Applies a model to texts; keeps emissions of recent words."""

    def __init__(self, model: Model):
        self.model = model
        self.emission = lru_cache(maxsize=RECENT)(model.emission)

    def tag(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """The lower-cased words of each text and the marginal chance of each to be toxic."""
        words = [WORD.findall((t or "").lower()) for t in texts]
        lengths = [len(w) for w in words]
        rows, cols = crf.windows(lengths)
        n = int(rows.max()) + 1 if len(rows) else 0
        emit, real = np.zeros((n, crf.WINDOW)), np.zeros((n, crf.WINDOW), bool)
        if n:
            emit[rows, cols] = np.fromiter((self.emission(w) for ws in words for w in ws), float, sum(lengths))
            real[rows, cols] = True
            chance = crf.marginals(emit, real, self.model.step, self.model.first)[rows, cols]
        else:
            chance = np.empty(0)
        ends = np.cumsum(lengths)
        return [(w, chance[end - len(w) : end]) for w, end in zip(words, ends, strict=True)]


def features(words: list[str], chance: np.ndarray) -> np.ndarray:
    """What the document score looks at: sum, most, count, distinct words and density of tags."""
    if not len(words):
        return np.array([1.0, 0, 0, 0, 0, 0])
    hit = np.flatnonzero(chance > 0.5)
    kinds = len({words[i] for i in hit})
    total = float(chance.sum())
    return np.array([1.0, np.log1p(total), float(chance.max()), np.log1p(len(hit)), np.log1p(kinds),
                     np.log1p(100 * total / len(words))])


def parts(texts: list[str | None], chars: int = 1 << 19) -> Iterator[list[str | None]]:
    for start, end in slices(texts, chars):
        yield texts[start:end]


def fit_score(sample: DataFrame, model: Model, rounds: int = 25, l2: float = 1e-2) -> Model:
    """Logistic regression on the tag features of the sample, six numbers a row, by Newton steps."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            rows = [features(*x) for part in parts(batch.column("text").to_pylist()) for x in tagger.tag(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tolist() for r in rows], pa.list_(pa.float64())), batch.column("label").cast(pa.int64())],
                names=["x", "y"],
            )

    rows = sample.select("text", "label").mapInArrow(read, "x array<double>, y bigint").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), 6)
    y = np.array([r["y"] for r in rows], float)
    w = np.zeros(6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - l2 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(6)
        w = w + np.linalg.solve(bend, slope)
    model.logit = w
    return model


def learn(df: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fit tagger and score from ``df(doc_id, text)`` and ``labels(doc_id, toxic)``.

    A document labelled twice is toxic if any label says so; null labels and texts do not count.
    Without both kinds of labels there is nothing to learn and None is returned.
    """
    bound_batches(df.sparkSession)
    marks = (
        labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    marks = stage(marks, "toxic-labels")
    # at most max_labelled pairs of numbers
    sample = stage(
        df.select("doc_id", "text").where("text is not null").join(F.broadcast(marks), "doc_id").select("text", "label"),
        "toxic-sample",
    )
    known = signs(sample)
    if not known.counts:
        return None
    return fit_score(sample, fit_tagger(sample, known))


def score(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``score``, ``n_toxic`` (expected toxic tokens) and ``spans`` to every row.

    Spans are runs of neighbouring tokens of chance over a half, with offsets in code points
    (end exclusive) and their largest chance. Null and empty texts get the score of no token;
    without a model every score is 0. Columns of the input with these names are replaced.
    """
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCORES)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        tagger = Tagger(known) if known else None
        for series in batches:
            out = []
            for part in parts(series.tolist()):
                if tagger is None:
                    out += [(0.0, 0.0, [])] * len(part)
                    continue
                for text, (words, chance) in zip(part, tagger.tag(part), strict=True):
                    value = 1 / (1 + np.exp(-np.clip(features(words, chance) @ known.logit, -30, 30)))
                    out.append((float(value), float(chance.sum()), spans(text, chance)))
            yield pd.DataFrame(out, columns=["score", "n_toxic", "spans"])

    kept = [c for c in df.columns if c not in ("score", "n_toxic", "spans")]
    return df.withColumn("_judged", judge(F.col(text))).select(
        *[F.col(f"`{c}`") for c in kept], "_judged.score", "_judged.n_toxic", "_judged.spans"
    )


def spans(text: str | None, chance: np.ndarray) -> list[dict]:
    hit = chance > 0.5
    if not hit.any():
        return []
    found: list[dict] = []
    last = -2
    # lower-casing may change lengths, so words are looked up in the text itself where counts agree
    places = list(WORD.finditer(text))
    if len(places) != len(chance):
        places = list(WORD.finditer(text.lower()))
    for i in np.flatnonzero(hit):
        start, end, prob = places[i].start(), places[i].end(), float(chance[i])
        if i == last + 1:
            found[-1] |= {"end": end, "prob": max(found[-1]["prob"], prob)}
        else:
            found.append({"start": start, "end": end, "prob": prob})
        last = i
    return found
