"""The tagger against enumeration of all tag sequences, and held-out accuracy of the scores."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemill.llm import crf, toxicity
from phrasemill.llm.queries import op3_toxicity

SF = "/root/testdata/sf0.01"


def enumerated(emit, step, first):
    n = len(emit)
    total, mass, between = 0.0, np.zeros(n), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=n):
        score = first[tags[0]] + sum(emit[i] * t for i, t in enumerate(tags))
        score += sum(step[a, b] for a, b in itertools.pairwise(tags))
        p = np.exp(score)
        total += p
        mass += p * np.array(tags)
        for a, b in itertools.pairwise(tags):
            between[a, b] += p
    return mass / total, np.log(total), between / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = [5, 1, 3]
    rows, cols = crf.windows(lengths)
    emit, real = np.zeros((3, crf.WINDOW)), np.zeros((3, crf.WINDOW), bool)
    values = rng.normal(0, 2, sum(lengths))
    emit[rows, cols], real[rows, cols] = values, True
    step, first = rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    tagged, log_total, between = crf.marginals(emit, real, step, first, pairs=True)
    parts = [enumerated(emit[i, :n], step, first) for i, n in enumerate(lengths)]
    for i, (n, part) in enumerate(zip(lengths, parts, strict=True)):
        assert tagged[i, :n] == pytest.approx(part[0])
    assert log_total == pytest.approx(sum(p[1] for p in parts))
    assert between == pytest.approx(sum(p[2] for p in parts))


def test_windows_start_new_rows():
    rows, cols = crf.windows([crf.WINDOW + 1, 0, 2])
    assert rows.tolist() == [0] * crf.WINDOW + [1, 2, 2] and cols[-3:].tolist() == [0, 0, 1]


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_toxicity(spark, SF).collect()
    assert len(rows) == len(texts)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    caught = [r for r in held if labels[r.doc_id] and r.predicted]
    wrong = [r for r in held if not labels[r.doc_id] and r.predicted]
    assert len(caught) >= 0.75 * sum(labels[r.doc_id] for r in held) and len(wrong) <= 1
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert all(0 <= s.start < s.end <= len(texts[r.doc_id]) for s in r.spans)
    assert {texts[r.doc_id][r.spans[0].start : r.spans[0].end].lower() for r in caught if r.spans} & {"idiot", "moron"}


def test_edges(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learn(docs, labels)
    odd = spark.createDataFrame(
        [(1, "", "a"), (2, None, None), (3, "you idiot, you moron! " * 3, "b"), (3, "you idiot, you moron! " * 3, "b"),
         (None, "the on " * 100_000, "c"), (5, "İİİ idiot moron scum", "d")],
        "doc_id bigint, text string, score string",
    )
    rows = toxicity.score(odd, model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 6 and by[1].score == by[2].score < 0.7 and by[3].score >= 0.7 and by[None].score < 0.7
    assert by[3].spans[0].start == 4 and by[5].spans
    assert toxicity.score(odd.where(F.lit(False)), model).count() == 0
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None
    assert toxicity.learn(docs.where(F.lit(False)), labels) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
