"""Scores against a plain bigram model, and whether they tell the target from the rest."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phrasemill.llm import lm_score
from phrasemill.llm.queries import op6_lm_scoring

SF = "/root/testdata/sf0.001"


def plain(rows, size):
    """rows: (text, target); the score of each text."""
    low = lambda t: (t or "").encode().lower().split()
    counts = Counter(w for t, _ in rows if t is not None for w in low(t))
    vocab = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: size - lm_score.CLASSES - 1]}
    code = lambda t: ["<s>", *(w if w in vocab else lm_score.word_class(w) for w in low(t))]
    kinds = len(vocab) + 1 + lm_score.CLASSES

    def model(texts):
        pairs, alone, before = Counter(), Counter(), Counter()
        for t in texts:
            c = code(t)
            for a, b in zip(c, c[1:], strict=False):
                pairs[a, b] += 1
                alone[b] += 1
                before[a] += 1
        total = sum(alone.values()) + kinds

        def loss(a, b):
            one = (alone[b] + 1) / total
            if not before[a]:
                return -math.log2(one)
            return -math.log2(lm_score.PAIR_WEIGHT * pairs[a, b] / before[a] + (1 - lm_score.PAIR_WEIGHT) * one)

        return loss

    target = model([t for t, y in rows if y and t is not None])
    whole = model([t for t, _ in rows if t is not None])
    out = []
    for t, _ in rows:
        c = code(t)
        gaps = [target(a, b) - whole(a, b) for a, b in zip(c, c[1:], strict=False)]
        out.append(sum(gaps) / len(gaps) if gaps else None)
    return out


def test_against_plain_version(spark):
    rows = [(r.doc_id, r.text, r.lang == "fr") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(-1, None, True), (-2, "", False), (-3, "  ", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, target boolean").withColumn("score", F.lit("x"))
    model = lm_score.learn(df, size=400)
    got = {r.doc_id: r.score for r in lm_score.score(df, model).collect()}
    for (doc_id, _, _), want in zip(rows, plain([r[1:] for r in rows], 400), strict=True):
        assert got[doc_id] == (None if want is None else pytest.approx(want, abs=1e-5))
    fr = [got[r[0]] for r in rows if r[2] and r[0] > 0]
    rest = [got[r[0]] for r in rows if r[2] is False and r[0] > 0]
    assert sorted(fr)[len(fr) * 9 // 10] < sorted(rest)[len(rest) // 10]


def test_query_covers_all_rows(spark):
    rows = op6_lm_scoring(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.n_tokens > 0 and math.isfinite(r.score) for r in rows)


def test_edges(spark):
    df = spark.createDataFrame([("a b", False), (None, True)], "text string, target boolean")
    for rows in (df, df.where(F.lit(False))):
        out = lm_score.score(df, lm_score.learn(rows)).collect()
        assert out[0].n_tokens == 2 and math.isfinite(out[0].score) and out[1].score is None
    assert lm_score.score(df.where(F.lit(False)), lm_score.learn(df)).count() == 0


def test_every_word_counts_as_itself(spark):
    """Rare words of one length and ending, far beyond any fixed vocabulary, still tell texts apart."""
    rows = [(i, " ".join(f"w{i * 40 + k:06d}xx" for k in range(40)) + (" goodterm" if i % 2 else " badtermxx"), i % 2 == 1) for i in range(200)]
    rows += [(1000, "qqqaaaxx qqqcccxx qqqaaaxx", True), (1001, "qqqbbbxx qqqdddxx qqqbbbxx", False), (1002, None, True), (1003, "", False)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, target boolean")
    model = lm_score.learn(df, kept=["doc_id"])
    own = {r.doc_id: r.score for r in lm_score.score_learned(model, ["doc_id"]).collect()}
    other = {r.doc_id: r.score for r in lm_score.score(df, model).collect()}
    assert own[1000] < own[1001] and own[1002] is None and own[1003] is None and len(own) == len(rows)
    for (doc_id, _, _), want in zip(rows, exact([r[1:] for r in rows]), strict=True):
        for got in (own, other):
            assert got[doc_id] == (None if want is None else pytest.approx(want, abs=1e-9))


def exact(rows):
    """The score of each text under models over all words."""
    low = lambda t: (t or "").encode().lower().split()
    kinds = len({w for t, _ in rows for w in low(t)}) + 2
    models = []
    for kind in (True, False):
        pairs = Counter(p for t, y in rows if y or not kind for p in zip(["<s>", *low(t)], low(t), strict=False))
        alone, before = Counter(), Counter()
        for (a, b), n in pairs.items():
            alone[b] += n
            before[a] += n
        models.append((pairs, alone, before, sum(alone.values()) + kinds))

    def loss(model, a, b):
        pairs, alone, before, total = model
        one, weight = (alone[b] + 1) / total, lm_score.PAIR_WEIGHT if before[a] else 0
        return -math.log2((weight * pairs[a, b] / before[a] if weight else 0) + (1 - weight) * one)

    out = []
    for t, _ in rows:
        gaps = [loss(models[0], a, b) - loss(models[1], a, b) for a, b in zip(["<s>", *low(t)], low(t), strict=False)]
        out.append(sum(gaps) / len(gaps) if gaps else None)
    return out
