"""Rank-order profiles against a plain version with counters."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phrasemill.llm import langid
from phrasemill.llm.queries import op10_language_id

SF = "/root/testdata/sf0.001"


def grams(text):
    line = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    line = re.sub(" +", " ", line)
    if line == " ":
        return []
    out = []
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if " " not in g[1:-1] and g.strip():
                out.append(g)
    return out


def code(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def top(counter):
    return [g for g, _ in sorted(counter.items(), key=lambda x: (-x[1], code(x[0])))[: langid.SIZE]]


def plain(rows):
    learned = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            learned.setdefault(r.lang, Counter()).update(grams(r.text))
    profiles = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in learned.items()}
    out = {}
    for r in rows:
        own = top(Counter(grams(r.text)))
        if not own:
            out[r.doc_id] = ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else langid.SIZE for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        out[r.doc_id] = (best, 1 - far[best] / (langid.SIZE * len(own)))
    return out


def test_against_plain_version_and_truth(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = op10_language_id(spark, SF).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    truth = {r.doc_id: r.lang for r in rows}
    held = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, "the thing and that", "en", "x"), (2, None, "en", "x"), (3, "123 !?", None, "x"), (4, "", "fr", "x"),
         (5, "été à la", "fr", "x"), (None, "la été", None, None), (5, "été à la", "fr", "x"),
         (7, "the " * 200_000, "en", "x")],
        "doc_id bigint, text string, lang string, score string",
    )
    out = langid.identify(docs, langid.learn(docs))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = sorted((r.doc_id or 0, r.lang_pred) for r in out.collect())
    assert got == [(0, "fr"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "fr"), (5, "fr"), (7, "en")]
    empty = docs.where(F.lit(False))
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(empty)).collect()} == {"und"}
    assert langid.identify(empty, langid.learn(docs)).count() == 0
