"""Phrase mining against plain counting of every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, difference

from phrasemill.llm import collocations as c
from phrasemill.llm.queries import ORACLE, op13_phrase_collocations

SF = "/root/testdata/sf0.001"


def pieces_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
        yield [w for w in re.split("[ \t]+", piece) if w]


def brute(rows, least, top):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            total[lang] += len(w)
            for n in range(1, 5):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        covered = {
            p[i : i + n] for p, a in cand.items() for n in range(2, len(p)) for i in range(len(p) - n + 1)
            if 100 * a >= 80 * count[p[i : i + n]]
        }
        scored = []
        for p, a in cand.items():
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            if p not in covered:
                scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, x, y) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, total[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed, n=400):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "né", "x", "日本", "the", "of", "a-b", "q"]
    seps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r", "\x0b"]
    line = "One two three four five. "
    return [
        ("".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(30))) + line * rng.randrange(2),
         rng.choice(["en", "de", None, "und", ""]))
        for _ in range(n)
    ]


def test_table_against_sql(spark):
    assert difference(op13_phrase_collocations(spark, SF), connect(SF), ORACLE["op13_phrase_collocations"]) == ""


@pytest.mark.parametrize("bits, proposed", [(1 << 20, 2), (1 << 6, 2), (1 << 20, 10**9)])
def test_every_bitmap_and_sample_gives_the_same(spark, monkeypatch, bits, proposed):
    """Also a full bitmap, and nothing proposed, so that passes over the border find everything."""
    monkeypatch.setattr(c, "PROPOSED", proposed)
    rows = made(1) + [(None, "en"), ("", "de"), ("...", "de"), (None, None)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = rows_of(c.collocations(df, least=5, top=40, bits=bits))
    assert got == brute(rows, 5, 40) and got


def test_long_text_ties_and_repeated_rows(spark):
    long = " ".join(f"w{i % 7} w{i % 3}" for i in range(60_000))
    rows = [(long, "en")] + [("same pair here", "fr"), ("other pair here", "fr")] * 6
    df = spark.createDataFrame(rows, "text string, lang string")
    assert rows_of(c.collocations(df, least=6)) == brute(rows, 6, 2000)


def test_clashing_names_and_no_rows(spark):
    rows = made(2, 100)
    df = spark.createDataFrame([(t, lang, 1, "p", 2) for t, lang in rows], "text string, lang string, n int, phrase string, key int")
    df = df.toDF("text", "lang", "n", "phrase", "n")
    assert rows_of(c.collocations(df, least=5)) == brute(rows, 5, 2000)
    assert c.collocations(df.where("false"), least=5).collect() == []


def test_words_of_a_buffer():
    texts = [t or "" for t, _ in made(3, 50)] + ["", " ", "end", "a\tb  c"]
    words = c.Words([t.encode() for t in texts], np.arange(len(texts)).astype(np.uint64))
    want = [(i, w) for i, t in enumerate(texts) for piece in pieces_of(t) for w in piece]
    got = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert list(zip(words.lang.tolist(), got, strict=True)) == want
    pairs = [" ".join(p[i : i + 2]) for t in texts for p in pieces_of(t) for i in range(len(p) - 1)]
    assert c._strings(words, words.phrases(2), 2).to_pylist() == pairs
    empty = c.Words([b""], np.zeros(1, np.uint64))
    assert len(empty.phrases(1)) == len(empty.phrases(4)) == 0


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = [(t or "").encode() for t, _ in made(4, 30)]
    langs = np.zeros(len(texts), np.uint64)
    whole = c.Words(texts, langs)
    monkeypatch.setattr(c, "BLOCK", 16)
    assert (c.Words(texts, langs).first == whole.first).all()


def test_phrases_with_one_hash_are_told_apart():
    words = c.Words([b"a b a b b a"], np.zeros(1, np.uint64))
    i = words.phrases(1)
    at, count = c._equal(np.zeros(len(i), np.uint64), c.SECOND.words(words.data, words.starts, words.ends), i, 1)
    assert sorted(zip(c._strings(words, at, 1).to_pylist(), count.tolist(), strict=True)) == [("a", 3), ("b", 3)]


def test_the_expansion_counts_what_the_full_pass_left_out():
    batch = pa.RecordBatch.from_pydict({"text": ["w x y z"], "lang": ["en"]})
    words = c.Words([b"w x y z"], np.array([c._lang_key("en")], np.uint64))

    def bitmap(*phrases):
        out = np.zeros(1 << 10, np.uint64)
        for i, n in phrases:
            bit = int(words.hashes(np.array([i]), n)[0]) & ((1 << 16) - 1)
            out[bit >> 6] |= np.uint64(1 << (bit & 63))
        return out

    class Shared:
        def __init__(self, *value):
            self.value = value

    def counted(*bitmaps):
        return sorted(r["key"].removesuffix("\nen") for b in c._counted(Shared(*map(c._closed, bitmaps)))(iter([batch])) for r in b.to_pylist())

    proposed = bitmap((1, 1), (2, 1))  # x and y
    assert counted(proposed, None) == ["", "w", "x", "x y", "y", "z"]
    # w fails: what holds it and nothing infrequent (z; x y was counted) comes now
    assert counted(proposed, bitmap((0, 1), (1, 1), (2, 1))) == ["w x"]
    assert counted(proposed, bitmap((0, 1), (1, 1), (2, 1), (1, 2))) == ["w x", "w x y"]
    assert counted(proposed, bitmap((0, 1), (1, 1), (2, 1), (3, 1), (1, 2))) == ["w x", "w x y", "w x y z", "x y z", "y z"]
    assert counted(proposed, proposed) == []
