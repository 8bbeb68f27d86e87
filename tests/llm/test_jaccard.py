"""The similarity join against the comparison of all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasemill.llm import jaccard
from phrasemill.llm.components import components
from phrasemill.llm.queries import op7_ngram_jaccard_join
from phrasemill.llm.shingles import shingle_set, shingle_sets, shingle_texts, word_counts, words

SCHEMA = "doc_id bigint, text string, component_id string"


def plain_set(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain(rows):
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = {}
    for i, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        met = {}
        for g in s:
            for j in at[g]:
                if j > i:
                    met[j] = met.get(j, 0) + 1
        for j, both in met.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_tables(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    want = plain([tuple(r) for r in rows])
    assert len({c for _, _, c in want}) < len(rows)
    assert result(op7_ngram_jaccard_join(spark, path)) == want


def test_edited_copies_around_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for base in range(6):
        text = [f"w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(40):
            own = list(text)
            for _ in range(rng.choice((0, 1, 2, 3, 4, 5))):
                own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                own = own[: rng.randrange(90, 120)]
            rows.append((len(rows) + 1000, " ".join(own), str(base)))
    shared = " ".join(f"s{i}" for i in range(30))
    rows += [(len(rows) + 1000, shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(20)), None) for _ in range(60)]
    rng.shuffle(rows)
    got = result(jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows)


def test_last_pass_alone_and_leaders_alone_agree(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 7, 60 + i % 5)), None) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    for share in (-1, 1e9):
        monkeypatch.setattr(jaccard, "OPEN_PAIRS", share)
        assert result(jaccard.near_duplicates(df)) == plain(rows)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "One two", "a"), (5, "one TWO", "a"), (5, "one TWO", "a"),
            (6, "one two three", "a"), (7, long, "a"), (8, long + " y", "a"), (9, "É b c d e f", "a"), (10, "é b c d e f", "a"),
            (11, "p q r s t u", "a"), (12, "other words of this row", "a"), (12, "p q r s t u", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert dict((i, c) for i, _, c in result(jaccard.near_duplicates(df))) == {
        1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11, 12: 11}
    assert jaccard.near_duplicates(df.where(F.lit(False))).count() == 0
    alone = spark.createDataFrame([(None, "a b", None), (3, "a b", None), (None, "c", None)], SCHEMA)
    assert sorted(map(str, (r.component_id for r in jaccard.near_duplicates(alone).collect()))) == ["3", "3", "None"]


def test_values_stand_for_words():
    for text in ("a b c d e f a b c d e f g", "  x\ty \x0bz\x0c ", "one", "", None, "Ünï ünï " * 40, "w" * 1000 + " " + "w" * 999):
        assert len(shingle_set(text)) == len(shingle_texts(text)) == len(plain_set(text))
    assert words("Aé É\xa0B") == ["aé".encode(), "É\xa0b".encode()]


def test_suffix_filter_never_drops_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        common = rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64) * np.uint64(2)
        x, y = (np.unique(np.append(common, rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64))) for _ in "ab")
        if jaccard.linked(set(x.tolist()), set(y.tolist())):
            assert jaccard.may_link(x, y, 80)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 299), (299, 300)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {299: 299, 300: 299}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_common_passage_makes_no_pairs_without_a_sketch(spark, monkeypatch):
    rng = random.Random(9)
    passage = " ".join(f"s{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(120)), None) for i in range(60)]
    rows += [(60 + i, " ".join(f"t{j}" for j in range(i % 3, 80)), None) for i in range(9)]
    compared, links = [], jaccard._links

    def count(pairs, *rest):
        compared.append(pairs.count())
        return links(pairs, *rest)

    monkeypatch.setattr(jaccard, "frequencies", lambda *_: np.zeros((2, jaccard.CELLS), np.uint32))
    monkeypatch.setattr(jaccard, "_links", count)
    assert result(jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert sum(compared) <= 9


def test_a_long_word_leaves_the_other_words_as_they_are(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, None), (2, text + " " + "q" * 5000, None), (3, text + " " + "q" * 9000, None)]
    assert len(np.intersect1d(shingle_set(rows[0][1]), shingle_set(rows[1][1]))) == 76
    assert len(shingle_set("q" * 5000 + "r" + "q" * 4095 + " " + "q" * 9096, 1)) == 2
    assert result(jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_texts_of_a_column_are_cut_as_each_alone():
    rng = random.Random(2)
    texts = ["", None, "a", " ", "a b", "b", "x" * 70_000, "Ünï A", "é\n"]
    texts += [" ".join(rng.choice(("a", "B", "cc", "é")) for _ in range(rng.randrange(30))) for _ in range(9000)]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["z", *texts, "z"]).slice(1, len(texts))):
        found = []
        for first, last, values, bounds in shingle_sets(column):
            assert first == len(found) and len(bounds) == last - first + 1
            found += np.split(values, bounds[1:-1])
        assert [v.tolist() for v in found] == [shingle_set(t).tolist() for t in texts]
        assert word_counts(column).tolist() == [len(words(t)) for t in texts]
    assert list(shingle_sets(pa.array([], pa.string()))) == [] and not len(word_counts(pa.array([], pa.string())))


def test_only_prefix_shingles_of_two_rows_are_joined(spark):
    own = [[i << 40 | 7 for i in range(1 + 100 * k, 60 + 100 * k)] for k in range(30)]
    rows = [(k, 300, bytes([k]), [-5 - k, *p] if k % 3 else [*p, -1 << 62]) for k, p in enumerate(own)] + [(90, 0, b"z", [])]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint, digest binary, prefix array<bigint>").repartition(4)
    met = spark.sparkContext.broadcast(jaccard._shared(df, 80))
    kept = df.mapInArrow(jaccard._thinned(met), "doc_id bigint, n bigint, digest binary, pos array<bigint>, h array<bigint>").collect()
    held = {(r.doc_id, p, h) for r in kept for p, h in zip(r.pos, r.h, strict=True)}
    assert {(k, 59, -1 << 62) for k in range(0, 30, 3)} <= held
    assert {k for k, p, h in held if h == -1 << 62} == set(range(0, 30, 3)) and all(rows[k][3][p] == h for k, p, h in held)


def test_parities_never_rule_out_a_link_and_spare_texts(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(200), k // 3):
            own[at] = f"v{k} {at}"
        texts.append(" ".join(own))
    rows = spark.createDataFrame(enumerate(texts), "node bigint, text string")
    texts_of = rows.withColumn("odd", F.arrow_udf(lambda t: jaccard.parities(t), "array<bigint>")("text"))
    pairs = spark.createDataFrame([(a, b) for b in range(60) for a in range(b)], "a bigint, b bigint")
    left = {tuple(r) for r in jaccard._near(pairs, texts_of, 80).collect()}
    sets = [shingle_texts(t) for t in texts]
    links = {(a, b) for b in range(60) for a in range(b) if jaccard.linked(sets[a], sets[b])}
    assert links <= left and len(left - links) < 0.2 * (1770 - len(links))
    assert {tuple(r) for r in jaccard._links(pairs, texts_of, 80, 5).collect()} == links
    assert jaccard.parities(pa.array([None, "a"])).to_pylist()[0] == [0] * 17


def test_a_bitmap_takes_few_jobs_however_many_partitions(spark, monkeypatch):
    rows = [(i, 9, bytes([i]), [i << 40, -7]) for i in range(90)]
    df = spark.createDataFrame(rows, "node bigint, n bigint, digest binary, prefix array<bigint>").repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        for made, group in ((lambda: jaccard._wanted(df.select("node")), "wanted"), (lambda: jaccard._shared(df, 80), "shared")):
            spark.sparkContext.setJobGroup(group, group)
            assert made().any()
            assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 10
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)


def test_values_of_words_of_every_length():
    texts = ["a", "a\0", "\0", "\0\0"] + ["x" * n for n in (*range(2, 40), 255, 256, 257, 300, 5000)]
    texts += ["x" * n + "y" for n in (7, 8, 15, 16, 247, 255, 256, 299)] + ["y" + "x" * n for n in (7, 8, 256)]
    values = [shingle_set(t).tolist() for t in texts]
    assert len({v for v, in values}) == len(texts)
    assert [shingle_set(t.upper()).tolist() for t in texts] == values
    assert [shingle_set(f"one {t} two", 1).tolist() for t in texts] == [
        sorted(shingle_set("one").tolist() + shingle_set("two").tolist() + v) for v in values]
