"""Packing against a search through all bins, and what every packing must keep."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from phrasemill.llm import packing
from phrasemill.llm.queries import op2_best_fit_packing

SF = "/root/testdata/sf0.01"


def plain(items, capacity):
    used, sources, clusters, out = [], [], [], []
    for n, source, cluster in items:
        fits = [(capacity - used[b] - n, b) for b in range(len(used))
                if used[b] + n <= capacity and not sources[b] & source and not clusters[b] & cluster]
        if fits:
            b = min(fits)[1]
        else:
            b = len(used)
            used.append(0)
            sources.append(0)
            clusters.append(0)
        used[b] += n
        sources[b] |= source
        clusters[b] |= cluster
        out.append(b)
    return out


def test_tightest_compatible_bin():
    rng = random.Random(4)
    for _ in range(60):
        items = [(rng.randrange(1, 101), 1 << rng.randrange(8), rng.choice((0, 0, 1, 2, 4))) for _ in range(120)]
        assert packing.best_fit(items, 100) == plain(items, 100)


def check(rows, docs, capacity):
    """docs: (doc_id, length, source, cluster) of rows with a length."""
    about = {d[0]: d for d in docs}
    pieces, held = defaultdict(list), defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            pieces[r.doc_id].append((r.start, r.n_tokens))
            held[r.bin_id].append(r)
    for doc_id, n, _, _ in docs:
        at = 0
        for start, length in sorted(pieces[doc_id]):
            assert start == at and 0 < length <= capacity
            at += length
        assert at == (n or 0)
    for rs in held.values():
        assert sum(r.n_tokens for r in rs) <= capacity
        for k in (2, 3):
            known = [about[r.doc_id][k] for r in rs if about[r.doc_id][k] is not None]
            assert len(known) == len(set(known))
    return len(held)


def test_table(spark):
    rows = op2_best_fit_packing(spark, SF).collect()
    docs = [(r.doc_id, len(r.text.split()), r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    total = sum(d[1] for d in docs)
    assert check(rows, docs, packing.CAPACITY) <= 1.25 * total / packing.CAPACITY + 1


def test_hot_source_and_edges(spark):
    rng = random.Random(7)
    docs = [(i, rng.choice((None, 0, 3, 40, 99, 100, 101, 250)), "hot" if i % 3 else f"s{i % 20}", rng.choice((None, "a", "b", f"c{i}")))
            for i in range(700)] + [(900, 60, None, None), (901, 40, None, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, n_tokens int, source string, cluster string").withColumn("bin_id", F.lit("x"))
    rows = packing.pack(df, capacity=100, lot=64).collect()
    check(rows, docs, 100)
    assert {r.doc_id for r in rows} == {d[0] for d in docs}
    assert sum(r.bin_id is None for r in rows) == sum(not d[1] for d in docs)
    free = packing.pack(df, source=None, cluster=None, capacity=100).collect()
    assert len({r.bin_id for r in free}) < len({r.bin_id for r in rows})
    same = spark.createDataFrame([(1, 5, "s", "c")] * 4 + [(None, 5, "s", None)], df.drop("bin_id").schema)
    assert len({r.bin_id for r in packing.pack(same).collect()}) == 5
    assert packing.pack(df.where(F.lit(False))).count() == 0
    full = packing.bins(packing.pack(df, capacity=100)).collect()
    assert all(r.n_tokens == sum(s.n_tokens for s in r.spans) for r in full)


def test_the_same_rows_give_the_same_bins(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 700 + 1).alias("n_tokens"),
                                  (F.col("id") % 5).alias("source"), F.lit(None).alias("cluster"))
    one, two = (sorted(map(tuple, packing.pack(df).collect())) for _ in "ab")
    assert one == two
    assert pytest.approx(sum(r[3] for r in one)) == df.agg(F.sum("n_tokens")).first()[0]


def test_near_copies_never_share_a_bin(spark, tmp_path):
    words = [f"word{i}" for i in range(60)]
    near = [" ".join(words), " ".join([*words[:-1], "other"]), "  ".join(words).upper(), "\n".join(words[1:])]
    docs = [(i, text, f"s{i}") for i, text in enumerate(near)] + [(None, " ".join([*words, "more"]), "s8"), (9, "some different text of its own", "s9")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op2_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(rows) == 6 and sum(r.n_tokens for r in rows) == sum(len(d[1].split()) for d in docs)
    assert len({r.bin_id for r in rows if r.doc_id != 9}) == 5
    assert len({r.bin_id for r in rows}) == 5
