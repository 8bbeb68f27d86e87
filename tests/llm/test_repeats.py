"""Suffix arrays against sorting, removal against a set of all stretches."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from phrasemill.llm import repeats, suffixes
from phrasemill.llm.queries import op12_suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("buckets", [1 << 10, 0])
def test_suffix_arrays_and_common_prefixes(monkeypatch, buckets):
    monkeypatch.setattr(suffixes, "BUCKETS", buckets)
    rng = random.Random(1)
    for turn in range(250):
        letters = rng.choice([1, 2, 3, 8])
        text = [rng.randrange(1, letters + 1) for _ in range(rng.randrange(60))]
        text = (text * 6 if turn % 5 == 0 else text) + [0]
        values = np.array(text, np.int64)
        array = suffixes.suffix_array(values, letters + 1)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert array.tolist() == want
        shared = [0] * len(text)
        for x, y in zip(want, want[1:], strict=False):
            while x + shared[y] < len(text) and y + shared[y] < len(text) and text[x + shared[y]] == text[y + shared[y]]:
                shared[y] += 1
        for most in (5, 1000):
            assert suffixes.common_prefixes(values, array, most).tolist() == [min(v, most) for v in shared]


def brute(rows):
    """Results by (doc_id, text), each such pair being one document."""
    place = lambda r: (r[0] is None, r[0] or 0, r[2])
    seen, out = set(), {}
    for doc_id, text, _ in sorted({(i, t, h) for i, t, h in rows}, key=place):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - repeats.LENGTH + 1):
            stretch = raw[i : i + repeats.LENGTH]
            if stretch in seen:
                gone[i : i + repeats.LENGTH] = b"\1" * repeats.LENGTH
            seen.add(stretch)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id, text] = (len(raw), len(raw) - len(kept), spans, kept)
    return out


def hashed(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    h = F.coalesce(F.xxhash64("text"), F.lit(0)).bitwiseAND(0xFFFFFFFF)
    return df, [(r.doc_id, r.text, r.h) for r in df.select("doc_id", "text", h.alias("h")).collect()]


def same(spark, rows, parts=3):
    df, known = hashed(spark, rows)
    want = brute(known)
    got = repeats.remove_repeats(df.repartition(parts).selectExpr("doc_id", "text", "text AS t")).collect()
    assert Counter((r.doc_id, r.t, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter(
        (i, t, *want[i, t]) for i, t, _ in known
    )


def made(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    line = " ".join(rng.choice(words) for _ in range(12))
    shared = [" ".join(rng.choice(words) for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice([*shared, line, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))]) for _ in range(rng.randrange(6))]
        text = "".join(p + rng.choice([" ", "", "\n"]) for p in parts)
        rows.append((i * 7 - 20, text))
    copies = [(1000 + k, rows[5][1]) for k in range(40)] + [(2000 + k, rows[9][1] + " " + str(k)) for k in range(40)]
    return rows + copies


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    _, known = hashed(spark, rows)
    want = {i: v for (i, _), v in brute(known).items()}
    got = op12_suffix_dedup(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        size, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, removed, spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_lines_and_passages(spark, seed):
    same(spark, made(seed, 120))


def test_edges(spark):
    long = " ".join(f"item {i * i}" for i in range(30_000))
    shift = "".join(chr(97 + i % 23) for i in range(99))
    rows = [
        (None, long), (None, None), (None, long[:500]), (1, ""), (2, None), (3, "a" * 5000), (4, "a" * 150), (4, "b" * 99), (4, "b" * 100),
        (5, "x" + "b" * 100), (6, shift + "Q"), (7, "Z" + shift + "Q"), (7, "Z" + shift + "Q"), (8, "日本" * 60), (9, "本" + "日本" * 60),
        (10, "ab" * 200 + "c"), (11, long[1000:3000]), (-5, long[2000:4000]), (12, "\x00" * 300),
    ]
    same(spark, rows)


def test_small_shards_arrays_and_flushes_change_nothing():
    """The stages in this process, where their limits can be set."""
    import pyarrow as pa

    rows = [(i, t, i * 31 % 1009) for i, t in made(3, 80)] + [(None, made(3, 80)[3][1], 7)]
    want = {(i, h): (size, removed, spans) for (i, t, h) in rows for size, removed, spans, _ in [brute(rows)[i, t]]}
    for flush, array, shards, share in ((1 << 24, 1 << 20, 1, 1 << 16), (500, 2000, 5, 1 << 16), (4000, 1, 3, 200)):
        found = run(rows, pa, flush, array, shards, share)
        for i, t, h in rows:
            gone = bytearray(len(t.encode()))
            for a, b in found.get((i, h), []):
                gone[a : b + repeats.LENGTH] = b"\1" * (b + repeats.LENGTH - a)
            assert len(gone) == len(t.encode()) and sum(gone) == want[i, h][1]


def run(rows, pa, flush, array, shards, share):
    old = repeats.FLUSH, repeats.ARRAY
    repeats.FLUSH, repeats.ARRAY = flush, array
    try:
        data, _ = repeats._buffer([t for _, t, _ in rows])
        cells = np.bincount((repeats.grams(data) >> np.uint64(44)).astype(np.int64), minlength=repeats.CELLS)

        class Shared:
            value = np.packbits(cells * share > cells.sum()).tobytes()

        batches = [
            pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in part], pa.int64()), "hash": pa.array([r[2] for r in part], pa.int64()), "text": [r[1] for r in part]})
            for part in (rows[k::4] for k in range(4))
        ]
        dealt = [b for k in range(4) for b in repeats._dealt(Shared, shards)(iter([batches[k]]))]
        found = {}
        for s in range(shards):
            mine = [b for b in dealt if b["shard"][0].as_py() == s]
            if mine:
                for r in repeats._sorted_out(pa.Table.from_batches(mine)).to_pylist():
                    found.setdefault((r["doc_id"], r["hash"]), []).append((r["start"], r["stop"]))
        return found
    finally:
        repeats.FLUSH, repeats.ARRAY = old


def test_clashing_names_and_no_rows(spark):
    rows = made(5, 30)
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id bigint, text string, kept string, start int, hash int").toDF(
        "doc_id", "text", "kept", "start", "start"
    )
    out = repeats.remove_repeats(df)
    assert out.columns == ["doc_id", "start", "start", "n_bytes", "n_removed", "n_spans", "kept"]
    _, known = hashed(spark, rows)
    want = {i: v for (i, _), v in brute(known).items()}
    assert {r[0]: (r[3], r[4], r[5], bytes(r[6])) for r in out.collect()} == want
    assert repeats.remove_repeats(df.where("false")).collect() == []
