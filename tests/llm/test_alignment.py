"""The alignment against a plain loop over the same two libraries."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from phrasemill.llm import alignment
from phrasemill.llm.common import stage
from phrasemill.llm.queries import op11_token_alignment
from phrasemill.llm.token_counts import byte_letters

SF = "/root/testdata/sf0.001"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def groups_of(text, libraries):
    a, b = libraries
    letters = byte_letters()
    spell_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))

    def spell_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    if not text:
        return []
    left = [(i, spell_a(i)) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, spell_b(i)) for i in b.encode(text)]
    whole = (" " + text).encode()
    if b"".join(s for _, s in left) != whole or b"".join(s for _, s in right) != whole:
        return []
    out, x, y, at = [], 0, 0, 0
    while x < len(left):
        ga, gb, ea, eb = [], [], at, at
        while not ga or ea != eb:
            if ea <= eb:
                ga.append(left[x][0])
                ea += len(left[x][1])
                x += 1
            else:
                gb.append(right[y][0])
                eb += len(right[y][1])
                y += 1
        out.append((ga, gb))
        at = ea
    return out


def brute(texts, libraries):
    groups = [groups_of(t, libraries) for t in texts]
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in groups]
    held = Counter(p for one in links for p in one)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for g, one in zip(groups, links, strict=True):
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(one.values()),
            sum(n for p, n in one.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in one.items()),
            hashlib.sha256(line.encode()).hexdigest() if g else "",
        ))
    return out


def values(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


def test_table(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], brute([r.text for r in docs], libraries), strict=True))
    got = op11_token_alignment(spark, SF).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: values(r) for r in got} == want


EDGES = [
    None, "", " ", "a", "  two  spaces ", "marked ▁ here", "<|endoftext|> <s> </s> <unk> <0x41>", "né 日本語 😀 \x00 end", "\n\n\t x",
    "a" * 5000, "ab " * 4000, "İıſ ǅ ﬁ", "日本" * 2000, "same", "same",
]


@pytest.mark.parametrize("lane, wide, expanded", [(1024, 1 << 14, 1 << 21), (7, 1, 50)])
def test_edges(spark, libraries, monkeypatch, lane, wide, expanded):
    """Small limits give the same results; repeated rows are documents of their own."""
    encoders = alignment.Encoders(*alignment._files(spark.range(1), *FILES).value)
    monkeypatch.setattr(alignment, "LANE", lane)
    monkeypatch.setattr(alignment, "WIDE", wide)
    monkeypatch.setattr(alignment, "EXPANDED", expanded)
    one = alignment.Aligned(encoders, EDGES)
    codes, weights = one.pairs()
    for d, text in enumerate(EDGES):
        groups = groups_of(text, libraries)
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        mine = codes >> 2 * alignment.BITS == d
        got = {((c >> alignment.BITS) & 0x1FFFFF, c & 0x1FFFFF): w for c, w in zip(codes[mine].tolist(), weights[mine].tolist(), strict=True)}
        assert one.groups()[d].decode() == line
        assert got == links
        assert (one.n_a[d], one.n_b[d], one.n_groups[d]) == (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups))


def test_a_document_longer_than_a_slice(spark, libraries, monkeypatch):
    text = " ".join(f"word{i} größer" for i in range(9000))
    df = spark.createDataFrame([(1, text), (2, "größer")], "doc_id bigint, text string")
    got = {r.doc_id: values(r) for r in alignment.align(df, *FILES).collect()}
    assert [got[1], got[2]] == brute([text, "größer"], libraries)


def test_frames(spark, libraries):
    """Nulls, repeated rows, clashing and repeated names; no rows at all."""
    rows = [(i, t, "x", i, None) for i, t in enumerate(EDGES)] + [(None, "same", None, 1, 2.5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, chunk string, n_a int, docs double").toDF("doc_id", "text", "chunk", "n_a", "doc_id")
    out = alignment.align(df, *FILES)
    assert out.columns == ["doc_id", "chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = Counter((r[0], r[1], r[2], *values(r)) for r in out.collect())
    assert got == Counter((r[0], r[2], r[4], *w) for r, w in zip(rows, brute([r[1] for r in rows], libraries), strict=True))
    empty = alignment.align(df.toDF("doc_id", "text", "chunk", "n_a", "x").where("false"), *FILES)
    assert empty.collect() == []


def test_a_chunk_is_read_alone(spark, libraries, monkeypatch):
    """A task reads one chunk at a time, however many chunks the task that wrote them had."""
    staged = []
    monkeypatch.setattr(alignment, "CHUNK", 50)
    monkeypatch.setattr(alignment, "SLICE", 20)
    monkeypatch.setattr(alignment, "stage", lambda *a, **b: staged.append(stage(*a, **b)) or staged[-1])
    texts = [f"größer than {i}, the same" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: values(r) for r in alignment.align(df, *FILES).collect()}
    assert [got[i] for i in range(40)] == brute(texts, libraries)
    files = [pq.ParquetFile(f).metadata for f in Path(staged[0]._staged_at).glob("*.parquet")]
    rows = [m.num_rows for m in files]
    assert max(rows) > 5 and [m.num_row_groups for m in files] == rows


def test_alignments_are_the_text_behind_the_digest(spark, libraries):
    df = spark.createDataFrame(list(enumerate(EDGES)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in alignment.alignments(df, *FILES).collect()}
    for (n_a, n_b, n_groups, n_links, _, _, digest), (i, text) in zip(brute(EDGES, libraries), enumerate(EDGES), strict=True):
        r = rows[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.text) == (n_a, n_b, n_groups, n_links, text)
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == digest


def test_lockstep_is_the_common_ends():
    rng = np.random.default_rng(1)
    a, b = (np.unique(np.append(rng.integers(1, 5000, 1500), 5000)) for _ in range(2))
    for lane in (1, 13, 5000):
        starts = np.arange(0, 5000, lane)
        i, j = alignment.lockstep(a, b, starts, np.minimum(starts + lane, 5000))
        assert a[i - 1].tolist() == b[j - 1].tolist() == np.intersect1d(a, b).tolist()


def test_fast_encoder_is_proven(spark):
    ranks, odd = alignment._proven(open(FILES[0], encoding="utf-8").read())
    assert len(ranks) == 50256
    import regex

    assert not regex.search(odd, "plain ascii, größer, señor, œuvre – “x” …")
    assert regex.search(odd, "日")
