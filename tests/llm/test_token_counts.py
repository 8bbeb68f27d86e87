"""Counts against the library itself."""

import random
import sys

import public_tokenizers
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from phrasemill.llm import token_counts
from phrasemill.llm.queries import op8_token_counts

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_table(spark):
    library = Tokenizer.from_file(FILE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)


def test_pre_tokens_agree_but_for_the_odd_code_points():
    odd = {i for a, b in token_counts.odd_ranges() for i in range(a, b + 1)}
    assert not any(i < 0x250 for i in odd) and len(odd) < 50_000
    library, cut = pre_tokenizers.ByteLevel(add_prefix_space=False), regex.compile(token_counts.PATTERN)
    points = [chr(i) for i in range(sys.maxunicode + 1) if i not in odd and not 0xD800 <= i <= 0xDFFF]
    random.Random(2).shuffle(points)
    for start in range(0, len(points), 20_000):
        text = "".join(c + " " * (i % 3 == 0) for i, c in enumerate(points[start : start + 20_000]))
        assert [m.span() for m in cut.finditer(text)] == [span for _, span in library.pre_tokenize_str(text)]


def test_whole_tokens_are_proven():
    library = Tokenizer.from_file(FILE)
    whole = token_counts.whole_tokens(library)
    assert 40_000 < len(whole) < 50_257 and " the" in whole and "<|endoftext|>" not in whole


def test_odd_texts(spark):
    library = Tokenizer.from_file(FILE)
    rng = random.Random(1)
    letters = "abcXYZ 0129  \n\t'!?.é漢字🙂  \u0085ßſ's're"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["", None, "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "word " * 50_000, "x" * 3000, "don't we'll", "   ", "<|endoftext"]
    texts += [f"a{chr(a)} {chr(b)}b" for a, b in token_counts.odd_ranges()[:50]]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id int, text string, n_tokens string")
    out = token_counts.add_token_counts(df, FILE)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    for r in out.collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids), repr(r.text)[:80]
    assert token_counts.add_token_counts(df.where(F.lit(False)), FILE).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 1)
    library = Tokenizer.from_file(FILE)
    counter = token_counts.Counter(library.to_str(), token_counts.whole_tokens(library), [])
    for text in ("qwertz asdfgh", "yxcvbn qwertz zzzzq", "asdfgh"):
        assert counter.count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_a_slice_larger_than_the_cache(monkeypatch):
    library = Tokenizer.from_file(FILE)
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counter = token_counts.Counter(library.to_str(), token_counts.whole_tokens(library), [])
    for turn in range(3):
        texts = [f"qzx{turn}{i} wvk{i}j " * 2 for i in range(20)]
        assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
