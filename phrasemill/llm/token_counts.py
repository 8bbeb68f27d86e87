"""Token counts of whole texts with a whole-token shortcut.

A byte-level BPE tokenizer first cuts a text into pre-tokens and merges the bytes of each. Before
the job every string of the vocabulary is encoded alone; those that give exactly their own one
token are proven whole tokens. A pre-token among them counts one without any merging, and only the
others go through the library, each distinct one once while it is remembered.

A text that holds the string of an added token is counted by the library as it is, because added
tokens are cut out before pre-tokens are. So is a text with a code point that the library's Unicode
tables class otherwise than ours; every code point is compared before the job.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from phrasemill.llm.common import slices

LIMIT = 1024
#: Merged pre-tokens a task remembers before it starts anew.
REMEMBERED = 400_000
#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """The texts that are proven to be one token: each vocabulary string is encoded alone."""
    to_byte = byte_letters()
    texts, ids = [], []
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            texts.append(bytes(to_byte[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # no whole characters: such a token never is a pre-token
        ids.append(number)
    alone = regex.compile(PATTERN)
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(
        text for text, number, code in zip(texts, ids, found, strict=True)
        if code.ids == [number] and alone.findall(text) == [text]
    )


def _agrees(text: str, cut: regex.Pattern, library: pre_tokenizers.ByteLevel) -> bool:
    return [m.span() for m in cut.finditer(text)] == [span for _, span in library.pre_tokenize_str(text)]


@lru_cache(maxsize=1)
def odd_ranges() -> list[tuple[int, int]]:
    """Ranges (both ends inside) of code points in whose neighbourhood the pre-tokens differ."""
    library, cut = pre_tokenizers.ByteLevel(add_prefix_space=False), regex.compile(PATTERN)
    around = lambda c: f"a{c}1{c}{c} {c}!\n"
    out: list[tuple[int, int]] = []
    for start in range(0, sys.maxunicode + 1, 512):
        points = [i for i in range(start, start + 512) if not 0xD800 <= i <= 0xDFFF]
        if points and not _agrees("".join(around(chr(i)) for i in points), cut, library):
            for i in points:
                if not _agrees(around(chr(i)), cut, library):
                    if out and out[-1][1] == i - 1:
                        out[-1] = out[-1][0], i
                    else:
                        out.append((i, i))
    return out


class Counter:
    """Counts the tokens of texts; made once in each task from the tokenizer's JSON."""

    def __init__(self, spec: str, whole: frozenset[str], odd: list[tuple[int, int]]):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile(PATTERN).findall
        ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in odd)
        self.odd = regex.compile(f"[{ranges}]").search if ranges else lambda text: None
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)

    def _merge(self, missing: list[str]) -> None:
        codes = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
        self.known.update(zip(missing, map(len, codes), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        plain = []
        if len(self.known) > len(self.whole) + REMEMBERED:  # between slices only: a slice needs all it has merged
            self.known = dict(self.whole)
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(a in text for a in self.added) or not text.isascii() and self.odd(text):
                out[i] = len(self.tokenizer.encode(text, add_special_tokens=False))
            else:
                plain.append((i, self.cut(text)))
        missing = {p for _, parts in plain for p in parts if p not in self.known}
        if missing:
            self._merge(list(missing))
        get = self.known.__getitem__
        for i, parts in plain:
            out[i] = sum(map(get, parts))
        return out


@lru_cache(maxsize=4)
def _prove(spec: str) -> frozenset[str]:
    return whole_tokens(Tokenizer.from_str(spec))


def add_token_counts(df: DataFrame, tokenizer_file: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``) to every row.

    Counts are those of the library's defaults without begin, end or other special tokens added,
    truncation or padding. Null texts count as empty. The tokenizer and the proven strings, a few
    megabytes whatever the input, go to the tasks. Columns of the input with these names are
    replaced.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    shared = df.sparkSession.sparkContext.broadcast((spec, _prove(spec), odd_ranges()))

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(*shared.value)
        for series in batches:
            texts = series.tolist()
            yield pd.Series([n for a, b in slices(texts) for n in counter.count(texts[a:b])], dtype="int64")

    kept = [c for c in df.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    return df.withColumn("_tokens", tokens(F.col(text))).select(
        *[F.col(f"`{c}`") for c in kept],
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_bytes"),
        F.col("_tokens").alias("n_tokens"), (F.col("_tokens") > limit).alias("over_limit"),
    )
