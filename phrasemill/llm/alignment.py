"""Alignment of two tokenizers over whole texts.

A byte-level BPE (A) encodes a space and the text, a sentencepiece model (B) the text, to which it
adds that space itself. Both token sequences spell the same bytes, so where a token of A and one of
B end at the same byte, the sequences are cut into groups, and every token of A in a group is linked
with every token of B in it.

**Lockstep merging.** A slice of documents is laid out as one stream of bytes. Its state is two NumPy
vectors with one entry a lane, the pointers into A and B; a lane is a document, or a piece of
``LANE`` bytes of a longer one (a pointer depends on the place in the bytes alone, so a lane can
start anywhere). Each step compares the ends under both pointers, advances the one that is behind or,
at a cut, both, emits the cuts, and compacts the lanes that have finished.

**Counts.** Each chunk of documents keeps its distinct linked id pairs. Spark sums how many documents
hold a pair, finds the best pairs of each A id, and sends each chunk the sums of its own pairs, so
nothing that grows with the corpus is held by a task or broadcast.

Defined results: null and empty texts, and texts whose tokens do not spell a space and the text (those
that hold U+2581, for one), have no tokens. Rows are independent documents, repeated ones too.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phrasemill.llm.common import bound_batches, slices, stage
from phrasemill.llm.token_counts import PATTERN, byte_letters

#: Bytes of one lane.
LANE = 1024
#: Code points that are encoded and merged at once.
SLICE = 1 << 19
#: Code points of a chunk, whose documents share one set of distinct pairs; a chunk is one row of about
#: two bytes a code point, of which a task holds a few.
CHUNK = 1 << 21
#: Links that are expanded at once, and from how many a group is first reduced to distinct ids.
EXPANDED, WIDE = 1 << 20, 1 << 14
#: Bits of an id in a pair; three such fields and a document number fit 64 bits.
BITS = 21
#: Code points for which the fast encoder is compared with the library before it is used.
PROBED = [*range(1, 0x250), *range(0x2010, 0x2028), 0x20AC]

NEW = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


# ---------------------------------------------------------------- the two encoders


def _ranks(spec: str) -> dict[bytes, int] | None:
    """Byte strings of a byte-level BPE with their ids, if its merges are given by the ids alone.

    That holds if ids rise with the merges and every string of the vocabulary, merged alone, gives
    itself: then the last two parts of a string are always those of its own merge.
    """
    model = json.loads(spec)["model"]
    vocab, letters = model["vocab"], byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [vocab.get("".join(p), -1) for p in pairs]
    alone = Tokenizer.from_str(spec)
    alone.pre_tokenizer = None
    added = {t.content for t in alone.get_added_tokens_decoder().values()}
    alone.encode_special_tokens = True
    words = [w for w in vocab if w not in added]
    got = alone.encode_batch_fast(words, add_special_tokens=False)
    if merged != sorted(merged) or -1 in merged or any(e.ids != [vocab[w]] for w, e in zip(words, got, strict=True)):
        return None
    try:
        return {bytes(letters[c] for c in w): vocab[w] for w in words}
    except KeyError:
        return None


@lru_cache(maxsize=2)
def _proven(spec: str) -> tuple[dict[bytes, int] | None, str]:
    """Ranks for the fast encoder and a pattern of the code points it is not proven for."""
    ranks = _ranks(spec)
    if ranks is None:
        return None, "(?s:.)"
    library = Tokenizer.from_str(spec)
    library.encode_special_tokens = True
    fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [f" a{c}1{c}{c} {c}!\n{c} x{c}" for c in map(chr, PROBED)]
    same = [
        c for c, t, e in zip(PROBED, texts, library.encode_batch(texts, add_special_tokens=False), strict=True)
        if fast.encode_ordinary(t) == e.ids
    ]
    return ranks, "[^" + "".join(f"\\U{c:08x}" for c in same) + "]"


class Encoders:
    """Ids of both tokenizers and the bytes that each id stands for; made once in each task."""

    def __init__(self, spec: str, ranks: dict[bytes, int] | None, odd: str, pieces: bytes):
        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        self.library.no_padding()
        self.library.no_truncation()
        self.fast = ranks and tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.odd = regex.compile(odd).search
        self.ascii = not self.odd("".join(map(chr, range(1, 128))))
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = byte_letters()
        spelled = {n: bytes(letters.get(c, 0) for c in w) for w, n in self.library.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = _Table(spelled)
        self.bytes_b = _Table({i: self._piece(i) for i in range(self.pieces.vocab_size())})
        if max(len(self.bytes_a.size), len(self.bytes_b.size)) > 1 << BITS:
            raise ValueError(f"vocabularies of more than {1 << BITS} ids")

    def _piece(self, i: int) -> bytes:
        if self.pieces.is_byte(i):
            return bytes([int(self.pieces.id_to_piece(i)[3:5], 16)])
        return self.pieces.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        spaced = [" " + t for t in texts]
        a: list = [None] * len(texts)
        slow = []
        for i, text in enumerate(spaced):
            plain = self.ascii and text.isascii() and "\0" not in text
            if self.fast is None or not plain and self.odd(text):
                slow.append(i)
            else:
                a[i] = self.fast.encode_ordinary(text)
        found = self.library.encode_batch_fast([spaced[i] for i in slow], add_special_tokens=False)
        for i, code in zip(slow, found, strict=True):
            a[i] = code.ids
        return a, self.pieces.encode(texts, num_threads=1)


class _Table:
    """Bytes of every id, laid out for vectorised spelling, and its decimal digits."""

    def __init__(self, spelled: dict[int, bytes]):
        top = max(spelled) + 1
        parts = [spelled.get(i, b"") for i in range(top)]
        self.size = np.fromiter(map(len, parts), np.int64, top)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.width = max(len(str(top)), 1)
        self.digits = np.zeros((top, self.width), np.uint8)
        numbers = [str(i).encode() for i in range(top)]
        self.n_digits = np.fromiter(map(len, numbers), np.int64, top)
        for i, n in enumerate(numbers):
            self.digits[i, : len(n)] = list(n)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_spread(self.start[ids], self.size[ids])]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices ``start, start + 1, ...`` of every range, one range after the other."""
    ends = np.cumsum(sizes)
    shift = np.repeat(starts - (ends - sizes), sizes)
    return shift + np.arange(len(shift))


# ---------------------------------------------------------------- merging


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of all lanes: numbers of tokens of A and of B up to each byte where both end, rising.

    A lane owns the ends in ``(start, stop]``. Each step handles one end of every lane.
    """
    far = np.iinfo(np.int64).max
    a, b = np.append(ends_a, far), np.append(ends_b, far)
    i = np.searchsorted(ends_a, starts, side="right")
    j = np.searchsorted(ends_b, starts, side="right")
    cuts_a, cuts_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(i):
        at_a, at_b = a[i], b[j]
        live = np.minimum(at_a, at_b) <= stops
        if not live.all():  # finished lanes leave the state
            i, j, stops, at_a, at_b = i[live], j[live], stops[live], at_a[live], at_b[live]
        i = i + (at_a <= at_b)
        j = j + (at_b <= at_a)
        both = at_a == at_b
        cuts_a.append(i[both])
        cuts_b.append(j[both])
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def _weighed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, rising, with the sums of their weights."""
    if not len(codes):
        return codes, weights
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.add.reduceat(weights, first)


def linked(ids_a, ids_b, cuts_a, cuts_b, doc) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, A id, B id) codes of all links, rising, and how many links each stands for.

    Groups are expanded in blocks of about ``EXPANDED`` links; a group of more than ``WIDE`` links is
    first reduced to its distinct ids, so memory follows the vocabularies and not the group.
    """
    start_a, start_b = np.append(0, cuts_a[:-1]), np.append(0, cuts_b[:-1])
    n_a, n_b = cuts_a - start_a, cuts_b - start_b
    links = n_a * n_b
    codes, weights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    narrow = np.flatnonzero(links <= WIDE)
    block = np.cumsum(links[narrow]) // EXPANDED
    for g in np.split(narrow, np.flatnonzero(np.diff(block)) + 1) if len(narrow) else []:
        which = np.repeat(g, links[g])
        place = _spread(np.zeros(len(g), np.int64), links[g])
        x, y = np.divmod(place, n_b[which])
        code = (doc[which] << 2 * BITS) | (ids_a[start_a[which] + x] << BITS) | ids_b[start_b[which] + y]
        got, n = np.unique(code, return_counts=True)
        codes.append(got)
        weights.append(n)
    for g in np.flatnonzero(links > WIDE):
        left, m = np.unique(ids_a[start_a[g] : cuts_a[g]], return_counts=True)
        right, n = np.unique(ids_b[start_b[g] : cuts_b[g]], return_counts=True)
        for x, times in zip(left, m, strict=True):
            codes.append((doc[g] << 2 * BITS) | (x << BITS) | right)
            weights.append(times * n)
    return _weighed(np.concatenate(codes), np.concatenate(weights))


def _texts(table_a: _Table, table_b: _Table, ids_a, ids_b, cuts_a, cuts_b, last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;...`` of all groups in one run of bytes, and where each document's text ends in it.

    ``last`` marks the groups that end a document; nothing follows those.
    """
    size_a, size_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
    at_a = np.arange(len(ids_a)) + np.repeat(cuts_b - size_b, size_a)
    at_b = np.arange(len(ids_b)) + np.repeat(cuts_a, size_b)
    total, width = len(ids_a) + len(ids_b), max(table_a.width, table_b.width)
    cells = np.zeros((total, width + 1), np.uint8)
    cells[at_a, : table_a.width] = table_a.digits[ids_a]
    cells[at_b, : table_b.width] = table_b.digits[ids_b]
    n = np.empty(total, np.int64)
    n[at_a], n[at_b] = table_a.n_digits[ids_a], table_b.n_digits[ids_b]
    mark = np.full(total, ord(","), np.uint8)
    mark[at_a[cuts_a - 1]] = ord("|")
    mark[at_b[cuts_b - 1]] = ord(";")
    cells[np.arange(total), n] = mark
    n += 1
    closing = at_b[cuts_b[last] - 1]
    n[closing] -= 1
    flat = cells[np.arange(width + 1) < n[:, None]]
    return flat.tobytes(), np.cumsum(n)[closing]


class Aligned:
    """Alignment of one slice of texts."""

    def __init__(self, encoders: Encoders, texts: list[str | None]):
        self.n_docs = len(texts)
        some = [i for i, t in enumerate(texts) if t]
        codes_a, codes_b = encoders.encode([texts[i] for i in some]) if some else ([], [])
        raw = [(" " + texts[i]).encode() for i in some]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        good = np.ones(len(some), bool)
        sides = [(_flat(c), np.array([len(x) for x in c], np.int64), t)
                 for c, t in ((codes_a, encoders.bytes_a), (codes_b, encoders.bytes_b))]
        del codes_a, codes_b
        for side in sides:
            good &= _spells(*side, raw, size)
        self.docs = np.asarray(some, np.int64)[good]
        ends = np.cumsum(size[good])
        self.ids_a, self.ids_b = (ids[np.repeat(good, n)] for ids, n, _ in sides)
        ends_a = np.cumsum(encoders.bytes_a.size[self.ids_a])
        ends_b = np.cumsum(encoders.bytes_b.size[self.ids_b])
        lanes = -(-size[good] // LANE)
        starts = np.repeat(ends - size[good], lanes) + LANE * _spread(np.zeros(len(lanes), np.int64), lanes)
        stops = np.minimum(starts + LANE, np.repeat(ends, lanes))
        self.cuts_a, self.cuts_b = lockstep(ends_a, ends_b, starts, stops)
        group_end = ends_a[self.cuts_a - 1]
        self.last = np.isin(group_end, ends)
        self.group_doc = self.docs[np.searchsorted(ends, group_end, side="left")] if len(group_end) else group_end
        self.n_a, self.n_b = np.zeros(self.n_docs, np.int64), np.zeros(self.n_docs, np.int64)
        self.n_a[self.docs], self.n_b[self.docs] = (n[good] for _, n, _ in sides)
        self.n_groups = np.bincount(self.group_doc, minlength=self.n_docs)
        self.tables = encoders.bytes_a, encoders.bytes_b

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return linked(self.ids_a, self.ids_b, self.cuts_a, self.cuts_b, self.group_doc)

    def groups(self) -> list[bytes]:
        out = [b""] * self.n_docs
        if len(self.docs):
            flat, ends = _texts(*self.tables, self.ids_a, self.ids_b, self.cuts_a, self.cuts_b, self.last)
            for doc, a, b in zip(self.docs, np.append(0, ends[:-1]), ends, strict=True):
                out[doc] = flat[a:b]
        return out


def _flat(codes: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(codes), np.int64, sum(map(len, codes)))


def _spells(ids: np.ndarray, n: np.ndarray, table: _Table, raw: list[bytes], size: np.ndarray) -> np.ndarray:
    """Which documents' tokens spell exactly their bytes, each token at least one."""
    doc = np.repeat(np.arange(len(n)), n)
    spelled = np.bincount(doc, table.size[ids], len(n)).astype(np.int64)
    good = spelled == size
    good[doc[table.size[ids] == 0]] = False
    keep = good[doc]
    got = table.spell(ids[keep])
    want = np.frombuffer(b"".join(itertools.compress(raw, good)), np.uint8)
    where = np.repeat(np.flatnonzero(good), size[good])
    good[where[got != want]] = False
    return good


# ---------------------------------------------------------------- frames


def _files(df: DataFrame, byte_file: str, piece_file: str):
    """Both tokenizers, a few megabytes whatever the input, for the tasks."""
    with open(byte_file, encoding="utf-8") as f:
        spec = f.read()
    with open(piece_file, "rb") as f:
        pieces = f.read()
    return df.sparkSession.sparkContext.broadcast((spec, *_proven(spec), pieces))


def alignments(df: DataFrame, byte_file: str, piece_file: str, text: str = "text") -> DataFrame:
    """Each row with ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups``, the groups' text
    ``a1,a2|b1;a3|b2,b3``. One narrow pass; columns of these names are replaced, others stay."""
    shared = _files(df, byte_file, piece_file)
    new = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string"

    @F.pandas_udf(new)
    def aligned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoders = Encoders(*shared.value)
        for series in batches:
            texts, parts = series.tolist(), []
            for x, y in slices(texts, SLICE):
                one = Aligned(encoders, texts[x:y])
                codes, weights = one.pairs()
                n = np.bincount(codes >> 2 * BITS, weights, one.n_docs).astype(np.int64)
                parts.append(pd.DataFrame({"n_a": one.n_a, "n_b": one.n_b, "n_groups": one.n_groups, "n_links": n,
                                           "groups": [g.decode() for g in one.groups()]}))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["n_a", "n_b", "n_groups", "n_links", "groups"])

    names = ["n_a", "n_b", "n_groups", "n_links", "groups"]
    kept = [c for c in df.columns if c not in names]
    return df.withColumn("_aligned", aligned(F.col(f"`{text}`"))).select(
        *[F.col(f"`{c}`") for c in kept], *[F.col(f"_aligned.{n}").alias(n) for n in names]
    )


def _packed(values: np.ndarray) -> bytes:
    """Numbers by byte planes, which compress well in a column of a file."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _chunk(batches: list[pa.RecordBatch], found: list[tuple]) -> pa.RecordBatch:
    """One row that holds the documents of a chunk and their distinct pairs."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for batch in batches:
            out.write_batch(batch)
    sizes, pairs, weights = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_pydict({
        "chunk": [uuid.uuid4().hex], "docs": [sink.getvalue().to_pybytes()], "sizes": [_packed(sizes)],
        "pairs": [_packed(np.diff(pairs, prepend=0))], "weights": [_packed(weights)],
    })


def _chunks(shared, column: int):
    """Documents to chunks: everything but the text, counts and digests, and distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(*shared.value)
        rows, found, held = [], [], 0
        for batch in batches:
            texts = batch.column(column).to_pylist()
            rest = batch.select([i for i in range(batch.num_columns) if i != column])
            for x, y in slices(texts, SLICE):
                one = Aligned(encoders, texts[x:y])
                codes, weights = one.pairs()
                doc = codes >> 2 * BITS
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in one.groups()]
                new = {
                    "n_a": one.n_a, "n_b": one.n_b, "n_groups": one.n_groups,
                    "n_links": np.bincount(doc, weights, one.n_docs).astype(np.int64), "groups_sha256": digests,
                }
                part = rest.slice(x, y - x)
                rows.append(pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(v, pa.string() if k == "groups_sha256" else pa.int64()) for k, v in new.items()]],
                    names=[*[f"c{i}" for i in range(part.num_columns)], *new],
                ))
                found.append((np.bincount(doc, minlength=one.n_docs), codes & ((1 << 2 * BITS) - 1), weights))
                held += sum(len(t or "") for t in texts[x:y])
                if held >= CHUNK:
                    yield _chunk(rows, found)
                    rows, found, held = [], [], 0
        if rows:
            yield _chunk(rows, found)

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each chunk and how many of its documents hold them."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs, n = np.unique(np.cumsum(_unpacked(row["pairs"])), return_counts=True)
            for x in range(0, len(pairs), 1 << 17):
                part = pairs[x : x + (1 << 17)]
                yield pa.RecordBatch.from_pydict({
                    "chunk": [row["chunk"]] * len(part), "a": part >> BITS, "b": part & ((1 << BITS) - 1),
                    "docs": n[x : x + (1 << 17)].astype(np.int64),
                })


def _answered(chunk: pa.Table, sums: pa.Table) -> pa.Table:
    """The documents of a chunk with the sums over their links."""
    keys = (sums["a"].to_numpy() << BITS) | sums["b"].to_numpy()
    order = np.argsort(keys)
    keys, count, best = keys[order], sums["n"].to_numpy()[order], sums["best"].to_numpy(zero_copy_only=False)[order]
    out = []
    for row in chunk.to_pylist():
        sizes, weights = _unpacked(row["sizes"]), _unpacked(row["weights"])
        at = np.searchsorted(keys, np.cumsum(_unpacked(row["pairs"])))
        ends = np.append(0, np.cumsum(sizes))

        def total(values, ends=ends):
            sums = np.append(0, np.cumsum(values))
            return sums[ends[1:]] - sums[ends[:-1]]

        docs = pa.ipc.open_stream(row["docs"]).read_all()
        out.append(docs.append_column("n_best", pa.array(total(weights * best[at]) if len(at) else sizes, pa.int64()))
                   .append_column("count_sum", pa.array(total(weights * count[at]) if len(at) else sizes, pa.int64())))
    return pa.concat_tables(out)


def align(df: DataFrame, byte_file: str, piece_file: str, text: str = "text") -> DataFrame:
    """Every column of ``df`` but the text, and ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``groups_sha256``, ``n_best`` (links whose pair is held by as many documents as any pair of its A
    id) and ``count_sum`` (over all links, the documents that hold the pair).

    Columns of these names are replaced; other names may repeat. Texts are encoded once; chunks are
    staged with their pairs, and a frequent pair costs one row a chunk.
    """
    bound_batches(df.sparkSession)
    new = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    at = df.columns.index(text)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    kept = [i for i, c in enumerate(df.columns) if i != at and c not in new]
    plain = plain.select(*[f"c{i}" for i in kept], f"c{at}")
    names = [df.columns[i] for i in kept]
    chunks = plain.mapInArrow(
        _chunks(_files(df, byte_file, piece_file), len(kept)),
        "chunk string, docs binary, sizes binary, pairs binary, weights binary",
    )
    chunks = stage(chunks, "alignment", compression="zstd", wide=True)
    asked = chunks.select("chunk", "pairs").mapInArrow(_asked, "chunk string, a bigint, b bigint, docs bigint")
    # pairs of an A id: at most the vocabulary of B, whatever the corpus
    counts = asked.groupBy("a", "b").agg(F.sum("docs").alias("n")).withColumn(
        "best", F.col("n") == F.max("n").over(Window.partitionBy("a"))
    )
    sums = asked.drop("docs").join(counts.hint("merge"), ["a", "b"])
    fields = [f"c{i} {plain.schema[i].dataType.simpleString()}" for i in range(len(kept))]
    out = chunks.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(
        _answered, ", ".join([*fields, NEW, "n_best bigint, count_sum bigint"])
    )
    return out.toDF(*names, *new)
