"""Removal of byte strings that occur earlier in the corpus, by suffix arrays of shards.

Every stretch of ``LENGTH`` bytes inside a document that also starts earlier (in a document before it,
or further left in its own) is removed with all its bytes.

* **Dealing.** A stretch is known by its *anchor*, the ``GRAM`` bytes in it with the least hash. Equal
  stretches have equal anchors, so all of them meet in one shard. Neighbouring stretches with one anchor
  travel as one *piece* of at most ``2 * LENGTH - GRAM`` bytes, about 3.5 bytes a byte of text.
* **Frequent strings.** Grams that hold more than one in ``SHARE`` of all places, told by a sketch of
  fixed size, are anchors only where a stretch has no other gram. Then a common line is dealt by the
  rare text around it, and stretches inside long common passages are equal pieces, of which a task
  sends one copy. So no anchor gathers an unbounded group.
* **Shards.** Pieces whose surroundings of the anchor occur once only cannot share a stretch and are
  left out; of equal pieces all but the earliest are marked. The rest are laid out in the order of the
  corpus, their suffix array is made by induced sorting, and permuted common prefixes of ``LENGTH`` and
  more join the stretches into classes of equal ones, of which the earliest stays.
* **Cutting.** Marked stretches go back to their documents as spans.

Defined results: documents are ordered by ``doc_id``, null ids last; rows of one id are told apart and
ordered by their text's hash, and rows equal in both are one document, each getting its result. Null
texts are empty. Texts shorter than ``LENGTH`` stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import mix, slices
from phrasemill.llm.suffixes import common_prefixes, suffix_array

LENGTH = 100
GRAM = 16
#: Cells of the sketch of grams, and the share (one in so many) from which a gram counts as frequent.
CELLS, SHARE = 1 << 20, 1 << 16
#: Code points whose anchors are sought at once, and bytes of text a task gathers before it sends pieces.
SLICE, FLUSH = 1 << 20, 16 << 20
#: Bytes of pieces in a shard, and in one suffix array unless a single anchor has more.
SHARD, ARRAY = 24 << 20, 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 27) - 1)
_SEED = np.random.default_rng(12).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BASE = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814D))
_UNDO = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASE)

PIECES = pa.schema([
    ("key", pa.uint64()), ("doc_id", pa.int64()), ("hash", pa.uint32()), ("start", pa.int32()), ("anchor", pa.uint8()), ("text", pa.binary()),
])
OUT = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
SPANS = pa.schema([("doc_id", pa.int64()), ("hash", pa.uint32()), ("start", pa.int32()), ("stop", pa.int32())])


# ---------------------------------------------------------------- anchors


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every place on; the last places read zeros behind the end."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(GRAM, np.uint8))).tobytes()
    words = np.ndarray((n + 8,), "<u8", padded, 0, (1,))
    return mix(words[:n] * _ODD + mix(words[GRAM - 8 : GRAM - 8 + n].copy()))


def anchored(data: np.ndarray, sizes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring stretches with one anchor: document, first and last start within the buffer,
    place of the anchor and its key. Of equal grams in a stretch the leftmost is the anchor."""
    hashes = grams(data)
    top = np.uint64(1 << 63)
    order = (hashes >> np.uint64(1)) | np.where(frequent[(hashes >> np.uint64(44)).astype(np.int64)], top, np.uint64(0))
    least = (order & ~_PLACE) | np.arange(len(data), dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    ends = np.cumsum(sizes)
    edge = np.zeros(len(data) + 1, np.int64)
    long = sizes >= LENGTH
    np.add.at(edge, (ends - sizes)[long], 1)
    np.add.at(edge, (ends - LENGTH + 1)[long], -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1])[: len(least)] > 0)
    least = least[starts]
    doc = np.searchsorted(ends, starts, side="right")
    if not len(starts):
        return doc, starts, starts, starts, least
    first = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))
    last = np.append(first[1:], len(starts)) - 1
    return doc[first], starts[first], starts[last], (least[first] & _PLACE).astype(np.int64), least[first] >> np.uint64(27)


def _sums(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    powers = np.full(len(data) + 1, _BASE[which], np.uint64)
    undo = np.full(len(data) + 1, _UNDO[which], np.uint64)
    powers[0] = undo[0] = 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SEED[which][data] * np.cumprod(powers)[:-1], out=total[1:])
    return total, np.cumprod(undo)


def _hashed(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    total, undo = sums
    return mix((total[stops] - total[starts]) * undo[starts] + (stops - starts).astype(np.uint64))


def _buffer(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the grams of a task fall into each cell of the sketch."""
    cells = np.zeros(CELLS, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for x, y in slices(texts, SLICE):
            data, _ = _buffer(texts[x:y])
            cells += np.bincount((grams(data) >> np.uint64(44)).astype(np.int64), minlength=CELLS)
    parts = cells.reshape(64, -1)
    yield pa.RecordBatch.from_pydict({"part": pa.array(range(64), pa.int32()), "cells": [zstandard.compress(p.tobytes(), 1) for p in parts]})


def _summed(table: pa.Table) -> pa.Table:
    cells = sum(np.frombuffer(zstandard.decompress(c.as_buffer()), np.int64) for c in table["cells"])
    return pa.table({"part": table["part"][:1], "cells": [zstandard.compress(cells.tobytes(), 1)]})


def sketch(texts: DataFrame) -> np.ndarray:
    """Grams in each of ``CELLS`` cells over all texts of the one column; the driver gets only these."""
    schema = "part int, cells binary"
    rows = texts.mapInArrow(_counted, schema).groupBy("part").applyInArrow(_summed, schema).collect()
    out = np.zeros((64, CELLS // 64), np.int64)
    for r in rows:
        out[r.part] = np.frombuffer(zstandard.decompress(bytes(r.cells)), np.int64)
    return out.ravel()


# ---------------------------------------------------------------- pieces


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    shift = np.repeat(starts - (ends - sizes), sizes)
    return shift + np.arange(len(shift))


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _binary(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[_spread(starts, sizes)])]
    return pa.Array.from_buffers(pa.binary(), len(starts), buffers)


def _ids(ids: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=null)


def _merged(order: tuple[np.ndarray, ...], start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (by index, first, last) with those that touch within a document made one."""
    i = np.lexsort((start, *order))
    if not len(i):
        return i, start, stop
    same = np.all([o[i][1:] == o[i][:-1] for o in order], axis=0)
    first = np.flatnonzero(np.append(True, ~(same & (start[i][1:] == stop[i][:-1] + 1))))
    last = np.append(first[1:], len(i)) - 1
    return i[first], start[i][first], stop[i][last]


class _Flush:
    """Pieces of one task on their way to the shards."""

    def __init__(self, shards: int, frequent: np.ndarray):
        self.shards, self.frequent = shards, frequent
        self.clear()

    def clear(self) -> None:
        self.buffers, self.columns, self.size, self.docs = [], [], 0, []

    def add(self, texts: list[str | None], ids: list[int | None], hashes: list[int]) -> None:
        data, sizes = _buffer(texts)
        doc, start, stop, place, key = anchored(data, sizes, self.frequent)
        begin = (np.cumsum(sizes) - sizes)[doc]
        hashed = [_hashed(_sums(data, k), start, stop + LENGTH) for k in (0, 1)]
        n_docs = sum(len(d[0]) for d in self.docs)
        self.docs.append((ids, hashes))
        self.columns.append((doc + n_docs, start - begin, stop - begin, place - start, key, *hashed, start + self.size))
        self.buffers.append(data)
        self.size += len(data)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.columns:
            return
        doc, start, stop, place, key, one, two, at = map(np.concatenate, zip(*self.columns, strict=True))
        data = np.concatenate(self.buffers)
        ids = [i for d in self.docs for i in d[0]]
        null = np.array([i is None for i in ids], bool)
        number = np.array([i or 0 for i in ids], np.int64)
        hashes = np.array([h for d in self.docs for h in d[1]], np.uint32)
        self.clear()
        # of equal pieces only the earliest goes on; the stretches of the others are marked here
        order = np.lexsort((start, hashes[doc], number[doc], null[doc], two, one, key))
        pairs = np.all([x[order][1:] == x[order][:-1] for x in (key, one, two)], axis=0)
        equal = np.append(False, pairs)[: len(order)]
        if len(order):
            # rows equal in id and text are one document, so the first of them marks nothing in the other
            head = order[np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))]
            x, y = doc[order], doc[head]
            twin = (null[x] == null[y]) & (number[x] == number[y]) & (hashes[x] == hashes[y]) & (start[order] == start[head])
            equal_marked = equal & ~twin
        else:
            equal_marked = equal
        copies, kept = order[equal_marked], order[~equal]
        which, first, last = _merged((hashes[doc[copies]], number[doc[copies]], null[doc[copies]]), start[copies], stop[copies])
        span_doc = doc[copies][which]
        spans = pa.RecordBatch.from_arrays(
            [_ids(number[span_doc], null[span_doc]), pa.array(hashes[span_doc]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
            schema=SPANS,
        )
        span_shard = (mix(hashes[span_doc].astype(np.uint64)) % np.uint64(self.shards)).astype(np.int64)
        by_span = np.argsort(span_shard, kind="stable")
        span_ends = np.searchsorted(span_shard[by_span], np.arange(self.shards + 1))
        shard = (mix(key[kept]) % np.uint64(self.shards)).astype(np.int64)
        order = np.lexsort((start[kept], doc[kept], shard))
        kept = kept[order]
        ends = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in range(self.shards):
            p, q = kept[ends[s] : ends[s + 1]], by_span[span_ends[s] : span_ends[s + 1]]
            if not len(p) and not len(q):
                continue
            d = doc[p]
            pieces = pa.RecordBatch.from_arrays([
                pa.array(key[p]), _ids(number[d], null[d]), pa.array(hashes[d]), pa.array(start[p].astype(np.int32)),
                pa.array(place[p].astype(np.uint8)), _binary(data, at[p], stop[p] - start[p] + LENGTH),
            ], schema=PIECES)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "pieces": [_ipc(pieces)], "spans": [_ipc(spans.take(pa.array(q)))]})


def _dealt(shared, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        flush = _Flush(shards, frequent)
        for batch in batches:
            ids, hashes, texts = (c.to_pylist() for c in batch.columns)
            for x, y in slices(texts, SLICE):
                flush.add(texts[x:y], ids[x:y], hashes[x:y])
                if flush.size >= FLUSH:
                    yield from flush.rows()
        yield from flush.rows()

    return run


# ---------------------------------------------------------------- shards


def marked(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which places of the pieces begin a stretch that also begins at an earlier place."""
    ends = np.cumsum(sizes + 1)
    text = np.ones(ends[-1] + 1 if len(ends) else 1, np.int64)  # 1 parts the pieces
    text[-1] = 0
    inside = _spread(ends - sizes - 1, sizes)
    text[inside] = data.astype(np.int64) + 2
    array = suffix_array(text, 258)
    joined = common_prefixes(text, array, LENGTH)[array] >= LENGTH
    first = np.flatnonzero(~joined)
    earliest = np.repeat(np.minimum.reduceat(array, first), np.diff(np.append(first, len(array))))
    later = np.zeros(len(text), bool)
    later[array] = array > earliest
    whole = np.zeros(len(text), bool)
    whole[_spread(ends - sizes - 1, np.maximum(sizes - LENGTH + 1, 0))] = True
    return (later & whole)[inside]


class _Shard:
    """The pieces of one shard in the order of the corpus."""

    def __init__(self, table: pa.Table):
        self.key = table["key"].to_numpy()
        self.null = table["doc_id"].is_null().to_numpy()
        self.number = table["doc_id"].fill_null(0).to_numpy()
        self.hash, self.start = table["hash"].to_numpy(), table["start"].to_numpy().astype(np.int64)
        self.place = table["anchor"].to_numpy().astype(np.int64)
        text = table["text"].combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        self.data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.empty(0, np.uint8)
        self.at, self.size = offsets[:-1], np.diff(offsets)
        self.rank = np.empty(len(self.key), np.int64)
        order = np.lexsort((self.start, self.hash, self.number, self.null))
        twin = np.append(False, np.all([x[order][1:] == x[order][:-1] for x in (self.start, self.hash, self.number, self.null)], axis=0))
        # pieces of rows that are one document share a rank, and are the same
        self.rank[order] = np.cumsum(~twin)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces with marked stretches: index, first and last start within the document."""
        by_key = np.argsort(self.key, kind="stable")
        groups = np.flatnonzero(np.append(True, np.diff(self.key[by_key]) != 0))
        load = np.cumsum(self.size[by_key])[np.append(groups[1:], len(by_key)) - 1]
        cut = groups[np.append(True, np.diff(load // ARRAY) != 0)]
        out = [self._part(p) for p in np.split(by_key, cut[1:])]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _part(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = p[np.argsort(self.rank[p], kind="stable")]
        data = self.data[_spread(self.at[p], self.size[p])]
        p, data = self._suspects(p, data)
        ends = np.cumsum(self.size[p])
        one, two = (_hashed(_sums(data, k), ends - self.size[p], ends) for k in (0, 1))
        order = np.lexsort((np.arange(len(p)), two, one))
        equal = np.append(False, (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1]))[: len(p)]
        head = order[np.maximum.accumulate(np.where(equal, 0, np.arange(len(p))))] if len(p) else order
        copies = order[equal & (self.rank[p][order] != self.rank[p][head])]
        kept = np.sort(order[~equal])
        whole = p[copies], self.start[p[copies]], self.start[p[copies]] + self.size[p[copies]] - LENGTH
        p, data = p[kept], data[_spread(ends[kept] - self.size[p[kept]], self.size[p[kept]])]
        flags = marked(data, self.size[p])
        piece = np.repeat(np.arange(len(p)), self.size[p])
        place = _spread(self.start[p], self.size[p])
        hit = np.flatnonzero(flags)
        if not len(hit):
            return whole
        first = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (piece[hit][1:] != piece[hit][:-1])))
        last = np.append(first[1:], len(hit)) - 1
        return tuple(np.concatenate(x) for x in zip(whole, (p[piece[hit[first]]], place[hit[first]], place[hit[last]]), strict=True))

    def _suspects(self, p: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that share an anchor and half a stretch beside it with another piece.

        A stretch reaches half of what it holds beside its anchor, or more, to one side of it.
        """
        begin = np.cumsum(self.size[p]) - self.size[p]
        sums = _sums(data, 0)
        half = (LENGTH - GRAM) // 2
        found = np.zeros(len(p), bool)
        for shift, fits in ((0, self.place[p] + GRAM + half <= self.size[p]), (-half, self.place[p] >= half)):
            i = np.flatnonzero(fits)
            start = begin[i] + self.place[p[i]] + shift
            around = _hashed(sums, start, start + GRAM + half) ^ mix(self.key[p[i]])
            _, which, n = np.unique(around, return_inverse=True, return_counts=True)
            found[i] |= n[which] > 1
        return p[found], data[_spread(begin[found], self.size[p[found]])]


def _sorted_out(table: pa.Table) -> pa.Table:
    """The spans of one shard."""
    read = lambda name: pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table[name]])
    spans, pieces = read("spans"), read("pieces")
    if not len(pieces):
        return spans.cast(OUT)
    shard = _Shard(pieces)
    p, first, last = shard.spans()
    more = pa.table(
        [_ids(shard.number[p], shard.null[p]), pa.array(shard.hash[p]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
        schema=SPANS,
    )
    return pa.concat_tables([spans, more]).cast(OUT)


# ---------------------------------------------------------------- frames


def _cut(columns: int):
    """Texts and their spans to what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(range(columns))
            texts, spans = batch.column(columns).to_pylist(), batch.column(columns + 1)
            offsets = spans.offsets.to_numpy()
            starts, stops = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for i, text in enumerate(texts):
                raw = (text or "").encode()
                x, y = offsets[i], offsets[i + 1]
                order = np.argsort(starts[x:y], kind="stable")
                begin, end = starts[x:y][order], np.maximum.accumulate(stops[x:y][order]) + LENGTH
                fresh = np.append(True, begin[1:] > end[:-1])[: len(begin)]
                begin, end = begin[fresh], end[np.append(np.flatnonzero(fresh)[1:], len(end)) - 1] if len(end) else end
                gaps = zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True)
                left = b"".join(raw[a:b] for a, b in gaps)
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(left))
                n_spans.append(len(begin))
                kept.append(left)
            new = [pa.array(v, pa.int64()) for v in (n_bytes, n_removed, n_spans)] + [pa.array(kept, pa.binary())]
            names = [*[f"c{i}" for i in range(columns)], "n_bytes", "n_removed", "n_spans", "kept"]
            yield pa.RecordBatch.from_arrays([*rest.columns, *new], names=names)

    return run


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every column of ``df`` but the text, and ``n_bytes`` (UTF-8), ``n_removed``, ``n_spans`` (maximal
    removed runs) and ``kept`` (what is left, binary because a character can be cut).

    Columns of these names are replaced; other names may repeat. ``doc_id`` is a whole number.
    """
    spark = df.sparkSession
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = df.columns.index(text)
    key = F.col(f"c{df.columns.index(doc_id)}").cast("bigint")
    hashed = F.coalesce(F.xxhash64(f"c{at}"), F.lit(0)).bitwiseAND(0xFFFFFFFF)
    kept = [i for i, c in enumerate(df.columns) if i != at and c not in new]
    cells = sketch(plain.select(f"c{at}"))
    total = int(cells.sum())
    frequent = np.packbits(cells * SHARE > total).tobytes()
    shards = max(1, int(3.6 * total) // SHARD + 1)
    dealt = plain.select(key.alias("doc_id"), hashed.alias("hash"), f"c{at}").mapInArrow(
        _dealt(spark.sparkContext.broadcast(frequent), shards), "shard int, pieces binary, spans binary"
    )
    spans = dealt.groupBy("shard").applyInArrow(_sorted_out, "doc_id bigint, hash bigint, start int, stop int")
    by_doc = spans.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    left = plain.select(*[f"c{i}" for i in kept], F.col(f"c{at}").alias("text"), key.alias("_id"), hashed.alias("_hash"))
    both = left.join(by_doc, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("hash")), "left").select(
        *[f"c{i}" for i in kept], "text", F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans")
    )
    fields = [f"c{j} {plain.schema[i].dataType.simpleString()}" for j, i in enumerate(kept)]
    out = both.mapInArrow(_cut(len(kept)), ", ".join([*fields, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"]))
    return out.toDF(*[df.columns[i] for i in kept], *new)
