"""Similarity join on word shingles by rare-first prefix filtering.

Two texts link when their sets of shingles reach a Jaccard similarity. Shingles are put in one
global order, rare ones first; texts that link must share one of the first ``n - ceil(t n) + 1``
shingles, their prefixes, so only texts that meet there are compared:

* Copies collapse to one node for each distinct set before anything is joined.
* The order comes from a count-min sketch over the shingles of all texts. Its size is fixed, and
  any order gives the same links, so its error costs time only, never a link.
* Prefix shingles that no other text has among its own go before anything is joined: 32 bits of each are
  exchanged, packed, and a bitmap of those that came twice travels back. It may pass some too many,
  which the join on whole shingles drops.
* Shingles of a prefix that no other prefix holds are not shared within both prefixes. How many others
  a prefix has from a shingle on, and what lies behind the longer prefix, bound the overlap of two
  texts that first share this shingle; so texts with a common passage only are hardly compared.
* Length and positional filters and that bound work in the join on prefix shingles, the suffix filter on what is
  left: value ranges hold too different numbers of shingles for the pair to link. Before texts are
  joined, parities rule out pairs: of ``PARITY`` bits of a set each shingle turns one, so two sets
  differ by no fewer shingles than their bits. Survivors are verified on the words, once a pair.
* A prefix shingle that many texts share would give all pairs of them. Instead each round compares
  its texts of like size with a few leaders, and texts already in one component are not compared again. When few
  pairs lie across components, or rounds no longer help, the last pass compares all that are left:
  in every group, whatever is not in its largest component with everything of another component.

So no link between components is lost, and a group of near copies costs about one comparison a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.llm.common import bound_batches, release, stage
from phrasemill.llm.components import stars
from phrasemill.llm.shingles import WIDTH, shingle_sets, shingle_texts

THRESHOLD = 80
#: Cells in each of the two rows of the sketch.
CELLS = 1 << 21
#: Rows in which a task sends its sketch.
PARTS = 64
#: Bits of the bitmap of prefix shingles that two texts have.
PLACES = 27
#: Bits of the bitmap of texts to compare. Fuller bitmaps pass more rows, lose none.
WANTED = 24
#: Prefix shingles of one bucket of their exchange, about, and those that a task holds until it sends them.
BUCKET, HELD = 1 << 20, 1 << 20
#: Leaders of each group in one round.
LEADERS = 8
#: Rounds with leaders end when this many open pairs are left for each prefix entry, or when a
#: round has closed less than a quarter of them.
OPEN_PAIRS = 8
#: Value ranges of the suffix filter.
RANGES = 16
#: Parity bits of a set of shingles.
PARITY = 1024


def _cells(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (values & np.uint64(CELLS - 1)).astype(np.int64), ((values >> np.uint64(32)) & np.uint64(CELLS - 1)).astype(np.int64)


def _sketch(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CELLS), np.int32)  # texts of one task
        for batch in batches:
            for _, _, values, _ in shingle_sets(batch.column(0), width):
                for row, cells in enumerate(_cells(values)):
                    np.add.at(total[row], cells, 1)
        parts = [zstandard.compress(p.astype(np.int64).tobytes(), 1) for p in np.array_split(total.ravel(), PARTS)]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "cells": parts})

    return count


def _summed(table: pa.Table) -> pa.Table:
    cells = sum(np.frombuffer(zstandard.decompress(c.as_buffer()), np.int64) for c in table["cells"])
    return pa.table({"part": table["part"][:1], "cells": [zstandard.compress(cells.tobytes(), 1)]})


def frequencies(texts: DataFrame, width: int = WIDTH) -> np.ndarray:
    """A count-min sketch of the number of texts that hold each shingle: 2 x ``CELLS`` counters.

    A task sends ``PARTS`` rows; the sums, whose size is fixed, come to the driver.
    """
    schema = "part int, cells binary"
    rows = texts.mapInArrow(_sketch(width), schema).groupBy("part").applyInArrow(_summed, schema).collect()
    if not rows:
        return np.zeros((2, CELLS), np.uint32)
    parts = [np.frombuffer(zstandard.decompress(bytes(r.cells)), np.int64) for r in sorted(rows, key=lambda r: r.part)]
    return np.concatenate(parts).clip(max=(1 << 32) - 1).astype(np.uint32).reshape(2, CELLS)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _prefixes(shared, threshold: int, width: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            ids, sizes, digests, lengths, prefixes = batch.column(0), [], [], [], []
            for first, last, values, bounds in shingle_sets(batch.column(1), width):
                one, two = _cells(values)
                rare = np.minimum(counts[0].take(one), counts[1].take(two))
                # sorted, these are the places of values in the order by rareness and value
                order = rare.astype(np.uint64) << np.uint64(32) | np.arange(len(values), dtype=np.uint64)
                for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), first):
                    own = values[a:b] if a < b else f"no words {ids[row].as_py()}".encode()
                    digests.append(hashlib.blake2b(own, digest_size=16).digest())
                    order[a:b].sort()
                n = np.diff(bounds)
                length = np.where(n > 0, n - -(-threshold * n // 100) + 1, 0)
                at = np.arange(length.sum()) + np.repeat(bounds[:-1] - np.cumsum(length) + length, length)
                prefixes.append(values[(order[at] & np.uint64((1 << 32) - 1)).astype(np.int64)].view(np.int64))
                sizes.append(n)
                lengths.append(length)
            if sizes:
                lists = _lists(np.concatenate(prefixes), np.concatenate(lengths))
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(pa.int64()), pa.array(np.concatenate(sizes)), pa.array(digests, pa.binary()), lists],
                    names=["doc_id", "n", "digest", "prefix"],
                )

    return describe


def _packed(bits: int):
    """What follows the first ``bits`` bits of the prefix shingles of a task, packed by those bits."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held))
            cuts = np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            rest = ((values >> np.uint64(32 - bits)) & np.uint64((1 << 32) - 1)).astype(np.uint32)
            parts = [(i, p.tobytes()) for i, p in enumerate(np.split(rest, cuts)) if len(p)]
            return pa.RecordBatch.from_pydict({"bucket": pa.array([i for i, _ in parts], pa.int32()),
                                               "rest": pa.array([p for _, p in parts], pa.binary())})

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy().view(np.uint64))
            if sum(map(len, held)) >= HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return send


def _twice(bits: int):
    def find(table: pa.Table) -> pa.Table:
        rest = np.sort(np.concatenate([np.frombuffer(r.as_buffer(), np.uint32) for r in table["rest"]]))
        own = np.zeros(1 << (PLACES - bits), bool)
        own[rest[1:][rest[1:] == rest[:-1]] >> np.uint32(32 - (PLACES - bits))] = True
        return pa.table({"bucket": table["bucket"][:1], "rest": [zstandard.compress(np.packbits(own, bitorder="little"), 1)]})

    return find


def _shared(rows: DataFrame, threshold: int) -> np.ndarray:
    """A bitmap of ``PLACES`` bits, by their first bits, of the prefix shingles that occur twice in ``rows``."""
    shingles = rows.agg(F.sum("n")).first()[0] or 0
    bits = min(max(ceil(log2(shingles * (100 - threshold) / 100 / BUCKET + 1)), 5), PLACES - 3)
    schema = "bucket int, rest binary"
    sent = rows.select("prefix").mapInArrow(_packed(bits), schema)
    bitmap = np.zeros((1 << bits, 1 << (PLACES - bits - 3)), np.uint8)
    for r in sent.groupBy("bucket").applyInArrow(_twice(bits), schema).collect():
        bitmap[r.bucket] = np.frombuffer(zstandard.decompress(bytes(r.rest)), np.uint8)
    return bitmap.ravel()


def _holds(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _thinned(known):
    """The rows with those prefix shingles only that a bitmap holds, and their places."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            values, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            held = _holds(known.value, (values.view(np.uint64) >> np.uint64(64 - PLACES)).astype(np.int64))
            pos = np.arange(len(values)) - np.repeat(ends - sizes, sizes)
            left = np.diff(np.concatenate([[0], np.cumsum(held)])[np.concatenate([[0], ends])])
            rows = [batch.column(c) for c in ("doc_id", "n", "digest")] + [_lists(pos[held], left), _lists(values[held], left)]
            yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "n", "digest", "pos", "h"]).filter(pa.array(left > 0))

    return keep


def _wanted(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``WANTED`` bits of the hashes of ``ids``."""
    place = _place("node")
    rows = ids.groupBy(F.bitmap_bucket_number(place).alias("i")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bitmap = np.zeros((1 << WANTED) // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        bitmap[(r.i - 1) * len(part) : r.i * len(part)] = part
    return bitmap


def _place(column: str):
    return F.pmod(F.xxhash64(column), F.lit(1 << WANTED)) + 1


def _among(known):
    @F.arrow_udf("boolean")
    def test(place: pa.Array) -> pa.Array:
        return pa.array(_holds(known.value, place.to_numpy(zero_copy_only=False) - 1))

    return test


def _need(threshold: int, a: str, b: str) -> str:
    """SQL: the least overlap of two linked sets of sizes ``a`` and ``b``."""
    return f"ceil({threshold} * ({a} + {b}) / {100 + threshold}.0D - 1e-9)"


def _filters(threshold: int, x: str, y: str) -> str:
    """SQL of the length and the positional filter for two entries of one prefix shingle, and of the
    bound by shared shingles: of the overlap no more than ``held`` lies in both prefixes, and from the
    first that does not, all lie behind one of the two."""
    return (
        f"{threshold} * greatest({x}.n, {y}.n) <= 100 * least({x}.n, {y}.n) "
        f"and least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {_need(threshold, f'{x}.n', f'{y}.n')} "
        f"and least({x}.held, {y}.held) + ceil({threshold} * greatest({x}.n, {y}.n) / 100.0D - 1e-9) - 1 "
        f">= {_need(threshold, f'{x}.n', f'{y}.n')}"
    )


def may_link(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """The suffix filter: sizes of value ranges differ by no more than the sets may differ."""
    cut = np.arange(1, RANGES, dtype=np.uint64) << np.uint64(60)
    sizes = [np.diff(np.concatenate([[0], np.searchsorted(v, cut), [len(v)]])) for v in (x, y)]
    need = -(-threshold * (len(x) + len(y)) // (100 + threshold))
    return int(np.abs(sizes[0] - sizes[1]).sum()) <= len(x) + len(y) - 2 * need


def parities(texts: pa.Array, width: int = WIDTH) -> pa.ListArray:
    """For each text the size of its set and the parity bits of the set in longs."""
    out = []
    for first, last, values, bounds in shingle_sets(texts, width):
        for row in range(0, last - first, 256):
            ends = bounds[row : row + 257]
            n = np.diff(ends)
            at = (values[ends[0] : ends[-1]] & np.uint64(PARITY - 1)).astype(np.int64) + np.repeat(np.arange(len(n)) * PARITY, n)
            odd = (np.bincount(at, minlength=len(n) * PARITY) & 1).astype(bool).reshape(-1, PARITY)
            out.append(np.column_stack([n, np.packbits(odd, axis=1, bitorder="little").view(np.int64)]))
    rows = np.concatenate(out) if out else np.empty((0, 1 + PARITY // 64), np.int64)
    return _lists(rows.ravel(), np.full(len(rows), rows.shape[1]))


def _may_differ(threshold: int, x: str, y: str) -> str:
    """SQL: the parities of two texts allow their sets to link."""
    bits = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(1, 1 + PARITY // 64))
    return f"{bits} <= {x}[0] + {y}[0] - 2 * {_need(threshold, f'{x}[0]', f'{y}[0]')}"


def enough(both: int, x: int, y: int, threshold: int) -> bool:
    return both > 0 and 100 * both >= threshold * (x + y - both)


def linked(x: set, y: set, threshold: int = THRESHOLD) -> bool:
    return enough(len(x & y), len(x), len(y), threshold)


def _verify(threshold: int, width: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = pa.chunked_array([batch.column("s"), batch.column("t")]).combine_chunks().dictionary_encode()
            at, texts, values = sides.indices.to_pylist(), sides.dictionary, []
            for _, _, found, bounds in shingle_sets(texts, width):
                values += np.split(found, bounds[1:-1])
            plain = lru_cache(maxsize=256)(lambda i: shingle_texts(texts[i].as_py(), width))
            keep = []
            for s, t in zip(at[: len(batch)], at[len(batch) :], strict=True):
                x, y = values[s], values[t]
                # equal words have equal values, so what the values rule out needs no words
                near = may_link(x, y, threshold) and enough(np.intersect1d(x, y, True).size, len(x), len(y), threshold)
                keep.append(near and linked(plain(s), plain(t), threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def _near(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``(a, b)`` that the parities of their texts leave."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("odd").alias("x")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("odd").alias("y")), "b")
    return both.where(F.expr(_may_differ(threshold, "x", "y"))).select("a", "b").distinct()


def _links(pairs: DataFrame, texts: DataFrame, threshold: int, width: int) -> DataFrame:
    """The pairs ``(a, b)`` whose texts link."""
    pairs = stage(_near(pairs, texts, threshold), "shingle-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    some = _among(pairs.sparkSession.sparkContext.broadcast(_wanted(ends)))
    texts = texts.select("node", "text").where(some(_place("node")))
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(_verify(threshold, width), "a bigint, b bigint")


def _in_order(x: str, y: str):
    return F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")


def near_duplicates(df: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``df(doc_id, text)``.

    ``n_shingles`` is the size of the row's set. Texts without words have an empty set and stay
    alone; null texts count as such. Rows that share a doc_id are one document: its component is
    that of all its texts. A row without doc_id links nothing and has the component of the rows
    with the same set, or null. Empty tables give empty results; other columns are not looked at.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = spark.sparkContext.broadcast(frequencies(docs.select("text"), width))
    rows = stage(
        docs.mapInArrow(_prefixes(counts, threshold, width), "doc_id bigint, n bigint, digest binary, prefix array<bigint>"),
        "shingle-prefixes",
    )
    nodes = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"))
    base = stage(
        rows.select("doc_id", "n", "digest").join(nodes, "digest", "left").select("doc_id", "n", "node"),
        "shingle-nodes",
    )
    met = spark.sparkContext.broadcast(_shared(rows, threshold))
    thin = rows.mapInArrow(_thinned(met), "doc_id bigint, n bigint, digest binary, pos array<bigint>, h array<bigint>")
    entries = (
        thin.join(nodes.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"))
        .where("doc_id = node").select("node", "n", F.inline(F.arrays_zip("pos", "h")))
    )
    # the smaller set of a linked pair has the shared shingle even among fewer first ones
    index = F.expr(f"pos <= n - {_need(threshold, 'n', 'n')}")
    on_h = Window.partitionBy("h")
    shared = entries.withColumn("c", F.count("*").over(on_h)).withColumn("leads", F.max(index).over(on_h)).where("c > 1")
    held = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("pos"))).alias("held")
    band = F.floor(F.log("n") / log(100 / threshold)).alias("band")
    members = stage(shared.select("h", "node", "n", "pos", held, band, "leads").where("leads").drop("leads"), "shingle-members")
    release(rows)
    # documents whose rows hold several sets tie these together
    several = base.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a < top")
    edges = base.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    edges, tested, parts = stage(edges, "edges"), None, None
    some = _among(spark.sparkContext.broadcast(_wanted(members.select("node"))))

    @F.arrow_udf("array<bigint>")
    def parity(text: pa.Array) -> pa.Array:
        return parities(text, width)

    texts = stage(
        docs.where("doc_id is not null").where(some(_place("doc_id")))
        .join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id")
        .select(F.col("doc_id").alias("node"), "text", parity("text").alias("odd")),
        "shingle-texts",
    )
    size = members.count()
    spin, before = 0, float("inf")
    while True:
        if parts is None:
            now = members.withColumn("comp", F.col("node"))
        else:
            now = members.join(parts, "node", "left").withColumn(
                "comp", F.coalesce("component", "node")).drop("component")
        now = stage(now, "shingle-members")
        kinds = now.groupBy("h", "comp").agg(F.count("*").alias("c"))
        per = kinds.groupBy("h").agg(
            F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("big"), F.count("*").alias("k")).where("k > 1")
        open_pairs = per.select(F.sum(F.col("c").cast("double") * (F.col("c") - F.col("big.c")))).first()[0] or 0
        last = spin > 0 and (open_pairs <= OPEN_PAIRS * size or open_pairs > 0.75 * before)
        before = open_pairs
        if last:
            minor = now.join(per.select("h", F.col("big.comp").alias("most")), "h").where("comp <> most")
            pairs = (
                minor.alias("x").join(now.alias("y"), "h")
                .where(F.expr(f"x.comp <> y.comp and {_filters(threshold, 'x', 'y')}")).select(*_in_order("x", "y"))
            )
        else:
            # leaders have few rarer shingles before the shared one: they are like the text that the
            # others were made from rather than ones with changes of their own; each round tries others
            head = F.struct(F.floor(F.expr("20 * pos / n")).alias("far"), F.xxhash64("node", F.lit(spin)).alias("rank"),
                            "node", "n", "pos", "held", "comp")
            seat = F.pmod(F.xxhash64("node", F.lit(spin), F.lit("seat")), F.lit(LEADERS)).alias("seat")
            lead = (
                now.join(per.select("h"), "h", "left_semi").groupBy("h", "band", seat).agg(F.min(head).alias("lead"))
                .select("h", "band", "lead.node", "lead.n", "lead.pos", "lead.held", "lead.comp")
            )
            pairs = (
                now.alias("x").join(lead.alias("y"), ["h", "band"])
                .where(F.expr(f"x.comp <> y.comp and {_filters(threshold, 'x', 'y')}")).select(*_in_order("x", "y"))
            )
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "shingle-pairs")
        edges = stage(edges.union(_links(pairs, texts, threshold, width)), "edges")
        release(parts)
        parts = stars(edges)
        if last:
            break
        tested = pairs if tested is None else stage(tested.union(pairs), "shingle-pairs")
        release(now)
        spin += 1
    for done in (members, texts, now):
        release(done)
    return base.join(parts, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")
    )
