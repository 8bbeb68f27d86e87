"""Best-fit packing of documents into sequences of fixed length, with conflicts.

Two documents of one source, or of one cluster of duplicates, never share a sequence ("bin"). A
bin carries a bitmap of its sources and one of its clusters; open bins stand in order of what is
left in them. A document, longest first, looks for the bin with the least room that still holds
it and moves on to its successors until one has no conflict; without any it opens a new bin.

The order is global only within a lot of ``lot`` rows. Rows are dealt evenly over tasks first, so
lots mix all sources, a hot source spreads over all of them, and a lot bounds the memory of a task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm import jaccard
from phrasemill.llm.common import stage
from phrasemill.llm.shingles import word_counts

CAPACITY = 2048
LOT = 4096
#: Rows dealt to one task.
TASK_ROWS = 16 * LOT


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each ``(length, source bit, cluster bit)``, in the given order; bins count from 0."""
    left: list[tuple[int, int]] = []  # open bins as (room, bin), least room first
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in items:
        at = bisect_left(left, (length, -1))
        while at < len(left):
            bin_no = left[at][1]
            if not (sources[bin_no] & source or clusters[bin_no] & cluster):
                break
            at += 1
        if at < len(left):
            room, bin_no = left.pop(at)
            sources[bin_no] |= source
            clusters[bin_no] |= cluster
        else:
            room, bin_no = capacity, len(sources)
            sources.append(source)
            clusters.append(cluster)
        if room > length:
            insort(left, (room - length, bin_no))
        out.append(bin_no)
    return out


def _bits(values: list, once: bool) -> list[int]:
    """A bit for each value; none for a null and, unless ``once``, for a value that stands alone."""
    counts = Counter(v for v in values if v is not None)
    shared = {v: 1 << i for i, v in enumerate(v for v, n in counts.items() if once or n > 1)}
    return [shared.get(v, 0) for v in values]


def _lot(rows: list[tuple], capacity: int) -> list[tuple]:
    """Pieces ``(position, piece, start, length, bin)`` of rows ``(length, source, cluster)``."""
    source, cluster = _bits([r[1] for r in rows], True), _bits([r[2] for r in rows], False)
    out, rest, bins = [], [], 0
    for i, (length, _, _) in enumerate(rows):
        for piece in range(length // capacity):
            out.append((i, piece, piece * capacity, capacity, bins))
            bins += 1
        if length % capacity:
            rest.append((length % capacity, source[i], cluster[i], i))
    rest.sort(key=lambda r: -r[0])
    for (length, _, _, i), bin_no in zip(rest, best_fit([r[:3] for r in rest], capacity), strict=True):
        whole = rows[i][0] // capacity
        out.append((i, whole, whole * capacity, length, bins + bin_no))
    return out


def _pack(capacity: int, lot: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def close(part: list[tuple]) -> pd.DataFrame:
            nonlocal first
            pieces = _lot([r[1:] for r in part], capacity)
            frame = pd.DataFrame(
                [(part[i][0], piece, start, n, first + b) for i, piece, start, n, b in pieces],
                columns=["doc_id", "piece", "start", "n_tokens", "bin_id"],
            )
            first += max((p[4] for p in pieces), default=-1) + 1
            return frame.astype({"doc_id": "Int64"})

        for frame in frames:
            ids = [None if pd.isna(v) else int(v) for v in frame["doc_id"]]
            held += zip(ids, frame["n"].tolist(), frame["source"].tolist(), frame["cluster"].tolist(), strict=True)
            while len(held) >= lot:
                yield close(held[:lot])
                held = held[lot:]
        if held:
            yield close(held)

    return pack


def pack(df: DataFrame, length: str = "n_tokens", source: str | None = "source", cluster: str | None = "cluster",
         capacity: int = CAPACITY, lot: int = LOT) -> DataFrame:
    """``(doc_id, piece, start, n_tokens, bin_id)``: every document as pieces of at most ``capacity``.

    A document longer than ``capacity`` fills bins of its own and only its rest shares one. Rows of
    null or no length have nothing to pack: one row with length 0 and no bin. Null sources and
    clusters conflict with nothing, and ``source=None`` or ``cluster=None`` leaves that conflict
    out. Repeated rows are packed as often as they stand there. Other columns are not looked at.
    """
    column = lambda name: F.lit(None).cast("string") if name is None else F.col(name).cast("string")
    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(length), F.lit(0)).cast("bigint").alias("n"),
                     column(source).alias("source"), column(cluster).alias("cluster"))
    tasks = rows.count() // TASK_ROWS + 1
    mixed = rows.where("n > 0").repartition(tasks).sortWithinPartitions(
        F.xxhash64("doc_id", "cluster"), "doc_id", "n", "source", "cluster")
    packed = mixed.mapInPandas(_pack(capacity, lot), "doc_id bigint, piece bigint, start bigint, n_tokens bigint, bin_id bigint")
    none = rows.where("n <= 0").select("doc_id", *[F.lit(0).cast("bigint").alias(c) for c in ("piece", "start", "n_tokens")],
                                       F.lit(None).cast("bigint").alias("bin_id"))
    return packed.union(none)


def measured(docs: DataFrame) -> DataFrame:
    """``documents`` with what packing needs: ``n_tokens`` as words between white space, and as
    ``cluster`` a digest of the text, so that copies never share a bin."""

    @F.arrow_udf("bigint")
    def n_words(text: pa.Array) -> pa.Array:
        return pa.array(word_counts(text))

    return docs.select("doc_id", n_words("text").alias("n_tokens"), "source", F.md5("text").alias("cluster"))


def clustered(docs: DataFrame) -> DataFrame:
    """As :func:`measured`, but copies and near copies are one ``cluster``: the component of the
    document in ``jaccard.near_duplicates``. A null doc_id is replaced, for the comparison only, by a
    large number made from the text, so that such rows have clusters too."""
    own = F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    key = F.coalesce(F.col("doc_id").cast("bigint"), own).alias("key")
    groups = jaccard.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("key"), F.col("component_id").alias("cluster")).distinct()
    rows = measured(docs.select("doc_id", "text", F.struct("source", key).alias("source"))).select(
        "doc_id", "n_tokens", "source.source", "source.key")
    return stage(rows.join(groups.hint("merge"), "key", "left").select("doc_id", "n_tokens", "source", "cluster"), "packing-rows")


def bins(packed: DataFrame) -> DataFrame:
    """One row for each bin: how full it is and the spans it holds, longest first."""
    span = F.struct((-F.col("n_tokens")).alias("k"), "doc_id", "piece", "start", "n_tokens")
    return packed.where("bin_id is not null").groupBy("bin_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.transform(F.array_sort(F.collect_list(span)), lambda s: s.dropFields("k")).alias("spans"),
    )
