"""Benchmark decontamination with DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters after A-Z became lower case. Every ten
consecutive words of a benchmark item are a window; an item of fewer words is one window. A
document word inside any occurrence of a window is hit.

The scan looks for a word position where a window may begin: the hash of its first words (three, or
all of a shorter window) is looked up in a bitmap of fixed size that travels with the plan. Only
positions that pass, a small share, become rows; they are joined with the windows themselves, so
every hit is verified on the words. Nothing is shuffled but these rows and the document keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import stage

WIDTH = 10
#: Bits of the bitmap of window beginnings. A fuller bitmap passes more positions, loses none.
BITS = 1 << 20
#: Words of a window that the bitmap knows.
LEAD = 3
#: Windows up to this many bytes of text are broadcast; more are joined by shuffling.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; for pure ASCII that is what ``lower`` does."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; null gives none."""
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(window, size, item_id)``: the distinct windows of each item, words joined by spaces."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    items = items.where("item_id is not null and size(w) > 0").withColumn("size", F.least(F.size("w"), F.lit(width)))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("start")
    return (
        items.select("item_id", "w", "size", starts)
        .select(F.array_join(F.slice("w", F.col("start"), F.col("size")), " ").alias("window"), "size", "item_id")
        .distinct()
    )


def _bit(hashed: Column) -> tuple[Column, Column]:
    """The element of the bitmap (63 bits each) and the bit in it that a hash stands for."""
    place = F.pmod(hashed, F.lit(BITS))
    return F.floor(place / 63).cast("int"), (place % 63).cast("int")


def _lead(w: Column, start: Column | int, k: int) -> Column:
    """The hash of ``k`` words from place ``start``, counted from 0."""
    return F.xxhash64(*[F.get(w, start + j) for j in range(k)])


def _bitmap(known: DataFrame, leads: list[int]) -> Column:
    """The beginnings of all windows as a constant array of longs, of a length fixed by ``BITS``."""
    w = F.split("window", " ")
    hashed = F.lit(None)
    for k in leads:
        hashed = F.when(F.least(F.col("size"), F.lit(LEAD)) == k, _lead(w, F.lit(0), k)).otherwise(hashed)
    place, bit = _bit(hashed)
    rows = known.select(place.alias("i"), bit.alias("b")).groupBy("i").agg(
        F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).collect()
    longs = ["0"] * (BITS // 63 + 1)
    for r in rows:
        longs[r["i"]] = str(r["m"])
    return F.split(F.lit(",".join(longs)), ",").cast("array<bigint>")


def _passes(bitmap: Column, hashed: Column) -> Column:
    place, bit = _bit(hashed)
    return F.getbit(F.get(bitmap, place), bit) == 1


def row_key(doc_id: Column, text: Column) -> Column:
    """What the hits of a row depend on, and its id: copies of one text stay spread by their ids."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))


def hits(df: DataFrame, known: DataFrame) -> DataFrame:
    """``(row_key, start, size, window)`` for every occurrence of a window, starts counted from 1."""
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    if not sizes:
        return df.select("row_key", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("window")).where(F.lit(False))
    leads = sorted({min(s, LEAD) for s in sizes})
    bitmap = _bitmap(known, leads)
    docs = df.where("size(w) > 0")

    def may_start(i: Column) -> Column:
        test = F.lit(False)
        for k in leads:
            test = test | _passes(bitmap, _lead(F.col("w"), i - 1, k))
        return test

    places = F.filter(F.sequence(F.lit(1), F.size("w")), may_start)
    found = (
        docs.select("row_key", "w", F.explode(places).alias("start"))
        .select("row_key", "start", F.explode(F.array(*[
            F.struct(F.lit(s).alias("size"), F.array_join(F.slice("w", F.col("start"), s), " ").alias("window"))
            for s in sizes
        ])).alias("at"))
        .select("row_key", "start", "at.size", "at.window")
    )
    plain = known.select("window", F.col("size").alias("of")).distinct()
    if (plain.agg(F.sum(F.length("window") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        plain = F.broadcast(plain)
    return found.join(plain, "window").where("size = of").select("row_key", "start", "size", "window")


def covered(spans: Column) -> Column:
    """Sorted spans ``struct<start,end>`` (end exclusive) merged where they touch."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(
            (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= span["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)),
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, empty, add)


def scan(df: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and ``hit_spans``.

    ``df`` has ``doc_id`` and ``text``; every row is kept with all its columns, but those of the
    names above are replaced. ``hit_spans`` are ranges of word numbers (from 1, end exclusive).
    Null and empty texts have no words; items that are null or without words have no window; an
    empty benchmark hits nothing. Item ids count once as strings however often they repeat.
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"]
    kept = [c for c in df.columns if c not in (*added, "_key")]
    known = stage(windows(benchmark, width), "windows")
    rows = df.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), words(F.col("text")).alias("w"))
    found = stage(hits(rows, known).distinct(), "hits")
    span = F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end"))
    places = found.groupBy("row_key").agg(covered(F.array_sort(F.collect_set(span))).alias("hit_spans"))
    items = (
        found.select("row_key", "window").distinct().join(known.select("window", "item_id"), "window")
        .groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    about = places.join(items, "row_key").withColumnRenamed("row_key", "_key")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return (
        df.select(*[F.col(f"`{c}`") for c in kept], row_key(F.col("doc_id"), F.col("text")).alias("_key"),
                  F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
        .join(about, "_key", "left")
        .select(
            *[F.col(f"`{c}`") for c in kept], "n_words", F.coalesce(n_hit, F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            F.col("hit_spans").isNotNull().alias("contaminated"),
            F.coalesce("hit_spans", F.array().cast("array<struct<start:int,end:int>>")).alias("hit_spans"),
        )
    )


def cut(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` and what follows each of them up to the next word."""
    # every word with its separators; upper-case letters belong to words here, they are not lowered
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), 0)
    edges = F.concat(F.array(F.lit(1)), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))),
                     F.array(F.size(pieces) + 1))
    gaps = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.slice(
        pieces, F.get(edges, i * 2), F.get(edges, i * 2 + 1) - F.get(edges, i * 2)))
    head = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(head, F.array_join(F.flatten(gaps), "")))


def decontaminate(df: DataFrame, benchmark: DataFrame, width: int = WIDTH, remove: str = "documents") -> DataFrame:
    """``df`` without its contaminated documents, or with ``remove='spans'`` without their hit words.

    Clean rows, null texts among them, stay as they are. Columns are those of ``df``.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), "doc_id", "text")
    found = scan(whole, benchmark, width)
    if remove == "documents":
        return found.where("not contaminated").select("row.*")
    fields = [F.when(F.col("contaminated"), cut(F.col("text"), F.col("hit_spans"))).otherwise(F.col("text")).alias("text")
              if c == "text" else F.col("row")[c].alias(c) for c in df.columns]
    return found.select(*fields)
