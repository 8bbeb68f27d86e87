"""Phrase collocations per language by Toivonen mining.

A *sample* of the documents proposes frequent phrases at a lowered threshold. The *full pass* then
counts, exactly and in all documents, the proposals and their negative border: every phrase that is
not proposed but whose parts (without its first, without its last word) all are, and every word. A
border phrase that turns out frequent is a *failure*: it and its like become proposals, and a further
pass counts what is new to border and proposals, until a pass finds no failure. Then no frequent
phrase can be missing, because all parts of a frequent phrase are frequent.

Proposals are held as a bitmap of ``BITMAP`` bits over phrase hashes, which are what travels to the
tasks: their size does not follow the corpus. A phrase that only shares a bit with a proposal is counted
too, and its exact count decides, so a full bitmap costs time and never a result. Counts are keyed by
the phrase itself; hashes only collect equal phrases within a chunk, and two independent ones must agree.

Defined results: null texts are empty, a null language is ``und``, repeated rows count again, ties are
broken as the ranking says, and a table without phrases gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phrasemill.llm.common import mix, stage

#: Least occurrences of a candidate, longest phrase, rows returned for each language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: One in so many documents is in the sample; a phrase is proposed from so many occurrences in it.
SAMPLE, PROPOSED = 8, 2
#: Bits of the set of proposals.
BITMAP = 1 << 27
#: Bytes of text whose phrases are summed before they leave a task, and bytes that are hashed at once.
CHUNK, BLOCK = 4 << 20, 1 << 18
#: Phrases in one batch of rows.
ROWS = 1 << 16
#: A longer candidate with so many hundredths of the occurrences covers a phrase inside it.
COVERED = 80

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: 0 ends a piece, 1 separates words, 2 belongs to a word.
KINDS = bytes(0 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 1 if b in b" \t" else 2 for b in range(256))


class _Hash:
    """A polynomial hash of every stretch of a buffer, modulo 2^64 over random values of the bytes."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = np.uint64(int(rng.integers(0, 1 << 62)) * 4 + 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))

    def sums(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums and the inverse powers that move a stretch to the beginning."""
        powers = np.full(len(data), self.base, np.uint64)
        undo = np.full(len(data) + 1, self.inverse, np.uint64)
        if len(data):
            powers[0] = 1
        undo[0] = 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * np.cumprod(powers), out=total[1:])
        return total, np.cumprod(undo)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of stretches that follow each other, block by block."""
        out = [np.empty(0, np.uint64)]
        cuts = np.flatnonzero(np.diff(starts // BLOCK)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(starts)), strict=True):
            if b > a:
                x, y = starts[a:b] - starts[a], ends[a:b] - starts[a]
                total, undo = self.sums(data[starts[a] : ends[b - 1]])
                out.append(mix((total[y] - total[x]) * undo[x] + (y - x).astype(np.uint64)))
        return np.concatenate(out)

    def phrases(self, words: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the phrases of ``n`` words that begin at word ``i``."""
        out = words[i]
        for k in range(1, n):
            out = mix(out * self.base + words[i + k])
        return out


FIRST, SECOND = _Hash(1), _Hash(2)


class Words:
    """The words of some texts as stretches of one buffer in which one space follows each word."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        raw = b"\n".join(texts).translate(LOWER)
        kinds = np.frombuffer(raw.translate(KINDS), np.uint8)
        word = kinds == 2
        before = np.append(False, word)[:-1]
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(~word & before)
        if len(ends) < len(starts):
            ends = np.append(ends, len(raw))
        kept = word | before  # each word and the byte behind it
        self.data = np.where(word[kept], np.frombuffer(raw, np.uint8)[kept], np.uint8(32))
        sizes = ends - starts
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes
        self.piece = np.searchsorted(np.flatnonzero(kinds == 0), starts)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.lang = langs[np.searchsorted(np.cumsum(size), starts, side="right")]
        self.first = FIRST.words(self.data, self.starts, self.ends)

    def phrases(self, n: int) -> np.ndarray:
        """The first words of all phrases of ``n`` words."""
        i = np.arange(max(len(self.starts) - n + 1, 0))
        return i[self.piece[i] == self.piece[i + n - 1]]

    def hashes(self, i: np.ndarray, n: int) -> np.ndarray:
        """A key of the phrase and its language."""
        return mix(FIRST.phrases(self.first, i, n) ^ self.lang[i])


def _lang_key(lang: str) -> int:
    data = np.frombuffer(lang.encode(), np.uint8)
    return int(SECOND.words(data, np.array([0]), np.array([len(data)]))[0])


def _closed(bitmap: np.ndarray | None) -> bytes | None:
    """A bitmap as it travels: few proposals take few bytes."""
    return None if bitmap is None else zstandard.compress(bitmap.tobytes(), 1)


def _opened(data: bytes | None) -> np.ndarray | None:
    return None if data is None else np.frombuffer(zstandard.decompress(data), np.uint64)


def has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bits of ``keys`` are set."""
    bit = keys & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, dict[int, str]]]:
    """Words of about ``CHUNK`` bytes of text at a time; a document is never cut."""
    texts, langs, names, held = [], [], {}, 0
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lang = "und" if lang is None else lang
            data = (text or "").encode()
            key = next((k for k, v in names.items() if v == lang), None)
            if key is None:
                key = _lang_key(lang)
                names[key] = lang
            texts.append(data)
            langs.append(key)
            held += len(data) + 1
            if held >= CHUNK:
                yield Words(texts, np.array(langs, np.uint64)), names
                texts, langs, held = [], [], 0
    if texts:
        yield Words(texts, np.array(langs, np.uint64)), names


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of all phrases and their counts: proposals need no more."""
    for words, _ in _chunks(batches):
        for n in range(1, LONGEST + 1):
            keys, count = np.unique(words.hashes(words.phrases(n), n), return_counts=True)
            for x in range(0, len(keys), ROWS):
                part = {"key": keys[x : x + ROWS].view(np.int64), "n": count[x : x + ROWS].astype(np.int64)}
                yield pa.RecordBatch.from_pydict(part)


def _equal(keys: np.ndarray, second: np.ndarray, i: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of every distinct phrase and its count; phrases are equal if both hashes are."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    other = SECOND.phrases(second, i, n)
    if np.any(same & (other[order][1:] != other[order][:-1])):
        order = np.lexsort((other, keys))
        same = (keys[order][1:] == keys[order][:-1]) & (other[order][1:] == other[order][:-1])
    first = np.flatnonzero(np.append(True, ~same)) if len(order) else order
    return i[order[first]], np.diff(np.append(first, len(order)))


def _counted(shared):
    """Exact counts. In the full pass (``frequent`` unknown) of words and of all phrases whose parts are
    proposed, and, under an empty phrase, of all words of a language; in the expansion pass of the phrases that
    were left out and whose parts are frequent or were not counted either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proposed, frequent = map(_opened, shared.value)
        for words, names in _chunks(batches):
            second = SECOND.words(words.data, words.starts, words.ends)
            label = np.array(list(names), np.uint64)
            texts = pa.array(list(names.values()), pa.string())
            if frequent is None:
                for key, lang in names.items():
                    total = int((words.lang == np.uint64(key)).sum())
                    yield _rows(pa.array([lang]), pa.array([""]), np.array([total]))
            inside = hopeful = np.ones(len(words.starts) + 1, bool)
            for n in range(1, LONGEST + 1):
                # the parts of the phrase at i are the phrases of n - 1 words at i and at i + 1
                i = words.phrases(n)
                counted = inside[i] & inside[i + 1]
                keys = words.hashes(i, n)
                wanted = counted if frequent is None else ~counted & hopeful[i] & hopeful[i + 1]
                if wanted.any():
                    places, counts = _equal(keys[wanted], second, i[wanted], n)
                    for x in range(0, len(places), ROWS):
                        at = places[x : x + ROWS]
                        lang = pa.DictionaryArray.from_arrays(_index(label, words.lang[at]), texts).cast(pa.string())
                        yield _rows(lang, _strings(words, at, n), counts[x : x + ROWS])
                inside = _marked(words, i, keys, counted, proposed)
                if frequent is not None:
                    hopeful = _marked(words, i, keys, counted, frequent)
                    hopeful[i[wanted]] = True

    return run


def _marked(words: Words, i: np.ndarray, keys: np.ndarray, reach: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """The places of proposals all of whose parts are proposals too."""
    out = np.zeros(len(words.starts) + 1, bool)
    out[i[reach]] = has(bitmap, keys[reach])
    return out


def _index(label: np.ndarray, keys: np.ndarray) -> pa.Array:
    order = np.argsort(label)
    return pa.array(order[np.searchsorted(label[order], keys)].astype(np.int32))


def _strings(words: Words, i: np.ndarray, n: int) -> pa.Array:
    starts, ends = words.starts[i], words.ends[i + n - 1]
    sizes = ends - starts
    offsets = np.append(0, np.cumsum(sizes))
    flat = words.data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat.tobytes())]
    return pa.Array.from_buffers(pa.string(), len(i), buffers)


def _rows(lang: pa.Array, phrase: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    """Phrase and language as one narrow key; no word holds the line break between them."""
    key = pc.binary_join_element_wise(phrase, lang, "\n")
    return pa.RecordBatch.from_arrays([key, pa.array(count.astype(np.int64))], names=["key", "n"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of phrases that are given as text."""
    for batch in batches:
        langs, phrases, sizes = (c.to_pylist() for c in batch.columns)
        label = {lang: _lang_key(lang) for lang in set(langs)}
        for n in range(1, LONGEST):
            mine = [x for x, size in enumerate(sizes) if size == n]
            words = Words([phrases[x].encode() for x in mine], np.array([label[langs[x]] for x in mine], np.uint64))
            keys = words.hashes(n * np.arange(len(mine)), n)
            yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64)})


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits of the keys; the driver gets at most ``bits / 64`` numbers."""
    bit = F.col("key").bitwiseAND(bits - 1)
    words = keys.groupBy(F.shiftrightunsigned(bit, 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("value")
    )
    got = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["at"].to_numpy()] = got["value"].to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", bits: int = BITMAP) -> DataFrame:
    """``(lang, phrase, words, n)`` of every phrase of up to ``LONGEST`` words that occurs ``least``
    times in its language, exactly; ``words`` 0 holds the number of all words of a language."""
    spark = docs.sparkSession
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    both = [F.col(f"c{docs.columns.index(c)}") for c in (text, lang)]
    # the sample is drawn by the whole row, so that copies of a text are in or out one by one
    drawn = plain.where(F.pmod(F.xxhash64(*plain.columns), F.lit(SAMPLE)) == 0).select(*both)
    proposed = drawn.mapInArrow(_sampled, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    bitmap = _bitmap(proposed.where(F.col("n") >= PROPOSED).select("key"), bits)

    def counted(frequent: np.ndarray | None) -> DataFrame:
        shared = spark.sparkContext.broadcast((_closed(bitmap), _closed(frequent)))
        rows = plain.select(*both).mapInArrow(_counted(shared), "key string, n bigint")
        # most phrases of a task occur there in one chunk: they are dealt out without being summed there again
        sums = rows.repartition("key").groupBy("key").agg(F.sum("n").alias("n"))
        some = sums.where((F.col("n") >= least) | F.col("key").startswith("\n"))
        phrase = F.substring_index("key", "\n", 1)
        named = some.select(F.col("key").substr(F.length(phrase) + 2, F.length("key")).alias("lang"), phrase.alias("phrase"), "n")
        size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
        kept = stage(named.select("lang", "phrase", size.alias("words"), "n"), "phrases")
        shared.unpersist()
        return kept

    full = counted(None)
    frequent = _bitmap(full.where(f"words between 1 and {LONGEST - 1}").select("lang", "phrase", "words").mapInArrow(_keys, "key bigint"), bits)
    failures = frequent & ~bitmap
    return full.unionByName(counted(frequent)) if failures.any() else full


def _big(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", bits: int = BITMAP
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of the ``top`` phrases of 2 to ``LONGEST`` words.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts at its lowest-scoring cut (ties: the first),
    ``n`` all words; the score is ``floor(2000000 * a / (l + r))``. Phrases inside a longer one with
    ``100 * f(longer) >= COVERED * a`` are left out. Ranked by score and ``a`` falling, then by phrase.
    """
    found = frequent_phrases(docs, least, text, lang, bits)
    sums = found.where("words > 0").select("lang", "phrase", "n")
    totals = found.where("words = 0").select("lang", "n")
    candidates = found.where("words > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("n").alias("a"))

    def part(start: Column | int, size: Column) -> Column:
        return F.array_join(F.slice("w", start, size), " ")

    k = F.col("k")
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(1, k).alias("left"), part(k + 1, F.size("w") - k).alias("right")
    )
    left = sums.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = sums.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    score = F.expr("cast(2000000 * cast(a as decimal(30,0)) as decimal(38,0)) div (cast(l as decimal(38,0)) + cast(r as decimal(37,0)))")
    scored = (
        cuts.join(left.hint("merge"), ["lang", "left"]).join(right.hint("merge"), ["lang", "right"])
        .select("lang", "phrase", "a", F.struct(score.cast("bigint").alias("score"), "k", "l", "r").alias("cut"))
        .groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    )
    # parts of 2 words and more inside each longer candidate, with the largest count of those around them
    inner = candidates.where(F.size("w") > 2).select(
        "lang", "w", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size")
    ).select("lang", "w", "longer", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    around = inner.select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(
        F.max("longer").alias("longer")
    )
    left_over = scored.join(around.hint("merge"), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_big(F.col("longer")) * 100 < _big(F.col("a")) * COVERED)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left_over.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
