"""Cross-entropy difference of two n-gram language models.

A bigram model of a target collection and one of the whole background, alike in all but their
counts, share one vocabulary. A document's score is the mean over its tokens of the loss under the
target model less the loss under the background model, in bits: the lower, the more the document
looks like the target.

Every word is a token of its own, and all counts are exact, whatever the size of the corpus. Nothing
that grows with the corpus comes to the driver or travels to every task: documents are put in chunks
of about ``CHUNK`` characters, each chunk counts its own words and pairs and asks for the counts of
these in all chunks. The questions go into buckets by the hash of the word or pair, about one for
``BUCKET`` tokens of the corpus, and travel as one compressed row for each chunk and bucket; the
answers come back in the order of the questions. So a word or pair moves once a chunk that holds it,
however often it stands there, and the most frequent one fills no task.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from phrasemill.llm.common import mix, slices, stage

#: Classes of the words outside a vocabulary of a given size.
CLASSES = 127
#: Weight of the pair's own frequency; the rest goes to the frequency of the token alone.
PAIR_WEIGHT = 0.7
#: Distinct words that a task holds before it passes its counts on.
HELD = 400_000
#: Code points of a chunk of documents; a longer text is a chunk of its own.
CHUNK = 1 << 23
#: Tokens of the corpus for each bucket, and the buckets that any corpus has.
BUCKET, LEAST_BUCKETS = 1 << 19, 64


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_class(word: bytes) -> int:
    """The class of a word outside a vocabulary of a given size."""
    return zlib.crc32(b"%d %s" % (min(len(word), 16), word[-2:])) % CLASSES


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush():
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(words(text))
            if len(held) > HELD:
                yield from flush()
    yield from flush()


def vocabulary(texts: DataFrame, size: int) -> list[bytes]:
    """The most frequent words of all texts, smaller word first on ties; classes have the rest."""
    counts = texts.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(size - CLASSES - 1).collect()]


def _code(known: Callable[[], frozenset[bytes] | None]):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, number = known(), count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            texts, target = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in slices(texts, CHUNK):
                ids: defaultdict = defaultdict(count(1).__next__)
                codes: list[np.ndarray] = []
                n = [0, 0]
                for text, is_target in zip(texts[start:end], target[start:end], strict=True):
                    found = words(text)
                    if vocab is not None:  # no word has white space in it, so classes differ from all of them
                        found = [w if w in vocab else b"\t%d" % word_class(w) for w in found]
                    codes.append(np.array([0, *[ids[w] for w in found]], np.int32))
                    n[0] += len(found) * is_target
                    n[1] += len(found)
                own = sorted(ids)  # numbers in this order, so that pairs in order of their numbers compress well
                rank = np.zeros(len(own) + 1, np.int32)
                rank[[ids[w] for w in own]] = np.arange(1, len(own) + 1)
                columns = [c.slice(start, end - start) for c in batch.columns[2:]]
                rows = pa.StructArray.from_arrays(columns, fields=list(batch.schema)[2:])
                one = lambda items: pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(number)], pa.int64()), one(rows), pa.array([rank[np.concatenate(codes)].tobytes()], pa.binary()),
                     one(pa.array(own, pa.binary())), one(pa.array(target[start:end], pa.bool_())),
                     pa.array(n[:1], pa.int64()), pa.array(n[1:], pa.int64())],
                    names=["chunk", "rows", "code", "words", "targets", "n_target", "n_whole"])

    return code


def chunks(df: DataFrame, kept: list[str], text: str = "text", vocab: list[bytes] | None = None) -> DataFrame:
    """A row for each chunk of documents: its rows of the columns ``kept``, their tokens as numbers of
    the chunk's own words (0 starts a text), these words, and which rows are of the target."""
    if vocab is None:
        known = lambda: None
    else:
        shared = df.sparkSession.sparkContext.broadcast(vocab)
        known = lambda: frozenset(shared.value)
    target = F.coalesce(F.col("target").cast("boolean"), F.lit(False)) if "target" in df.columns else F.lit(False)
    plain = df.select(F.col(f"`{text}`").alias("t"), target.alias("y"), F.lit(True).alias("c"),
                      *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    row = StructType([StructField(f.name, f.dataType) for f in plain.schema.fields[2:]])
    schema = StructType([
        StructField("chunk", LongType()), StructField("rows", ArrayType(row)), StructField("code", BinaryType()),
        StructField("words", ArrayType(BinaryType())), StructField("targets", ArrayType(BooleanType())),
        StructField("n_target", LongType()), StructField("n_whole", LongType())])
    return stage(plain.mapInArrow(_code(known), schema), "lm-chunks")


class _Counts:
    """Counts of one chunk, target and whole in two rows: of each word as a token, of each word (and
    the start) before a token, and of each pair. ``all`` has them in this order, one behind the other."""

    def __init__(self, code: bytes, n_words: int, targets: list[bool]):
        numbers = np.frombuffer(code, np.int32)
        at = np.flatnonzero(numbers)
        self.size = n_words + 1
        self.doc = (np.cumsum(numbers == 0) - 1)[at]
        before, token = numbers[at - 1].astype(np.int64), numbers[at].astype(np.int64)
        self.pairs, self.inverse = np.unique(before * self.size + token, return_inverse=True)
        weight = np.array(targets, bool)[self.doc].astype(float)
        both = lambda items, n: [np.bincount(items, weight, n), np.bincount(items, minlength=n)]
        self.all = np.concatenate(
            [both(token - 1, n_words), both(before, self.size), both(self.inverse, len(self.pairs))], axis=1).astype(np.int64)

    def keys(self, own: pa.Array) -> pa.Array:
        """The names of all that is counted: ``word``, ``word`` and a space, two words with a space."""
        full = pa.concat_arrays([pa.array([b""], pa.binary()), own])
        empty, space = pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary())
        before, token = np.divmod(self.pairs, self.size)
        return pa.concat_arrays([
            own, pc.binary_join_element_wise(full, empty, space),
            pc.binary_join_element_wise(full.take(pa.array(before)), full.take(pa.array(token)), space)])

    def dealt(self, own: pa.Array, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of all that is counted by buckets, in each words first, and where buckets begin."""
        value = np.array([0, *[zlib.crc32(w) + 1 for w in own.to_pylist()]], np.uint64)
        before, token = np.divmod(self.pairs, self.size)
        far = np.uint64(1 << 33)
        hashed = mix(np.concatenate([value[1:], value + far, mix(value[before] + far) + value[token]]))
        bucket = (hashed % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def _squeeze(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _numbers(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 16 * n, codec="zstd", asbytes=True), np.int64).reshape(2, n)


def _ask(counted: bool, n_buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, code, targets = (batch.column(k)[i].as_py() for k in ("chunk", "code", "targets"))
                own = batch.column("words")[i].values
                found = _Counts(code, len(own), targets)
                order, starts = found.dealt(own, n_buckets)
                n = found.all[:, order] if counted else np.zeros_like(found.all)
                keys = found.keys(own).take(pa.array(order))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), keys), b"\n")
                rows = []
                for bucket, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    if a < b:
                        raw = joined[bucket].as_py()
                        rows.append({
                            "bucket": bucket, "chunk": chunk, "counted": counted, "n": b - a,
                            "n_words": int(np.searchsorted(-(order[a:b] < len(own)).astype(int), 0)),
                            "chars": len(raw), "keys": _squeeze(raw), "counts": _squeeze(n[:, a:b].tobytes())})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ASKED_ARROW)

    return ask


_ASKED = StructType([
    StructField("bucket", LongType()), StructField("chunk", LongType()), StructField("counted", BooleanType()),
    StructField("n", LongType()), StructField("n_words", LongType()), StructField("chars", LongType()),
    StructField("keys", BinaryType()), StructField("counts", BinaryType())])
_ASKED_ARROW = to_arrow_schema(_ASKED)
_TOLD = StructType([
    StructField("chunk", LongType()), StructField("bucket", LongType()), StructField("n", LongType()),
    StructField("kinds", LongType()), StructField("counts", BinaryType())])


def _answer(asked: pa.Table) -> pa.Table:
    """Sums over all chunks for one bucket, in the order of each question; the first row of the bucket
    has the number of its distinct words in counted chunks."""
    rows = asked.to_pylist()
    lists = [pa.decompress(r["keys"], r["chars"], codec="zstd", asbytes=True).split(b"\n") for r in rows]
    at = pa.array(chain.from_iterable(lists), pa.binary()).dictionary_encode().indices.to_numpy()
    counts = np.concatenate([_numbers(r["counts"], r["n"]) for r in rows], axis=1)
    sums = np.stack([np.bincount(at, c) for c in counts]).astype(np.int64)[:, at]
    ends = np.cumsum([0, *[r["n"] for r in rows]])
    seen = [at[a : a + r["n_words"]] for a, r in zip(ends[:-1], rows, strict=True) if r["counted"]]
    kinds = len(np.unique(np.concatenate(seen))) if seen else 0
    return pa.Table.from_pylist(
        [{"chunk": r["chunk"], "bucket": r["bucket"], "n": r["n"], "kinds": 0 if i else kinds,
          "counts": _squeeze(sums[:, ends[i] : ends[i + 1]].tobytes())} for i, r in enumerate(rows)], schema=to_arrow_schema(_TOLD))


class Model:
    """The counted chunks, the tokens in target and whole, and a closed vocabulary if there is one."""

    def __init__(self, counted: DataFrame, totals: tuple[int, int], vocab: list[bytes] | None):
        self.counted, self.totals, self.vocab = counted, totals, vocab


def learn(df: DataFrame, size: int | None = None, kept: list[str] | None = None) -> Model:
    """Count both models on ``df(text, target)``: the target rows, and all rows as background.

    Every word counts as itself. A caller who wants a closed vocabulary gives its ``size``: the most
    frequent words and ``CLASSES`` classes of all others. With the columns ``kept`` the rows learned
    from can be scored by :func:`score_learned`.
    """
    vocab = None if size is None else vocabulary(df.select("text"), size)
    counted = chunks(df, kept or [], vocab=vocab)
    sums = counted.agg(F.sum("n_target"), F.sum("n_whole")).first()
    return Model(counted, (sums[0] or 0, sums[1] or 0), vocab)


def _judge(totals: tuple[int, int], kinds: int, n_buckets: int, schema: pa.Schema):
    def bits(n: np.ndarray, found: _Counts, total: int) -> np.ndarray:
        """Bits of each pair: its frequency mixed with that of the token alone, to which every kind
        of token adds one."""
        words_end = found.size - 1
        before, token = np.divmod(found.pairs, found.size)
        one = (n[token - 1] + 1.0) / (total + kinds)
        seen = n[words_end + before]
        after = np.divide(n[words_end + found.size :], seen, out=np.zeros(len(before)), where=seen > 0)
        weight = np.where(seen > 0, PAIR_WEIGHT, 0.0)
        return -np.log2(weight * after + (1 - weight) * one)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for i in range(left.num_rows):
            own, targets = left.column("words").combine_chunks()[i].values, left.column("targets")[i].as_py()
            found = _Counts(left.column("code")[i].as_py(), len(own), targets)
            order, starts = found.dealt(own, n_buckets)
            n = np.zeros_like(found.all)
            for bucket, size, packed in zip(*[right.column(k).to_pylist() for k in ("bucket", "n", "counts")], strict=True):
                n[:, order[starts[bucket] : starts[bucket + 1]]] = _numbers(packed, size)
            gap = bits(n[0], found, totals[0]) - bits(n[1], found, totals[1])
            size = np.bincount(found.doc, minlength=len(targets))
            total = np.bincount(found.doc, gap[found.inverse], len(targets))
            score = np.divide(total, size, out=np.zeros(len(targets)), where=size > 0)
            rows = left.column("rows").combine_chunks()[i].values
            parts.append(pa.Table.from_arrays(
                [*rows.flatten()[1:], pa.array(size), pa.array(score, mask=size == 0)], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return judge


def _buckets(model: Model) -> int:
    return LEAST_BUCKETS + model.totals[1] // BUCKET


def _scored(asking: DataFrame, kept: list[str], asked: DataFrame, model: Model) -> DataFrame:
    """``kept``, ``n_tokens`` and ``score`` of the rows in the chunks ``asking``; only these have numbers from 0 on."""
    told = stage(asked.groupBy("bucket").applyInArrow(_answer, _TOLD), "lm-counts")
    if model.vocab is None:  # the start of a text and any word not seen are two kinds more
        kinds = (told.agg(F.sum("kinds")).first()[0] or 0) + 2
    else:
        kinds = len(model.vocab) + 1 + CLASSES
    row = asking.schema["rows"].dataType.elementType.fields[1:]
    schema = StructType([*row, StructField("n_tokens", LongType()), StructField("score", DoubleType())])
    judge = _judge(model.totals, kinds, _buckets(model), to_arrow_schema(schema))
    left = asking.select("chunk", "rows", "code", "words", "targets")
    out = left.groupBy("chunk").cogroup(told.where("chunk >= 0").groupBy("chunk")).applyInArrow(judge, schema)
    return out.toDF(*kept, "n_tokens", "score")


def score_learned(model: Model, kept: list[str]) -> DataFrame:
    """``n_tokens`` and ``score`` of the rows that ``model`` was learned from with these columns ``kept``."""
    return _scored(model.counted, kept, model.counted.mapInArrow(_ask(True, _buckets(model)), _ASKED), model)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``score`` to every row: the mean loss difference, lower nearer the target.

    Null and empty texts have no token and a null score. Columns of the input with these names are
    replaced.
    """
    kept = [c for c in df.columns if c not in ("n_tokens", "score")]
    asking = chunks(df, kept, text, model.vocab)
    n = _buckets(model)
    learned = model.counted.withColumn("chunk", -1 - F.col("chunk")).mapInArrow(_ask(True, n), _ASKED)
    return _scored(asking, kept, learned.union(asking.mapInArrow(_ask(False, n), _ASKED)), model)
