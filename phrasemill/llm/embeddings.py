"""Near-duplicate vectors by an inverted multi-index.

Each half of a unit vector has a codebook of its own; the two nearest centroids of a vector name its
cell in the product grid. A vector looks for its neighbours in the cells nearest to it: the
multi-sequence traversal lists the cells of the grid in order of the sum of the two squared
distances. How many cells are visited is set on the fitting sample, as the least number at which the
pairs found among its vectors and small displacements of them reach the target recall.

Every vector is indexed and every vector searches, within its label. Candidates of a cell are
verified by exact cosine in double precision, in blocks of bounded size: vectors of a crowded cell
are split into chunks and each pair of chunks is one task-sized product, so a cell that holds a
third of all rows is spread and no list of pairs is ever written. A block passes on numbers of links
and a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import stage
from phrasemill.llm.components import components

THRESHOLD = 0.98
#: Vectors that the codebooks are fitted on and the visits are set on: those of smallest hash.
SAMPLE = 8_192
#: Centroids of each half; the grid has the square of it. A larger table wants a larger number.
CENTROIDS = 16
TARGET_RECALL = 0.995
#: Vectors of a cell in one block.
CHUNK = 1024
FLOATS = "array<double>"


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vector: str) -> F.Column:
    """Not null, no null or non-finite component, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(some, F.lit(False)), F.lit(False))


def kmeans(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids of a bounded sample: farthest-first starts, then Lloyd steps. Deterministic."""
    if len(points) == 0:
        return np.zeros((1, points.shape[1]))
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < min(k, len(points)):
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    centers = points[chosen].copy()
    for _ in range(rounds):
        own = squares(points, centers).argmin(axis=1)
        for c in range(len(centers)):
            if (own == c).any():
                centers[c] = points[own == c].mean(axis=0)
    return centers


def squares(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ centers.T + (centers**2).sum(axis=1)[None], 0)


def multi_sequence(first: np.ndarray, second: np.ndarray, visits: int) -> list[int]:
    """The ``visits`` cells of least summed distance, nearest first, by walking both sorted lists.

    Cell (i, j) is taken up once (i-1, j) and (i, j-1) have been visited; a heap gives the next.
    Cells are numbered ``i * len(second) + j`` by the places in the given arrays.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], set(), []
    while heap and len(out) < visits:
        _, i, j = heappop(heap)
        seen.add((i, j))
        out.append(int(a[i]) * len(b) + int(b[j]))
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in seen):
            heappush(heap, (first[a[i + 1]] + second[b[j]], i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in seen):
            heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
    return out


@dataclass
class Index:
    """Two codebooks and the number of cells that a search visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def cells(self, rows: np.ndarray, visits: int) -> np.ndarray:
        """The nearest cells of each unit vector, home first."""
        half = rows.shape[1] // 2
        one, two = squares(rows[:, :half], self.first), squares(rows[:, half:], self.second)
        if visits == 1:
            return (one.argmin(axis=1) * len(self.second) + two.argmin(axis=1))[:, None]
        return np.array([multi_sequence(a, b, visits) for a, b in zip(one, two, strict=True)])


def fit(rows: np.ndarray, threshold: float = THRESHOLD, centroids: int = CENTROIDS, target: float = TARGET_RECALL) -> Index:
    """Fit codebooks on unit vectors of a sample and set the visits that reach the target recall.

    The pairs are each vector of the sample and one displaced by just the angle of the threshold in a
    random direction: a pair as far apart as links can be.
    """
    half = rows.shape[1] // 2
    index = Index(kmeans(rows[:, :half], centroids), kmeans(rows[:, half:], centroids), 1)
    grid = len(index.first) * len(index.second)
    if not len(rows):
        return index
    rng = np.random.default_rng(0)
    step = rng.normal(size=rows.shape)
    step = step - (step * rows).sum(axis=1, keepdims=True) * rows
    size = np.linalg.norm(step, axis=1, keepdims=True)
    step = np.where(size > 0, step / np.where(size > 0, size, 1), 0)
    there = unit(threshold * rows + np.sqrt(1 - threshold**2) * step)
    home = index.cells(there, 1)[:, 0]
    own = index.cells(rows, 1)[:, 0]
    order, back = index.cells(rows, grid), index.cells(there, grid)
    # a pair is found if either of the two visits the other's cell
    rank = np.minimum((order == home[:, None]).argmax(axis=1), (back == own[:, None]).argmax(axis=1))
    index.visits = int(np.quantile(rank, target, method="higher")) + 1
    return index


def sample(rows: DataFrame, size: int = SAMPLE) -> np.ndarray:
    """At most ``size`` usable vectors of the most frequent dimension, as unit vectors."""
    part = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("vector").collect()
    vectors = [r["vector"] for r in part]
    if not vectors:
        return np.zeros((0, 2))
    dims = pd.Series([len(v) for v in vectors]).mode().max()
    return unit(np.array([v for v in vectors if len(v) == dims], float))


def _place(shared, visits: int):
    """Home cell and visited cells of every vector."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        dims = index.first.shape[1] + index.second.shape[1]
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            cells: list[list[int]] = [[-len(v)] for v in vectors]  # another dimension: cells of its own
            fit_in = [i for i, v in enumerate(vectors) if len(v) == dims]
            if fit_in:
                found = index.cells(unit(np.array([vectors[i] for i in fit_in], float)), visits)
                for i, c in zip(fit_in, found, strict=True):
                    cells[i] = c.tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    return place


def _forest(hit: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix the least node that each node reaches."""
    label = np.arange(len(hit))
    while True:
        least = np.minimum(label, np.where(hit, label[None, :], len(hit)).min(axis=1, initial=len(hit)))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def block_links(guests: pd.DataFrame, hosts: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between guests of a cell and hosts at home there: ``(vec_id, n, root)``.

    A pair that both search directions find is counted in one place only: in the common home cell
    for the guest of smaller id, else in the cell of the pair's larger id.
    """
    x = unit(np.array(guests["vector"].tolist(), float))
    y = unit(np.array(hosts["vector"].tolist(), float))
    hit = x @ y.T >= threshold
    if hit.any():
        gi, hi = guests["vec_id"].to_numpy(), hosts["vec_id"].to_numpy()
        a, b = np.nonzero(hit)
        cell = guests["cell"].iloc[0]
        back = [guests["home"].iat[i] in hosts["cells"].iat[j] for i, j in zip(a, b, strict=True)] \
            if (guests["home"] != cell).any() else [True] * len(a)
        count = (gi[a] < hi[b]) | ~np.array(back, bool)
        hit[a[~count], b[~count]] = False
    n, m = hit.shape
    ids = np.concatenate([guests["vec_id"].to_numpy(), hosts["vec_id"].to_numpy()])
    weights = np.concatenate([guests["copies"].to_numpy(), hosts["copies"].to_numpy()])
    degree = np.concatenate([hit @ weights[n:], weights[:n] @ hit])
    both = np.zeros((n + m, n + m), bool)
    both[:n, n:], both[n:, :n] = hit, hit.T
    label = _forest(both)
    keep = degree > 0
    return pd.DataFrame({"vec_id": ids[keep], "n": degree[keep], "root": ids[label[keep]]})


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, centroids: int = CENTROIDS,
                    sample_size: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``df(vec_id, embedding, label)``.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing: no links, a component of their own. Rows that share label and vector are copies:
    they link with each other (and count as such), and only one of them is searched. Rows that
    repeat a vec_id are one node, whose links are those of all its rows. A null vec_id keeps a null
    component and is not kept. Vectors of different lengths never link.
    """
    spark = df.sparkSession
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), F.col("embedding"))
    good = rows.where(usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).select(
        "vec_id", "label", F.col("embedding").cast(FLOATS).alias("vector"))
    # -0.0 and 0.0 are one number but two bit patterns
    good = good.withColumn("vector", F.transform("vector", lambda x: x + 0.0))
    copies = good.groupBy("label", "vector").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies"))
    heads = stage(copies.select(F.col("head").alias("vec_id"), "copies", "label", "vector"), "vector-heads")
    named = good.join(copies.select("label", "vector", "head", "copies"), ["label", "vector"])
    own = stage(named.select("vec_id", "head", "copies"), "vector-copies")
    index = fit(sample(heads, sample_size), threshold, centroids)
    shared = spark.sparkContext.broadcast(index)
    kind = heads.schema["label"].dataType.simpleString()
    placed = stage(
        heads.mapInArrow(_place(shared, index.visits),
                         f"vec_id bigint, copies bigint, label {kind}, vector {FLOATS}, cells array<bigint>"),
        "vector-cells",
    ).withColumn("home", F.get("cells", F.lit(0)))
    hosts = placed.select("*", F.col("home").alias("cell"))
    guests = placed.select("*", F.explode("cells").alias("cell"))
    split = lambda rows, name: rows.groupBy("label", "cell").agg(F.ceil(F.count("*") / chunk).alias(name))
    sizes = split(hosts, "host_chunks").join(split(guests, "guest_chunks"), ["label", "cell"])
    pick = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n)
    # each side meets every chunk of the other
    sides = []
    for side, mine, other, role in ((hosts, "host_chunks", "guest_chunks", 0), (guests, "guest_chunks", "host_chunks", 1)):
        sides.append(
            side.join(sizes, ["label", "cell"])
            .withColumn("mine", pick(F.col(mine), role))
            .withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
            .select("label", "cell", F.col("mine" if role == 0 else "theirs").alias("h"),
                    F.col("theirs" if role == 0 else "mine").alias("g"), F.lit(role).alias("role"),
                    "vec_id", "copies", "vector", "home", F.when(F.lit(role) == 0, F.col("cells")).alias("cells"))
        )

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        role = group["role"] == 1
        if role.all() or not role.any():
            return pd.DataFrame({"vec_id": [], "n": [], "root": []}).astype("int64")
        out = [block_links(g, group[~role & (group["vector"].str.len() == d)], threshold)
               for d, g in group[role].groupby(group["vector"].str.len()) if (~role & (group["vector"].str.len() == d)).any()]
        return pd.concat(out)

    links = stage(
        sides[0].union(sides[1]).groupBy("label", "cell", "h", "g").applyInPandas(verify, "vec_id bigint, n bigint, root bigint"),
        "vector-links",
    )
    # copies hang on their head, and a vec_id on all heads that its rows have
    edges = links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).union(own.select(F.col("vec_id").alias("a"), F.col("head").alias("b")))
    parts = components(edges)
    degree = links.groupBy(F.col("vec_id").alias("head")).agg(F.sum("n").alias("n"))
    counted = (
        own.join(degree, "head", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
        .groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    )
    about = counted.join(parts.select(F.col("node").alias("vec_id"), F.col("component").alias("c")), "vec_id", "left")
    return rows.select("vec_id").join(about, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("c", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("c", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
