"""Links and components of vectors against the comparison of all pairs."""

import numpy as np
import pytest

from phrasemill.llm import embeddings
from phrasemill.llm.embeddings import fit, multi_sequence, near_duplicates, unit

SCHEMA = "vec_id bigint, embedding array<float>, label int, kept string"


def plain(rows):
    """{vec_id: (links, component)} of unique ids."""
    ok = {}
    for vec_id, v, label, *_ in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault((label, len(v)), []).append((vec_id, v))
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for group in ok.values():
        x = unit(np.array([v for _, v in group], np.float32).astype(float))
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)), strict=True):
            a, b = group[i][0], group[j][0]
            links[a] += 1
            links[b] += 1
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: (links[i], find(i)) for i in links}


def near(rng, base, cosine):
    step = rng.normal(size=len(base))
    step -= step @ base * base
    return cosine * base + np.sqrt(1 - cosine**2) * step / np.linalg.norm(step)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    out = []
    for _ in range(150):
        base = unit(rng.normal(size=(1, 16)))[0]
        label = int(rng.integers(3))
        for _ in range(int(rng.integers(1, 5))):
            out.append((len(out) * 3 + 1, (near(rng, base, rng.uniform(0.97, 1)) * rng.uniform(0.5, 2)).tolist(), label, "x"))
    base = unit(rng.normal(size=(1, 16)))[0]
    hot = [near(rng, base, rng.uniform(0.985, 0.9999)).tolist() for _ in range(150)]
    out += [(10_000 + i, v, 1, "x") for i, v in enumerate(hot)]
    out += [(20_000 + i, hot[0], 1, "x") for i in range(40)] + [(30_000, hot[0], 2, "x"), (30_001, hot[0], None, "x")]
    return out


def test_links_and_components(spark, rows):
    want = plain(rows)
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), chunk=64).collect()}
    assert set(got) == set(want)
    found = sum(r.n_links for r in got.values())
    assert found >= 0.97 * sum(n for n, _ in want.values())
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(got[i].component_id != want[i][1] for i in want) <= 0.02 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert got[20_005].n_links == got[10_000].n_links >= 180


def test_all_cells_give_all_links(spark, rows, monkeypatch):
    monkeypatch.setattr(embeddings, "TARGET_RECALL", 1.0)
    everything = lambda *a, **k: (lambda i: setattr(i, "visits", len(i.first) * len(i.second)) or i)(fit(*a, **k))
    monkeypatch.setattr(embeddings, "fit", everything)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), centroids=3, chunk=50).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain(rows)


def test_edges(spark):
    one, two = [1.0, 0.0, 0.0, 0.0], [0.99, 0.01, 0.0, 0.0]
    odd = [(1, one, 5, None), (2, two, 5, None), (3, None, 5, None), (4, [0.0] * 4, 5, None), (5, [None, 1.0, 0.0, 0.0], 5, None),
           (6, [float("nan"), 1.0, 0.0, 0.0], 5, None), (7, [float("inf"), 1.0, 0.0, 0.0], 5, None), (8, [], 5, None),
           (9, one, None, None), (10, [1.0, 0.0], 5, None), (11, [1.0, 0.0], 5, None), (12, [-0.0, 1.0, 0.0, 0.0], 5, None),
           (13, [0.0, 1.0, 0.0, 0.0], 5, None), (14, [-1.0, 0.0, 0.0, 0.0], 5, None)]
    df = spark.createDataFrame(odd, SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    alone = {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 14)}
    assert got == alone | {1: (1, 1, True), 2: (1, 1, False), 10: (1, 10, True), 11: (1, 10, False), 12: (1, 12, True), 13: (1, 12, False)}
    twice = spark.createDataFrame([(1, one, 5, None), (1, one, 5, None), (None, one, 5, None)], SCHEMA)
    assert sorted(map(str, map(tuple, near_duplicates(twice).collect()))) == [
        "(1, 2, 1, True)", "(1, 2, 1, True)", "(None, 0, None, False)"]
    assert near_duplicates(df.where("vec_id < 0")).count() == 0


def test_multi_sequence_visits_in_order():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.random(5), rng.random(7)
        got = multi_sequence(a, b, 20)
        sums = (a[:, None] + b[None, :]).ravel()
        assert np.allclose(sums[got], np.sort(sums)[:20]) and len(set(got)) == 20


def test_recall_on_the_table(spark):
    """Vectors of the given table with neighbours planted near the threshold: displaced in a random
    direction, or in one half only, which leaves the cell most often."""
    rng = np.random.default_rng(4)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").limit(900).collect()
    rows = [(r.vec_id, list(r.embedding), r.label, None) for r in table]
    for k, r in enumerate(table):
        vector = np.array(r.embedding) / np.linalg.norm(r.embedding)
        step, half = rng.normal(size=len(vector)), len(vector) // 2
        if k % 3:
            step[(slice(half), slice(half, None))[k % 3 - 1]] = 0
        step -= step @ vector * vector
        near = 0.983 * vector + np.sqrt(1 - 0.983**2) * step / np.linalg.norm(step)
        rows.append((1_000_000 + r.vec_id, near.tolist(), r.label, None))
    want = plain(rows)
    got = {r.vec_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    links = sum(n for n, _ in want.values())
    assert sum(got.values()) >= 0.95 * links and links >= 900
    assert all(got[i] <= want[i][0] for i in want)
