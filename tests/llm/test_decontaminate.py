"""The scan against SQL, a plain version and hand-made rows."""

import hashlib
import random
import re

from compare import connect, difference
from pyspark.sql import functions as F

from phrasemill.llm.decontaminate import decontaminate, scan
from phrasemill.llm.queries import ORACLE, op9_benchmark_decontamination

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items):
    known = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if w else ():
            known.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in known}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in known:
                    hit |= set(range(i, i + size))
                    found |= known[tuple(w[i : i + size])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def test_table_against_sql(spark):
    with connect(SF) as con:
        assert difference(op9_benchmark_decontamination(spark, SF), con, ORACLE["op9_benchmark_decontamination"]) == ""


def test_random_rows(spark):
    rng = random.Random(2)
    vocab = [*"abcdefg", "É", "é", "Z9", "x_y", "-"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice((1, 2, 3, 5, 9, 10, 14)))) for i in range(12)] + [(50, None), (51, "--"), (52, "")]
    items += [(60, items[0][1]), (9, "b a d " * 4)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(80)] + [(100, None), (101, " . ")]
    docs += [(200 + i, "x " + items[i][1] + " Y") for i in range(12)]
    df = spark.createDataFrame([(d, t, "c", 5) for d, t in docs], "doc_id bigint, text string, n_hit string, size int")
    out = scan(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert out.columns[:3] == ["doc_id", "text", "size"]
    assert sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=str) == plain(docs, items)


def test_edges(spark):
    item = spark.createDataFrame([(1, "the Quick brown fox jumps over a lazy dog today or so")], "item_id int, text string")
    long = "word " * 100_000
    bad = "Start. The quick, brown FOX jumps over a lazy dog today -- or so; END!"
    rows = [(1, None), (2, ""), (3, bad), (3, bad), (None, bad), (4, "The quick"), (5, long + bad)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in scan(df, item).select(*COLUMNS).collect()), key=str)
    assert got == plain(rows, [(1, "the Quick brown fox jumps over a lazy dog today or so")])
    assert sorted(str(r.doc_id) for r in decontaminate(df, item).collect()) == ["1", "2", "4"]
    cut = decontaminate(df, item, remove="spans")
    assert cut.columns == df.columns
    by = {r.doc_id: r.text for r in cut.collect()}
    assert by[3] == "Start. END!" == by[None] and by[5] == long + "Start. END!" and by[4] == "The quick" and by[1] is None
    assert scan(cut, item).where("contaminated").count() == 0
    assert scan(df.where(F.lit(False)), item).count() == 0
    assert scan(df, item.where(F.lit(False))).where("n_hit > 0 or n_items > 0 or contaminated").count() == 0


def test_no_python_in_the_plan(spark):
    plan = op9_benchmark_decontamination(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
