"""The stages one by one on a small table, and the whole pipeline on a given one."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phrasemill.llm import jaccard, langid, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [
        (1, clean, "en", "a", 5), (2, clean + " end", "en", "a", 5), (3, None, "en", None, None), (4, "", None, "a", 0),
        (5, "12 34", "en", "a", 5), (6, "Before. " + item + " after", "en", "b", 9), (None, "alone here now", None, None, None),
        (None, "alone here now", None, None, None), (7, "one short", "fr", "c", 9), (7, "one short", "fr", "c", 9),
        (8, "You idiot! you moron, stupid trash clown and worthless scum " * 2, "en", "c", 4),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_stages(spark, docs):
    by = dict(corpus_pipeline.STAGES)
    assert list(by) == ["language", "toxicity", "near_duplicates", "benchmark", "packing"]
    kept = {name: by[name](spark, docs, SF) for name in by}
    for name in list(by)[:-1]:
        assert kept[name].columns == docs.columns
    assert ids(kept["language"]) == [1, 2, 6, 7, 7, 8, None, None]
    assert ids(kept["near_duplicates"]) == [1, 3, 4, 5, 6, 7, 8, None]
    assert ids(kept["benchmark"]) == [1, 2, 3, 4, 5, 7, 7, 8, None, None]
    assert len(ids(kept["packing"])) == docs.count()
    none = docs.where(F.lit(False))
    for name in by:
        assert by[name](spark, none, SF).count() == 0


def test_run(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = corpus_pipeline.run(spark, SF)
    packed = {r.doc_id for r in out.collect()}
    assert 0 < len(packed) < rows.count()
    groups = jaccard.near_duplicates(rows).collect()
    assert len({r.component_id for r in groups if r.doc_id in packed}) == len(packed)
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(packed & clean) > len(clean) / 2


def test_toxic_documents_go(spark):
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.toxic(spark, rows, path).select("doc_id").collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    assert sum(marks[d] for d in marks if d in kept) <= 0.35 * sum(marks.values())
    assert sum(1 - marks[d] for d in marks if d in kept) >= 0.98 * sum(1 - m for m in marks.values())


def test_long_texts_reach_tasks_in_batches_of_bounded_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.range(0, 1500, 1, 1).select(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" words ")), 2000).alias("text"))
    before = spark.conf.get(name)
    try:
        for judge in (lambda: toxicity.score(df, None), lambda: langid.learn(df.select("text", F.lit("en").alias("lang")))):
            spark.conf.unset(name)
            judge()
            sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint").collect()
            assert sum(n for n, in sizes) > 12_000_000 and max(n for n, in sizes) < 10_000_000
        spark.conf.set(name, "5000000b")
        judge()
        assert spark.conf.get(name) == "5000000b"
    finally:
        spark.conf.set(name, before)
