"""A training corpus from raw documents: stages that each hand on what they keep.

language -> toxicity -> near duplicates -> decontamination -> packing. Every stage works on all
documents that the one before kept and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm import decontaminate, jaccard, langid, packing, toxicity
from phrasemill.llm.common import held_out, stage, table


def _row(docs: DataFrame) -> Column:
    """All columns in one, so that what an operator adds cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised go: null texts and those without a letter."""
    profiles = langid.learn(docs.where(~held_out(F.col("doc_id"))))
    found = langid.identify(docs.select(_row(docs), "text"), profiles)
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score from ``toxicity.THRESHOLD`` on go.

    The model learns from the labelled documents of the fold that ``op3`` learns from.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    found = toxicity.score(docs.select(_row(docs), "text"), model)
    return found.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id.

    A null doc_id is replaced, for the comparison only, by a large number made from the text. Rows
    of one id are one document; of these the row of the smallest text stays.
    """
    own = F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    rows = docs.select(_row(docs), F.coalesce(F.col("doc_id").cast("bigint"), own).alias("doc_id"), "text")
    groups = jaccard.near_duplicates(rows)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    return rows.join(kept, "doc_id").groupBy("doc_id").agg(F.min_by("row", F.struct("text")).alias("row")).select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of ``packing.CAPACITY`` words."""
    return packing.pack(packing.measured(docs))


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("packing", pack),
]

#: A fitted tagger decides in one stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
