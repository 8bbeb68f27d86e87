"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.session import scratch_dir

#: Bytes of rows in one Arrow batch, about; both sides of a Python task hold several batches.
BATCH = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python tasks in batches of about ``BATCH`` bytes, not of Spark's 64 MB.

    A session's own smaller or larger bound stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, f"{BATCH}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str, compression: str | None = None, wide: bool = False) -> DataFrame:
    """Write ``df`` once into the shared folder of ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage with files that every executor sees, so a lost executor costs only its
    running tasks. Columns are stored by position and renamed after, so names may clash or repeat.
    ``wide`` is for rows of megabytes: each is a row group of its own. Else a writer holds, and a reader
    unpacks at once, up to a hundred of them, as many as a task has.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    options = {"parquet.block.row.count.limit": "1"} if wide else {}
    plain.write.options(**options).parquet(path, compression=compression)
    back = spark.read.schema(plain.schema).parquet(path)
    out = back.toDF(*df.columns)
    out._staged_at = path
    return out


def release(df: DataFrame | None) -> None:
    """Empty the files of a staged frame that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        df.sparkSession.range(0).write.mode("overwrite").parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that nothing may be learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def slices(texts: list[str | None], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``chars`` code points each, so that work arrays stay small."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over ``uint64`` values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
