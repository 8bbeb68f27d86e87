"""Global 0-based positions without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BITS = 20  # a bucket spans 2**20 line numbers, a bucket of buckets 2**40


def number_by_line(df: DataFrame, line_no: str = "line_no", position: str = "position") -> DataFrame:
    """0-based rank of each row by its unique integer ``line_no``.

    Rows are ranked inside buckets of about a million consecutive line numbers, so no window
    group can be larger than that, whatever the data. Bucket sizes are then summed in two
    levels; buckets are cut by value, not by sampled ranges, so recomputed tasks agree.
    """
    bucketed = df.withColumn("_pm_b", F.shiftright(line_no, _BITS))
    within = bucketed.withColumn(
        "_pm_r", F.row_number().over(Window.partitionBy("_pm_b").orderBy(line_no)) - 1
    )
    sizes = (
        bucketed.groupBy("_pm_b")
        .agg(F.count(F.lit(1)).alias("_pm_n"))
        .withColumn("_pm_bb", F.shiftright("_pm_b", _BITS))
    )
    inner = sizes.withColumn(
        "_pm_inner",
        F.sum("_pm_n").over(
            Window.partitionBy("_pm_bb").orderBy("_pm_b").rowsBetween(Window.unboundedPreceding, -1)
        ),
    )
    # One row per 2**40 line numbers: a single row for any list below a trillion lines.
    outer = (
        sizes.groupBy("_pm_bb")
        .agg(F.sum("_pm_n").alias("_pm_nn"))
        .withColumn(
            "_pm_outer",
            F.sum("_pm_nn").over(
                Window.partitionBy(F.lit(0)).orderBy("_pm_bb").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("_pm_nn")
    )
    offsets = inner.join(outer, "_pm_bb").select(
        "_pm_b",
        (F.coalesce("_pm_inner", F.lit(0)) + F.coalesce("_pm_outer", F.lit(0))).alias("_pm_off"),
    )
    return (
        within.join(offsets, "_pm_b")
        .withColumn(position, (F.col("_pm_off") + F.col("_pm_r")).cast("bigint"))
        .drop("_pm_b", "_pm_r", "_pm_off")
    )


def with_split(scan: DataFrame) -> DataFrame:
    """Add the place of every row of a file scan that :func:`number_by_file` works with."""
    return scan.select(
        "*", F.col("_metadata.file_path").alias("_pm_path"), F.col("_metadata.file_block_start").alias("_pm_block"),
    )


def number_by_file(df: DataFrame, position: str, probe: str | None = None) -> DataFrame:
    """0-based position of each row of a file *scan*, in path order and order inside the file.

    ``df`` must be a scan that carries ``_pm_path`` and ``_pm_block`` (see :func:`with_split`); it may
    have been filtered, and then only the rows that are left count. They get a running number here, so
    those of one split are consecutive, and a row's position is the number of rows in earlier splits plus
    its distance from the split's first row. Only one small row per split is sorted; no row of the scan
    is moved. ``probe`` names a column that makes a row exist at
    all: without it the counting scan of a JSON source would read no column and count blank
    lines too.
    """
    df = df.withColumn("_pm_mid", F.monotonically_increasing_id())
    rows = F.count(F.lit(1))
    splits = df.groupBy("_pm_path", "_pm_block").agg(
        F.min("_pm_mid").alias("_pm_first"),
        (rows if probe is None else F.greatest(rows, F.count(probe))).alias("_pm_n"),
    )
    # One small row per split, so this single ordered sum is bounded by the file listing.
    order = Window.partitionBy(F.lit(0)).orderBy("_pm_path", "_pm_block")
    before = F.sum("_pm_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select(
        "_pm_path", "_pm_block", "_pm_first", F.coalesce(before, F.lit(0)).alias("_pm_off")
    )
    # One small row a split: the list of splits is what the driver holds anyway to plan the scan
    # (a million splits, 128 TB, are some 60 MB), so no record is shuffled to get its number.
    return (
        df.join(F.broadcast(offsets), ["_pm_path", "_pm_block"])
        .withColumn(position, (F.col("_pm_off") + F.col("_pm_mid") - F.col("_pm_first")).cast("bigint"))
        .drop("_pm_path", "_pm_block", "_pm_mid", "_pm_first", "_pm_off")
    )
