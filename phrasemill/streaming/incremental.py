"""Incremental conversion of arriving example files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phrasemill.functions.lexicon import DEFAULT, Lexicon
from phrasemill.functions.splice import is_editable
from phrasemill.operators.convert import convert_examples, convert_output, convert_question
from phrasemill.schemas import EXAMPLE
from phrasemill.sources.examples import parse_records


def example_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over parquet example files of a folder."""
    reader = spark.readStream.schema(EXAMPLE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def incremental_convert(
    stream: DataFrame, out: str, checkpoint: str, lexicon: Lexicon = DEFAULT, available_now: bool = True
) -> StreamingQuery:
    """Convert each example once, whatever restarts happen in between.

    Conversion keeps no state; the checkpoint records which files are done and the parquet sink
    commits each batch once, so a resumed run goes on where the last one stopped.
    """
    writer = (
        convert_examples(stream, lexicon).writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def line_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the lines of JSON Lines files of a folder."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def convert_lines(lines: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``(kind, example_id, input, output_json, problem, record)`` of the lines of one batch.

    ``kind`` is ``converted`` or ``rejected``; a rejected line has the reason and itself instead of an
    example. Blank lines are no records. Ids are unique within the batch.
    """
    rows = lines.where(F.trim("value") != "").withColumn("example_id", F.monotonically_increasing_id())
    read = parse_records(rows, F.col("value"))
    foreign = F.when(~is_editable(F.col("output_json")), F.lit("output is no object that can be edited"))
    read = read.withColumn("problem", F.coalesce("problem", foreign))
    record = F.coalesce("record", F.to_json(F.struct("input", F.col("output_json").alias("output"))))
    good = F.col("problem").isNull()
    split = read.select(
        F.when(good, F.lit("converted")).otherwise(F.lit("rejected")).alias("kind"), "example_id",
        F.when(good, F.col("input")).alias("input"), F.when(good, F.col("output_json")).alias("output_json"),
        "problem", F.when(~good, record).alias("record"),
    )
    # both kinds go through the conversion, where nulls stay nulls, so that a batch is parsed once
    return convert_output(convert_question(split, "input", lexicon))


def incremental_convert_lines(
    stream: DataFrame, out: str, checkpoint: str, lexicon: Lexicon = DEFAULT, available_now: bool = True,
    then: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Convert the records of a line stream and put aside what is none, each line once in one of the two.

    A micro-batch is written by one job into the folder of its number, converted examples and rejects as
    two partitions of it. A batch that is run again after a failure overwrites its folder, so neither part
    can be doubled, lost or out of step with the other. ``then`` is called with the number of each batch
    that has been written.
    """

    def write(batch: DataFrame, number: int) -> None:
        convert_lines(batch, lexicon).write.mode("overwrite").partitionBy("kind").parquet(f"{out}/batch={number}")
        if then is not None:
            then(number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


_LINES = f"batch bigint, kind string, {EXAMPLE}, problem string, record string"


def converted_lines(spark: SparkSession, out: str) -> DataFrame:
    """``(batch, example_id, input, output_json)``: what :func:`incremental_convert_lines` converted."""
    rows = spark.read.schema(_LINES).parquet(out).where("kind = 'converted'")
    return rows.select("batch", "example_id", "input", "output_json")


def rejected_lines(spark: SparkSession, out: str) -> DataFrame:
    """``(batch, problem, record)``: what it put aside, with the reason."""
    return spark.read.schema(_LINES).parquet(out).where("kind = 'rejected'").select("batch", "problem", "record")
