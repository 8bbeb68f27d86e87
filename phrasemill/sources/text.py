"""Text sources and sinks: question lists, prompt templates and context files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.operators.numbering import number_by_file, with_split
from phrasemill.operators.questions import clean_lines


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file or folder with their places in the files, not yet numbered.

    Question lists are cleaned and numbered from such a scan without moving a line.
    """
    return with_split(spark.read.text(path)).withColumnRenamed("value", "line")


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of a text file or folder, numbered from 0 in file order."""
    return number_by_file(scan_lines(spark, path), "line_no").select("line_no", "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines without blanks and ``//`` comments, under their original line numbers."""
    return clean_lines(read_raw_lines(spark, path))


def write_lines(combined: DataFrame, path: str) -> None:
    """Write ``(source, position, line)`` rows in order, one line each.

    The sort is a range partitioning: part files in name order hold the list in order.
    """
    combined.orderBy("source", "position").select("line").write.text(path)


def load_template(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(template, template_chars)`` holding a whole prompt template file."""
    size = F.length("value").cast("bigint")
    checked = F.when(size > 0, F.col("value")).otherwise(
        F.raise_error(F.lit("the prompt template is empty"))
    )
    return spark.read.text(path, wholetext=True).select(
        checked.alias("template"), size.alias("template_chars")
    )


def load_context(
    spark: SparkSession, folder: str, missing_ok: bool = True, max_bytes: int | None = None
) -> DataFrame:
    """One row ``(context, context_chars)``: every ``*.json`` file under its bracketed name.

    Files come in name order. A context is one text that goes into every prompt, so it has to fit
    a model's window; ``max_bytes`` is the caller's own bound, checked from the file listing before
    any content is read. A missing folder gives an empty context, or an error unless ``missing_ok``.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    except AnalysisException as error:
        if not missing_ok or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(1).select(
            F.lit("").alias("context"), F.lit(0).cast("bigint").alias("context_chars")
        )
    if max_bytes is not None:
        size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]  # one number
        if size > max_bytes:
            raise ValueError(f"context files hold {size} bytes, more than {max_bytes}")
    bodies = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(
        F.col("_metadata.file_name").alias("name"), "value"
    )
    parts = F.array_sort(F.collect_list(F.struct("name", "value")))
    text = F.array_join(
        F.transform(parts, lambda p: F.concat(F.lit("\n\n["), p["name"], F.lit("]\n"), p["value"])), ""
    )
    return bodies.agg(text.alias("context")).select(
        "context", F.length("context").cast("bigint").alias("context_chars")
    )
