"""Merging of numbered question lists.

A list is either a frame ``(line_no, line)``, whose order is that of ``line_no``, or a scan of text files
(``sources.text.scan_lines``), whose order is that of the files. Numbering a scan moves no line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.functions.text import drop_number, strip_edges
from phrasemill.operators.numbering import number_by_file, number_by_line

FIRST_NUMBER = 61  # fixed value: number of the first generated question


def clean_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines without blank ones and ``//`` comments, with their places."""
    trimmed = lines.withColumn("line", strip_edges(F.col("line")))
    return trimmed.filter((F.col("line") != "") & ~F.col("line").startswith("//"))


def strip_numbering(lines: DataFrame) -> DataFrame:
    """Cleaned lines without their leading number; numbers inside the text stay."""
    return clean_lines(lines).withColumn("line", drop_number(F.col("line")))


def _numbered(lines: DataFrame) -> DataFrame:
    """Add the 0-based ``position`` of every line."""
    if "line_no" in lines.columns:
        return number_by_line(lines)
    return number_by_file(lines, "position")


def renumber(lines: DataFrame, first: int = FIRST_NUMBER) -> DataFrame:
    """Cleaned lines with consecutive numbers in line order, ``(position, line)``."""
    numbered = _numbered(strip_numbering(lines))
    return numbered.select(
        "position",
        F.concat((F.col("position") + first).cast("string"), F.lit(". "), F.col("line")).alias("line"),
    )


def combine_questions(existing: DataFrame, generated: DataFrame, first: int = FIRST_NUMBER) -> DataFrame:
    """The existing list as it is, then the generated list renumbered.

    ``(source, position)`` is the order of the combined list.
    """
    kept = _numbered(clean_lines(existing)).select(F.lit(0).alias("source"), "position", "line")
    added = renumber(generated, first).select(F.lit(1).alias("source"), "position", "line")
    return kept.unionByName(added)
