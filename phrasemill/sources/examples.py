"""Example files: JSON Lines, JSON arrays, bare concatenated objects, parquet, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from phrasemill.functions.jsontext import is_strict_json
from phrasemill.functions.text import emit
from phrasemill.operators.audit import quality_report
from phrasemill.operators.numbering import number_by_file, with_split
from phrasemill.schemas import EXAMPLE

_RECORD = "input string, output string, _corrupt_record string"


def _checked(rows: DataFrame) -> DataFrame:
    """The columns of an example with the reason why it is none, if so."""
    problem = (
        F.when(F.col("_corrupt_record").isNotNull(), F.lit("not a JSON object"))
        .when(F.col("input").isNull(), F.lit("no input"))
        .when(F.col("output").isNull(), F.lit("no output"))
    )
    return rows.select(
        "example_id", "input", F.col("output").alias("output_json"), problem.alias("problem"),
        F.col("_corrupt_record").alias("record"),
    )


def _placed(
    scan: DataFrame, dense: bool, probe: str | None = None, keep: Column | None = None
) -> DataFrame:
    """Add ``example_id``: the exact position, or only a unique and increasing number.

    Rows that fail ``keep`` are no records; they may only stand at the end of a file.
    """
    rows = with_split(scan)
    rows = rows if keep is None else rows.filter(keep)
    if dense:
        return number_by_file(rows, "example_id", probe)
    return rows.drop("_pm_path", "_pm_block").withColumn("example_id", F.monotonically_increasing_id())


def _scan_records(spark: SparkSession, path: str, array: bool, dense: bool) -> DataFrame:
    scan = spark.read.json(path, schema=_RECORD, multiLine=array)
    return _checked(_placed(scan, dense, probe="input"))


def _scan_objects(spark: SparkSession, path: str, indent: int, dense: bool) -> DataFrame:
    """Indented objects, cut at the closing brace in column ``indent``.

    The brace line is the record separator, so one huge file is still read by many tasks. JSON
    strings hold no raw line breaks, so the separator cannot occur inside a value.
    """
    close = "\n" + " " * indent + "}"
    # What stands behind the last object: white space, commas or the end of an array.
    piece = ~F.col("value").rlike(r"\A[\s,\[\]]*\z")
    rows = _placed(spark.read.text(path, lineSep=close), dense, keep=piece)
    return parse_records(rows, F.concat(F.regexp_replace("value", r"\A[\s,\[]+", ""), F.lit("\n}")))


def parse_records(rows: DataFrame, text: Column) -> DataFrame:
    """``(example_id, input, output_json, problem, record)`` of rows whose ``text`` is one record."""
    record = F.from_json(text, _RECORD, {"columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = rows.select("example_id", record.alias("_pm_rec"))
    fields = [F.col(f"_pm_rec.{c}").alias(c) for c in ("input", "output", "_corrupt_record")]
    return _checked(emit(parsed, F.lit(True), F.col("example_id"), *fields))


def scan_examples(
    spark: SparkSession, path: str, layout: str = "lines", dense: bool = True
) -> DataFrame:
    """All records ``(example_id, input, output_json, problem, record)`` of example files.

    Layouts: ``lines`` (JSON Lines), ``pretty_array`` (one array per file with two-space
    indentation), ``objects`` (indented objects without an array around them), ``array`` (any
    JSON array; such a file cannot be cut, so one task reads each). Positions count records in
    file order, and the output keeps its JSON text. Exact positions need a counting pass over
    the files first; with ``dense=False`` ids are unique and increasing but leave gaps, in one
    pass.
    """
    if layout in ("lines", "array"):
        return _scan_records(spark, path, layout == "array", dense)
    return _scan_objects(spark, path, {"pretty_array": 2, "objects": 0}[layout], dense)


def read_examples(
    spark: SparkSession, path: str, layout: str = "lines", dense: bool = True
) -> DataFrame:
    """The well-formed examples; see :func:`rejected_examples` for the others."""
    good = scan_examples(spark, path, layout, dense).filter("problem IS NULL")
    return good.select("example_id", "input", "output_json")


def rejected_examples(
    spark: SparkSession, path: str, layout: str = "lines", dense: bool = True
) -> DataFrame:
    """Quarantine: records that are not JSON or lack a part, with the reason."""
    bad = scan_examples(spark, path, layout, dense).filter("problem IS NOT NULL")
    return bad.select("example_id", "problem", "record")


def repair_concat_json(spark: SparkSession, path: str, pretty: bool = True) -> DataFrame:
    """Records of a file of bare consecutive objects, indented or one per line."""
    return scan_examples(spark, path, "objects" if pretty else "lines")


def record_text(input: Column, output_json: Column) -> Column:
    """One example as one line of JSON with its output embedded as it is.

    A raw line break in valid JSON is white space, so it becomes a blank.
    """
    output_json = F.regexp_replace(output_json, r"[\r\n]", " ")
    return F.concat(
        F.lit('{"input":'), F.to_json(F.array(input)).substr(F.lit(2), F.length(F.to_json(F.array(input))) - 2),
        F.lit(',"output":'), output_json, F.lit("}"),
    )


def write_problem(input: Column, output_json: Column) -> Column:
    """Why an example cannot be a JSON record; NULL if it can."""
    return (
        F.when(input.isNull(), F.lit("no input")).when(output_json.isNull(), F.lit("no output"))
        .when(~is_strict_json(output_json), F.lit("output is not JSON"))
    )


def write_examples(df: DataFrame, path: str, format: str = "json", ordered: bool = False) -> None:
    """Write examples as JSON Lines or parquet, in one pass.

    ``ordered`` makes positions the file order, by range partitioning and not by one sorted task; that makes
    the rows twice, once for the ranges, but checks them once, so order a cheap input rather than the result. Examples
    that cannot be JSON records never become broken lines: they go with the reason to the folder
    ``_rejects`` inside ``path``, which readers of ``path`` skip; see :func:`unwritten_examples`.
    It is written only if there are any, and only then are they made a second time.
    """
    rows = df.select("example_id", "input", "output_json")
    if format != "json":
        (rows.orderBy("example_id") if ordered else rows).write.format(format).save(path)
        return
    problem = write_problem(F.col("input"), F.col("output_json")).alias("problem")
    seen = Observation()
    # ordered before they are checked: what finds the ranges makes the rows, but parses none of them
    checked = (rows.orderBy("example_id") if ordered else rows).select("*", problem)
    good = checked.observe(seen, F.count("problem").alias("rejects")).filter("problem IS NULL")
    good.select(record_text(F.col("input"), F.col("output_json"))).write.text(path)
    if seen.get["rejects"]:
        rows.select("*", problem).filter("problem IS NOT NULL").write.parquet(f"{path.rstrip('/')}/_rejects")


def unwritten_examples(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_examples` put aside in ``path``: ``(example_id, input, output_json, problem)``."""
    try:
        return spark.read.parquet(f"{path.rstrip('/')}/_rejects")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{EXAMPLE}, problem string")


def write_report(df: DataFrame, path: str) -> None:
    """Write the quality report of a dataset as one JSON record."""
    quality_report(df).write.json(path)
