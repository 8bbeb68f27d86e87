"""The end-to-end jobs: convert, audit, merge question lists, annotate."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.functions.lexicon import DEFAULT, Lexicon
from phrasemill.operators import annotate
from phrasemill.operators.convert import convert_examples
from phrasemill.operators.questions import combine_questions
from phrasemill.schemas import EXAMPLE, RESPONSE
from phrasemill.sources import examples as files
from phrasemill.sources import text


def convert_dataset(
    spark: SparkSession, source: str, target: str, layout: str = "lines", ordered: bool = True,
    lexicon: Lexicon = DEFAULT,
) -> None:
    """Read examples, convert them, write them.

    Rows are ordered before they are converted: range partitioning reads its input twice, and
    reading is cheaper than converting. Without ``ordered`` there is no shuffle at all.
    """
    examples = files.read_examples(spark, source, layout, dense=ordered)
    if ordered:
        examples = examples.orderBy("example_id")
    files.write_examples(convert_examples(examples, lexicon), target, ordered=False)


def audit_dataset(spark: SparkSession, source: str, report: str, layout: str = "lines") -> None:
    """Read examples and write their quality report. Positions are not needed for it."""
    files.write_report(files.read_examples(spark, source, layout, dense=False), report)


def merge_question_files(spark: SparkSession, existing: str, generated: str, target: str) -> None:
    """Merge two question lists into one numbered list."""
    combined = combine_questions(text.scan_lines(spark, existing), text.scan_lines(spark, generated))
    text.write_lines(combined, target)


def annotate_dataset(
    spark: SparkSession, source: str, template: str, context: str, model: annotate.ModelCall,
    store: str, target: str, start: int = 0, end: int | None = None, batch_size: int = 10,
    layout: str = "lines", parallelism: int | None = None, commit_every: int = 100_000,
) -> DataFrame:
    """Send the slice ``[start, end)`` of a dataset through a model and write the result.

    The work goes by the steps of :func:`prepare_steps` and can be stopped and started again with the
    same ``store`` at any time. Returns the summary of the stored result.
    """
    prepare_steps(spark, source, store, start, end, layout, commit_every)
    template_text = text.load_template(spark, template).first()["template"]
    context_text = text.load_context(spark, context).first()["context"]
    annotate_steps(spark, store, model, template_text, context_text, batch_size, parallelism)
    annotated(spark, store).write.parquet(target)
    return annotate.annotation_summary(spark.read.parquet(target))


_MANIFEST = "source string, start bigint, end bigint, commit_every bigint"


def prepare_steps(
    spark: SparkSession, source: str, store: str, start: int = 0, end: int | None = None, layout: str = "lines",
    commit_every: int = 100_000,
) -> None:
    """Number the examples of a slice and write them into ``store``, in steps of ``commit_every`` positions.

    This is the only time that the source is read. A store that is complete stays as it is, one that was
    left half written is written anew; a store of another source, slice or step size is refused.
    """
    wanted = (source, start, end, commit_every)
    known = _stored(spark, f"{store}/manifest", _MANIFEST)
    known = None if known is None else known.first()
    if known is not None:
        if tuple(known) != wanted:
            raise ValueError(f"{store} was made for {tuple(known)}, not for {wanted}")
        return
    examples = annotate.slice_range(files.read_examples(spark, source, layout), start, end)
    step = F.floor(F.col("example_id") / commit_every).cast("bigint")
    examples.withColumn("step", step).write.mode("overwrite").partitionBy("step").parquet(f"{store}/examples")
    # written last, so that its presence tells that the examples are complete
    spark.createDataFrame([wanted], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest")


def open_steps(spark: SparkSession, store: str) -> list[int]:
    """The steps that hold an example without a final outcome, from one scan of ids and answers."""
    examples = spark.read.schema(f"{EXAMPLE}, step bigint").parquet(f"{store}/examples").select("step", "example_id")
    known = answers(spark, store)
    if known is not None:
        examples = annotate.unanswered(examples, known)
    return sorted(r.step for r in examples.select("step").distinct().collect())


def annotate_steps(
    spark: SparkSession, store: str, model: annotate.ModelCall, template: str, context: str | None = None,
    batch_size: int = 10, parallelism: int | None = None, max_steps: int | None = None,
) -> int:
    """Ask the model for what is open in a prepared store, step by step; returns the steps left over.

    A step reads its own examples and its own answers only, and its answers are committed before the next
    step begins, so a failure costs the calls of one step at most and attempts of an example come from one
    run. ``parallelism`` tasks call the model (by default as many as the session has cores);
    ``max_steps`` ends the run earlier.
    """
    left = open_steps(spark, store)
    for step in left[:max_steps]:
        todo = spark.read.schema(EXAMPLE).parquet(f"{store}/examples/step={step}")
        known = _stored(spark, f"{store}/answers/step={step}", RESPONSE)
        if known is not None:
            todo = annotate.unanswered(todo, known)
        made = annotate.annotate_batches(
            todo, model, batch_size, parallelism=parallelism or spark.sparkContext.defaultParallelism,
            template=template, context=context,
        )
        made.write.mode("append").parquet(f"{store}/answers/step={step}")
    return 0 if max_steps is None else max(len(left) - max_steps, 0)


def annotated(spark: SparkSession, store: str) -> DataFrame:
    """Every example of a store with its new output and where that came from."""
    examples = spark.read.schema(EXAMPLE).parquet(f"{store}/examples")
    known = answers(spark, store)
    if known is None:
        known = spark.createDataFrame([], RESPONSE)
    return annotate.annotated_dataset(examples, known)


def answers(spark: SparkSession, store: str) -> DataFrame | None:
    """All answers of a store so far, or None before the first step is committed."""
    return _stored(spark, f"{store}/answers", RESPONSE)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
