"""Prompt rendering, batch annotation by a user's model, and resolution of its responses."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.functions.jsontext import is_strict_json
from phrasemill.schemas import RESPONSE

# Placeholders of a prompt template and the request settings of each preset.
QUESTION_MARK = "{{ context.current_question }}"
CONTEXT_MARK = "{{ context.model_files }}"
SYSTEM = "You are a helpful assistant for BI intent discovery."
SYSTEM_JSON = SYSTEM + " Always respond with valid JSON."
MAX_ATTEMPTS = 3


@dataclass(frozen=True)
class RequestSettings:
    model: str
    system: str
    temperature: float
    max_tokens: int
    json_object: bool


BATCH = RequestSettings("gpt-4.1-nano", SYSTEM_JSON, 0.1, 2048, True)
INTERACTIVE = RequestSettings("gpt-4.1-mini", SYSTEM, 0.2, 1024, False)
LOCAL = RequestSettings("Qwen2.5-7B-Instruct", SYSTEM, 0.2, 1024, False)


# ---------------------------------------------------------------- slices and batches


def slice_range(df: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Examples at positions ``[start, end)``; bounds clamp, negative ones count from the end."""
    if start >= 0 and (end is None or end >= 0):
        out = df.filter(F.col("example_id") >= start)
        return out if end is None else out.filter(F.col("example_id") < end)
    size = df.agg(F.count(F.lit(1)))

    def bound(value: int) -> Column:
        return F.lit(value) if value >= 0 else F.greatest(size.scalar() + value, F.lit(0))

    keep = F.col("example_id") >= bound(start)
    return df.filter(keep if end is None else keep & (F.col("example_id") < bound(end)))


def assign_batches(df: DataFrame, batch_size: int = 10, start: int = 0) -> DataFrame:
    """Add the batch number of each example of a slice that begins at ``start``."""
    return df.withColumn(
        "batch_no", F.floor((F.col("example_id") - start) / batch_size).cast("bigint")
    )


# ---------------------------------------------------------------- prompts and requests


def prompt_column(
    question: Column, template: str | Column, context: str | Column | None = None
) -> Column:
    """Fill the question, then the context, so a context mark inside a question is filled too.

    Without a context only the question is filled.
    """
    if isinstance(template, str):
        if not template:
            raise ValueError("the prompt template is empty")
        template = F.lit(template)
    prompt = F.replace(template, F.lit(QUESTION_MARK), question)
    if context is None:
        return prompt
    context = F.lit(context) if isinstance(context, str) else context
    return F.replace(prompt, F.lit(CONTEXT_MARK), context)


def render_prompt(
    df: DataFrame, template: str | DataFrame, context: str | DataFrame | None = None
) -> DataFrame:
    """``(example_id, input, prompt)`` for every example.

    Template and context may be the one-row frames of ``sources.text``; they are read once and
    enter the plan as values.
    """
    if isinstance(template, DataFrame):
        template = template.select("template").scalar()
    if isinstance(context, DataFrame):
        context = context.select("context").scalar()
    return df.select(
        "example_id", "input", prompt_column(F.col("input"), template, context).alias("prompt")
    )


def request_rows(
    df: DataFrame, template: str, context: str | None = None, settings: RequestSettings = BATCH
) -> DataFrame:
    """One chat request per question: messages and parameters as columns and as JSON."""
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(settings.system).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
    )
    fields = [
        F.lit(settings.model).alias("model"),
        messages.alias("messages"),
        F.lit(settings.temperature).alias("temperature"),
        F.lit(settings.max_tokens).alias("max_tokens"),
    ]
    if settings.json_object:
        fields.append(F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    return render_prompt(df, template, context).select(
        "example_id",
        F.lit(settings.model).alias("model"),
        F.lit(settings.system).alias("system_message"),
        F.col("prompt").alias("user_message"),
        F.lit(settings.temperature).alias("temperature"),
        F.lit(settings.max_tokens).cast("bigint").alias("max_tokens"),
        F.to_json(F.struct(*fields)).alias("request_json"),
    )


def prompt_sizes(df: DataFrame, template: str, context: str = "") -> DataFrame:
    """Length of template and context, and the spread of the rendered prompt lengths."""
    size = F.length("prompt").cast("bigint")
    return render_prompt(df, template, context).agg(
        F.lit(len(template)).cast("bigint").alias("template_chars"),
        F.lit(len(context)).cast("bigint").alias("context_chars"),
        F.min(size).alias("min_prompt_chars"),
        F.avg(size).alias("avg_prompt_chars"),
        F.max(size).alias("max_prompt_chars"),
    )


# ---------------------------------------------------------------- running a model

ModelCall = Callable[[Sequence[str], int], Sequence["str | None | Exception"]]


def annotate_batches(
    prompts: DataFrame, model: ModelCall, batch_size: int = 10, max_attempts: int = MAX_ATTEMPTS,
    parallelism: int | None = None, template: str | None = None, context: str | None = None,
) -> DataFrame:
    """Run ``model(prompts, attempt)`` over ``(example_id, prompt)``; one row per attempt made.

    With a ``template`` the frame holds ``(example_id, input)`` instead and each task fills in the
    prompts itself, so template and context travel once a task and not once a row. ``parallelism``
    is the number of tasks that call the model at a time; without it the partitions of the frame
    decide, and a file in one split is one task.

    The model answers a batch with one text per prompt, or an exception in place of a text; a
    call that raises fails the whole batch. Prompts whose answer is not valid JSON are tried
    again. An empty answer counts as an exception. A task holds one Arrow batch of prompts and
    hands answers on as it goes. The helpers are nested so that they travel with the task and workers need no copy of this package.
    """

    def is_json(text: str) -> bool:
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    def answers(batch: list[str], attempt: int) -> Sequence[str | None | Exception]:
        try:
            out = list(model(batch, attempt))
        except Exception as error:  # the model is foreign code: any failure is an outcome
            return [error] * len(batch)
        if len(out) != len(batch):
            return [ValueError("wrong number of answers")] * len(batch)
        return out

    question_mark, context_mark = QUESTION_MARK, CONTEXT_MARK

    def filled(value: str) -> str:
        if template is None:
            return value
        prompt = template.replace(question_mark, value)
        return prompt if context is None else prompt.replace(context_mark, context)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["example_id", "attempt", "content", "error"]
        for frame in frames:
            todo = list(zip(frame["example_id"].tolist(), map(filled, frame.iloc[:, 1].tolist())))
            rows = []
            for at in range(0, len(todo), batch_size):
                open_rows = todo[at : at + batch_size]
                for attempt in range(max_attempts):
                    if not open_rows:
                        break
                    replies = answers([prompt for _, prompt in open_rows], attempt)
                    failed = []
                    for (example_id, prompt), reply in zip(open_rows, replies):
                        if reply is None:
                            reply = TypeError("empty answer")
                        raised = isinstance(reply, Exception)
                        rows.append(
                            (example_id, attempt, None if raised else reply, str(reply) if raised else None)
                        )
                        if raised or not is_json(reply):
                            failed.append((example_id, prompt))
                    open_rows = failed
                if len(rows) >= 1000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    rows = prompts.select("example_id", "prompt" if template is None else "input")
    if parallelism:
        rows = rows.repartition(parallelism, "example_id")
    return rows.mapInPandas(run, RESPONSE)


def unanswered(examples: DataFrame, responses: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Examples without a final outcome in ``responses``: no valid JSON and attempts left over."""
    done = responses.groupBy("example_id").agg(
        F.max(F.when(F.col("error").isNull(), is_strict_json(F.col("content"))).otherwise(F.lit(False))).alias("ok"),
        F.max("attempt").alias("last"),
    ).filter(F.col("ok") | (F.col("last") >= max_attempts - 1))
    return examples.join(done.select("example_id"), "example_id", "left_anti")


# ---------------------------------------------------------------- resolving responses


def parse_response(responses: DataFrame) -> DataFrame:
    """Add ``kind``: ``ok``, ``invalid`` (text that is not JSON) or ``error`` (raised or empty)."""
    failed = F.col("error").isNotNull() | F.col("content").isNull()
    kind = (
        F.when(failed, F.lit("error"))
        .when(is_strict_json(F.col("content")), F.lit("ok"))
        .otherwise(F.lit("invalid"))
    )
    return responses.withColumn("kind", kind)


def outcomes(responses: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Per example the first valid answer, and how the last attempt ended.

    One shuffle on ``example_id``; a group holds at most ``max_attempts`` short-lived rows, and
    rows past the first success do not matter because the smallest valid attempt wins.
    """
    parsed = parse_response(responses).filter(F.col("attempt") < max_attempts)
    valid = F.col("kind") == "ok"
    return parsed.groupBy("example_id").agg(
        F.min(F.when(valid, F.col("attempt"))).cast("bigint").alias("attempt"),
        F.min_by(F.col("content"), F.when(valid, F.col("attempt"))).alias("content"),
        F.max_by(F.col("kind"), F.col("attempt")).alias("last_kind"),
    )


def resolve_attempts(responses: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The winning answer of each example that has one."""
    done = outcomes(responses, max_attempts)
    return done.filter("attempt IS NOT NULL").select("example_id", "attempt", "content")


def skeleton_column(question: Column) -> Column:
    """The empty one-step output as JSON text."""
    nothing = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    result = F.struct(
        F.lit("step_1").alias("step_id"), question.alias("sub_question"),
        empty.alias("measures"), empty.alias("dimensions"),
        nothing.alias("timegrain"), nothing.alias("timeframe"), nothing.alias("pattern"),
        empty.alias("segments"), empty.alias("breakdowns"), empty.alias("unmatched_intents"),
    )
    output = F.struct(
        F.lit("intents_discovery").alias("intent"), F.array(result).alias("discovery_results")
    )
    return F.to_json(output, {"ignoreNullFields": "false"})


def annotated_dataset(
    examples: DataFrame, responses: DataFrame, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Every example once with its new output and where it came from.

    ``model`` for a valid answer, ``skeleton`` when the last attempt was not JSON, ``original``
    when the last attempt raised or there was none.
    """
    done = outcomes(responses, max_attempts).withColumnRenamed("attempt", "won")
    joined = examples.select("example_id", "input", "output_json").join(done, "example_id", "left")
    source = (
        F.when(F.col("won").isNotNull(), F.lit("model"))
        .when(F.col("last_kind") == "invalid", F.lit("skeleton"))
        .otherwise(F.lit("original"))
    )
    return joined.withColumn("provenance", source).select(
        "example_id", "input",
        F.when(F.col("provenance") == "model", F.col("content"))
        .when(F.col("provenance") == "skeleton", skeleton_column(F.col("input")))
        .otherwise(F.col("output_json"))
        .alias("output_json"),
        "provenance",
    )


def fallback_skeleton(
    examples: DataFrame, responses: DataFrame, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """The examples that end with the empty structure."""
    return (
        annotated_dataset(examples, responses, max_attempts)
        .filter("provenance = 'skeleton'").drop("provenance")
    )


def fallback_original(
    examples: DataFrame, responses: DataFrame, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """The examples that keep their original output."""
    return (
        annotated_dataset(examples, responses, max_attempts)
        .filter("provenance = 'original'").drop("provenance")
    )


def drop_failures(examples: DataFrame, responses: DataFrame) -> DataFrame:
    """One attempt only; examples whose attempt failed are left out."""
    first = parse_response(responses.filter("attempt = 0")).filter("kind = 'ok'")
    return examples.select("example_id", "input").join(
        first.select("example_id", F.col("content").alias("output_json")), "example_id"
    )


def retry_schedule(responses: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Back-off after each attempt that was needed: ``2 ** attempt`` seconds after an exception
    that is not the last one, else none. Nothing sleeps."""
    parsed = parse_response(responses).filter(F.col("attempt") < max_attempts)
    won = F.min(F.when(F.col("kind") == "ok", F.col("attempt"))).over(Window.partitionBy("example_id"))
    made = parsed.withColumn("won", won).filter("won IS NULL OR attempt <= won")
    waits = (F.col("kind") == "error") & (F.col("attempt") < max_attempts - 1)
    return made.select(
        "example_id", F.col("attempt").cast("bigint"), "kind",
        F.when(waits, F.pow(F.lit(2.0), F.col("attempt"))).otherwise(F.lit(0.0)).alias("delay_seconds"),
    )


def annotation_summary(results: DataFrame) -> DataFrame:
    """Intent (``N/A`` when absent) and number of steps (NULL when absent) of each result."""
    out = F.from_json("output_json", "struct<intent:variant,discovery_results:array<variant>>")
    return results.withColumn("_pm_out", out).select(
        "example_id",
        F.when(F.col("_pm_out.intent").isNull(), F.lit("N/A"))
        .otherwise(F.try_variant_get("_pm_out.intent", "$", "string"))
        .alias("intent"),
        F.array_size("_pm_out.discovery_results").cast("bigint").alias("steps"),
    )


def annotation_totals(examples: DataFrame, results: DataFrame) -> DataFrame:
    """Results obtained out of examples given."""
    given = examples.agg(F.count(F.lit(1)))
    return results.agg(F.count(F.lit(1)).alias("processed")).select(
        "processed", given.scalar().alias("examples")
    )


def stamp_results(results: DataFrame, model: str, at: str | None = None) -> DataFrame:
    """``(example_id, question, response, model, timestamp)`` with an ISO time stamp."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    moment = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return results.select(
        "example_id", F.col("input").alias("question"), F.col("output_json").alias("response"),
        F.lit(model).alias("model"), F.date_format(moment, iso).alias("timestamp"),
    )
