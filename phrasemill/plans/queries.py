"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill import fixtures as fx
from phrasemill.functions.lexicon import DEFAULT, backfill_context, rewrite_terms
from phrasemill.operators import annotate, audit, convert, flatten, questions, rules
from phrasemill.plans.jobs import annotate_steps, annotated, convert_dataset, prepare_steps
from phrasemill.session import scratch_dir
from phrasemill.sources import examples as example_files
from phrasemill.sources import text as text_files
from phrasemill.streaming.incremental import (
    converted_lines, example_stream, incremental_convert, incremental_convert_lines, line_stream, rejected_lines,
)

Query = Callable[[SparkSession, str], DataFrame]

TEMPLATE = "Question: {{ context.current_question }}\nModel: {{ context.model_files }}\nAnswer in JSON."
CONTEXT = '[events.json]\n{"columns": ["event_id", "event_type", "user_id"]}'
STAMP = "2024-01-01T00:00:00"


def on_examples(fn: Callable[[DataFrame], DataFrame]) -> Query:
    """A query that applies an operator to the derived examples."""
    return lambda spark, sf_dir: fn(fx.examples(spark, sf_dir))


def on_all_spellings(fn: Callable[[DataFrame], DataFrame]) -> Query:
    """A query over the examples and those with outputs of other writers."""
    return lambda spark, sf_dir: fn(fx.odd_examples(spark, sf_dir))


def on_responses(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(fx.responses(spark, sf_dir))


def on_both(fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(fx.examples(spark, sf_dir), fx.responses(spark, sf_dir))


def on_documents(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(fx.documents(spark, sf_dir))


# ---------------------------------------------------------------- sources and sinks


def read_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "examples")
    example_files.write_examples(fx.examples(spark, sf_dir), path, ordered=True)
    return example_files.read_examples(spark, path)


def write_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "converted")
    example_files.write_examples(fx.examples(spark, sf_dir), f"{base}/in", ordered=True)
    convert_dataset(spark, f"{base}/in", f"{base}/out")
    return example_files.read_examples(spark, f"{base}/out")


def write_examples_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indented array in, lines out, and back."""
    base = scratch_dir(spark, "array")
    ordered = fx.examples(spark, sf_dir).orderBy("example_id")
    indented = F.concat(
        F.lit('  {\n    "input": '), F.to_json(F.array("input")).substr(F.lit(2), F.length(F.to_json(F.array("input"))) - 2),
        F.lit(',\n    "output":\n      '), F.regexp_replace("output_json", ',"', ',\n      "'), F.lit("\n  }"),
    )
    ordered.select(indented).write.option("lineSep", ",\n").text(f"{base}/in")
    example_files.write_examples(example_files.read_examples(spark, f"{base}/in", "pretty_array"), f"{base}/out", ordered=True)
    back = example_files.read_examples(spark, f"{base}/out")
    return back.select("example_id", "input", F.regexp_replace("output_json", ', +"', ',"').alias("output_json"))


def write_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers written as outputs: what is no JSON is put aside with its reason, nothing is lost."""
    path = scratch_dir(spark, "answers")
    answers = fx.responses(spark, sf_dir).select(
        (F.col("example_id") * 3 + F.col("attempt")).alias("example_id"),
        F.concat(F.lit("answer "), "example_id").alias("input"), F.col("content").alias("output_json"))
    example_files.write_examples(answers, path)
    good = example_files.read_examples(spark, path).select("input", "output_json", F.lit(None).cast("string").alias("problem"))
    return good.union(example_files.unwritten_examples(spark, path).select("input", "output_json", "problem"))


def write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "report")
    report = audit.quality_report(fx.examples(spark, sf_dir))
    report.write.json(path)
    return audit.flat_report(spark.read.schema(report.schema).json(path))


def _stored_lines(spark: SparkSession, lines: DataFrame, label: str) -> str:
    path = scratch_dir(spark, label)
    lines.orderBy("line_no").select("line").write.text(path)
    return path


def _scan(spark: SparkSession, lines: DataFrame, label: str) -> DataFrame:
    return text_files.scan_lines(spark, _stored_lines(spark, lines, label))


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files.read_lines(spark, _stored_lines(spark, fx.generated_lines(spark, sf_dir), "lines"))


def write_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "questions")
    combined = questions.combine_questions(
        fx.existing_lines(spark, sf_dir), fx.generated_lines(spark, sf_dir)
    )
    text_files.write_lines(combined, path)
    return text_files.read_raw_lines(spark, path)


def load_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of all examples from a template read from a file."""
    path = scratch_dir(spark, "template")
    spark.createDataFrame([(TEMPLATE,)], "value string").coalesce(1).write.option("lineSep", " ").text(path)
    loaded = text_files.load_template(spark, path)
    prompts = annotate.render_prompt(fx.examples(spark, sf_dir), loaded)
    return prompts.select(
        "example_id", "prompt", loaded.select("template_chars").scalar().alias("template_chars")
    )


def load_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of all examples with a context read from files; run ids in file names are cut."""
    path = scratch_dir(spark, "context")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    nations.coalesce(1).sortWithinPartitions("n_nationkey").write.json(path)
    context = text_files.load_context(spark, path).select(
        F.regexp_replace("context", r"\[part-(\d+)-[^\]]*\.json\]", r"[part-$1.json]").alias("context")
    )
    prompts = annotate.render_prompt(fx.examples(spark, sf_dir), TEMPLATE, context)
    return prompts.select(
        "example_id", F.md5("prompt").alias("prompt_md5"),
        F.length("prompt").cast("bigint").alias("prompt_chars"),
    )


def repair_concat_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "objects")
    ordered = fx.examples(spark, sf_dir).orderBy("example_id")
    pretty = F.concat(
        F.lit('{\n  "input": '), F.to_json(F.array("input")).substr(F.lit(2), F.length(F.to_json(F.array("input"))) - 2),
        F.lit(',\n  "output": '), F.col("output_json"), F.lit("\n}"),
    )
    ordered.select(pretty).write.text(path)
    repaired = example_files.repair_concat_json(spark, path)
    return repaired.filter("problem IS NULL").select("example_id", "input", "output_json")


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "stream")
    fx.examples(spark, sf_dir).write.parquet(f"{base}/in")
    query = incremental_convert(
        example_stream(spark, f"{base}/in", files_per_batch=4), f"{base}/out", f"{base}/checkpoint"
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def incremental_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record lines, some of them broken, that arrive in two parts with a restart in between."""
    base = scratch_dir(spark, "lines")
    lines = fx.record_lines(spark, sf_dir)
    for part in (0, 1):
        lines.where(F.col("example_id") % 2 == part).select("line").write.mode("append").text(f"{base}/in")
        stream = line_stream(spark, f"{base}/in", files_per_batch=4)
        incremental_convert_lines(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    none = F.lit(None).cast("string")
    good = converted_lines(spark, f"{base}/out").select("input", "output_json", none.alias("problem"), none.alias("record"))
    return good.union(rejected_lines(spark, f"{base}/out").select(none, none, "problem", "record"))


def _planted(examples: DataFrame) -> DataFrame:
    """Examples in which some lists hold an element that is no object."""
    out = F.replace(F.col("output_json"), F.lit('"dimensions":[{'), F.lit('"dimensions":["Country",{'))
    out = F.when(F.col("example_id") % 10 == 4, out).otherwise(F.col("output_json"))
    return examples.withColumn("output_json", F.when(F.col("example_id") % 10 == 5, F.replace(
        out, F.lit('"discovery_results":['), F.lit('"discovery_results":[7,'))).otherwise(out))


def _slice(examples: DataFrame, name: str, start: int, end: int | None) -> DataFrame:
    return annotate.slice_range(examples, start, end).select(F.lit(name).alias("slice"), "example_id", "input")


# ---------------------------------------------------------------- conversion


def lexicon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon with the number of questions each of its terms takes part in."""
    hits = audit.term_counts(fx.examples(spark, sf_dir), tuple(DEFAULT.terms))
    return DEFAULT.frame(spark).join(hits.drop("term"), "ord").select(
        F.col("ord").cast("bigint").alias("ord"), "key", "repl",
        F.array_join("alternates", ",").alias("alternates"), "questions",
    )


def vocabulary_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions per word of the flat target vocabulary."""
    counted = audit.term_counts(fx.examples(spark, sf_dir), tuple(DEFAULT.vocabulary))
    return counted.select(F.col("term").alias("word"), "questions")


def recoded(fn: Callable[[DataFrame], DataFrame], flat: Callable[[DataFrame], DataFrame]) -> Query:
    """Recode outputs, then show the list that was recoded."""
    return on_examples(lambda ex: flat(fn(ex)))


def typed_output(ex: DataFrame, responses: DataFrame) -> DataFrame:
    typed = flatten.with_typed_output(annotate.annotated_dataset(ex, responses))
    return typed.select(
        "example_id", F.col("output.intent").alias("intent"),
        F.array_size("output.discovery_results").cast("bigint").alias("results"),
        F.array_join("extra_keys", ",").alias("extra_keys"),
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples with some planted elements as a parquet copy with parsed outputs."""
    path = scratch_dir(spark, "stored")
    flatten.stored_results(_planted(fx.examples(spark, sf_dir))).write.parquet(path)
    return spark.read.parquet(path)


def rewritten_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.convert_question(fx.conversations(spark, sf_dir))


# ---------------------------------------------------------------- question lists


def strip_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.strip_numbering(fx.generated_lines(spark, sf_dir))


def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.renumber(_scan(spark, fx.generated_lines(spark, sf_dir), "generated"))


def combine_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = questions.combine_questions(
        _scan(spark, fx.existing_lines(spark, sf_dir), "existing"), _scan(spark, fx.generated_lines(spark, sf_dir), "generated")
    )
    return out.withColumn("source", F.col("source").cast("bigint"))


# ---------------------------------------------------------------- annotation


def echo_model() -> annotate.ModelCall:
    """A deterministic stand-in for a user's model: its outcome depends on the prompt length."""

    def answer(prompts: Sequence[str], attempt: int) -> list[str | Exception]:
        out: list[str | Exception] = []
        for prompt in prompts:
            kind = len(prompt) % 4
            if kind == 0 and attempt == 0:
                out.append(RuntimeError("rate_limit"))
            elif kind == 1 and attempt < 2:
                out.append("{")
            elif kind == 2:
                out.append("no json")
            else:
                out.append(json.dumps({"chars": len(prompt), "attempt": attempt}))
        return out

    return answer


def annotate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = annotate.render_prompt(fx.examples(spark, sf_dir), TEMPLATE, CONTEXT)
    made = annotate.annotate_batches(prompts, echo_model())
    return made.withColumn("attempt", F.col("attempt").cast("bigint"))


def incremental_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation in four steps, stopped after two of them and taken up again."""
    base = scratch_dir(spark, "annotate")
    examples = fx.examples(spark, sf_dir)
    example_files.write_examples(examples, f"{base}/in", ordered=True)
    prepare_steps(spark, f"{base}/in", f"{base}/store", commit_every=-(-examples.count() // 4) or 1)
    while annotate_steps(spark, f"{base}/store", echo_model(), TEMPLATE, CONTEXT, max_steps=2):
        pass
    return annotated(spark, f"{base}/store")


def request_rows(settings: annotate.RequestSettings) -> Query:
    return on_examples(lambda ex: annotate.request_rows(ex, TEMPLATE, CONTEXT, settings))


def annotation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = annotate.drop_failures(fx.examples(spark, sf_dir), fx.responses(spark, sf_dir))
    return annotate.annotation_summary(results)


def annotation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = fx.examples(spark, sf_dir)
    return annotate.annotation_totals(ex, annotate.drop_failures(ex, fx.responses(spark, sf_dir)))


def stamp_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = annotate.drop_failures(fx.examples(spark, sf_dir), fx.responses(spark, sf_dir))
    return annotate.stamp_results(results, annotate.LOCAL.model, STAMP)


# ---------------------------------------------------------------- rules


def union_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples and the question list as a second dataset."""
    lines = questions.strip_numbering(fx.generated_lines(spark, sf_dir))
    more = lines.select(
        F.col("line_no").alias("example_id"), F.col("line").alias("input"),
        annotate.skeleton_column(F.col("line")).alias("output_json"),
    )
    return rules.union_datasets(events=fx.examples(spark, sf_dir), questions=more)


def _phrases(ex: DataFrame) -> DataFrame:
    """The original phrases of all measures and dimensions, from one reading of each example."""
    def tagged(field: str, kind: str) -> Column:
        listed = F.transform(field, lambda item, i: F.when(item.isNotNull(), F.struct(
            i.cast("bigint").alias("item_no"), item["original_phrase"].alias("original_phrase"), F.lit(kind).alias("kind"))))
        return F.coalesce(listed, F.array().cast("array<struct<item_no:bigint,original_phrase:string,kind:string>>"))

    both = F.concat(tagged("measures", "measure"), tagged("dimensions", "dimension"))
    return flatten.steps(ex, "measures", "dimensions").select("example_id", "step_no", F.inline(both)).filter("kind IS NOT NULL")


def entity_drift_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.learn_drift(convert.convert_question(fx.examples(spark, sf_dir)))


def entity_drift_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = convert.convert_question(fx.examples(spark, sf_dir))
    return flatten.flatten_steps(rules.fix_drift(ex, rules.learn_drift(ex))).select("example_id", "step_no", "sub_question")


def before_after_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.before_after(fx.examples(spark, sf_dir), rules.repair)


def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.before_after(fx.examples(spark, sf_dir), rules.fix_examples)



QUERIES: dict[str, Query] = {
    # sources and sinks
    "read_examples": read_examples,
    "write_examples_array": write_examples_array,
    "write_rejects": write_rejects,
    "write_examples": write_examples,
    "write_report": write_report,
    "read_lines": read_lines,
    "write_lines": write_lines,
    "load_context": load_context,
    "load_template": load_template,
    "repair_concat_json": repair_concat_json,
    # conversion
    "lexicon_table": lexicon_table,
    "lexicon_vocabulary": vocabulary_use,
    "lexicon_rewrite": on_examples(lambda ex: rewrite_terms(ex).select("example_id", "input")),
    "lexicon_rewrite_documents": on_documents(rewrite_terms),
    "context_backfill": on_examples(lambda ex: backfill_context(ex).select("example_id", "input")),
    "convert_question": on_examples(lambda ex: convert.convert_question(ex).select("example_id", "input")),
    "convert_question_documents": on_documents(convert.convert_question),
    "convert_question_conversations": rewritten_conversations,
    "recode_measures": recoded(convert.recode_measures, flatten.flatten_measures),
    "recode_dimensions": recoded(convert.recode_dimensions, flatten.flatten_dimensions),
    "recode_unmatched": recoded(convert.recode_unmatched, flatten.flatten_unmatched),
    "convert_output": on_all_spellings(lambda ex: convert.convert_output(ex).select("example_id", "output_json")),
    "convert_examples": on_all_spellings(convert.convert_examples),
    "unreadable_outputs": on_responses(
        lambda r: convert.unreadable_outputs(
            r.filter("content IS NOT NULL").select("example_id", F.col("content").alias("output_json"))
        )
    ),
    "conversion_preview": on_examples(convert.conversion_preview),
    "conversion_progress": on_examples(convert.conversion_progress),
    "typed_output": on_both(typed_output),
    "flatten_steps": on_examples(flatten.flatten_steps),
    "flatten_measures": on_examples(flatten.flatten_measures),
    "flatten_dimensions": on_examples(flatten.flatten_dimensions),
    "flatten_unmatched": on_examples(flatten.flatten_unmatched),
    "skipped_elements": on_examples(lambda ex: flatten.skipped_elements(_planted(ex))),
    "stored_steps": lambda spark, sf_dir: flatten.flatten_steps(stored(spark, sf_dir)),
    "stored_skipped": lambda spark, sf_dir: flatten.skipped_elements(stored(spark, sf_dir)),
    # audit
    "step_distribution": on_examples(audit.step_distribution),
    "complexity_summary": on_examples(audit.complexity_summary),
    "term_counts": on_examples(lambda ex: audit.term_counts(ex).drop("ord")),
    "term_counts_documents": on_documents(lambda d: audit.term_counts(d).drop("ord")),
    "terms_used": on_examples(audit.terms_used),
    "top_terms": on_examples(audit.top_terms),
    "terms_unused": on_examples(lambda ex: audit.terms_unused(ex).select("term")),
    "question_patterns": on_examples(lambda ex: audit.question_patterns(ex).drop("ord")),
    "question_patterns_documents": on_documents(lambda d: audit.question_patterns(d).drop("ord")),
    "question_pattern_flags": on_examples(audit.question_pattern_flags),
    "pattern_ranking": on_examples(audit.pattern_ranking),
    "structure_issues_top": on_examples(audit.structure_issues_top),
    "structure_issues_fields": on_examples(audit.structure_issues_fields),
    "structure_issues": on_examples(lambda ex: audit.structure_issues(ex).select("example_id", "issue")),
    "validity_rate": on_examples(audit.validity_rate),
    "residual_terms": on_examples(audit.residual_terms),
    "residual_term_summary": on_examples(audit.residual_term_summary),
    "dataset_term_flag": on_examples(audit.dataset_term_flag),
    "issue_sample": on_examples(audit.issue_sample),
    "overall_statistics": on_examples(audit.overall_statistics),
    "quality_score": on_examples(audit.quality_score),
    "quality_verdict": on_examples(audit.quality_verdict),
    "quality_report": on_examples(lambda ex: audit.flat_report(audit.quality_report(ex))),
    "quality_report_converted": on_examples(
        lambda ex: audit.flat_report(audit.quality_report(convert.convert_examples(ex)))
    ),
    # question lists
    "strip_numbering": strip_numbering,
    "renumber": renumber,
    "combine_questions": combine_questions,
    # annotation
    "slice_range": on_examples(
        lambda ex: _slice(ex, "middle", 100, 700).union(_slice(ex, "end", -250, None))
    ),
    "assign_batches": on_examples(
        lambda ex: annotate.assign_batches(ex, 5).select("example_id", "batch_no")
    ),
    "render_prompt": on_examples(lambda ex: annotate.render_prompt(ex, TEMPLATE, CONTEXT)),
    "request_rows": request_rows(annotate.BATCH),
    "request_rows_interactive": request_rows(annotate.INTERACTIVE),
    "annotate_batches": annotate_batches,
    "incremental_annotate": incremental_annotate,
    "parse_response": on_responses(
        lambda r: annotate.parse_response(r).withColumn("attempt", F.col("attempt").cast("bigint"))
    ),
    "resolve_attempts": on_responses(annotate.resolve_attempts),
    "fallback_skeleton": on_both(annotate.fallback_skeleton),
    "fallback_original": on_both(annotate.fallback_original),
    "annotated_dataset": on_both(annotate.annotated_dataset),
    "drop_failures": on_both(annotate.drop_failures),
    "retry_schedule": on_responses(annotate.retry_schedule),
    "annotation_summary": annotation_summary,
    "annotation_totals": annotation_totals,
    "stamp_results": stamp_results,
    "prompt_sizes": on_examples(lambda ex: annotate.prompt_sizes(ex, TEMPLATE, CONTEXT)),
    "incremental_convert": incremental,
    "incremental_convert_lines": incremental_lines,
    # rules
    "union_datasets": union_datasets,
    "fix_types": recoded(rules.fix_types, flatten.flatten_unmatched),
    "fix_types_text": on_all_spellings(lambda ex: rules.fix_types(ex).select("example_id", "output_json")),
    "complete_fields": on_all_spellings(lambda ex: rules.complete_fields(ex).select("example_id", "output_json")),
    "invalid_types": on_examples(rules.invalid_types),
    "invalid_calculations": on_examples(rules.invalid_calculations),
    "complexity_mismatch": on_examples(rules.complexity_mismatch),
    "phrase_mismatch": on_examples(rules.phrase_mismatch),
    "sub_question_mismatch": on_examples(rules.sub_question_mismatch),
    "count_measure_name": on_examples(lambda ex: rules.count_measure_name(convert.recode_measures(ex))),
    "count_measure_name_fix": on_examples(
        lambda ex: flatten.flatten_measures(rules.fix_count_names(convert.recode_measures(ex)))
    ),
    "unknown_term_audit": on_examples(rules.unknown_term_audit),
    "unknown_term_reclass": recoded(
        lambda ex: rules.reclassify_unknown(ex), flatten.flatten_unmatched
    ),
    "split_phrases": on_examples(rules.split_phrases),
    "split_phrases_fix": recoded(rules.merge_split_phrases, flatten.flatten_unmatched),
    "original_phrase_fix": on_examples(lambda ex: _phrases(rules.fix_original_phrases(ex))),
    "complexity_fix": recoded(rules.merge_steps, flatten.flatten_steps),
    "entity_drift_learned": entity_drift_learned,
    "entity_drift_fix": entity_drift_fix,
    "before_after_repair": before_after_repair,
    "entity_drift": on_examples(lambda ex: rules.entity_drift(convert.convert_question(ex))),
    "calculation_mismatch": on_examples(rules.calculation_mismatch),
    "breakdown_confusion": on_examples(rules.breakdown_confusion),
    "redundant_dimensions": on_examples(rules.redundant_dimensions),
    "redundant_dimensions_fix": recoded(rules.drop_redundant_dimensions, flatten.flatten_dimensions),
    "missing_timeframe": on_examples(rules.missing_timeframe),
    "sub_question_fix": on_all_spellings(lambda ex: rules.fix_sub_questions(ex).select("example_id", "output_json")),
    "timeframe_fix": on_all_spellings(lambda ex: rules.fix_timeframes(ex).select("example_id", "output_json")),
    "premium_move": recoded(rules.add_business_phrases, flatten.flatten_dimensions),
    "premium_reclass": recoded(rules.add_business_phrases, flatten.flatten_unmatched),
    "exact_duplicates": on_examples(rules.exact_duplicates),
    "exact_duplicates_documents": on_documents(lambda d: rules.exact_duplicates(d, columns=("input",))),
    "drop_duplicates": on_examples(lambda ex: rules.drop_duplicates(ex).select("example_id", "input")),
    "conflicting_duplicates": on_examples(rules.conflicting_duplicates),
    "conflicting_templates": on_examples(rules.conflicting_templates),
    "intent_coverage": on_examples(rules.intent_coverage),
    "issue_priorities": on_examples(rules.issue_priorities),
    "data_quality_rate": on_examples(rules.data_quality_rate),
    "before_after": before_after,
    "readiness_gate": on_examples(rules.readiness_gate),
    "clean_subset": on_examples(rules.clean_subset),
}
