"""Conversion of examples: question rewriting and order-keeping recoding of outputs. Narrow only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.functions.lexicon import DEFAULT, Lexicon, backfill_context, rewrite_terms
from phrasemill.functions.splice import Edit, edit_elements, edit_members, edit_results, is_editable, mentions, text_of
from phrasemill.functions.text import emit

# Recoded names. Names that are not listed stay as they are.
MEASURE_NAMES = {"Count": "Total", "Max": "Maximum", "Min": "Minimum", "Sum": "Total"}
DIMENSION_NAMES = {"Geographic": "Region", "Temporal": "Time", "Categorical": "Category"}
UNMATCHED_PHRASES = {
    "departments": "users", "employees": "users", "customers": "users", "students": "users",
    "budget": "revenue", "sales": "revenue",
    "companies": "publishers", "schools": "publishers", "organizations": "publishers",
}


def recoder(mapping: dict[str, str]) -> Edit:
    """An edit that maps a JSON string through ``mapping``, leaving other values alone."""
    pairs = [(F.lit(old), F.lit(json.dumps(new, ensure_ascii=False))) for old, new in mapping.items()]
    table = F.create_map(*[x for pair in pairs for x in pair])
    return lambda raw: F.coalesce(F.try_element_at(table, text_of(raw)), raw)


def field_edit(field: str, mapping: dict[str, str]) -> Edit:
    """Edit of an array field: recode ``field`` of each of its objects."""
    recode = recoder(mapping)

    def edit(raw):
        edited = edit_elements(raw, lambda item: edit_members(item, {field: recode}))
        return F.when(mentions(raw, mapping), edited).otherwise(raw)

    return edit


def _recode(df: DataFrame, *fields: tuple[str, str, dict[str, str]]) -> DataFrame:
    """Recode ``(list field, key, names)``; outputs that mention no listed name are not cut."""
    edits = {field: field_edit(key, names) for field, key, names in fields if names}
    if not edits:
        return df
    some = mentions(F.col("output_json"), dict.fromkeys(n for *_, names in fields for n in names))
    return df.withColumn("output_json", edit_results(F.col("output_json"), lambda r: edit_members(r, edits), some))


def recode_measures(df: DataFrame, names: dict[str, str] = MEASURE_NAMES) -> DataFrame:
    """Recode measure names; calculations and phrases are untouched."""
    return _recode(df, ("measures", "name", names))


def recode_dimensions(df: DataFrame, names: dict[str, str] = DIMENSION_NAMES) -> DataFrame:
    """Recode dimension names."""
    return _recode(df, ("dimensions", "name", names))


def recode_unmatched(df: DataFrame, phrases: dict[str, str] = UNMATCHED_PHRASES) -> DataFrame:
    """Recode unmatched phrases by exact, case-sensitive match."""
    return _recode(df, ("unmatched_intents", "phrase", phrases))


def convert_output(
    df: DataFrame,
    measures: dict[str, str] = MEASURE_NAMES,
    dimensions: dict[str, str] = DIMENSION_NAMES,
    unmatched: dict[str, str] = UNMATCHED_PHRASES,
) -> DataFrame:
    """All three recodes in one pass over the JSON; the sub question stays as it was."""
    return _recode(
        df, ("measures", "name", measures), ("dimensions", "name", dimensions), ("unmatched_intents", "phrase", unmatched)
    )


def unreadable_outputs(df: DataFrame) -> DataFrame:
    """Quarantine: examples whose output is left unconverted because it is no JSON object, or nests
    deeper than edits reach."""
    return emit(df, ~is_editable(F.col("output_json")), F.col("example_id"), F.col("output_json"))


def convert_question(df: DataFrame, text: str = "input", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Rewrite terms, then backfill a subject where no target word is present."""
    return backfill_context(rewrite_terms(df, text, lexicon), text, lexicon)


def convert_examples(df: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The converted ``(example_id, input, output_json)`` of every example."""
    return convert_output(convert_question(df, "input", lexicon)).select(
        "example_id", "input", "output_json"
    )


def conversion_preview(df: DataFrame, n: int = 5, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The first ``n`` questions beside their conversions.

    The rows are picked before they are converted, so only ``n`` of them are.
    """
    first = df.select("example_id", F.col("input").alias("original")).orderBy("example_id").limit(n)
    return convert_question(first.withColumn("converted", F.col("original")), "converted", lexicon)


def conversion_progress(df: DataFrame, every: int = 1000) -> DataFrame:
    """Examples per block of ``every`` positions, with the position each block starts at."""
    block = (F.floor(F.col("example_id") / F.lit(every)) * every).cast("bigint")
    return df.groupBy(block.alias("processed")).agg(F.count(F.lit(1)).alias("examples"))
