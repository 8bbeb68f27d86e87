"""One row per result, measure, dimension or unmatched intent. Narrow only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.functions.jsontext import is_object, result_texts, typed_items
from phrasemill.functions.splice import let
from phrasemill.schemas import ITEM_TYPES, REQUIRED_FIELDS, output_type, result_type


def with_typed_output(df: DataFrame) -> DataFrame:
    """Add ``output`` as a typed struct, and ``extra_keys``: keys the type has no place for.

    Stored as parquet, the struct lets later scans read only the nested fields they use.
    ``output_json`` stays, so nothing is lost.
    """
    results = F.from_json("output_json", "struct<discovery_results:array<map<string,string>>>")
    known = F.array(*map(F.lit, REQUIRED_FIELDS))
    inner = F.flatten(
        F.transform(results["discovery_results"], lambda r: F.array_except(F.map_keys(r), known))
    )
    top = F.array_except(
        F.json_object_keys("output_json"), F.array(F.lit("intent"), F.lit("discovery_results"))
    )
    none = F.array().cast("array<string>")
    return df.withColumn("output", F.from_json("output_json", output_type())).withColumn(
        "extra_keys", F.array_distinct(F.concat(F.coalesce(top, none), F.coalesce(inner, none)))
    )


def stored_results(df: DataFrame) -> DataFrame:
    """Add ``results`` and ``skipped``: every output parsed once, for a parquet copy that is read many times.

    ``results`` holds what :func:`steps` gives for each discovery result, ``skipped`` what
    :func:`skipped_elements` lists. The functions of this module take a frame with these columns instead of
    ``output_json``, with equal rows, and the scan then reads only the nested fields that they use.
    """
    def result(text: Column, i: Column) -> Column:
        def fields(step: Column) -> Column:
            read = [
                (typed_items(step[f], ITEM_TYPES[f]) if f in ITEM_TYPES else step[f]).alias(f) for f in REQUIRED_FIELDS
            ]
            return F.struct(i.cast("bigint").alias("step_no"), *read)

        return F.when(is_object(text), let(F.from_json(text, result_type(*REQUIRED_FIELDS)), fields))

    def skipped(text: Column, i: Column) -> Column:
        def entry(field: str, item: Column, element: Column) -> Column:
            return F.struct(i.cast("bigint").alias("step_no"), F.lit(field).alias("field"), item.cast("bigint").alias("item_no"), element.alias("element"))

        def listed(step: Column, field: str) -> Column:
            elements = F.coalesce(step[field], F.array().cast("array<string>"))
            return F.filter(F.transform(elements, lambda t, k: entry(field, k, t)), lambda e: ~is_object(e["element"]))

        def of(step: Column) -> Column:
            return F.concat(*[listed(step, f) for f in ITEM_TYPES])

        whole = F.array(entry("discovery_results", F.lit(-1), text))
        return F.when(is_object(text), let(F.from_json(text, result_type(*ITEM_TYPES)), of)).otherwise(whole)

    texts = result_texts(F.col("output_json"))
    return df.withColumns({
        "results": F.filter(F.transform(texts, result), lambda r: r.isNotNull()), "skipped": F.flatten(F.transform(texts, skipped)),
    })


def steps(df: DataFrame, *fields: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(example_id, *keep, step_no, *fields)`` per discovery result, parsing only ``fields``.

    Results that are no objects have no row and such elements of a list are NULL, at their
    places; :func:`skipped_elements` lists both.
    """
    names = fields or REQUIRED_FIELDS
    if "results" in df.columns:
        # one array a field: only those are read, while exploding the results would read every field
        chosen = F.arrays_zip(*[F.col("results")[f] for f in ("step_no", *names)])
        stored = df.select("example_id", *keep, F.inline(chosen))
        return stored.toDF("example_id", *keep, "step_no", *names)
    raw = df.select(
        "example_id", *keep, F.posexplode(result_texts(F.col("output_json"))).alias("_pm_no", "_pm_text")
    )
    parsed = raw.filter(is_object(F.col("_pm_text"))).withColumn(
        "_pm_step", F.from_json("_pm_text", result_type(*names))
    )
    return parsed.select(
        "example_id", *keep, F.col("_pm_no").cast("bigint").alias("step_no"),
        *[
            (typed_items(F.col("_pm_step")[f], ITEM_TYPES[f]) if f in ITEM_TYPES else F.col("_pm_step")[f]).alias(f)
            for f in names
        ],
    )


def items(df: DataFrame, field: str, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(example_id, *keep, step_no, item_no, *columns)`` per element of an array field."""
    exploded = steps(df, field, keep=keep).select(
        "example_id", *keep, "step_no", F.posexplode(field)
    ).filter("col IS NOT NULL")
    return exploded.select(
        "example_id", *keep, "step_no", F.col("pos").cast("bigint").alias("item_no"),
        *[F.col("col")[c].alias(c) for c in columns],
    )


def flatten_steps(df: DataFrame) -> DataFrame:
    """One row per discovery result with its scalars and the size of each list."""
    flat = steps(df)
    return flat.select(
        "example_id", "step_no", "step_id", "sub_question",
        F.col("timegrain.phrase").alias("timegrain"),
        F.col("timeframe.phrase").alias("timeframe"),
        *[
            F.coalesce(F.array_size(c), F.lit(0)).cast("bigint").alias(f"n_{c}")
            for c in ("measures", "dimensions", "pattern", "segments", "breakdowns", "unmatched_intents")
        ],
    )


def flatten_measures(df: DataFrame) -> DataFrame:
    return items(df, "measures", "name", "calculation", "original_phrase")


def flatten_dimensions(df: DataFrame) -> DataFrame:
    return items(df, "dimensions", "name", "filter_value", "original_phrase")


def flatten_unmatched(df: DataFrame) -> DataFrame:
    return items(df, "unmatched_intents", "phrase", "type", "reason")


def skipped_elements(df: DataFrame) -> DataFrame:
    """Quarantine ``(example_id, step_no, field, item_no, element)``: what is no object where one
    belongs. ``field`` is ``discovery_results`` and ``item_no`` -1 for a whole result."""
    if "skipped" in df.columns:
        return df.select("example_id", F.inline("skipped"))
    raw = df.select("example_id", F.posexplode(result_texts(F.col("output_json"))).alias("_pm_no", "_pm_text"))
    at = F.col("_pm_no").cast("bigint").alias("step_no")
    whole = raw.filter(~is_object(F.col("_pm_text"))).select(
        "example_id", at, F.lit("discovery_results").alias("field"), F.lit(-1).cast("bigint").alias("item_no"),
        F.col("_pm_text").alias("element"),
    )
    lists = raw.filter(is_object(F.col("_pm_text"))).withColumn(
        "_pm_step", F.from_json("_pm_text", result_type(*ITEM_TYPES))
    )

    def elements(field: str) -> Column:
        return F.transform(
            F.coalesce(F.col("_pm_step")[field], F.array().cast("array<string>")),
            lambda t, i: F.struct(
                F.lit(field).alias("field"), i.cast("bigint").alias("item_no"), t.alias("element")
            ),
        )

    inner = lists.select("example_id", at, F.inline(F.concat(*map(elements, ITEM_TYPES)))).filter(~is_object(F.col("element")))
    return whole.union(inner)
