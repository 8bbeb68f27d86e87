"""Audit metrics, structure issues, residual terms and the quality score.

All dataset-level numbers come from one aggregate over one scan (:func:`audit_metrics`); the
per-metric operators select from it, so a caller that asks for the whole report still reads
the data once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.functions.jsontext import has_key, result_texts
from phrasemill.functions.text import contains_any, contains_sql, emit, first_contained, quoted
from phrasemill.schemas import REQUIRED_FIELDS

# Target terms whose use is counted, in reporting order.
BI_TERMS = (
    "publishers", "advertisers", "bidders", "campaigns", "users", "customers",
    "viewers", "clicks", "revenue", "spend", "cost", "budget", "websites",
    "apps", "channels", "sites", "visitors", "audience", "ads", "creatives",
    "placements", "impressions", "conversions", "requests", "bids", "locations",
    "regions", "markets", "territories", "videos", "content", "activities",
    "events", "managers", "leaders", "operators", "controllers",
)

# Source-domain terms that should be gone, in checking order.
NON_BI_TERMS = (
    "departments", "employees", "students", "schools", "companies",
    "customers", "films", "movies", "books", "sports", "games",
)

# Question patterns and the substrings that show them, in reporting order.
PATTERNS = {
    "how_many": ("how many",),
    "list": ("list",),
    "what_are": ("what are",),
    "compare": ("compare", "versus", "vs"),
    "top": ("top",),
    "bottom": ("bottom", "lowest"),
    "average": ("average",),
    "maximum": ("maximum", "highest"),
    "minimum": ("minimum", "lowest"),
    "trend": ("trend", "change"),
    "percentage": ("percentage", "%"),
    "which": ("which",),
    "show": ("show",),
    "find": ("find",),
    "return": ("return",),
}


STEP_IDS = ("step_1", "step_2", "step_3")

# Score steps as (lower bound, points), best first; below all of them the rest.
VOLUME_STEPS = ((7000, 20), (5000, 15), (3000, 10))
TERM_STEPS = ((20, 20), (15, 15), (10, 10))
VALIDITY_STEPS = ((0.95, 20), (0.90, 15), (0.80, 10))

FLAG_TERM = "departments"
FLAG_ISSUE = "Inconsistent terminology: 'departments' still present in outputs"


def _with_lower(df: DataFrame) -> DataFrame:
    return df.withColumn("_pm_lower", F.lower("input"))


def _share(part: str | Column, whole: str | Column) -> Column:
    """Ratio as double; NULL for an empty dataset."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _stack(row: DataFrame, names: dict[str, str], label: str, value: str) -> DataFrame:
    """A one-row frame to ``(ord, label, value)`` rows; ``names`` maps label to column."""
    cells = ", ".join(f"{i}, {quoted(n)}, {c}" for i, (n, c) in enumerate(names.items()))
    return row.selectExpr(f"stack({len(names)}, {cells}) AS (ord, {label}, {value})")


# ---------------------------------------------------------------- one-row metrics


def _step_count(ids: Column, step: str) -> Column:
    """Results of one example with this step id; 0 without results."""
    return F.coalesce(F.array_size(F.filter(ids, lambda s: s == step)), F.lit(0))


def _step_sum(per_row: Column, step: str) -> Column:
    return F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias(step)


def _with_step_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("_pm_ids", _step_ids(result_texts(F.col("output_json"))))


def _step_ids(results: Column) -> Column:
    return F.transform(results, lambda r: F.from_json(r, "struct<step_id:string>")["step_id"])


def _step_aggs() -> list[Column]:
    return [_step_sum(_step_count(F.col("_pm_ids"), s), s) for s in STEP_IDS]


def _term_aggs(terms: tuple[str, ...]) -> list[Column]:
    return [
        F.expr(f"count_if({contains_sql('_pm_lower', (t,))}) AS term_{i}") for i, t in enumerate(terms)
    ]


def _pattern_aggs() -> list[Column]:
    return [
        F.expr(f"count_if({contains_sql('_pm_lower', words)}) AS pattern_{name}")
        for name, words in PATTERNS.items()
    ]


def _total() -> Column:
    return F.count(F.lit(1)).alias("total_examples")


def _flag_condition(term: str) -> Column:
    """``term`` anywhere in question or output. JSON escapes are resolved only where there are any."""
    out = F.col("output_json")
    shown = F.when(out.contains("\\u"), F.coalesce(F.to_json(F.try_parse_json(out)), out)).otherwise(out)
    return F.coalesce(F.col("_pm_lower").contains(term), F.lit(False)) | F.coalesce(
        F.lower(shown).contains(term), F.lit(False)
    )


def _with_presence(df: DataFrame) -> DataFrame:
    return df.withColumn("_pm_results", result_texts(F.col("output_json")))


def _missing_fields() -> Column:
    """Per result the array of absent required fields, for examples passing the top check; none
    for a result that is no object. A key is present whatever its value and however often."""
    required = F.array(*map(F.lit, REQUIRED_FIELDS))
    return F.transform(
        F.col("_pm_results"),
        lambda r: F.coalesce(F.array_except(required, F.json_object_keys(r)), F.array().cast("array<string>")),
    )


def _has_key(name: str) -> Column:
    return has_key(F.col("output_json"), name)


def _has_intent() -> Column:
    return _has_key("intent")


def _has_results() -> Column:
    return _has_key("discovery_results")


def audit_metrics(df: DataFrame, terms: tuple[str, ...] = BI_TERMS) -> DataFrame:
    """Every dataset-level count in one row, from one scan with map-side partial sums."""
    ids = _step_ids(F.col("_pm_results"))
    missing = F.aggregate(_missing_fields(), F.lit(0), lambda n, m: n + F.size(m))
    rows = _with_presence(_with_lower(df)).select(
        "*",
        (_has_intent() & _has_results()).alias("_pm_valid"),
        F.coalesce(missing, F.lit(0)).alias("_pm_missing"),
        *[_step_count(ids, step).alias(f"_pm_{step}") for step in STEP_IDS],
    )
    return rows.agg(
        _total(),
        *[_step_sum(F.col(f"_pm_{s}"), s) for s in STEP_IDS],
        *_term_aggs(terms),
        *_pattern_aggs(),
        F.count_if("_pm_valid").alias("valid_outputs"),
        F.coalesce(
            F.sum(F.when(F.col("_pm_valid"), F.col("_pm_missing")).otherwise(F.lit(1))), F.lit(0)
        )
        .cast("bigint")
        .alias("output_issues"),
        F.count_if(contains_any(F.col("_pm_lower"), NON_BI_TERMS)).alias("residual_issues"),
        F.coalesce(F.bool_or(_flag_condition(FLAG_TERM)), F.lit(False)).alias("dataset_flag"),
    )


# ---------------------------------------------------------------- complexity


def step_distribution(df: DataFrame) -> DataFrame:
    """Number of results per known step id; other ids are ignored, zero counts are shown."""
    return _stack(_with_step_ids(df).agg(*_step_aggs()), {s: s for s in STEP_IDS}, "step_id", "results").drop("ord")


def _complexity() -> list[Column]:
    return [
        F.col("step_1").alias("simple_questions"),
        (F.col("step_2") + F.col("step_3")).alias("complex_questions"),
        F.col("step_2").alias("multi_step_questions"),
        F.col("step_3").alias("three_step_questions"),
        _share(F.col("step_2") + F.col("step_3"), "total_examples").alias("complexity_ratio"),
    ]


def complexity_summary(df: DataFrame) -> DataFrame:
    """Simple, complex, multi-step and three-step counts with the complexity ratio."""
    metrics = _with_step_ids(df).agg(_total(), *_step_aggs())
    return metrics.select(*_complexity())


# ---------------------------------------------------------------- terms


def term_counts(df: DataFrame, terms: tuple[str, ...] = BI_TERMS) -> DataFrame:
    """Questions that contain each term, ``(ord, term, questions)``, zero counts included: one
    conditional sum for each term in a single aggregate."""
    row = _with_lower(df).agg(*_term_aggs(terms))
    return _stack(row, {t: f"term_{i}" for i, t in enumerate(terms)}, "term", "questions")


def terms_used(df: DataFrame, terms: tuple[str, ...] = BI_TERMS) -> DataFrame:
    """Number of terms that occur at all."""
    return term_counts(df, terms).agg(F.count_if(F.col("questions") > 0).alias("terms_used"))


def top_terms(df: DataFrame, n: int = 10, terms: tuple[str, ...] = BI_TERMS) -> DataFrame:
    """The ``n`` most common terms that occur at all; ties in list order."""
    hits = term_counts(df, terms).filter("questions > 0")
    return hits.orderBy(F.desc("questions"), "ord").limit(n).select("term", "questions")


def terms_unused(df: DataFrame, terms: tuple[str, ...] = BI_TERMS) -> DataFrame:
    """Terms that never occur, with their place in the list."""
    return term_counts(df, terms).filter("questions = 0").select("ord", "term")


# ---------------------------------------------------------------- question patterns


def question_patterns(df: DataFrame) -> DataFrame:
    """Questions per pattern, ``(ord, pattern, questions)``; patterns overlap."""
    row = _with_lower(df).agg(*_pattern_aggs())
    return _stack(row, {p: f"pattern_{p}" for p in PATTERNS}, "pattern", "questions")


def question_pattern_flags(df: DataFrame) -> DataFrame:
    """The pattern tests per question, one boolean column each."""
    return _with_lower(df).selectExpr(
        "example_id", *[f"{contains_sql('_pm_lower', words)} AS is_{p}" for p, words in PATTERNS.items()]
    )


def pattern_ranking(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most common patterns with their share of all questions; ties in list order."""
    row = _with_lower(df).agg(_total(), *_pattern_aggs())
    ranked = _stack(
        row, {p: f"named_struct('n', pattern_{p}, 'total', total_examples)" for p in PATTERNS}, "pattern", "hit"
    ).select(
        "ord", "pattern", F.col("hit.n").alias("questions"), _share("hit.n", "hit.total").alias("share")
    ).filter("questions > 0")
    return ranked.orderBy(F.desc("questions"), "ord").limit(n).drop("ord")


# ---------------------------------------------------------------- structure


def _top_problem() -> Column:
    return F.when(~_has_intent(), F.lit("Missing intent field")).when(
        ~_has_results(), F.lit("Missing discovery_results")
    )


def structure_issues_top(df: DataFrame) -> DataFrame:
    """Examples without ``intent``, else without ``discovery_results``."""
    found = _with_presence(df).select("example_id", _top_problem().alias("problem"))
    issue = F.concat(F.lit("Example "), F.col("example_id"), F.lit(": "), F.col("problem"))
    return emit(found, F.col("problem").isNotNull(), F.col("example_id"), issue.alias("issue"))


def structure_issues_fields(df: DataFrame) -> DataFrame:
    """One row per absent required field of each result of examples passing the top check."""
    missing = _with_presence(df).select(
        "example_id",
        F.posexplode_outer(F.when(_has_intent() & _has_results(), _missing_fields())).alias("pos", "fields"),
    )
    return missing.select(
        "example_id", F.col("pos").cast("bigint").alias("step_no"), F.explode("fields").alias("field")
    ).select(
        "example_id", "step_no", "field",
        F.concat(
            F.lit("Example "), F.col("example_id"), F.lit(", Result "), F.col("step_no"),
            F.lit(": Missing "), F.col("field"),
        ).alias("issue"),
    )


def structure_issues(df: DataFrame) -> DataFrame:
    """All structure issues as ``(example_id, step_no, field_no, issue)`` from one parse.

    ``step_no`` and ``field_no`` give the report order and are -1 for top-level issues.
    """
    top = _top_problem()
    found = _with_presence(df).select(
        "example_id",
        F.when(
            top.isNotNull(),
            F.array(
                F.struct(
                    F.lit(-1).alias("step_no"), F.lit(-1).alias("field_no"),
                    F.concat(F.lit(": "), top).alias("problem"),
                )
            ),
        )
        .otherwise(
            F.flatten(
                F.transform(
                    _missing_fields(),
                    lambda fields, j: F.transform(
                        fields,
                        lambda f: F.struct(
                            j.alias("step_no"),
                            (F.array_position(F.array(*map(F.lit, REQUIRED_FIELDS)), f) - 1)
                            .cast("int").alias("field_no"),
                            F.concat(F.lit(", Result "), j, F.lit(": Missing "), f).alias("problem"),
                        ),
                    ),
                )
            )
        )
        .alias("found"),
    )
    rows = found.select("example_id", F.inline_outer("found")).filter("problem IS NOT NULL")
    return rows.select(
        "example_id", F.col("step_no").cast("bigint"), F.col("field_no").cast("bigint"),
        F.concat(F.lit("Example "), F.col("example_id"), F.col("problem")).alias("issue"),
    )


def validity_rate(df: DataFrame) -> DataFrame:
    """Examples with both top-level keys; absent result fields do not reduce the rate."""
    row = _with_presence(df).agg(
        _total(), F.count_if(_has_intent() & _has_results()).alias("valid_outputs")
    )
    return row.select("valid_outputs", _share("valid_outputs", "total_examples").alias("validity_rate"))


def issue_sample(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` structure issues in report order, and how many more there are."""
    issues = structure_issues(df)
    first = issues.orderBy("example_id", "step_no", "field_no").limit(n)
    rest = issues.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).cast("bigint"))
    return first.select("example_id", "issue", rest.scalar().alias("remaining"))


# ---------------------------------------------------------------- residual terms


def residual_terms(df: DataFrame, terms: tuple[str, ...] = NON_BI_TERMS) -> DataFrame:
    """The first source-domain term left in each question, at most one per example."""
    found = _with_lower(df).select(
        "example_id", first_contained(F.col("_pm_lower"), terms).alias("term")
    )
    issue = F.concat(F.lit("Non-BI term found: '"), F.col("term"), F.lit("' in question"))
    return emit(
        found, F.col("term").isNotNull(), F.col("example_id"), F.col("term"), issue.alias("issue")
    )


def dataset_term_flag(df: DataFrame, term: str = FLAG_TERM) -> DataFrame:
    """Whether ``term`` is left anywhere in questions or outputs, keys included."""
    return _with_lower(df).agg(
        F.coalesce(F.bool_or(_flag_condition(term)), F.lit(False)).alias("term_present")
    )


def residual_term_summary(df: DataFrame) -> DataFrame:
    """Distinct issue texts with their counts, the dataset-level issue included once.

    Both are counted in one pass: an example brings up to two texts, which are summed where they are read.
    """
    term = first_contained(F.col("_pm_lower"), NON_BI_TERMS)
    own = F.concat(F.lit("Non-BI term found: '"), term, F.lit("' in question"))
    flag = F.when(_flag_condition(FLAG_TERM), F.lit(FLAG_ISSUE))
    said = _with_lower(df).select(F.explode(F.array_compact(F.array(own, flag))).alias("issue"))
    counted = said.groupBy("issue").agg(F.count(F.lit(1)).alias("issues"))
    once = F.when(F.col("issue") == FLAG_ISSUE, F.lit(1).cast("bigint")).otherwise(F.col("issues"))
    return counted.withColumn("issues", once)


# ---------------------------------------------------------------- report and score


def overall_statistics(df: DataFrame) -> DataFrame:
    """Totals and shares of simple, complex and valid examples."""
    row = _with_step_ids(_with_presence(df)).agg(
        _total(), *_step_aggs(), F.count_if(_has_intent() & _has_results()).alias("valid_outputs")
    )
    both = F.col("step_2") + F.col("step_3")
    return row.select(
        "total_examples", "valid_outputs",
        _share("valid_outputs", "total_examples").alias("validity_rate"),
        F.col("step_1").alias("simple_questions"),
        _share("step_1", "total_examples").alias("simple_share"),
        both.alias("complex_questions"),
        _share(both, "total_examples").alias("complex_share"),
    )


def _points(value: Column, bounds: tuple[tuple[float, int], ...], rest: int) -> Column:
    out = None
    for bound, points in bounds:
        out = F.when(value >= bound, points) if out is None else out.when(value >= bound, points)
    return out.otherwise(rest)


def _score_columns(terms: tuple[str, ...]) -> list[Column]:
    ratio = _share(F.col("step_2") + F.col("step_3"), "total_examples")
    used = F.expr(" + ".join(f"int(term_{i} > 0)" for i in range(len(terms))))
    issues = F.col("residual_issues") + F.when(F.col("dataset_flag"), 1).otherwise(0)
    return [
        _points(F.col("total_examples"), VOLUME_STEPS, 0).alias("volume_points"),
        F.when(ratio.between(0.3, 0.7), 20).when(ratio.between(0.2, 0.8), 15).otherwise(10)
        .alias("complexity_points"),
        _points(used, TERM_STEPS, 0).alias("term_points"),
        _points(_share("valid_outputs", "total_examples"), VALIDITY_STEPS, 0).alias("validity_points"),
        F.when(issues == 0, 20).when(issues <= 10, 15).when(issues <= 50, 10).otherwise(5)
        .alias("issue_points"),
    ]


_PARTS = ("volume_points", "complexity_points", "term_points", "validity_points", "issue_points")


def _verdict(score: Column) -> Column:
    return (
        F.when(score >= 80, "excellent").when(score >= 60, "good").otherwise("needs work")
    )


def quality_score(df: DataFrame, terms: tuple[str, ...] = BI_TERMS) -> DataFrame:
    """Five parts of at most 20 points and their sum."""
    parts = audit_metrics(df, terms).select(*_score_columns(terms))
    total = sum((F.col(p) for p in _PARTS[1:]), F.col(_PARTS[0]))
    return parts.select(
        *[F.col(p).cast("bigint").alias(p) for p in _PARTS], total.cast("bigint").alias("score")
    )


def quality_verdict(df: DataFrame, terms: tuple[str, ...] = BI_TERMS) -> DataFrame:
    """The score in words."""
    return quality_score(df, terms).select("score", _verdict(F.col("score")).alias("verdict"))


def quality_report(df: DataFrame, terms: tuple[str, ...] = BI_TERMS) -> DataFrame:
    """The whole audit as one nested row."""
    metrics = audit_metrics(df, terms)
    cells = ", ".join(
        f"named_struct('questions', term_{i}, 'rank', {-i}, 'term', {quoted(t)})"
        for i, t in enumerate(terms)
    )
    counts = F.expr(f"array({cells})")
    used = F.filter(counts, lambda c: c["questions"] > 0)
    top = F.slice(F.sort_array(used, asc=False), 1, 10)
    unused = F.filter(counts, lambda c: c["questions"] == 0)
    scored = metrics.select("*", *_score_columns(terms))
    score = sum((F.col(p) for p in _PARTS[1:]), F.col(_PARTS[0])).cast("bigint")
    return scored.select(
        "total_examples",
        F.struct(*_complexity()).alias("complexity_distribution"),
        F.struct(
            F.size(used).cast("bigint").alias("total_terms_used"),
            F.transform(top, lambda c: F.struct(c["term"].alias("term"), c["questions"].alias("questions")))
            .alias("most_common_terms"),
            F.transform(unused, lambda c: c["term"]).alias("terms_with_zero_usage"),
        ).alias("terms_coverage"),
        F.struct(*[F.col(f"pattern_{p}").alias(p) for p in PATTERNS]).alias("question_patterns"),
        F.struct(
            "valid_outputs", "output_issues",
            _share("valid_outputs", "total_examples").alias("validity_rate"),
        ).alias("output_quality"),
        F.struct("residual_issues", "dataset_flag").alias("issues"),
        F.struct(
            *[F.col(p).cast("bigint").alias(p) for p in _PARTS],
            score.alias("score"), _verdict(score).alias("verdict"),
        ).alias("quality"),
    )


def flat_report(report: DataFrame) -> DataFrame:
    """A nested report as plain columns; lists are joined with commas."""
    return report.select(
        "total_examples", "complexity_distribution.*",
        "terms_coverage.total_terms_used",
        F.array_join(
            F.transform(
                "terms_coverage.most_common_terms",
                lambda c: F.concat(c["term"], F.lit("="), c["questions"]),
            ),
            ",",
        ).alias("most_common_terms"),
        F.array_join("terms_coverage.terms_with_zero_usage", ",").alias("terms_with_zero_usage"),
        *[F.col(f"question_patterns.{p}").alias(f"pattern_{p}") for p in PATTERNS],
        "output_quality.*", "issues.*", "quality.*",
    )
