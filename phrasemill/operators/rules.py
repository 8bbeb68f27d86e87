"""Data-quality rules: fixes, per-example checks and the issue accounting built on them.

Vocabularies are parameters. Defaults marked "ours" are not given by any published rule and
only make the rule usable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.functions.jsontext import canonical, has_key, is_object, result_texts, typed_items
from phrasemill.functions.splice import (
    adopt_members, edit_elements, edit_members, edit_results, let, mentions, quote, raw_elements, raw_members, raw_value,
    spelled_members,
)
from phrasemill.functions.text import contains_any, digest, emit
from phrasemill.operators.audit import BI_TERMS, NON_BI_TERMS
from phrasemill.operators.convert import field_edit
from phrasemill.operators.flatten import items, steps
from phrasemill.schemas import ITEM_TYPES, LIST_FIELDS, REQUIRED_FIELDS, result_type

# Named by the rules.
TYPE_FIXES = {"action": "business_action"}
INTENTS = ("intents_discovery", "request_human_input")
DRIFT_PAIRS = (("publishers", "departments"), ("revenue", "budget"))
READY_RATE = 0.95
SUBSET_SIZE = 1000

# Ours: starting vocabularies.
ALLOWED_TYPES = ("business_entity", "business_action", "unknown_term")
ALLOWED_CALCULATIONS = (
    "Count", "Sum", "Total", "Average", "Max", "Min", "Maximum", "Minimum", "Percentage Contribution",
)
COMPLEXITY_INDICATORS = ("ordered by", "compare")
CALCULATION_WORDS = {
    "average": ("Average",),
    "how many": ("Count",),
    "maximum": ("Max", "Maximum"),
    "minimum": ("Min", "Minimum"),
}
# Ours: least likeness (hundredths) of a phrase and the words that replace it; least results and
# thousandths of a learned pair.
LEAST_LIKENESS = 50
# Words of a phrase up to which rounded scores tell stretches apart: (3 n)^2 < 2,000,000.
MOST_TIGHT = 400
DRIFT_SUPPORT, DRIFT_CONFIDENCE = 5, 100
BUSINESS_PHRASES = tuple(dict.fromkeys(BI_TERMS + NON_BI_TERMS))
PREMIUM_PHRASES = ("premium customers",)
TIME_PHRASE = r"(?i)\b(Q[1-4] \d{4}|last (?:one )?\w+)"
PRIORITIES = {
    "structure": "high", "invalid_type": "high", "complexity": "high",
    "original_phrase": "medium", "calculation": "low",
}

_LOWER = "_pm_lower"


def _with_lower(df: DataFrame) -> DataFrame:
    return df.withColumn(_LOWER, F.lower("input"))


def _absent(value: Column, allowed: tuple[str, ...]) -> Column:
    """True when ``value`` is not one of ``allowed``; NULL is not."""
    return ~F.coalesce(value.isin(*allowed), F.lit(False))


# ---------------------------------------------------------------- combining datasets


def union_datasets(**datasets: DataFrame) -> DataFrame:
    """All examples under new positions, with their source and old position.

    Positions of a dataset start behind the largest position of the one before.
    """
    out, offset = None, F.lit(0).cast("bigint")
    for name, df in datasets.items():
        placed = df.select(
            F.lit(name).alias("source"), F.col("example_id").alias("source_id"),
            (F.col("example_id") + offset).alias("example_id"), "input", "output_json",
        )
        out = placed if out is None else out.unionByName(placed)
        offset = offset + df.agg(F.coalesce(F.max("example_id"), F.lit(-1)) + 1).scalar()
    return out


# ---------------------------------------------------------------- fixes


def _edited(df: DataFrame, per_result, when: Column | None = None, **other) -> DataFrame:
    return df.withColumn("output_json", edit_results(F.col("output_json"), per_result, when, **other))


def _maybe(fields: str, test: Callable[[Column], Column]) -> Column:
    """False only where all results can be read and ``test`` is false for every one: then an edit that needs it
    would change nothing, and the text is not cut. Whatever cannot be read or is NULL counts as yes."""
    read = F.from_json("output_json", f"struct<discovery_results:array<struct<{fields}>>>")["discovery_results"]
    return F.coalesce(F.exists(read, test), F.lit(True))


def fix_types(df: DataFrame, fixes: dict[str, str] = TYPE_FIXES) -> DataFrame:
    """Recode invalid types of unmatched intents."""
    edit = {"unmatched_intents": field_edit("type", fixes)}
    return _edited(df, lambda r: edit_members(r, edit), mentions(F.col("output_json"), fixes))


_EMPTY_FIELDS = {f: "[]" if f in LIST_FIELDS else "null" for f in REQUIRED_FIELDS}
_EMPTY_TOP = {"intent": "null", "discovery_results": "[]"}


def _incomplete() -> Column:
    """Whether a required key may be absent; see :func:`_maybe`."""
    has_all = lambda text, keys: F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(text))) == 0
    whole = F.forall(result_texts(F.col("output_json")), lambda r: has_all(r, _EMPTY_FIELDS))
    return ~F.coalesce(has_all(F.col("output_json"), _EMPTY_TOP) & whole, F.lit(False))


def complete_fields(df: DataFrame) -> DataFrame:
    """Append absent required keys with their empty value: ``[]`` for lists, else null."""
    return _edited(df, lambda r: edit_members(r, {}, _EMPTY_FIELDS), _incomplete(), absent=_EMPTY_TOP)


def fix_examples(df: DataFrame) -> DataFrame:
    """The two published fixes, types and absent fields, in one pass."""
    edit = {"unmatched_intents": field_edit("type", TYPE_FIXES)}
    some = mentions(F.col("output_json"), TYPE_FIXES) | _incomplete()
    return _edited(df, lambda r: edit_members(r, edit, _EMPTY_FIELDS), some, absent=_EMPTY_TOP)


def _list_edit(field: str, per_item, words: tuple[str, ...]) -> dict:
    """Edit of the objects of a list that mentions one of ``words``."""

    def edit(raw: Column) -> Column:
        return F.when(mentions(raw, words), edit_elements(raw, per_item)).otherwise(raw)

    return {field: edit}


def fix_count_names(df: DataFrame) -> DataFrame:
    """Name every ``Count`` measure ``Count``."""

    def renamed(measure: Column) -> Column:
        is_count = F.from_json(measure, "struct<calculation:string>")["calculation"] == "Count"
        return F.when(is_count, edit_members(measure, {"name": lambda _: F.lit('"Count"')})).otherwise(measure)

    edit = _list_edit("measures", renamed, ("Count",))
    return _edited(df, lambda r: edit_members(r, edit), mentions(F.col("output_json"), ("Count",)))


def reclassify_unknown(df: DataFrame, phrases: tuple[str, ...] = BUSINESS_PHRASES) -> DataFrame:
    """Turn ``unknown_term`` into ``business_entity`` for listed phrases (case-insensitive)."""

    def retyped(intent: Column) -> Column:
        read = F.from_json(intent, "struct<phrase:string,type:string>")
        hit = (read["type"] == "unknown_term") & F.lower(read["phrase"]).isin(*phrases)
        return F.when(hit, edit_members(intent, {"type": lambda _: F.lit('"business_entity"')})).otherwise(intent)

    edit = _list_edit("unmatched_intents", retyped, ("unknown_term",))
    return _edited(df, lambda r: edit_members(r, edit), mentions(F.col("output_json"), ("unknown_term",)))


def _name(item: Column) -> Column:
    """The name of an object of a list; NULL for any other element."""
    return F.when(item.startswith("{"), F.from_json(item, "struct<name:string>")["name"])


def drop_redundant_dimensions(df: DataFrame) -> DataFrame:
    """Remove dimensions whose name is also among the breakdowns of the same result."""

    def pruned(result: Column) -> Column:
        listed = F.from_json(result, "struct<breakdowns:array<string>>")["breakdowns"]
        names = F.array_compact(F.transform(listed, _name))

        def left(raw: Column) -> Column:
            return edit_elements(raw, keep=lambda d: ~F.coalesce(F.array_contains(names, _name(d)), F.lit(False)))

        return F.when(F.size(names) > 0, edit_members(result, {"dimensions": left})).otherwise(result)

    return _edited(df, pruned, _maybe("breakdowns:array<string>", lambda r: F.array_size(r["breakdowns"]) > 0))


def _put(result: Column, key: str, raw: Column) -> Column:
    """A result with one key set, whether it had it or not."""
    return edit_members(result, {key: lambda _: raw}, {key: raw})


def fix_sub_questions(df: DataFrame) -> DataFrame:
    """Set the sub question of one-step examples to the question; see :func:`sub_question_mismatch`."""
    one = F.coalesce(F.array_size(result_texts(F.col("output_json"))) == 1, F.lit(False)) & F.col("input").isNotNull()
    # spelled as it would be: a text without escapes, and no other kind of value, of which none has a blank inside
    # but lists and objects
    plain = ~F.col("output_json").contains("\\") & F.col("input").contains(" ") & ~F.col("input").rlike(r"\A[\[{]")
    plain = plain & (quote(F.col("input")) == F.concat(F.lit('"'), "input", F.lit('"')))
    other = _maybe("sub_question:string", lambda r: r["sub_question"] != F.col("input"))
    return _edited(df, lambda r: _put(r, "sub_question", quote(F.col("input"))), one & (~plain | other))


def fix_timeframes(df: DataFrame, pattern: str = TIME_PHRASE) -> DataFrame:
    """Give the first result of a question with a time phrase that phrase as time frame, where no result
    of the example has one; see :func:`missing_timeframe`. Later steps build on the first, so the phrase
    is not repeated in them."""
    phrase = F.regexp_extract("input", pattern, 1)
    open_ = (phrase != "") & ~F.coalesce(_covered(), F.lit(False))
    frame = F.concat(F.lit('{"phrase":'), quote(phrase), F.lit("}"))
    return _edited(df, lambda r: _put(r, "timeframe", frame), open_, only_first=True)


def _covered() -> Column:
    """Whether a result of the example holds a time frame."""
    return F.exists(
        result_texts(F.col("output_json")),
        lambda r: F.from_json(r, result_type("timeframe"))["timeframe"]["phrase"].isNotNull(),
    )


def add_business_phrases(df: DataFrame, phrases: tuple[str, ...] = PREMIUM_PHRASES) -> DataFrame:
    """Move listed phrases of the question to the unmatched intents of every result.

    A dimension whose name, filter value or original phrase is such a phrase goes; a result whose
    unmatched intents lack the phrase gets it as ``business_entity``. An absent or null list is created.
    """
    some = F.col("_pm_phrases")

    def item(phrase: Column) -> Column:
        return F.concat(F.lit('{"phrase":'), quote(phrase), F.lit(',"type":"business_entity","reason":"listed business phrase"}'))

    def listed(d: Column) -> Column:
        read = F.from_json(d, "struct<name:string,filter_value:string,original_phrase:string>")
        said = F.array_compact(F.array(*[F.lower(read[f]) for f in ("name", "filter_value", "original_phrase")]))
        return F.coalesce(F.when(d.startswith("{"), F.arrays_overlap(said, some)), F.lit(False))

    def extended(result: Column) -> Column:
        intents = F.from_json(result, "struct<unmatched_intents:array<string>>")["unmatched_intents"]
        have = F.array_compact(F.transform(intents, lambda u: F.when(u.startswith("{"), F.lower(F.from_json(u, "struct<phrase:string>")["phrase"]))))
        new = F.filter(some, lambda p: ~F.coalesce(F.array_contains(have, p), F.lit(False)))
        added = F.transform(new, item)
        alone = F.concat(F.lit("["), F.array_join(added, ","), F.lit("]"))
        grow = lambda raw: F.when(raw == "null", alone).otherwise(edit_elements(raw, more=added))
        return edit_members(
            result, {"unmatched_intents": grow, "dimensions": lambda raw: edit_elements(raw, keep=lambda d: ~listed(d))},
            {"unmatched_intents": alone},
        )

    found = F.array_compact(
        F.array(*[F.when(F.col(_LOWER).contains(p), F.lit(p)) for p in phrases])
    )
    rows = _with_lower(df).withColumn("_pm_phrases", found)
    return _edited(rows, extended, F.size("_pm_phrases") > 0).drop(_LOWER, "_pm_phrases")


# ---------------------------------------------------------------- fixes of words and phrases

# A word with what stands behind it, so that words in a row spell their part of the text.
_WORD = r"[\p{L}\p{N}]+"
_SPELLED = r"[\p{L}\p{N}]+[^\p{L}\p{N}]*"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _stretch(spelled: Column, start: Column, size: Column) -> Column:
    """The text of ``size`` words from the ``start``-th on, as it stands."""
    return F.regexp_replace(F.array_join(F.slice(spelled, start, size), ""), r"[^\p{L}\p{N}]+\z", "")


def best_stretch(phrase: Column, words: Column, spelled: Column, least: int = LEAST_LIKENESS) -> Column:
    """The words of a question in a row that are most like a phrase, as they stand; NULL if none is.

    Likeness is twice the number of common words over the words of both, in hundredths at least
    ``least``. Of equally like stretches the earliest counts, then the shortest. ``words`` are those of the
    question in lower case, ``spelled`` the same with what stands behind each.
    """

    def scored(said: Column) -> Column:
        n = F.size(said)
        # A stretch that begins or ends with another word is less like the phrase than the one without it:
        # the scores differ by more than rounding while phrases have at most MOST_TIGHT words.
        every = F.sequence(F.lit(1), F.size(words))
        within = F.filter(every, lambda i: F.array_contains(said, F.element_at(words, i)))
        places = F.when(n <= MOST_TIGHT, within).otherwise(every) if least > 0 else every

        def stretches(at: Column) -> Column:
            def to(start: Column) -> Column:
                def ending(end: Column) -> Column:
                    size = end - start + 1
                    common = F.size(F.array_intersect(F.slice(words, start, size), said))
                    score = F.floor(common * 2_000_000 / (size + n))
                    return F.struct(score.alias("score"), (-start).alias("place"), (-size).alias("size"))

                return F.transform(F.filter(at, lambda end: (end >= start) & (end - start < 2 * n)), ending)

            return F.array_max(F.flatten(F.transform(at, to)))

        found = let(places, stretches)
        return let(found, lambda f: F.when(f["score"] >= least * 10_000, _stretch(spelled, -f["place"], -f["size"])))

    return let(F.array_distinct(_words(F.lower(phrase))), lambda said: F.when((F.size(said) > 0) & (F.size(words) > 0), scored(said)))


def fix_original_phrases(
    df: DataFrame, least: int = LEAST_LIKENESS, words: dict[str, tuple[str, ...]] = CALCULATION_WORDS
) -> DataFrame:
    """Give measures and dimensions whose original phrase is not part of the question the words that are.

    These are the words in a row most like the phrase, see :func:`best_stretch`, or else, for a measure,
    the listed words of the question that stand for its calculation ("how many" for ``Count``). Without
    either the phrase stays and :func:`phrase_mismatch` goes on listing it.
    """
    lower, asked = F.col(_LOWER), F.col("_pm_words")
    spelled = F.regexp_extract_all("input", F.lit(_SPELLED), F.lit(0))  # no column: few rows need it

    def said_for(calculation: Column) -> Column:
        hits = [
            F.when(calculation.isin(*names) & lower.contains(word), F.col("input").substr(F.instr(lower, word), F.lit(len(word))))
            for word, names in words.items()
        ]
        return F.coalesce(*hits) if hits else F.lit(None).cast("string")

    def mended(item: Column) -> Column:
        read = F.from_json(item, "struct<original_phrase:string,calculation:string>")

        def choose(r: Column) -> Column:
            better = F.coalesce(best_stretch(r["original_phrase"], asked, spelled, least), said_for(r["calculation"]))
            foreign = ~lower.contains(F.lower(r["original_phrase"]))
            return let(F.when(foreign, better), lambda b: F.when(
                b.isNotNull(), edit_members(item, {"original_phrase": lambda _: quote(b)})).otherwise(item))

        return let(read, choose)

    def near(item: Column) -> Column:
        phrase = F.lower(item["original_phrase"])
        likely = F.arrays_overlap(_words(phrase), asked) if least > 0 else F.lit(True)
        return ~lower.contains(phrase) & (said_for(item["calculation"]).isNotNull() | likely)

    phrases = "array<struct<original_phrase:string,calculation:string>>"
    some = _maybe(f"measures:{phrases},dimensions:{phrases}", lambda r: F.exists(r["measures"], near) | F.exists(r["dimensions"], near))
    edit = {field: lambda raw: edit_elements(raw, mended) for field in ("measures", "dimensions")}
    rows = _with_lower(df).withColumn("_pm_words", _words(F.lower("input")))
    return _edited(rows, lambda r: edit_members(r, edit), F.col("input").isNotNull() & some).drop(_LOWER, "_pm_words")


def merge_split_phrases(df: DataFrame) -> DataFrame:
    """Join neighbouring one-word unmatched phrases that stand side by side in the question.

    A run is taken as long as its words, with one blank between them, are part of the question (any case);
    the first of a run gets the whole phrase and keeps its other fields, the others go.
    """

    def merged(pieces: Column) -> Column:
        kind = "struct<head:string,value:string,phrase:string,runs:boolean>"

        def read(p: Column) -> Column:
            phrase = F.when(p["value"].startswith("{"), F.from_json(p["value"], "struct<phrase:string>")["phrase"])
            return F.struct(p["head"].alias("head"), p["value"].alias("value"), phrase.alias("phrase"), F.lit(False).alias("runs"))

        def step(done: Column, p: Column) -> Column:
            last = F.element_at(done, -1)
            longer = F.concat(last["phrase"], F.lit(" "), p["phrase"])
            single = ~p["phrase"].contains(" ") & (last["runs"] | ~last["phrase"].contains(" "))
            joins = (F.size(done) > 0) & single & F.col(_LOWER).contains(F.lower(longer))
            joined = F.struct(last["head"].alias("head"), last["value"].alias("value"), longer.alias("phrase"), F.lit(True).alias("runs"))
            return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(p)))

        runs = F.aggregate(F.transform(pieces, read), F.array().cast(f"array<{kind}>"), step)
        return F.transform(runs, lambda r: F.struct(
            r["head"].alias("head"),
            F.when(r["runs"], edit_members(r["value"], {"phrase": lambda _: quote(r["phrase"])})).otherwise(r["value"]).alias("value"),
        ))

    edit = {"unmatched_intents": lambda raw: edit_elements(raw, whole=merged)}
    some = F.col(_LOWER).isNotNull() & _maybe("unmatched_intents:array<string>", lambda r: F.array_size(r["unmatched_intents"]) > 1)
    return _edited(_with_lower(df), lambda r: edit_members(r, edit), some).drop(_LOWER)


# ---------------------------------------------------------------- fix of steps

_MERGED_LISTS = ("measures", "dimensions", "pattern", "segments", "breakdowns", "unmatched_intents")


def _merge(left: Column, right: Column) -> Column:
    """Two results as one: lists joined with equal items once, of other values the left one unless it is
    null, and what only the right one has. Associative, so any grouping of the steps gives the same."""

    def joined(own: Column, name: str):
        def edit(raw: Column) -> Column:
            def chosen(other: Column) -> Column:
                def lists(x: Column) -> Column:
                    items = F.array_distinct(F.concat(x["mine"], x["theirs"]))
                    both = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
                    return F.when(F.size(F.array_except(x["theirs"], x["mine"])) > 0, both).otherwise(raw)

                cut = F.struct(raw_elements(raw).alias("mine"), raw_elements(other).alias("theirs"))
                return F.when(raw == "null", F.coalesce(other, raw)).otherwise(let(cut, lists))

            return let(raw_value(own, name), chosen)

        return edit

    def first_of(own: Column, name: str):
        return lambda raw: F.when(raw == "null", F.coalesce(raw_value(own, name), raw)).otherwise(raw)

    def merged(own: Column) -> Column:
        edits = {n: joined(own, n) if n in _MERGED_LISTS else first_of(own, n) for n in REQUIRED_FIELDS}
        return let(edit_members(left, edits), lambda both: adopt_members(both, right))

    return let(spelled_members(raw_members(right)), merged)


def merge_steps(df: DataFrame, indicators: tuple[str, ...] = COMPLEXITY_INDICATORS) -> DataFrame:
    """Make one step of the results of questions without a complexity indicator; see
    :func:`complexity_mismatch`. Elements that are no objects stay. Questions that need more steps than
    they have cannot be split by rule and stay listed."""

    def one(pieces: Column) -> Column:
        objects = F.filter(pieces, lambda p: p["value"].startswith("{"))
        values = F.transform(objects, lambda p: p["value"])
        merged = F.aggregate(F.slice(values, 2, F.size(values)), F.element_at(values, 1), _merge)
        named = let(merged, lambda m: edit_members(m, {"step_id": lambda _: F.lit('"step_1"')}))
        first = F.struct(F.element_at(objects, 1)["head"].alias("head"), named.alias("value"))
        others = F.filter(pieces, lambda p: ~p["value"].startswith("{"))
        return F.when(F.size(objects) > 1, F.concat(F.array(first), others)).otherwise(pieces)

    edit = {"discovery_results": lambda raw: edit_elements(raw, whole=one)}
    several = F.array_size(result_texts(F.col("output_json"))) > 1
    simple = several & ~contains_any(F.lower("input"), indicators) & F.json_object_keys("output_json").isNotNull()
    merged = F.when(simple, F.coalesce(edit_members(F.col("output_json"), edit), F.col("output_json")))
    return df.withColumn("output_json", merged.otherwise(F.col("output_json")))


# ---------------------------------------------------------------- entity drift

# What a count of learned drift is for; the nulls of a group's words tell the same.
_PAIR, _ASKED, _TOLD, _ALL = range(4)


def _swaps(question: Column, sub_question: Column) -> Column:
    """``array<struct<place,was,is>>``: words of a question that stand otherwise in its sub question.

    The texts are compared word by word, so both must have as many words; others hold no swap.
    """
    same = F.zip_with(question, sub_question, lambda a, b: F.struct(a.alias("was"), b.alias("is")))
    listed = F.transform(same, lambda p, i: F.struct((i + 1).alias("place"), p["was"].alias("was"), p["is"].alias("is")))
    other = F.filter(listed, lambda p: F.lower(p["was"]) != F.lower(p["is"]))
    return F.when(F.size(question) == F.size(sub_question), other).otherwise(F.array().cast("array<struct<place:int,was:string,is:string>>"))


def learn_drift(df: DataFrame, support: int = DRIFT_SUPPORT, confidence: int = DRIFT_CONFIDENCE) -> DataFrame:
    """Words that sub questions put in place of a question's word, learned from all examples.

    A row ``(in_question, in_sub_question, results, question_results, sub_results, confidence, lift)`` for
    each pair found at the same place of at least ``support`` results and in at least ``confidence``
    thousandths of the results whose question holds the first word. ``lift`` is how many thousandths as
    often the two meet as words spread by chance would. Each result counts a pair and a word once, and is
    summed where it is read, so the shuffles carry distinct words and pairs.

    All counts come from one aggregate. What is left out is left out inside the generator, and kinds are
    told apart by a column of the aggregate: filters on the question or on a group key would be pushed
    below it, into the expression of the question, and make four different reads of one.
    """
    flat = steps(df, "sub_question", keep=("input",))
    none = F.lit(None).cast("string")
    entry = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    def entries(said: Column) -> Column:
        pairs = F.transform(_swaps(said["asked"], said["told"]), lambda p: F.struct(p["was"], p["is"]))
        return F.concat(
            F.transform(F.array_distinct(pairs), lambda p: entry(_PAIR, p["was"], p["is"])),
            F.transform(F.array_distinct(said["asked"]), lambda w: entry(_ASKED, w, none)),
            F.transform(F.array_distinct(said["told"]), lambda w: entry(_TOLD, none, w)),
            F.array(entry(_ALL, none, none)),
        )

    both = F.col("input").isNotNull() & F.col("sub_question").isNotNull()
    said = F.when(both, F.struct(_words(F.lower("input")).alias("asked"), _words(F.lower("sub_question")).alias("told")))
    found = F.explode(let(said, lambda s: F.when(s.isNotNull(), entries(s))))
    counted = flat.select(found.alias("e")).groupBy("e.a", "e.b").agg(F.min("e.kind").alias("kind"), F.count(F.lit(1)).alias("n"))
    rows = counted.select("kind", "n", *[F.coalesce(c, F.lit("")).alias(c) for c in ("a", "b")])
    of = lambda kind, *cols: rows.where(F.col("kind") == kind).select(*cols)
    met = of(_PAIR, F.col("a").alias("in_question"), F.col("b").alias("in_sub_question"), F.col("n").alias("results"))
    met = met.where(F.col("results") >= support)
    table = (
        met.join(of(_ASKED, F.col("a").alias("in_question"), F.col("n").alias("question_results")), "in_question")
        .join(of(_TOLD, F.col("b").alias("in_sub_question"), F.col("n").alias("sub_results")), "in_sub_question")
    )
    total = of(_ALL, F.col("n")).scalar()
    share = F.expr("results * 1000 div question_results")
    lift = F.floor(F.col("results").cast("decimal(38,0)") * 1000 * total.cast("decimal(18,0)") / (
        F.col("question_results").cast("decimal(18,0)") * F.col("sub_results").cast("decimal(18,0)"))).cast("bigint")
    return table.withColumns({"confidence": share, "lift": lift}).where(F.col("confidence") >= confidence).select(
        "in_question", "in_sub_question", "results", "question_results", "sub_results", "confidence", "lift"
    )


def _found_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(_pm_row, _pm_known)``: the pairs that stand in the results of rows with a key, for keys that have any.

    The join is on pairs alone, so no text moves with it and neither side need fit a task.
    """
    flat = steps(df.select("example_id", "input", "output_json", "_pm_row"), "sub_question", keep=("input", "_pm_row"))

    def keys(swaps: Column) -> Column:
        return F.array_distinct(F.transform(swaps, lambda p: F.struct(F.lower(p["was"]).alias("a"), F.lower(p["is"]).alias("b"))))

    swaps = F.when(F.col("sub_question") != F.col("input"), _swaps(_words(F.col("input")), _words(F.col("sub_question"))))
    asked = flat.select("_pm_row", F.inline(keys(swaps)))
    known = asked.join(pairs.select(F.col("in_question").alias("a"), F.col("in_sub_question").alias("b")), ["a", "b"])
    return known.groupBy("_pm_row").agg(F.collect_set(F.concat_ws(" ", "a", "b")).alias("_pm_known"))


def fix_drift(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Put the question's words back into sub questions, at the places where a learned pair stands.

    All pairs count, however many there are. Each row gets those that stand in it by a join on a hash of
    its texts; rows whose hashes meet share their pairs, which are learned pairs all the same, so that
    changes no result. Rows without a pair are not cut.
    """
    asked = F.col("_pm_words")

    def mended(result: Column) -> Column:
        def put_back(sub: Column) -> Column:
            spelled = F.regexp_extract_all(sub, F.lit(_SPELLED), F.lit(0))
            before = F.regexp_extract(sub, r"\A[^\p{L}\p{N}]*", 0)
            told = F.transform(spelled, lambda s: F.regexp_extract(s, _WORD, 0))
            mine = F.filter(_swaps(asked, told), lambda p: F.array_contains(
                F.col("_pm_known"), F.concat(F.lower(p["was"]), F.lit(" "), F.lower(p["is"]))))

            def rebuilt(swaps: Column) -> Column:
                def word(s: Column, i: Column) -> Column:
                    was = F.try_element_at(F.filter(swaps, lambda p: p["place"] == i + 1), F.lit(1))["was"]
                    return F.when(was.isNull(), s).otherwise(F.concat(was, F.regexp_extract(s, r"[^\p{L}\p{N}]*\z", 0)))

                text = F.concat(before, F.array_join(F.transform(spelled, word), ""))
                return F.when(F.size(swaps) > 0, edit_members(result, {"sub_question": lambda _: quote(text)})).otherwise(result)

            return let(mine, rebuilt)

        return let(F.from_json(result, "struct<sub_question:string>")["sub_question"],
                   lambda sub: F.when(sub.isNotNull(), put_back(sub)).otherwise(result))

    keyed = df.withColumn("_pm_row", F.xxhash64("input", "output_json"))
    rows = keyed.join(_found_pairs(keyed, pairs), "_pm_row", "left").withColumn("_pm_words", _words(F.col("input")))
    some = F.col("input").isNotNull() & F.col("_pm_known").isNotNull()
    return _edited(rows, mended, some).drop("_pm_row", "_pm_words", "_pm_known")


def repair(df: DataFrame) -> DataFrame:
    """All fixes that need no learning: structure and types, steps, phrases, sub questions, time frames."""
    for fix in (fix_examples, merge_steps, merge_split_phrases, fix_original_phrases, reclassify_unknown,
                drop_redundant_dimensions, add_business_phrases, fix_sub_questions, fix_timeframes):
        df = fix(df)
    return df


# ---------------------------------------------------------------- checks


def invalid_types(df: DataFrame, allowed: tuple[str, ...] = ALLOWED_TYPES) -> DataFrame:
    """Unmatched intents whose type is not allowed."""
    return items(df, "unmatched_intents", "phrase", "type").filter(_absent(F.col("type"), allowed))


def invalid_calculations(
    df: DataFrame, allowed: tuple[str, ...] = ALLOWED_CALCULATIONS
) -> DataFrame:
    """Measures whose calculation is not allowed."""
    return items(df, "measures", "name", "calculation").filter(
        _absent(F.col("calculation"), allowed)
    )


def complexity_mismatch(
    df: DataFrame, indicators: tuple[str, ...] = COMPLEXITY_INDICATORS
) -> DataFrame:
    """``under_split``: an indicator but one step. ``over_split``: two or more steps without one."""
    n = F.array_size(F.from_json("output_json", "struct<discovery_results:array<string>>")["discovery_results"])
    hinted = contains_any(F.col(_LOWER), indicators)
    rows = _with_lower(df).select(
        "example_id", "input", hinted.alias("_pm_hint"),
        F.coalesce(n, F.lit(0)).cast("bigint").alias("steps"),
    )
    return emit(
        rows, F.col("_pm_hint") == (F.col("steps") < 2),
        F.col("example_id"), F.col("input"), F.col("steps"),
        F.when(F.col("_pm_hint"), F.lit("under_split")).otherwise(F.lit("over_split")).alias("mismatch"),
    )


def phrase_mismatch(df: DataFrame) -> DataFrame:
    """Measures and dimensions whose original phrase is not part of the question (any case)."""
    flat = steps(_with_lower(df), "measures", "dimensions", keep=(_LOWER,))

    def tagged(field: str, kind: str) -> Column:
        pairs = F.transform(
            F.col(field),
            lambda item, i: F.struct(
                F.lit(kind).alias("kind"), i.cast("bigint").alias("item_no"),
                item["original_phrase"].alias("original_phrase"),
            ),
        )
        empty = F.array().cast("array<struct<kind:string,item_no:bigint,original_phrase:string>>")
        return F.coalesce(pairs, empty)

    both = F.concat(tagged("measures", "measure"), tagged("dimensions", "dimension"))
    return (
        flat.select("example_id", "step_no", _LOWER, F.inline(both))
        .filter(~F.col(_LOWER).contains(F.lower("original_phrase")))
        .drop(_LOWER)
    )


def sub_question_mismatch(df: DataFrame) -> DataFrame:
    """One-step examples whose sub question is not the question."""
    subs = F.transform(
        result_texts(F.col("output_json")), lambda r: F.from_json(r, "struct<sub_question:string>")["sub_question"]
    )
    rows = df.select("example_id", "input", subs.alias("_pm_subs"))
    only = F.when(F.array_size("_pm_subs") == 1, F.try_element_at("_pm_subs", F.lit(1)))
    return emit(rows, only != F.col("input"), F.col("example_id"), F.col("input"), only.alias("sub_question"))


def count_measure_name(df: DataFrame) -> DataFrame:
    """Measures that count but are not named ``Count``."""
    flat = items(df, "measures", "name", "calculation")
    return flat.filter((F.col("calculation") == "Count") & ~F.col("name").eqNullSafe("Count"))


def unknown_term_audit(df: DataFrame) -> DataFrame:
    """Unmatched intents per type."""
    return items(df, "unmatched_intents", "type").groupBy("type").agg(F.count(F.lit(1)).alias("intents"))


def split_phrases(df: DataFrame) -> DataFrame:
    """Neighbouring one-word unmatched phrases that stand side by side in the question."""
    flat = steps(_with_lower(df), "unmatched_intents", keep=(_LOWER,))
    phrase = F.col("unmatched_intents")["phrase"]
    pairs = F.zip_with(
        phrase, F.slice(phrase, 2, F.greatest(F.array_size(phrase), F.lit(1))),
        lambda a, b: F.when(
            ~a.contains(" ") & ~b.contains(" "), F.concat_ws(" ", a, b)
        ),
    )
    return (
        flat.select("example_id", "step_no", _LOWER, F.posexplode(pairs).alias("pos", "phrase"))
        .filter(F.col(_LOWER).contains(F.lower("phrase")))
        .select("example_id", "step_no", F.col("pos").cast("bigint").alias("item_no"), "phrase")
    )


def entity_drift(df: DataFrame, pairs: tuple[tuple[str, str], ...] = DRIFT_PAIRS) -> DataFrame:
    """Results per term pair whose question has the first and whose sub question the second."""
    flat = steps(_with_lower(df), "sub_question", keep=(_LOWER,))
    sub = F.lower("sub_question")
    row = flat.agg(
        *[
            F.count_if(F.col(_LOWER).contains(a) & sub.contains(b)).alias(f"n{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("in_question"), F.lit(b).alias("in_sub_question"),
                        F.col(f"n{i}").alias("results"),
                    )
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        )
    )


def calculation_mismatch(
    df: DataFrame, words: dict[str, tuple[str, ...]] = CALCULATION_WORDS
) -> DataFrame:
    """Questions that name a calculation no measure of the example has."""
    def calculations_of(result: Column) -> Column:
        read = typed_items(F.from_json(result, result_type("measures"))["measures"], ITEM_TYPES["measures"])
        return F.coalesce(F.transform(read, lambda m: m["calculation"]), F.array().cast("array<string>"))

    have = F.flatten(F.transform(result_texts(F.col("output_json")), calculations_of))
    named = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(_LOWER).contains(word)
                    & ~F.coalesce(
                        F.arrays_overlap("_pm_have", F.array(*map(F.lit, calculations))), F.lit(False)
                    ),
                    F.lit(word),
                )
                for word, calculations in words.items()
            ]
        )
    )
    return (
        _with_lower(df)
        .select("example_id", _LOWER, F.coalesce(have, F.array().cast("array<string>")).alias("_pm_have"))
        .select("example_id", F.explode(named).alias("word"))
    )


def breakdown_confusion(df: DataFrame, word: str = " by ") -> DataFrame:
    """Results with dimensions but no breakdowns although the question says ``by``."""
    flat = steps(_with_lower(df), "dimensions", "breakdowns", keep=(_LOWER,))
    return flat.filter(
        F.col(_LOWER).contains(word)
        & (F.array_size("dimensions") > 0)
        & (F.coalesce(F.array_size("breakdowns"), F.lit(0)) == 0)
    ).select("example_id", "step_no", F.array_size("dimensions").cast("bigint").alias("n_dimensions"))


def redundant_dimensions(df: DataFrame) -> DataFrame:
    """Dimensions that are also among the breakdowns of their result."""
    flat = steps(df, "dimensions", "breakdowns")
    names = F.transform("breakdowns", lambda b: F.get_json_object(b, "$.name"))
    doubled = flat.select("example_id", "step_no", names.alias("_pm_names"), F.posexplode("dimensions"))
    return doubled.filter(F.array_contains("_pm_names", F.col("col.name"))).select(
        "example_id", "step_no", F.col("pos").cast("bigint").alias("item_no"), F.col("col.name").alias("name")
    )


def missing_timeframe(df: DataFrame, pattern: str = TIME_PHRASE) -> DataFrame:
    """Questions with a time phrase whose results hold no time frame."""
    phrase = F.regexp_extract("input", pattern, 1)
    rows = df.select(
        "example_id", phrase.alias("phrase"), F.coalesce(_covered(), F.lit(False)).alias("_pm_covered")
    )
    return emit(
        rows, (F.col("phrase") != "") & ~F.col("_pm_covered"), F.col("example_id"), F.col("phrase")
    )


# ---------------------------------------------------------------- duplicates


def exact_duplicates(
    df: DataFrame, key: str = "example_id", columns: tuple[str, ...] = ("input", "output_json")
) -> DataFrame:
    """Groups of equal rows: smallest id and number of copies.

    Rows are grouped by a 32-byte digest, and copies collapse before the shuffle, so neither
    long texts nor a text with very many copies weigh on it.
    """
    return (
        df.groupBy(digest(*[F.col(c) for c in columns]).alias("_pm_digest"))
        .agg(F.min(key).alias("kept_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("kept_id", "copies")
    )


def drop_duplicates(
    df: DataFrame, key: str = "example_id", columns: tuple[str, ...] = ("input", "output_json")
) -> DataFrame:
    """Rows without their exact copies; of equal rows the smallest id stays.

    The join is on unique ids, so a hot text cannot make a hot join key.
    """
    kept = (
        df.groupBy(digest(*[F.col(c) for c in columns]).alias("_pm_digest"))
        .agg(F.min(key).alias(key))
        .select(key)
    )
    return df.join(kept, key, "left_semi")


def conflicting_duplicates(df: DataFrame, as_json: bool = False) -> DataFrame:
    """Questions that occur with different outputs; ``as_json`` ignores key order and spacing.

    Grouped by (question, output digest) first: a hot question collapses to its distinct
    outputs map-side before it is grouped alone.
    """
    output = canonical(F.col("output_json")) if as_json else F.col("output_json")
    pairs = df.groupBy("input", digest(output).alias("_pm_out")).agg(
        F.min("example_id").alias("first_id"), F.count(F.lit(1)).alias("examples")
    )
    return (
        pairs.groupBy("input")
        .agg(
            F.min("first_id").alias("first_id"), F.sum("examples").alias("examples"),
            F.count(F.lit(1)).alias("outputs"),
        )
        .filter("outputs > 1")
    )


# In a text, and inside the strings of a JSON text, where double quotes are escaped.
_QUOTED = r"'[^']*'|\"[^\"]*\""
_QUOTED_INSIDE = r"'[^']*'|\\\"[^\"\\]*\\\""
_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


def question_template(df: DataFrame) -> DataFrame:
    """Add ``template``, the question with filter values, quoted values and numbers as slots, and ``shape``,
    the output with the same slots.

    Filter values are those of the example's own dimensions, in their order; an empty one is no slot.
    """

    def values_of(result: Column) -> Column:
        read = F.from_json(result, "struct<dimensions:array<string>>")["dimensions"]
        return F.transform(F.filter(read, lambda d: d.startswith("{")), lambda d: F.from_json(d, "struct<filter_value:string>")["filter_value"])

    found = F.flatten(F.transform(result_texts(F.col("output_json")), lambda r: F.coalesce(values_of(r), F.array().cast("array<string>"))))
    values = F.coalesce(F.filter(found, lambda v: v != ""), F.array().cast("array<string>"))
    slots = lambda text: F.aggregate(F.col("_pm_values"), text, lambda t, v: F.replace(t, v, F.lit("<v>")))
    slotted = lambda text, quoted: F.regexp_replace(F.regexp_replace(slots(text), quoted, "<q>"), _NUMBER, "<n>")
    rows = df.withColumn("_pm_values", F.array_distinct(values))
    return rows.withColumns({
        "template": slotted(F.col("input"), _QUOTED), "shape": slotted(F.col("output_json"), _QUOTED_INSIDE),
    }).drop("_pm_values")


def conflicting_templates(df: DataFrame) -> DataFrame:
    """Question templates that occur with outputs of different shapes: questions that are alike but for
    numbers, quoted and filter values, answered differently. See :func:`question_template`.

    Grouped by (template digest, shape digest) first, so that a hot template spreads and collapses before
    it is grouped alone; the text of a template travels once a task and shape.
    """
    rows = question_template(df).filter("template IS NOT NULL")
    pairs = rows.groupBy("template", digest(F.col("shape")).alias("_pm_shape")).agg(
        F.min("example_id").alias("first_id"), F.count(F.lit(1)).alias("examples")
    )
    return (
        pairs.groupBy("template")
        .agg(F.min("first_id").alias("first_id"), F.sum("examples").alias("examples"), F.count(F.lit(1)).alias("shapes"))
        .filter("shapes > 1")
    )


# ---------------------------------------------------------------- coverage and accounting


def intent_coverage(df: DataFrame, intents: tuple[str, ...] = INTENTS) -> DataFrame:
    """Examples per required intent, zero counts included."""
    intent = F.get_json_object("output_json", "$.intent")
    row = df.select(intent.alias("_pm_intent")).agg(
        *[F.count_if(F.col("_pm_intent") == v).alias(f"n{i}") for i, v in enumerate(intents)]
    )
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(v).alias("intent"), F.col(f"n{i}").alias("examples"))
                    for i, v in enumerate(intents)
                ]
            )
        )
    )


def with_issue_counts(
    df: DataFrame,
    indicators: tuple[str, ...] = COMPLEXITY_INDICATORS,
    types: tuple[str, ...] = ALLOWED_TYPES,
    calculations: tuple[str, ...] = ALLOWED_CALCULATIONS,
) -> DataFrame:
    """Add the number of issues of each class to every example, as ``n_<class>``.

    Issues of an example depend on that example alone, so counting, sharing and filtering by
    issue needs no join: one parse, one scan, no shuffle.
    """
    results = F.col("_pm_results")

    def total(per_result) -> Column:
        return F.coalesce(F.aggregate(results, F.lit(0), lambda n, r: n + per_result(r)), F.lit(0))

    def bad(result: Column, name: str, item_test) -> Column:
        return F.coalesce(F.array_size(F.filter(result[name], item_test)), F.lit(0))

    def foreign(item: Column) -> Column:
        return ~F.coalesce(F.col(_LOWER).contains(F.lower(item["original_phrase"])), F.lit(True))

    texts = result_texts(F.col("output_json"))
    lists = ("measures", "dimensions", "unmatched_intents")
    read = F.transform(
        F.filter(texts, is_object),
        lambda t: let(F.from_json(t, result_type(*lists)), lambda step: F.struct(
            F.json_object_keys(t).alias("keys"),
            *[F.array_compact(typed_items(step[name], ITEM_TYPES[name])).alias(name) for name in lists],
        )),
    )
    required = F.array(*map(F.lit, REQUIRED_FIELDS))
    broken = ~has_key(F.col("output_json"), "intent") | ~has_key(F.col("output_json"), "discovery_results")
    missing = total(lambda r: F.array_size(F.array_except(required, r["keys"])))
    n_steps = F.coalesce(F.col("_pm_steps"), F.lit(0))
    hinted = contains_any(F.col(_LOWER), indicators)
    parsed = _with_lower(df).withColumns({"_pm_results": read, "_pm_steps": F.array_size(texts)})
    return parsed.select(
        *df.columns,
        F.when(broken, 1).otherwise(missing).alias("n_structure"),
        total(lambda r: bad(r, "unmatched_intents", lambda u: _absent(u["type"], types)))
        .alias("n_invalid_type"),
        F.when((hinted & (n_steps < 2)) | (~hinted & (n_steps >= 2)), 1).otherwise(0).alias("n_complexity"),
        total(lambda r: bad(r, "measures", foreign) + bad(r, "dimensions", foreign)).alias("n_original_phrase"),
        total(lambda r: bad(r, "measures", lambda m: _absent(m["calculation"], calculations)))
        .alias("n_calculation"),
    )


_CLASSES = tuple(PRIORITIES)


def issue_priorities(df: DataFrame) -> DataFrame:
    """Per issue class its priority, issues, examples concerned and their share."""
    counted = with_issue_counts(df)
    row = counted.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.coalesce(F.sum(f"n_{c}"), F.lit(0)).cast("bigint").alias(f"s_{c}") for c in _CLASSES],
        *[F.count_if(F.col(f"n_{c}") > 0).alias(f"e_{c}") for c in _CLASSES],
    )
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("issue_class"), F.lit(p).alias("priority"),
                        F.col(f"s_{c}").alias("issues"), F.col(f"e_{c}").alias("examples"),
                        F.try_divide(F.col(f"e_{c}").cast("double"), F.col("total").cast("double"))
                        .alias("example_share"),
                    )
                    for c, p in PRIORITIES.items()
                ]
            )
        )
    )


def data_quality_rate(df: DataFrame) -> DataFrame:
    """One minus issues per example; NULL for an empty dataset."""
    every = sum((F.col(f"n_{c}") for c in _CLASSES[1:]), F.col(f"n_{_CLASSES[0]}"))
    row = with_issue_counts(df).agg(
        F.count(F.lit(1)).alias("examples"),
        F.coalesce(F.sum(every), F.lit(0)).cast("bigint").alias("issues"),
    )
    rate = 1 - F.try_divide(F.col("issues").cast("double"), F.col("examples").cast("double"))
    return row.select("examples", "issues", rate.alias("quality_rate"))


def before_after(before: DataFrame, after: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Issues per class in two versions of a dataset and the improvement in percent.

    ``after`` is the other version, or the fix that makes it; a fix is applied and counted in the same pass
    and aggregate as its input.
    """
    if isinstance(after, DataFrame):
        old = issue_priorities(before).select("issue_class", F.col("issues").alias("issues_before"))
        new = issue_priorities(after).select("issue_class", F.col("issues").alias("issues_after"))
        both = old.join(new, "issue_class", "full")
    else:
        counted = with_issue_counts(before).withColumnsRenamed({f"n_{c}": f"_pm_{c}" for c in _CLASSES})
        sums = [F.coalesce(F.sum(f"{p}{c}"), F.lit(0)).cast("bigint").alias(f"{p}{c}") for c in _CLASSES for p in ("_pm_", "n_")]
        rows = [
            F.struct(F.lit(c).alias("issue_class"), F.col(f"_pm_{c}").alias("issues_before"), F.col(f"n_{c}").alias("issues_after"))
            for c in _CLASSES
        ]
        both = with_issue_counts(after(counted)).agg(*sums).select(F.inline(F.array(*rows)))
    gone = (F.col("issues_before") - F.col("issues_after")).cast("double")
    return both.select(
        "issue_class", "issues_before", "issues_after",
        (F.try_divide(gone, F.col("issues_before").cast("double")) * 100).alias("improvement_pct"),
    )


def readiness_gate(df: DataFrame, bound: float = READY_RATE) -> DataFrame:
    """Whether the quality rate is above the bound."""
    return data_quality_rate(df).select(
        "quality_rate", F.coalesce(F.col("quality_rate") > bound, F.lit(False)).alias("ready")
    )


def clean_subset(df: DataFrame, n: int = SUBSET_SIZE) -> DataFrame:
    """The first ``n`` examples without any issue."""
    every = sum((F.col(f"n_{c}") for c in _CLASSES[1:]), F.col(f"n_{_CLASSES[0]}"))
    clean = emit(
        with_issue_counts(df), every == 0, F.col("example_id"), F.col("input"), F.col("output_json")
    )
    return clean.orderBy("example_id").limit(n)
