import json

import pytest
from pyspark.sql import functions as F

from phrasemill.functions.lexicon import DEFAULT, Lexicon
from phrasemill.operators import convert, flatten

GOLDEN = [
    ("How many of the departments hired in week 9?", "How many of the publishers hired in week 9?"),
    ("Compare the budget of each department by year", "Compare the revenue of each department by year"),
    ("Which departments spent the largest budget?", "Which publishers spent the largest revenue?"),
    ("Report yearly enrollment by affiliation of schools", "Report yearly engagement by association of websites"),
    ("Show the industry of those companies", "Show the category of those publishers"),
    # the vocabulary is missing: a subject is added
    ("how many dogs", "How many users dogs"),
    ("How many dogs", "How many dogs"),
    ("List dogs", "List all campaigns dogs"),
    ("What are zebras", "What are all the zebras"),
    # the first trigger decides although it replaces nothing
    ("How many dogs on List", "How many dogs on List"),
    # substrings count, whatever the case
    ("Which COUNTRIES host championships", "Which totalRIES host championcampaigns"),
    ("", ""),
    ("Größe der ſhips", "Größe der ſhips"),
]


def test_golden_questions(spark, make):
    out = convert.convert_question(make(*[(q, "{}") for q, _ in GOLDEN])).orderBy("example_id")
    assert [r.input for r in out.collect()] == [a for _, a in GOLDEN]


def test_guard_looks_at_the_original_text(make):
    lexicon = Lexicon.from_text("alpha: beta, x\nbeta: gamma, y")
    out = convert.rewrite_terms(make(("alpha", "{}"), ("alpha beta", "{}")), lexicon=lexicon)
    # in the first text "beta" only appears by replacement, so it does not take part
    assert [r.input for r in out.orderBy("example_id").collect()] == ["beta", "gamma gamma"]


def test_lexicon_shape(spark):
    assert len(DEFAULT.entries) == 100 and len(DEFAULT.vocabulary) == 240
    frame = DEFAULT.frame(spark)
    assert frame.count() == 100 and frame.filter(F.size("alternates") == 4).count() == 100


def result(**fields):
    return {"intent": "intents_discovery", "discovery_results": [fields]}


CASES = [
    # recoded, other fields untouched
    (result(measures=[{"name": "Count", "calculation": "Count", "original_phrase": "count"}]),
     result(measures=[{"name": "Total", "calculation": "Count", "original_phrase": "count"}])),
    (result(measures=[{"name": "Median"}, {"calculation": "Max"}, {"name": None}, {"name": 5}]),
     result(measures=[{"name": "Median"}, {"calculation": "Max"}, {"name": None}, {"name": 5}])),
    (result(dimensions=[{"name": "Geographic"}, {"name": "Entity"}, {"name": "Temporal"}]),
     result(dimensions=[{"name": "Region"}, {"name": "Entity"}, {"name": "Time"}])),
    # breakdowns keep their names
    (result(breakdowns=[{"name": "Geographic"}]), result(breakdowns=[{"name": "Geographic"}])),
    # exact case only
    (result(unmatched_intents=[{"phrase": "schools"}, {"phrase": "Schools"}]),
     result(unmatched_intents=[{"phrase": "publishers"}, {"phrase": "Schools"}])),
    # absent, null and unknown keys survive
    (result(timegrain=None, sub_question="departments"), result(timegrain=None, sub_question="departments")),
    ({"note": {"deep": [1, 2.5, None, "ü\"\n"]}, "discovery_results": [{"extra": True}]},
     {"note": {"deep": [1, 2.5, None, "ü\"\n"]}, "discovery_results": [{"extra": True}]}),
    ({"intent": "x"}, {"intent": "x"}),
    ({"discovery_results": None}, {"discovery_results": None}),
    ({"discovery_results": []}, {"discovery_results": []}),
    (result(measures=None), result(measures=None)),
    ({}, {}),
]


@pytest.mark.parametrize("before, after", CASES)
def test_convert_output(make, before, after):
    row = convert.convert_output(make(("q", json.dumps(before)))).first()
    assert json.loads(row.output_json) == after


def test_other_elements_survive(make):
    before = {"discovery_results": ["x", None, 5, {"measures": ["y", {"name": "Max"}, None]}]}
    after = {"discovery_results": ["x", None, 5, {"measures": ["y", {"name": "Maximum"}, None]}]}
    assert json.loads(convert.convert_output(make(("q", json.dumps(before)))).first().output_json) == after


def test_of_repeated_keys_the_last_is_edited(make):
    texts = ['{"intent":"a","intent":"b"}', '{"discovery_results":[{"measures":[{"name":"Max","name":"Min"}]}]}', "{}", "["]
    df = make(*[("q", t) for t in texts])
    rows = convert.convert_output(df).orderBy("example_id").collect()
    assert [r.output_json for r in rows] == [texts[0], texts[1].replace("Min", "Minimum"), "{}", "["]
    assert [r.example_id for r in convert.unreadable_outputs(df).collect()] == [3]


@pytest.mark.parametrize("text", ["not json", "[1]", '"x"', '{"a":1', ""])
def test_other_texts_stay(make, text):
    assert convert.convert_output(make(("q", text))).first().output_json == text


def test_preview_converts_the_first_rows_only(make):
    out = convert.conversion_preview(make(*[(f"List dogs {i}", "{}") for i in range(20)]))
    rows = out.orderBy("example_id").collect()
    assert [r.original for r in rows] == [f"List dogs {i}" for i in range(5)]
    assert rows[0].converted == "List all campaigns dogs 0"


SAMPLE = [
    {"intent": "intents_discovery", "discovery_results": [{
        "step_id": "step_1", "sub_question": "top 5?",
        "measures": [{"name": "Ad Requests", "calculation": "Percentage Contribution", "original_phrase": "share"}],
        "dimensions": [{"name": "Advertiser", "filter_value": "A, B", "original_phrase": "A and B"},
                       {"name": "Publisher", "filter_value": None, "original_phrase": "publishers"}],
        "timegrain": {"phrase": "day-level"}, "timeframe": None,
        "pattern": [{"name": "Top N", "phrase": "top 5"}], "segments": [], "breakdowns": [],
        "unmatched_intents": [{"phrase": "rendered", "type": "business_action", "reason": "r"}]}]},
]


def test_flatten_sample(make):
    df = make(("q", json.dumps(SAMPLE[0])))
    step = flatten.flatten_steps(df).first()
    assert (step.timegrain, step.timeframe, step.n_dimensions, step.n_pattern) == ("day-level", None, 2, 1)
    assert [r.filter_value for r in flatten.flatten_dimensions(df).orderBy("item_no").collect()] == ["A, B", None]
    assert flatten.flatten_unmatched(df).first().type == "business_action"


def test_typed_output_names_what_it_drops(make):
    text = '{"note":1,"intent":"i","discovery_results":[{"step_id":"s","more":2,"timegrain":null,"breakdowns":[{"name":"A"}]}]}'
    row = flatten.with_typed_output(make(("q", text), ("q", "broken"))).orderBy("example_id").collect()
    assert sorted(row[0].extra_keys) == ["more", "note"] and row[1].extra_keys == []
    assert row[0].output.discovery_results[0].breakdowns == ['{"name":"A"}']
    assert row[0].output_json == text


def test_own_lexicon_letters_stand_for_themselves(make):
    lexicon = Lexicon.from_text("us$: a\\b $1, x\nc++: d.e, y\na.b: z, w")
    out = convert.rewrite_terms(make(("pay us$ now", "{}"), ("C++ or a.b", "{}"), ("axb ccc", "{}")), lexicon=lexicon)
    assert [r.input for r in out.orderBy("example_id").collect()] == ["pay a\\b $1 now", "d.e or z", "axb ccc"]


def test_an_empty_vocabulary_backfills_every_trigger(make):
    out = convert.convert_question(make(("how many dogs", "{}")), lexicon=Lexicon(()))
    assert out.first().input == "How many users dogs"


def test_stored_results_give_the_same_rows(spark, make, tmp_path):
    odd = ('{"discovery_results":["x",7,{"step_id":1,"measures":["m",{"name":"A"},null,{"name":"B","calculation":"Sum"}],"dimensions":null,'
           '"pattern":{"name":"no list"}},{"unmatched_intents":[[],{"phrase":"p"}]}]}')
    df = make(*[("q", t) for t in (json.dumps(SAMPLE[0]), odd, "{}", "broken", '{"discovery_results":null}', '{"discovery_results":[]}')], (None, None))
    flatten.stored_results(df).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    for fn in (flatten.flatten_steps, flatten.flatten_measures, flatten.flatten_dimensions, flatten.flatten_unmatched, flatten.skipped_elements):
        want = sorted(map(str, fn(df).collect()))
        assert sorted(map(str, fn(stored).collect())) == want and want
    plan = flatten.flatten_measures(stored)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert read.startswith("struct<example_id:bigint,results:array<struct<step_no:bigint,measures:array")
