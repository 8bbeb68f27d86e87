import json

import pytest

from phrasemill.operators import convert, flatten, rules
from phrasemill.schemas import REQUIRED_FIELDS


def out(*results, **top):
    return json.dumps({"intent": "intents_discovery", "discovery_results": list(results)} | top)


def first(df):
    return json.loads(df.first().output_json)


def test_complete_fields(make):
    result = first(rules.complete_fields(make(("q", out({"step_id": "s", "extra": 1})))))["discovery_results"][0]
    assert set(result) == set(REQUIRED_FIELDS) | {"extra"}
    assert result["measures"] == [] and result["pattern"] is None and result["step_id"] == "s"
    assert first(rules.complete_fields(make(("q", "{}")))) == {"intent": None, "discovery_results": []}


def test_fix_examples_leaves_no_structure_or_type_issue(make):
    df = make(("q", out({"unmatched_intents": [{"type": "action"}]})), ("q", "{}"))
    row = {r.issue_class: r for r in rules.before_after(df, rules.fix_examples(df)).collect()}
    assert (row["structure"].issues_before, row["structure"].issues_after) == (10, 0)
    assert (row["invalid_type"].issues_before, row["invalid_type"].issues_after) == (1, 0)
    assert row["structure"].improvement_pct == 100.0 and row["calculation"].improvement_pct is None


def test_types_and_calculations(make):
    df = make(("q", out({
        "unmatched_intents": [{"phrase": "a", "type": "action"}, {"phrase": "b"}, {"phrase": "c", "type": "business_entity"}],
        "measures": [{"calculation": "Trend"}, {"calculation": "Sum"}, {"calculation": None}]})))
    assert [r.phrase for r in sorted(rules.invalid_types(df).collect())] == ["a", "b"]
    assert [r.item_no for r in sorted(rules.invalid_calculations(df).collect())] == [0, 2]


def test_complexity(make):
    df = make(("x ordered by y", out({})), ("plain", out({}, {})), ("plain", out({})), ("Ordered BY", out({}, {})))
    assert [(r.example_id, r.mismatch) for r in sorted(rules.complexity_mismatch(df).collect())] == [
        (0, "under_split"), (1, "over_split")]


def test_phrases(make):
    df = make(("How many cats", out({
        "measures": [{"original_phrase": "how MANY"}, {"original_phrase": "count"}, {"original_phrase": None}],
        "dimensions": [{"original_phrase": "dogs"}]})))
    assert [(r.kind, r.item_no) for r in sorted(rules.phrase_mismatch(df).collect())] == [
        ("dimension", 0), ("measure", 1)]


def test_sub_question(make):
    df = make(("a", out({"sub_question": "b"})), ("a", out({"sub_question": "a"})),
              ("a", out({"sub_question": "b"}, {"sub_question": "c"})))
    assert [r.example_id for r in rules.sub_question_mismatch(df).collect()] == [0]


def test_count_names(make):
    df = make(("q", out({"measures": [{"name": "Total", "calculation": "Count"}, {"name": "Total", "calculation": "Sum"}]})))
    assert rules.count_measure_name(df).count() == 1
    fixed = rules.fix_count_names(df)
    assert rules.count_measure_name(fixed).count() == 0
    assert [r.name for r in sorted(flatten.flatten_measures(fixed).collect())] == ["Count", "Total"]


def test_split_phrases(make):
    df = make(("the student enrollment and two words", out({"unmatched_intents": [
        {"phrase": "student"}, {"phrase": "enrollment"}, {"phrase": "two words"}, {"phrase": "and"}]})),
        ("one", out({"unmatched_intents": [{"phrase": "one"}]})), ("none", out({"unmatched_intents": []})))
    assert [tuple(r) for r in rules.split_phrases(df).collect()] == [(0, 0, 0, "student enrollment")]


def test_redundant_dimensions(make):
    df = make(("q", out({"dimensions": [{"name": "A"}, {"name": "B"}], "breakdowns": [{"name": "A"}]}, {"dimensions": [{"name": "A"}]})))
    assert [(r.step_no, r.name) for r in rules.redundant_dimensions(df).collect()] == [(0, "A")]
    left = flatten.flatten_dimensions(rules.drop_redundant_dimensions(df))
    assert [(r.step_no, r.name) for r in sorted(left.collect())] == [(0, "B"), (1, "A")]


def test_premium(make):
    df = make(("Average for PREMIUM customers", out({"unmatched_intents": [{"phrase": "x"}]}, {"unmatched_intents": [{"phrase": "Premium Customers"}]})),
              ("other", out({"unmatched_intents": []})))
    got = [(r.example_id, r.step_no, r.phrase) for r in sorted(flatten.flatten_unmatched(rules.add_business_phrases(df)).collect())]
    assert got == [(0, 0, "x"), (0, 0, "premium customers"), (0, 1, "Premium Customers")]


def test_premium_moves_out_of_the_dimensions(make):
    text = ('{"discovery_results": [ {"dimensions":[{"name":"Segment","filter_value":"Premium Customers"}, {"name":"Region"},"x"],'
            '"n":1.0} ] }')
    moved = ('{"discovery_results": [ {"dimensions":[{"name":"Region"},"x"],"n":1.0,"unmatched_intents":[{"phrase":"premium customers",'
             '"type":"business_entity","reason":"listed business phrase"}]} ] }')
    df = make(("premium customers by region", text), ("by region", text))
    assert [r.output_json for r in rules.add_business_phrases(df).orderBy("example_id").collect()] == [moved, text]


def test_the_time_frame_goes_to_the_first_result(make):
    df = make(("ARR for Q3 2024", '{"discovery_results":["x",{"timeframe":null},{"timeframe":null}]}'))
    assert rules.fix_timeframes(df).first().output_json == (
        '{"discovery_results":["x",{"timeframe":{"phrase":"Q3 2024"}},{"timeframe":null}]}')


def test_timeframe(make):
    df = make(("ARR for Q3 2024", out({"timeframe": None})), ("ARR for Q3 2024", out({"timeframe": {"phrase": "Q3 2024"}})),
              ("in the last month", out()), ("blast it", out()))
    assert [(r.example_id, r.phrase) for r in sorted(rules.missing_timeframe(df).collect())] == [
        (0, "Q3 2024"), (2, "last month")]


def test_duplicates_with_a_hot_text(spark, make):
    df = make(*[("hot", "{}")] * 500, *[(f"t{i}", "{}") for i in range(20)], ("t1", '{"a":1}'))
    group = rules.exact_duplicates(df).collect()
    assert [tuple(r) for r in group] == [(0, 500)]
    assert sorted(r.example_id for r in rules.drop_duplicates(df).collect()) == [0, *range(500, 521)]
    assert [(r.input, r.outputs, r.examples) for r in rules.conflicting_duplicates(df).collect()] == [("t1", 2, 2)]


def test_conflicts_as_json(make):
    df = make(("a", '{"x":1,"y":2}'), ("a", '{"y": 2, "x": 1}'), ("b", "{}"), ("b", "[]"))
    assert rules.conflicting_duplicates(df).count() == 2
    assert [r.input for r in rules.conflicting_duplicates(df, as_json=True).collect()] == ["b"]


def test_repeated_keys_while_completing(make):
    df = make(("q", '{"a":1,"a":2}'), ("q", "broken"))
    whole = '{"a":1,"a":2,"intent":null,"discovery_results":[]}'
    assert [r.output_json for r in rules.complete_fields(df).orderBy("example_id").collect()] == [whole, "broken"]


def test_digest_borders(make):
    assert rules.exact_duplicates(make(("ab", "c"), ("a", "bc"), ("a", None), ("a", ""))).count() == 0


def test_union_offsets(make):
    rows = rules.union_datasets(a=make(("x", "{}"), ("y", "{}")), b=make(("z", "{}")), c=make(("w", "{}"))).collect()
    assert [(r.source, r.source_id, r.example_id) for r in sorted(rows)] == [
        ("a", 0, 0), ("a", 1, 1), ("b", 0, 2), ("c", 0, 3)]


def test_gate_and_subset(make):
    full = {f: None for f in REQUIRED_FIELDS}
    good, bad = ("fine", out(full)), ("ordered by", "{}")
    assert rules.readiness_gate(make(*[good] * 3)).first().ready is True
    assert rules.readiness_gate(make(good, bad)).first().ready is False
    assert rules.readiness_gate(make()).first().ready is False
    assert [r.example_id for r in rules.clean_subset(make(bad, good, good, good), 2).collect()] == [1, 2]


def test_fixes_make_no_nulls(make):
    import json

    from phrasemill.operators import rules

    raw = json.dumps({"intent": "i", "discovery_results": [
        {"dimensions": ["Country", {"name": "Region"}, {"name": "Year"}], "breakdowns": ["x", {"name": "Region"}],
         "unmatched_intents": ["raw"]},
        {"unmatched_intents": None}, {}, "text"]})
    df = make(("all premium customers", raw))
    out = json.loads(rules.drop_redundant_dimensions(df).first().output_json)["discovery_results"]
    assert out[0]["dimensions"] == ["Country", {"name": "Year"}] and out[3] == "text"
    grown = json.loads(rules.add_business_phrases(df).first().output_json)["discovery_results"]
    new = {"phrase": "premium customers", "type": "business_entity", "reason": "listed business phrase"}
    assert [r["unmatched_intents"] for r in grown[:3]] == [["raw", new], [new], [new]]


def test_lists_and_counts_agree_on_mixed_outputs(make):
    import json

    from phrasemill.operators import audit, flatten, rules

    bad = {"name": "N", "calculation": "Nonsense", "original_phrase": "nowhere"}
    mixed = json.dumps({"intent": "i", "discovery_results": [
        {"measures": [bad, "text", 5, None], "dimensions": ["Country", {"name": "Region", "original_phrase": "elsewhere"}],
         "unmatched_intents": [{"phrase": "p", "type": "odd"}, []]},
        "not a result", {"measures": {"name": "no list"}}]})
    twice = '{"intent":"i","intent":"j","discovery_results":[{"measures":[1],"measures":[{"name":"M","name":"N","calculation":"Bad"}]}]}'
    df = make(("a question", mixed), ("a question", twice))
    counts = rules.with_issue_counts(df).groupBy().sum().first().asDict()
    listed = {
        "invalid_type": rules.invalid_types(df).count(), "calculation": rules.invalid_calculations(df).count(),
        "original_phrase": rules.phrase_mismatch(df).count(), "structure": audit.structure_issues(df).count(),
    }
    assert {k: counts[f"sum(n_{k})"] for k in listed} == listed
    assert listed == {"invalid_type": 1, "calculation": 2, "original_phrase": 2, "structure": 7 + 9 + 9}
    names = [(r.example_id, r.step_no, r.item_no, r.name) for r in flatten.flatten_measures(df).collect()]
    assert sorted(names) == [(0, 0, 0, "N"), (1, 0, 0, "N")]
    skipped = {(r.step_no, r.field, r.item_no) for r in flatten.skipped_elements(df).collect() if r.example_id == 0}
    assert skipped == {(0, "measures", 1), (0, "measures", 2), (0, "measures", 3), (0, "dimensions", 0), (0, "unmatched_intents", 1),
                       (1, "discovery_results", -1)}


def test_original_phrases_come_from_the_question(make):
    item = lambda phrase, calculation=None: {"original_phrase": phrase, "calculation": calculation}
    question = "How many engines of the ferries were built before 1956?"
    df = make((question, out({
        "measures": [item("count", "Count"), item("ferries of engines"), item(None), item("zzz"), item("ENGINES of"), item("")],
        "dimensions": [item("built 1956"), item("Ferries, the"), "text"]})), (None, out({"measures": [item("x")]})), ("", out({"measures": [item("x")]})))
    fixed = rules.fix_original_phrases(df)
    result = first(fixed)["discovery_results"][0]
    assert [m["original_phrase"] for m in result["measures"]] == ["How many", "engines of the ferries", None, "zzz", "ENGINES of", ""]
    assert [d if d == "text" else d["original_phrase"] for d in result["dimensions"]] == ["built before 1956", "the ferries", "text"]
    assert [r.original_phrase for r in rules.phrase_mismatch(fixed).collect() if r.example_id == 0] == ["zzz"]
    before, after = (rules.with_issue_counts(d).orderBy("example_id").first().n_original_phrase for d in (df, fixed))
    assert (before, after) == (5, 1)


def test_split_phrases_are_joined_in_runs_of_any_length(make):
    text = ('{"discovery_results":[{"unmatched_intents":[ {"phrase":"yearly","x":1.0}, {"phrase":"student"}, "s", {"phrase":"enrollment"},'
            '{"phrase":"at"},{"phrase":"affiliation"},{"phrase":"two words"},{"phrase":"type"},{"phrase":null},{} ]}]}')
    want = ('{"discovery_results":[{"unmatched_intents":[ {"phrase":"yearly student","x":1.0}, "s", {"phrase":"enrollment at affiliation"},'
            '{"phrase":"two words"},{"phrase":"type"},{"phrase":null},{} ]}]}')
    df = make(("The Yearly student enrollment at affiliation type two words", text), (None, text), ("other", text))
    rows = rules.merge_split_phrases(df).orderBy("example_id").collect()
    assert [r.output_json for r in rows] == [want, text, text]
    assert rules.split_phrases(rules.merge_split_phrases(df)).count() == 0


def test_steps_of_simple_questions_become_one(make):
    text = ('{"discovery_results": [ {"step_id":"step_1","measures":[{"n":1.0}],"timegrain":null} , "x", {"step_id":"step_2",'
            '"measures":[{"n":1.0},{"n":2}],"timegrain":{"phrase":"d"},"breakdowns":[1],"pattern":null}, {"extra":1.50,"segments":null} ],"n":1 }')
    want = ('{"discovery_results": [ {"step_id":"step_1","measures":[{"n":1.0},{"n":2}],"timegrain":{"phrase":"d"},"breakdowns":[1],'
            '"pattern":null,"extra":1.50,"segments":null} , "x" ],"n":1 }')
    df = make(("plain", text), ("ordered by age", text), ("plain", out({})), ("plain", "broken"))
    fixed = rules.merge_steps(df)
    assert [r.output_json for r in fixed.orderBy("example_id").collect()] == [want, text, out({}), "broken"]
    three = [{"measures": [i, i + 1], "segments": None, f"k{i}": i} for i in range(3)]
    merged = first(rules.merge_steps(make(("plain", out(*three)))))["discovery_results"]
    assert merged == [{"measures": [0, 1, 2, 3], "segments": None, "k0": 0, "k1": 1, "k2": 2}]


def test_drift_is_learned_and_undone(make):
    sub = lambda text: out({"sub_question": text})
    swapped = [(f"How many engines of the Ferries were built before {i} ?", sub(f"How many engines of the tractors were built before {i} ?")) for i in range(8)]
    rare = [("the one", sub("the two"))] * 2
    clean = [("all ferries", sub("all ferries")), ("other words here", sub("words here")), ("budget", sub(None)), (None, sub("x"))]
    df = make(*swapped, *rare, *clean)
    pairs = rules.learn_drift(df)
    assert [tuple(r) for r in pairs.collect()] == [("ferries", "tractors", 8, 9, 8, 888, 12 * 8 * 1000 // (9 * 8))]
    rows = [r.output_json for r in rules.fix_drift(df, pairs).orderBy("example_id").collect()]
    assert rows == [sub(q) for q, _ in swapped] + [o for _, o in [*rare, *clean]]
    assert rules.learn_drift(make()).count() == 0
    assert rules.fix_drift(make(*clean), rules.learn_drift(make())).count() == 4


def test_every_learned_pair_is_undone(spark, make):
    """More pairs than one value of a plan would hold; each row is mended by its own, rare ones too."""
    sub = lambda text: out({"sub_question": text}, {"sub_question": "w1"})
    n = 1500
    df = make(*[(f"Show W{i} now", sub(f"show x{i}, now")) for i in range(n)], ("same w3 now", sub("same x4 now")), (None, sub("x1")))
    pairs = spark.createDataFrame([(f"w{i}", f"x{i}", n - i) for i in range(n)], "in_question string, in_sub_question string, results bigint")
    fixed = rules.fix_drift(df, pairs)
    assert fixed.columns == df.columns
    rows = [r.output_json for r in fixed.orderBy("example_id").collect()]
    assert rows == [sub(f"show W{i}, now") for i in range(n)] + [sub("same x4 now"), sub("x1")]
    assert rules.fix_drift(df.union(df), pairs).count() == 2 * len(rows)


def test_repair_lowers_every_class_it_can(make):
    bad = out({"unmatched_intents": [{"type": "action"}], "measures": [{"original_phrase": "count", "calculation": "Count"}]}, {"extra": 1})
    df = make(("how many cats", bad), ("plain", "{}"))
    row = {r.issue_class: (r.issues_before, r.issues_after) for r in rules.before_after(df, rules.repair).collect()}
    assert row == {r.issue_class: (r.issues_before, r.issues_after) for r in rules.before_after(df, rules.repair(df)).collect()}
    assert {k: after for k, (_, after) in row.items()} == dict.fromkeys(row, 0)
    assert all(row[k][0] > 0 for k in ("structure", "invalid_type", "complexity", "original_phrase"))


def test_what_needs_no_edit_is_not_cut(make):
    """Which texts an edit is asked for: all it could change or cannot read, and no others."""
    item = lambda phrase, **more: {"original_phrase": phrase, "calculation": "Sum", **more}
    whole = out({"sub_question": "all cats", "measures": [item("cats")], "dimensions": [item("zzz")], "breakdowns": [], "unmatched_intents": [{"phrase": "a"}]})
    df = make(
        ("all cats", whole), ("all cats", whole.replace('"cats"', '"the cats"')), ("all cats", whole.replace('"breakdowns": []', '"breakdowns": [1]')),
        ("all cats", whole.replace('{"phrase": "a"}', '{"phrase": "a"}, 7')), ("all cats", whole.replace('[{"sub', '["stray", {"sub')), ("all cats", "broken"),
    )
    some = {}
    edited = rules._edited
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rules, "_edited", lambda rows, fn, when=None, **other: some.update(last=rows.select("example_id", when.alias("w"))) or edited(rows, fn, when, **other))
        for fix, want in ((rules.fix_original_phrases, [1, 4, 5]), (rules.drop_redundant_dimensions, [2, 4, 5]),
                          (rules.merge_split_phrases, [3, 4, 5]), (rules.fix_examples, [0, 1, 2, 3, 4, 5])):
            fix(df)
            assert [r.example_id for r in some["last"].orderBy("example_id").collect() if r.w] == want
        full = out({k: [] if k in rules.LIST_FIELDS else None for k in rules.REQUIRED_FIELDS})
        rules.fix_examples(make(("q", full), ("q", full.replace('"intent"', '"other"')), ("q", full.replace('"segments"', '"s"'))))
        assert [r.w for r in some["last"].orderBy("example_id").collect()] == [False, True, True]
        spelled = out({"sub_question": "all cats"})
        rules.fix_sub_questions(make(("all cats", spelled), ("all cats", spelled.replace("all c", "all\\u0020c")), ("5", out({"sub_question": 5})), ("all dogs", spelled)))
        assert [r.w for r in some["last"].orderBy("example_id").collect()] == [False, True, True, True]


def test_conflicts_among_questions_of_one_template(make):
    def output(name, value, sub):
        return out({"sub_question": sub, "measures": [{"name": name}], "dimensions": [{"name": "Region", "filter_value": value}, "x"]})

    df = make(
        ("Sales of North in 2023 for 'A b'", output("Total", "North", "Sales of North in 2023 for 'A b'")),
        ("Sales of South in 2,024.5 for 'c'", output("Total", "South", "Sales of South in 2,024.5 for 'c'")),
        ('Sales of West in 7 for "d e"', output("Total", "West", 'Sales of West in 7 for "d e"')),
        ("Sales of East in 9 for 'q'", output("Average", "East", "Sales of East in 9 for 'q'")),
        ("Other 1", "{}"), ("Other 2", "{}"), (None, "{}"), ("Other 3", None), ("one", "{}"), ("one", "[]"),
    )
    rows = sorted(rules.conflicting_templates(df).collect())
    assert [tuple(r) for r in rows] == [
        ("Other <n>", 4, 3, 2), ("Sales of <v> in <n> for <q>", 0, 4, 2), ("one", 8, 2, 2)]


def test_a_hot_template(make):
    df = make(*[(f"batch {i}", "{}") for i in range(400)], *[(f"batch {i}", "[]") for i in range(5)])
    assert [tuple(r) for r in rules.conflicting_templates(df).collect()] == [("batch <n>", 0, 405, 2)]


def test_both_versions_are_counted_in_one_scan(spark, tmp_path):
    path = str(tmp_path / "ex")
    spark.createDataFrame([(0, "q", "{}")], "example_id bigint, input string, output_json string").write.parquet(path)
    plan = rules.before_after(spark.read.parquet(path), rules.fix_examples)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_drift_reads_the_question_once(make):
    df = convert.convert_question(make(("how many departments", '{"discovery_results":[{"sub_question":"how many publishers"}]}')))
    query = rules.learn_drift(df, support=1, confidence=1)
    assert query.count() >= 0
    plan = query._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = [line for line in plan if "Filter " in line]
    assert filters and not any("RLIKE" in line for line in filters)  # no filter repeats the rewriting
    counts = {line[line.index("Aggregate ") :].split("[")[1].count("#") for line in plan if "Aggregate " in line}
    assert counts == {2}  # grouped by the two words alone, so all uses share one exchange


def test_phrases_read_an_example_once(make):
    from phrasemill.plans.queries import _phrases

    df = make(("q", out({"measures": [{"original_phrase": "a"}, 3, {}], "dimensions": [None, {"original_phrase": "b"}]}, {"dimensions": None})))
    rows = sorted((r.step_no, r.kind, r.item_no, r.original_phrase) for r in _phrases(df).collect())
    assert rows == [(0, "dimension", 1, "b"), (0, "measure", 0, "a"), (0, "measure", 2, None)]
    assert _phrases(df)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
