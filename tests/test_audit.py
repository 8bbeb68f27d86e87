import json

import pytest

from phrasemill.operators import audit
from phrasemill.schemas import REQUIRED_FIELDS

FULL = {f: None for f in REQUIRED_FIELDS} | {"step_id": "step_1"}


def out(*results, **top):
    return json.dumps({"intent": "i", "discovery_results": list(results)} | top)


def test_empty_dataset(make):
    empty = make()
    assert audit.validity_rate(empty).first().validity_rate is None
    assert audit.complexity_summary(empty).first().complexity_ratio is None
    assert audit.quality_report(empty).first().total_examples == 0
    assert audit.top_terms(empty).count() == 0


def test_null_is_present_and_absent_is_not(make):
    df = make(
        ("q", out(FULL)),
        ("q", json.dumps({"discovery_results": []})),
        ("q", json.dumps({"intent": None})),
        ("q", json.dumps({"intent": None, "discovery_results": None})),
        ("q", out({k: v for k, v in FULL.items() if k not in ("pattern", "segments")})),
    )
    issues = [r.issue for r in audit.structure_issues(df).orderBy("example_id", "step_no", "field_no").collect()]
    assert issues == [
        "Example 1: Missing intent field", "Example 2: Missing discovery_results",
        "Example 4, Result 0: Missing pattern", "Example 4, Result 0: Missing segments",
    ]
    assert audit.validity_rate(df).first().valid_outputs == 3


def test_presence_survives_values_of_another_shape(make):
    df = make(
        ("q", '{"intent":"i","discovery_results":[{"measures":[{"name":"A","name":"B"}]}]}'),
        ("q", '{"intent":"i","discovery_results":{"a":1}}'),
    )
    assert audit.validity_rate(df).first().valid_outputs == 2
    assert audit.structure_issues_top(df).count() == 0


def test_steps_count_results_and_ignore_others(make):
    df = make(("q", out({"step_id": "step_1"}, {"step_id": "step_2"}, {"step_id": "step_9"}, {})))
    assert {r.step_id: r.results for r in audit.step_distribution(df).collect()} == {
        "step_1": 1, "step_2": 1, "step_3": 0}
    row = audit.complexity_summary(df).first()
    assert (row.complex_questions, row.complexity_ratio) == (1, 1.0)


def test_ties_follow_the_list(make):
    df = make(("ads and users", "{}"), ("Users and ADS", "{}"))
    assert [r.term for r in audit.top_terms(df).collect()] == ["users", "ads"]


def test_long_and_short_lists_agree(make):
    df = make(("ads and users", "{}"), ("users", "{}"), ("none", "{}"))
    terms = audit.BI_TERMS
    long = terms + tuple(f"zz{i}" for i in range(100))
    short = {(r.term, r.questions) for r in audit.term_counts(df, terms).collect()}
    assert short == {(r.term, r.questions) for r in audit.term_counts(df, long).collect() if r.term in terms}


def test_residual_takes_the_first_listed_term(make):
    df = make(("movies about schools", "{}"), ("fine", "{}"))
    assert [(r.example_id, r.term) for r in audit.residual_terms(df).collect()] == [(0, "schools")]


@pytest.mark.parametrize("text, there", [
    ('{"x": "DEPARTMENTS"}', True), ('{"departments": 1}', True), ('{"x": "\\u0064epartments"}', True),
    ('{"x": "department"}', False), (None, False),
])
def test_dataset_flag(make, text, there):
    assert audit.dataset_term_flag(make(("q", text))).first().term_present is there


def test_score_and_verdict(make):
    df = make(*[("show users", out(FULL))] * 4)
    row = audit.quality_score(df).first()
    assert (row.volume_points, row.complexity_points, row.term_points, row.validity_points, row.issue_points) == (
        0, 10, 0, 20, 20)
    assert audit.quality_verdict(df).first().verdict == "needs work"


def test_report_is_one_nested_row(make):
    row = audit.quality_report(make(("show top users", out(FULL)))).first()
    assert row.terms_coverage.most_common_terms[0].term == "users"
    assert len(row.terms_coverage.terms_with_zero_usage) == 36
    assert (row.question_patterns.show, row.question_patterns.top) == (1, 1)


def test_issue_sample_counts_the_rest(make):
    sample = audit.issue_sample(make(*[("q", "{}")] * 8)).collect()
    assert len(sample) == 5 and {r.remaining for r in sample} == {3}
