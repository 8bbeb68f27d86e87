import json

import pytest

from phrasemill import fixtures as fx
from phrasemill.operators import annotate
from phrasemill.plans import jobs

SF = "/root/testdata/sf0.001"
TEMPLATE = f"Q: {annotate.QUESTION_MARK} C: {annotate.CONTEXT_MARK}"


def test_marks_inside_a_question(make):
    df = make((f"a {annotate.CONTEXT_MARK}", "{}"), (f"b {annotate.QUESTION_MARK}", "{}"))
    rows = sorted(annotate.render_prompt(df, TEMPLATE, "ctx").collect())
    assert rows[0].prompt == "Q: a ctx C: ctx"
    assert rows[1].prompt == f"Q: b {annotate.QUESTION_MARK} C: ctx"
    assert annotate.render_prompt(df, TEMPLATE).orderBy("example_id").first().prompt.endswith(annotate.CONTEXT_MARK)


def test_empty_template(make):
    with pytest.raises(ValueError):
        annotate.render_prompt(make(("a", "{}")), "")


def test_request_json(make):
    row = annotate.request_rows(make(('say "hi"', "{}")), TEMPLATE, "c").first()
    request = json.loads(row.request_json)
    assert request["messages"][1] == {"role": "user", "content": 'Q: say "hi" C: c'}
    assert request["response_format"] == {"type": "json_object"}
    plain = json.loads(annotate.request_rows(make(("a", "{}")), TEMPLATE, "c", annotate.INTERACTIVE).first().request_json)
    assert "response_format" not in plain and plain["max_tokens"] == 1024


@pytest.mark.parametrize("start, end", [(0, None), (3, 7), (5, 100), (8, 3), (-3, None), (0, -2), (-6, -2), (-100, 2)])
def test_slices_are_list_slices(make, start, end):
    df = make(*[(str(i), "{}") for i in range(10)])
    got = [r.example_id for r in sorted(annotate.slice_range(df, start, end).collect())]
    assert got == list(range(10))[start:end]


def test_batches_begin_at_the_slice(make):
    df = annotate.slice_range(make(*[(str(i), "{}") for i in range(10)]), 3)
    rows = sorted(annotate.assign_batches(df, 5, start=3).collect())
    assert [r.batch_no for r in rows] == [0, 0, 0, 0, 0, 1, 1]


def test_outcomes_of_derived_responses(spark):
    made = annotate.annotated_dataset(fx.examples(spark, SF), fx.responses(spark, SF))
    counts = {r.provenance: r["count"] for r in made.groupBy("provenance").count().collect()}
    assert counts == {"model": 600, "skeleton": 200, "original": 200}


def responses(spark, *rows):
    return spark.createDataFrame(rows, "example_id bigint, attempt int, content string, error string")


def test_last_attempt_decides(spark, make):
    df = make(("a", '{"o":0}'), ("b", '{"o":1}'), ("c", '{"o":2}'), ("d", '{"o":3}'), ("e", '{"o":4}'))
    r = responses(
        spark,
        (0, 0, "{", None), (0, 1, '{"first":1}', None), (0, 2, '{"later":1}', None),
        (1, 0, "{", None), (1, 1, "{", None), (1, 2, None, "down"),
        (2, 0, None, "down"), (2, 1, None, "down"), (2, 2, "x", None),
        (3, 0, None, None), (3, 1, None, None), (3, 2, None, None), (3, 3, "{}", None),
    )
    rows = sorted(annotate.annotated_dataset(df, r).collect())
    assert [x.provenance for x in rows] == ["model", "original", "skeleton", "original", "original"]
    assert rows[0].output_json == '{"first":1}' and rows[1].output_json == '{"o":1}'
    skeleton = json.loads(rows[2].output_json)["discovery_results"][0]
    assert skeleton["sub_question"] == "c" and skeleton["timegrain"] is None and skeleton["segments"] == []
    assert len(skeleton) == 10


def test_schedule(spark):
    r = responses(spark, (0, 0, None, "x"), (0, 1, "{", None), (0, 2, None, "x"), (1, 0, "{}", None), (1, 1, None, "x"))
    got = {(x.example_id, x.attempt): x.delay_seconds for x in annotate.retry_schedule(r).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.0, (0, 2): 0.0, (1, 0): 0.0}


def test_summary(spark):
    r = spark.createDataFrame(
        [(0, '{"intent":"x","discovery_results":[{},{}]}'), (1, "{}"), (2, '{"intent":null}'), (3, "[1]")],
        "example_id bigint, output_json string")
    got = [(x.intent, x.steps) for x in sorted(annotate.annotation_summary(r).collect())]
    assert got == [("x", 2), ("N/A", None), (None, None), ("N/A", None)]


def test_model_attempts(spark, make):
    def model(prompts, attempt):
        if any("boom" in p for p in prompts):
            raise RuntimeError("boom")
        return [None if "none" in p else ("{}" if attempt >= int(p) else "{") for p in prompts]

    df = make(("0", "{}"), ("1", "{}"), ("2", "{}"), ("3", "{}"), ("none", "{}"), ("boom", "{}"))
    prompts = annotate.render_prompt(df, annotate.QUESTION_MARK)
    made = annotate.annotate_batches(prompts, model, batch_size=1)
    tries = {}
    for r in sorted(made.collect()):
        tries.setdefault(r.example_id, []).append(r.error or r.content)
    assert tries == {
        0: ["{}"], 1: ["{", "{}"], 2: ["{", "{", "{}"], 3: ["{", "{", "{"],
        4: ["empty answer"] * 3, 5: ["boom"] * 3}


def test_annotate_dataset(spark, tmp_path):
    rows = [{"input": str(i), "output": {"old": i}} for i in range(12)]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "t.txt").write_text(TEMPLATE)
    (tmp_path / "ctx").mkdir()
    (tmp_path / "ctx" / "m.json").write_text("{}")

    def model(prompts, attempt):
        return ['{"intent":"new","discovery_results":[]}' if "[m.json]" in p else "" for p in prompts]

    summary = jobs.annotate_dataset(
        spark, str(tmp_path / "d.json"), str(tmp_path / "t.txt"), str(tmp_path / "ctx"), model,
        str(tmp_path / "r"), str(tmp_path / "out"), start=2, end=8, batch_size=5)
    assert [(r.example_id, r.intent, r.steps) for r in sorted(summary.collect())] == [(i, "new", 0) for i in range(2, 8)]


def test_a_rerun_asks_only_for_what_is_open(spark, tmp_path):
    rows = [{"input": f"question {i}", "output": {}} for i in range(20)]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "t.txt").write_text(TEMPLATE)
    (tmp_path / "calls").mkdir()
    calls, broken = str(tmp_path / "calls"), str(tmp_path / "broken")
    (tmp_path / "broken").write_text("x")

    def model(prompts, attempt):
        import os
        import uuid

        if any("question 13" in p for p in prompts) and os.path.exists(broken):
            os._exit(1)  # the worker dies, so the step fails whatever the operator catches
        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(p[-20:].replace("\n", " ") for p in prompts))
        return ['{"intent":"new","discovery_results":[]}'] * len(prompts)

    def job(target):
        return jobs.annotate_dataset(
            spark, str(tmp_path / "d.json"), str(tmp_path / "t.txt"), str(tmp_path / "none"), model,
            str(tmp_path / "r"), str(tmp_path / target), batch_size=2, parallelism=2, commit_every=10)

    def asked():
        return sum(len(f.read_text().splitlines()) for f in (tmp_path / "calls").iterdir())

    with pytest.raises(Exception):
        job("out1")
    stored = jobs.answers(spark, str(tmp_path / "r"))
    assert stored.count() == 10 and jobs.open_steps(spark, str(tmp_path / "r")) == [1]
    (tmp_path / "broken").unlink()
    (tmp_path / "d.json").write_text("not read again")
    before = asked()
    summary = job("out2").collect()
    assert asked() - before == 10 and sorted(r.example_id for r in summary) == list(range(20))
    assert jobs.open_steps(spark, str(tmp_path / "r")) == []
    before = asked()
    assert jobs.annotate_steps(spark, str(tmp_path / "r"), model, TEMPLATE) == 0 and asked() == before


def test_a_store_is_for_one_slice_and_is_written_whole(spark, tmp_path):
    rows = [{"input": f"question {i}", "output": {}} for i in range(30)]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)))
    source, store = str(tmp_path / "d.json"), str(tmp_path / "s")
    # left behind by a run that died before its examples were complete
    spark.createDataFrame([(99, "old", "{}", 7)], "example_id bigint, input string, output_json string, step bigint").write.partitionBy(
        "step").parquet(f"{store}/examples")
    jobs.prepare_steps(spark, source, store, 5, 25, commit_every=10)
    assert jobs.open_steps(spark, store) == [0, 1, 2]
    jobs.prepare_steps(spark, source, store, 5, 25, commit_every=10)
    with pytest.raises(ValueError, match="was made for"):
        jobs.prepare_steps(spark, source, store, 0, 25, commit_every=10)
    model = lambda prompts, attempt: ["{}"] * len(prompts)
    assert jobs.annotate_steps(spark, store, model, TEMPLATE, max_steps=2) == 1
    got = {r.example_id: r.provenance for r in jobs.annotated(spark, store).collect()}
    assert got == {i: "model" if i < 20 else "original" for i in range(5, 25)}
    assert jobs.annotate_steps(spark, store, model, TEMPLATE, max_steps=2) == 0
    plan = spark.read.parquet(f"{store}/answers").where("step = 2")
    assert sorted(r.example_id for r in plan.collect()) == list(range(20, 25))
