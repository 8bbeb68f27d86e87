import json

import pytest
from pyspark.sql import functions as F

from phrasemill.operators.convert import convert_examples
from phrasemill.plans import jobs
from phrasemill.sources import examples as files
from phrasemill.sources import text

DATA = [{"input": f"q {i} \"ü\"", "output": {"intent": "x", "n": [i, {"k": None}]}, "other": 1} for i in range(300)]


def stored(path, layout):
    if layout == "lines":
        path.write_text("".join(json.dumps(d) + "\n\n" for d in DATA))
    elif layout == "array":
        path.write_text(json.dumps(DATA))
    elif layout == "pretty_array":
        path.write_text(json.dumps(DATA, indent=2))
    else:
        path.write_text("\n".join(json.dumps(d, indent=2) for d in DATA))


@pytest.mark.parametrize("layout", ["lines", "array", "pretty_array", "objects"])
def test_layouts(spark, tmp_path, layout):
    stored(tmp_path / "d.json", layout)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = sorted(files.read_examples(spark, str(tmp_path / "d.json"), layout).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.example_id for r in rows] == list(range(300))
    assert [r.input for r in rows] == [d["input"] for d in DATA]
    assert [json.loads(r.output_json) for r in rows] == [d["output"] for d in DATA]


def test_objects_with_commas_between(spark, tmp_path):
    body = ",\n\n".join(json.dumps(d, indent=2) for d in DATA[:5])
    (tmp_path / "d.json").write_text("[" + body + "\n]\n")
    rows = files.repair_concat_json(spark, str(tmp_path / "d.json"))
    assert rows.filter("problem IS NULL").count() == 5 == rows.count()


@pytest.mark.parametrize("layout", ["pretty_array", "objects"])
def test_positions_run_on_over_files(spark, tmp_path, layout):
    for name, part in (("a", DATA[:3]), ("b", DATA[3:7]), ("c", DATA[7:9])):
        body = json.dumps(part, indent=2) if layout == "pretty_array" else "\n".join(
            json.dumps(d, indent=2) for d in part)
        (tmp_path / f"{name}.json").write_text(body + "\n")
    for dense in (True, False):
        rows = sorted(files.read_examples(spark, str(tmp_path), layout, dense).collect())
        assert [r.input for r in rows] == [d["input"] for d in DATA[:9]] or not dense
        assert {r.input for r in rows} == {d["input"] for d in DATA[:9]}
        assert [r.example_id for r in rows] == list(range(9)) or not dense


def test_rejects(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '{"input":"a","output":{}}\nbroken\n{"output":{}}\n{"input":"b"}\n{"input":"c","output":{"k":1}}\n')
    good = files.read_examples(spark, str(tmp_path / "d.json"))
    assert [(r.example_id, r.input) for r in sorted(good.collect())] == [(0, "a"), (4, "c")]
    bad = files.rejected_examples(spark, str(tmp_path / "d.json"))
    assert [(r.example_id, r.problem) for r in sorted(bad.collect())] == [
        (1, "not a JSON object"), (2, "no input"), (3, "no output")]


def test_ids_without_counting_keep_the_order(spark, tmp_path):
    stored(tmp_path / "d.json", "lines")
    rows = sorted(files.read_examples(spark, str(tmp_path / "d.json"), dense=False).collect())
    assert [r.input for r in rows] == [d["input"] for d in DATA]


@pytest.mark.parametrize("format", ["json", "parquet"])
def test_round_trip(spark, make, tmp_path, format):
    df = convert_examples(make(("List dogs", '{"intent":"é\\"","discovery_results":[]}'), ("a\nb", "{}")))
    files.write_examples(df, str(tmp_path / "out"), format, ordered=True)
    back = (files.read_examples(spark, str(tmp_path / "out")) if format == "json"
            else spark.read.parquet(str(tmp_path / "out")))
    assert sorted(back.collect()) == sorted(df.collect())


def test_context(spark, tmp_path):
    folder = tmp_path / "model"
    folder.mkdir()
    (folder / "b.json").write_text('{"b": 1}\n')
    (folder / "a.json").write_text('{"a":\n 1}')
    (folder / "note.txt").write_text("no")
    row = text.load_context(spark, str(folder)).first()
    assert row.context == '\n\n[a.json]\n{"a":\n 1}\n\n[b.json]\n{"b": 1}\n'
    assert row.context_chars == len(row.context)
    with pytest.raises(ValueError):
        text.load_context(spark, str(folder), max_bytes=10)


def test_missing_context(spark, tmp_path):
    assert text.load_context(spark, str(tmp_path / "none")).first().context == ""
    with pytest.raises(Exception):
        text.load_context(spark, str(tmp_path / "none"), missing_ok=False).collect()


def test_template(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb")
    assert tuple(text.load_template(spark, str(tmp_path / "t.txt")).first()) == ("a\nb", 3)


def test_jobs(spark, tmp_path):
    stored(tmp_path / "d.json", "pretty_array")
    jobs.convert_dataset(spark, str(tmp_path / "d.json"), str(tmp_path / "out"), "pretty_array")
    back = sorted(files.read_examples(spark, str(tmp_path / "out")).collect())
    assert [r.input for r in back] == [d["input"] for d in DATA]
    jobs.audit_dataset(spark, str(tmp_path / "out"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().total_examples == 300
    (tmp_path / "old.txt").write_text("1. a\n")
    (tmp_path / "new.txt").write_text("1. b\nc\n")
    jobs.merge_question_files(
        spark, str(tmp_path / "old.txt"), str(tmp_path / "new.txt"), str(tmp_path / "all"))
    assert [r.line for r in sorted(text.read_raw_lines(spark, str(tmp_path / "all")).collect())] == [
        "1. a", "61. b", "62. c"]


def test_nothing_is_lost_on_writing(spark, tmp_path):
    from phrasemill.sources import examples as files

    rows = [(0, "a", '{\n "x": 1,\r\n "y": [1,\n2]}'), (1, "b", None), (2, "c", "not json"), (3, None, "{}"), (4, "line\nbreak", "[]"),
            (5, "d", "{} {}")]
    df = spark.createDataFrame(rows, "example_id bigint, input string, output_json string")
    path = str(tmp_path / "out")
    files.write_examples(df, path, ordered=True)
    good = {r.input: r.output_json for r in files.read_examples(spark, path).collect()}
    assert set(good) == {"a", "line\nbreak"} and "".join(good["a"].split()) == '{"x":1,"y":[1,2]}'
    aside = {r.example_id: (r.input, r.output_json, r.problem) for r in files.unwritten_examples(spark, path).collect()}
    assert aside == {1: ("b", None, "no output"), 2: ("c", "not json", "output is not JSON"), 3: (None, "{}", "no input"),
                     5: ("d", "{} {}", "output is not JSON")}
    assert files.rejected_examples(spark, path).count() == 0
    files.write_examples(df.where("example_id = 4"), path + "2")
    assert files.unwritten_examples(spark, path + "2").count() == 0


def test_ordered_writing_checks_a_record_once_and_puts_rejects_aside(spark, tmp_path):
    rows = [(i, None if i % 10 == 3 else f"q{i}", "{" if i % 10 == 7 else "{}") for i in range(400)][::-1]
    checks = spark.sparkContext.accumulator(0)
    known = files.write_problem

    def counted(question, output):
        def count(values):
            checks.add(len(values))
            return values

        return known(F.pandas_udf(count, "string")(question), output)

    df = spark.createDataFrame(rows, "example_id bigint, input string, output_json string").repartition(5)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(files, "write_problem", counted)
        files.write_examples(df.where("input is not null and output_json <> '{'"), str(tmp_path / "good"), ordered=True)
    assert checks.value == 320
    files.write_examples(df, str(tmp_path / "all"), ordered=True)
    parts = sorted((tmp_path / "all").glob("part-*"))
    lines = "".join(f.read_text() for f in parts).splitlines()
    assert [json.loads(line)["input"] for line in lines] == [r[1] for r in rows[::-1] if r[1] and r[2] == "{}"]
    assert files.unwritten_examples(spark, str(tmp_path / "all")).count() == 80
