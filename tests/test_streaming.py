import json

import pytest

from phrasemill import fixtures as fx
from phrasemill.operators.convert import convert_examples
from phrasemill.streaming.incremental import (
    converted_lines, example_stream, incremental_convert, incremental_convert_lines, line_stream, rejected_lines,
)

SF = "/root/testdata/sf0.001"


def test_resumed_stream_equals_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    ex = fx.examples(spark, SF)
    for low, high in ((0, 400), (400, 1000)):
        ex.filter(f"example_id >= {low} AND example_id < {high}").write.mode("append").parquet(source)
        incremental_convert(example_stream(spark, source, files_per_batch=3), out, state).awaitTermination()
    again = incremental_convert(example_stream(spark, source), out, state)
    again.awaitTermination()
    assert sorted(spark.read.parquet(out).collect()) == sorted(convert_examples(ex).collect())


def test_a_batch_that_is_run_again_is_not_doubled(spark, tmp_path):
    """The job dies after a batch is written and before the stream has committed it."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    good = [json.dumps({"input": f"List dogs {i}", "output": {"n": i}}) for i in range(40)]
    bad = [f"broken {i}" for i in range(10)]
    for k in range(5):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(good[k::5] + bad[k::5] + ["", "  "]) + "\n")

    def dies(number):
        if number == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        incremental_convert_lines(line_stream(spark, source, 2), out, state, then=dies).awaitTermination()
    assert {r.batch for r in converted_lines(spark, out).collect()} == {0, 1}
    for _ in range(2):
        incremental_convert_lines(line_stream(spark, source, 2), out, state).awaitTermination()
    rows = converted_lines(spark, out).collect()
    assert sorted(json.loads(r.output_json)["n"] for r in rows) == list(range(40))
    assert len({(r.batch, r.example_id) for r in rows}) == 40
    assert sorted((r.problem, r.record) for r in rejected_lines(spark, out).collect()) == sorted(("not a JSON object", b) for b in bad)
