import json

import pytest
from pyspark.sql import functions as F

from phrasemill.functions.jsontext import canonical, is_strict_json

PROBES = [
    "{}", "[]", "[1]", '"x"', "1", "-1.5e3", "true", "null", ' {"a": 1} ', '{"a":{"b":[1,{"c":null}]}}',
    '{"a":1,"a":2}', '{"a":"\\u00e9"}', "", " ", "{", "[1,", '{"a":1', '{"a":1} x', '{"a":1}{"b":2}',
    "1],[2", "{'a':1}", "'x'", "not json", '{"a":}', "[1 2]", '{a:1}', "tru", '"x', '{"a":1}}', "[1]]", ",", "1,2",
]


def accepted(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def test_strictness_equals_python(spark):
    df = spark.createDataFrame([(p,) for p in PROBES], "s string")
    got = {r.s: r.ok for r in df.select("s", is_strict_json(F.col("s")).alias("ok")).collect()}
    assert got == {p: accepted(p) for p in PROBES}


@pytest.mark.parametrize("text, want", [
    ('{"b": 1, "a": [ {"d":2, "c":1} ]}', '{"a":[{"c":1,"d":2}],"b":1}'), ("no json", "no json"),
])
def test_canonical(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(canonical(F.col("s")).alias("c")).first().c == want
