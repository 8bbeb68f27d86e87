"""Edits of raw JSON text: what is not edited stays byte for byte."""

import json
import random

import pytest
from pyspark.sql import functions as F

from phrasemill.functions import splice
from phrasemill.operators import convert, rules


def apply(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.o for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def value(rng, depth):
    kind = rng.randrange(8 if depth else 5)
    if kind == 0:
        return rng.choice(["1", "-0.10", "1e5", "123456789012345678901234567890", "1.0", "true", "null"])
    if kind < 5:
        return rng.choice(['"x"', '""', '"{}[],:"', r'"a\\"', r'"\"q\""', '"caf\u00e9 日本"', r'"\u0041\n"'])
    space = lambda: rng.choice(["", " ", "\n  ", "\t"])
    if kind == 5:
        return "[" + space() + ("," + space()).join(value(rng, depth - 1) + space() for _ in range(rng.randrange(4))) + "]"
    keys = ['"a"', '"b"', r'"\u0061"', '"c d"', '"a"', '""']
    members = [rng.choice(keys) + space() + ":" + space() + value(rng, depth - 1) + space() for _ in range(rng.randrange(5))]
    return "{" + space() + ("," + space()).join(members) + "}"


def test_random_texts_stay_unless_edited(spark):
    rng = random.Random(5)
    texts = [value(rng, 5) for _ in range(400)]
    texts = [rng.choice(["", " "]) + t + rng.choice(["", "\n"]) for t in texts]
    objects = [t for t in texts if t.strip().startswith("{")]
    assert len(objects) > 60
    same = apply(spark, texts, lambda c: splice.edit_members(c, {"a": lambda raw: raw}))
    assert same == texts
    edited = apply(spark, objects, lambda c: splice.edit_members(c, {"a": lambda _: F.lit('"new"')}, {"a": "0", "z": "[1]"}))
    for before, after in zip(objects, edited, strict=True):
        want = json.loads(before)
        want = want | {"a": "new" if "a" in want else 0, "z": [1]}
        assert json.loads(after) == want


def test_arrays(spark):
    texts = ["[]", "[ ]", "[1]", '[{"a":1}]', '[ {"a":1} , 2,"{}", {"b":2} ]', "{}", "null", '"[]"']
    grown = apply(spark, texts, lambda c: splice.edit_elements(c, more=F.array(F.lit("7"), F.lit("8"))))
    assert grown == ["[7,8]", "[7,8 ]", "[1,7,8]", '[{"a":1},7,8]', '[ {"a":1} , 2,"{}", {"b":2},7,8 ]', "{}", "null", '"[]"']
    left = apply(spark, texts, lambda c: splice.edit_elements(c, keep=lambda v: ~v.startswith("{")))
    assert left == ["[]", "[ ]", "[1]", "[]", '[ 2,"{}" ]', "{}", "null", '"[]"']
    first = apply(spark, texts, lambda c: splice.edit_elements(c, lambda v: F.lit("{}"), only_first=True))
    assert first[3:5] == ["[{}]", '[ {} , 2,"{}", {"b":2} ]']


def test_depth_and_length(spark):
    nested = lambda n: '{"a":' + "[" * n + "]" * n + "}"
    long = '{"a":"' + 'x\\"' * 100_000 + '","b":[' + ",".join(['{"x":1}'] * 20_000) + "]}"
    texts = [nested(splice.DEPTH), nested(splice.DEPTH + 1), long]
    out = apply(spark, texts, lambda c: splice.edit_members(c, {"b": lambda raw: splice.edit_elements(raw, lambda _: F.lit("{}"))}, {"c": "1"}))
    assert out[0] == texts[0][:-1] + ',"c":1}' and out[1] == texts[1]
    assert out[2] == long.replace('{"x":1}', "{}")[:-1] + ',"c":1}'
    assert apply(spark, texts, splice.is_editable) == [True, False, True]


@pytest.mark.parametrize("fix", [
    convert.convert_output, rules.fix_types, rules.complete_fields, rules.fix_examples, rules.fix_count_names, rules.reclassify_unknown,
    rules.drop_redundant_dimensions, rules.fix_sub_questions, rules.fix_timeframes, rules.add_business_phrases,
])
def test_every_fix_keeps_spelling_and_order(make, fix):
    """An output that needs every fix: all but the edited values stays in place."""
    text = ('{ "z" : 123456789012345678901234567890123456789012, "discovery_results":[ {"weight":1.0,"measures":[{"n":0.10,"name":"Sum",'
            '"calculation":"Count"}], "dimensions":[{"name":"Region"},{"name":"Premium Customers"}],"breakdowns":[{"name":"Region"}],'
            '"unmatched_intents":[{"type":"action"},{"phrase":"revenue","type":"unknown_term"}] } ],"z":1e5 }')
    after = fix(make(("premium customers in Q3 2024", text))).first().output_json
    assert after != text
    # removing what a fix may write gives subsequences of the text
    rest = iter(after)
    kept = sum(1 for c in text if any(c == d for d in rest))
    assert '"z" : 123456789012345678901234567890123456789012' in after and '"weight":1.0' in after and '"z":1e5' in after
    assert after.index('"z" :') < after.index('"weight"') < after.index('"z":1e5') and kept


def test_an_edit_cuts_a_text_once(spark):
    df = spark.createDataFrame([('{"a":[1]}',)], "t string")
    plan = df.select(splice.edit_members(F.col("t"), {"a": lambda _: F.lit("2")}).alias("o"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1


def test_a_closing_ends_a_text(spark):
    texts = ['{"a":1', '{"a":1}}', '{"a":1} x', '{"a":1,}', '}', '{', ' { } ', ' {"a":1} ', '{"b":[1}', '{"a":{"a":1}']
    edited = apply(spark, texts, lambda c: splice.edit_members(c, {"a": lambda _: F.lit("2")}))
    assert edited == [' {"a":2} ' if t == ' {"a":1} ' else t for t in texts]
    lists = ["[1", "[1]]", "[1] x", "[1,]", "]", "[", "[ ]", "[1 ]"]
    grown = apply(spark, lists, lambda c: splice.edit_elements(c, more=F.array(F.lit("7"))))
    assert grown == [*lists[:6], "[7 ]", "[1,7 ]"]
