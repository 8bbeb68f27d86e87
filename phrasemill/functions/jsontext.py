"""JSON text helpers: strict validity, key presence, reading level by level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false"}


def is_strict_json(text: Column) -> Column:
    """True for exactly one JSON value with nothing behind it.

    ``from_json`` stops after the first value, so the text is wrapped twice: inside an array
    (rejects trailing garbage) and inside an object (rejects ``1],[2``, which would close
    the array).
    """
    one = F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT))
    pair = F.size(
        F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>", _STRICT)
    )
    return F.coalesce((one == 1) & (pair == 1), F.lit(False))


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and no white space, or the text itself if it is not JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def is_object(text: Column) -> Column:
    """Whether a text is one JSON object; false for NULL."""
    return F.json_object_keys(text).isNotNull()


def has_key(text: Column, key: str) -> Column:
    """Whether an object's text has a key, whatever its value; false if it is no object."""
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))


def result_texts(output_json: Column) -> Column:
    """Every element of ``discovery_results`` as its own text, objects or not; NULL without a list.

    Reading level by level keeps what a typed parse of the whole would lose: an element of another
    kind voids nothing but itself, and of a repeated key the last value counts.
    """
    return F.from_json(output_json, "struct<discovery_results:array<string>>")["discovery_results"]


def typed_items(texts: Column, kind: str) -> Column:
    """The elements of a list of texts as structs, NULL where an element is no object."""
    return F.transform(texts, lambda t: F.when(is_object(t), F.from_json(t, kind)))
