"""Shapes of the data: example rows, parsed outputs and the required-field lists."""

from __future__ import annotations

# The field names of one discovery result, in checking order.
REQUIRED_FIELDS = (
    "step_id", "sub_question", "measures", "dimensions", "timegrain",
    "timeframe", "pattern", "segments", "breakdowns", "unmatched_intents",
)
LIST_FIELDS = ("measures", "dimensions", "segments", "breakdowns", "unmatched_intents")

MEASURE = "struct<name:string,calculation:string,original_phrase:string>"
DIMENSION = "struct<name:string,filter_value:string,original_phrase:string>"
UNMATCHED = "struct<phrase:string,type:string,reason:string>"

# Typed shape of each required field. Elements of segments and breakdowns are kept as
# their own JSON text.
FIELD_TYPES = {
    "step_id": "string",
    "sub_question": "string",
    "measures": f"array<{MEASURE}>",
    "dimensions": f"array<{DIMENSION}>",
    "timegrain": "struct<phrase:string>",
    "timeframe": "struct<phrase:string>",
    "pattern": "array<struct<name:string,phrase:string>>",
    "segments": "array<string>",
    "breakdowns": "array<string>",
    "unmatched_intents": f"array<{UNMATCHED}>",
}

# Fields whose elements are objects, read one by one.
ITEM_TYPES = {
    "measures": MEASURE, "dimensions": DIMENSION, "pattern": "struct<name:string,phrase:string>",
    "unmatched_intents": UNMATCHED,
}

EXAMPLE = "example_id bigint, input string, output_json string"
RESPONSE = "example_id bigint, attempt int, content string, error string"


def steps_type(*fields: str) -> str:
    """Type of an output that holds only ``fields`` of every result: parse what is read."""
    names = fields or REQUIRED_FIELDS
    inner = ",".join(f"{name}:{FIELD_TYPES[name]}" for name in names)
    return f"struct<discovery_results:array<struct<{inner}>>>"


def result_type(*fields: str) -> str:
    """Type of one result that holds only ``fields``, elements of lists still as texts."""
    kinds = {f: "array<string>" if FIELD_TYPES[f].startswith("array<") else FIELD_TYPES[f] for f in fields or REQUIRED_FIELDS}
    return "struct<" + ",".join(f"{f}:{kind}" for f, kind in kinds.items()) + ">"


def output_type() -> str:
    """Type of a whole output."""
    return steps_type().replace("struct<", "struct<intent:string,", 1)
