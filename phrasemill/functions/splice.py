"""Order-keeping edits of JSON text.

An object or array is cut in one pass into its members or elements, each a piece of the text itself: a
head (separator, key, white space) and a raw value; the closing is the last piece. Only pieces that an
edit is for are split into head and value, only values that it changes are replaced, and the pieces are
joined again, so everything else stays byte for byte: key order, white space, spelled numbers, escapes,
unknown keys and elements of other kinds. Of a repeated key the last value is edited, which is the one
that counts when the text is read.

Texts nest up to ``DEPTH`` levels below the piece that is cut; a deeper one is left as it is.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Edit = Callable[[Column], Column]

DEPTH = 12

# Possessive and atomic groups never give back, so a long text costs one pass and no stack. A run of
# plain characters is an atomic greedy one, which is the fastest loop there is; each follows a bracket,
# a string or a nested text, so that no place is tried twice.
_STRING = r'"(?>[^"\\]*)(?:\\.(?>[^"\\]*))*+"'
_PLAIN = r'(?>[^\[\]{}"]*)'
_NESTED = rf'[\[{{]{_PLAIN}(?:{_STRING}{_PLAIN})*+[\]}}]'
for _ in range(DEPTH - 1):
    _NESTED = rf'[\[{{]{_PLAIN}(?:(?:{_STRING}|{_NESTED}){_PLAIN})*+[\]}}]'
_VALUE = rf'(?:{_STRING}|{_NESTED}|[^\s,\[\]{{}}":]++)'
_MEMBER_HEAD = rf'\s*+[{{,]\s*+{_STRING}\s*+:\s*+'
_ELEMENT_HEAD = r'\s*+[\[,]\s*+'


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def text_of(raw: Column) -> Column:
    """The text a raw JSON string stands for; NULL for any other kind of value."""
    decoded = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0]
    plain = raw.substr(F.lit(2), F.length(raw) - 2)
    return F.when(raw.startswith('"'), F.when(raw.contains("\\"), decoded).otherwise(plain))


def quote(text: Column) -> Column:
    """The raw JSON string of a text."""
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def _pieces(text: Column, head: str, opening: str, closing: str, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn`` of the pieces of ``text`` and of the closing behind the last (of an empty object or list: all
    of it); the text itself if it is not made of such pieces to its end."""
    end = rf"\s*+\{closing}\s*+\z"
    pattern = rf"(?s)\G{head}{_VALUE}|\G{end}|\A\s*+\{opening}{end}"

    def checked(cut: Column) -> Column:
        tail = F.try_element_at(cut, F.lit(-1))
        whole = (F.octet_length(F.array_join(cut, "")) == F.octet_length(text)) & tail.rlike(rf"\A\s*+(?:\{opening})?+{end}")
        return F.when(whole, fn(F.slice(cut, 1, F.size(cut) - 1), tail)).otherwise(text)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), checked)


def _parted(piece: Column, head: str) -> Column:
    """A piece as ``struct<head,value>``."""
    return let(F.regexp_extract(piece, rf"\A{head}", 0), lambda h: F.struct(
        h.alias("head"), piece.substr(F.length(h) + 1, F.length(piece)).alias("value")))


def _with_value(piece: Column, head: str, fn: Edit) -> Column:
    """A piece with its value edited; the piece itself where the edit gives NULL."""
    return let(_parted(piece, head), lambda p: F.coalesce(F.concat(p["head"], fn(p["value"])), piece))


def _text(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def _grown(body: Column, tail: Column, more: Column, opening: str) -> Column:
    """``body`` and ``tail`` with ``more`` (raw pieces, joined by commas) between them."""
    at = F.instr(tail, opening)  # only an empty object or list has its opening in the tail
    inside = F.concat(tail.substr(F.lit(1), at), more, tail.substr(at + 1, F.length(tail)))
    behind = F.concat(body, F.when(body.rlike(r"[\[{]\s*\z"), F.lit("")).otherwise(F.lit(",")), more, tail)
    return F.when(more == "", F.concat(body, tail)).when(at > 0, inside).otherwise(behind)


def edit_members(raw: Column, edits: dict[str, Edit], absent: dict[str, Column | str] | None = None) -> Column:
    """An object's text with the values of some keys edited and absent keys appended.

    An edit maps a raw value to a raw value; ``absent`` holds the raw value of each key to append (NULL:
    none). A text that is no object is returned as it is.
    """
    absent = absent or {}
    names = list(dict.fromkeys([*edits, *absent]))

    def spliced(pieces: Column, tail: Column) -> Column:
        def with_places(keys: Column) -> Column:
            # places of the last occurrences, from 0; beyond the end for an absent key
            last = {n: F.size(keys) - F.array_position(keys, n) for n in names}
            return let(F.struct(*[v.alias(f"p{i}") for i, v in enumerate(last.values())]), filled)

        def filled(places: Column) -> Column:
            at = {n: places[f"p{i}"] for i, n in enumerate(names)}

            def edited(piece: Column, i: Column) -> Column:
                out = None
                for n, fn in edits.items():
                    new = _with_value(piece, _MEMBER_HEAD, fn)
                    out = F.when(i == at[n], new) if out is None else out.when(i == at[n], new)
                return out.otherwise(piece)

            whole = _text(F.transform(pieces, edited) if edits else pieces)
            if not absent:
                return F.concat(whole, tail)
            more = F.concat_ws(",", *[
                F.when(at[n] == F.size(pieces), F.concat(F.lit(json.dumps(n) + ":"), F.lit(value))) for n, value in absent.items()
            ])
            return let(F.struct(whole.alias("b"), more.alias("m")), lambda x: _grown(x["b"], tail, x["m"], "{"))

        return let(F.reverse(F.json_object_keys(raw)), with_places)

    return _pieces(raw, _MEMBER_HEAD, "{", "}", spliced)


def edit_elements(
    raw: Column, fn: Edit | None = None, keep: Callable[[Column], Column] | None = None, more: Column | None = None,
    only_first: bool = False, whole: Edit | None = None,
) -> Column:
    """An array's text with its objects (or the first of them) edited, elements that ``keep`` refuses
    left out, and the raw elements ``more`` (an array of texts) appended. A text that is no array is
    returned as it is.

    ``whole`` maps all pieces ``array<struct<head,value>>`` to those that are left.
    """

    def opened(left: Column, pieces: Column) -> Column:
        """Pieces of which the first has the head of the array's first."""
        first = F.element_at(pieces, 1)["head"]
        return F.transform(left, lambda p, i: F.struct(F.when(i == 0, first).otherwise(p["head"]).alias("head"), p["value"].alias("value")))

    def edited(p: Column, chosen: Column) -> Column:
        """The text of a piece, edited if it is chosen."""
        return F.concat(p["head"], F.when(chosen, F.coalesce(fn(p["value"]), p["value"])).otherwise(p["value"]))

    def chosen_elements(out: Column) -> Column:
        is_object = lambda p: p["value"].startswith("{")
        if fn is None:
            return F.transform(out, lambda p: F.concat(p["head"], p["value"]))
        if not only_first:
            return F.transform(out, lambda p: edited(p, is_object(p)))
        return let(F.array_position(F.transform(out, is_object), True) - 1, lambda first: F.transform(
            out, lambda p, i: edited(p, is_object(p) & (i == first))))

    def spliced(cut: Column, tail: Column) -> Column:
        return let(F.transform(cut, lambda t: _parted(t, _ELEMENT_HEAD)), lambda pieces: rejoined(pieces, tail))

    def rejoined(pieces: Column, tail: Column) -> Column:
        out = pieces
        if whole is not None:
            out = opened(whole(pieces), pieces)
        if keep is not None:
            out = opened(F.filter(out, lambda p: keep(p["value"])), pieces)
        body = _text(chosen_elements(out))
        if keep is not None:  # nothing left: the opening of the first element stays
            body = let(body, lambda b: F.when((b == "") & (F.size(pieces) > 0), F.rtrim(F.element_at(pieces, 1)["head"])).otherwise(b))
        if more is None:
            return F.concat(body, tail)
        return let(F.struct(body.alias("b"), F.array_join(more, ",").alias("m")), lambda x: _grown(x["b"], tail, x["m"], "["))

    return F.when(raw.startswith("["), _pieces(raw, _ELEMENT_HEAD, "[", "]", spliced)).otherwise(raw)


def raw_elements(raw: Column) -> Column:
    """The raw elements of an array; empty for anything else."""
    found = F.regexp_extract_all(raw, F.lit(rf"(?s)\G{_ELEMENT_HEAD}({_VALUE})"), F.lit(1))
    return F.when(raw.startswith("["), found).otherwise(F.array().cast("array<string>"))


def raw_members(raw: Column) -> Column:
    """The raw members of an object, each with its head."""
    return F.regexp_extract_all(raw, F.lit(rf"(?s)\G{_MEMBER_HEAD}{_VALUE}"), F.lit(0))


def spelled_members(members: Column) -> Column:
    """Raw members as ``array<struct<key,value>>``, the key as it is spelled between its quotes."""
    head = rf'(?s)\A\s*+[{{,]\s*+"((?:[^"\\]++|\\.)*+)"\s*+:\s*+'
    return F.transform(members, lambda m: F.struct(
        F.regexp_extract(m, head, 1).alias("key"), F.regexp_replace(m, head, "").alias("value")))


def raw_value(spelled: Column, key: str) -> Column:
    """The last raw value of a key whose spelling holds no escape among spelled members; NULL if there is none."""
    return F.try_element_at(F.filter(spelled, lambda m: m["key"] == key), F.lit(-1))["value"]


def adopt_members(raw: Column, other: Column) -> Column:
    """An object's text with those members of another appended, as they stand, whose keys it lacks."""
    found = raw_members(other)
    bare = F.transform(found, lambda m: F.regexp_replace(m, r"(?s)\A\s*+[{,]\s*+", ""))

    def lacks(keys: Column, member: Column) -> Column:
        spelled = F.regexp_extract(member, r'(?s)\A"((?:[^"\\]++|\\.)*+)"', 1)
        key = F.when(spelled.contains("\\"), text_of(F.concat(F.lit('"'), spelled, F.lit('"')))).otherwise(spelled)
        return ~F.array_contains(keys, key)

    tail = F.regexp_extract(raw, r"\s*\}\s*\z", 0)
    body = raw.substr(F.lit(1), F.length(raw) - F.length(tail))
    grown = lambda more: F.when(more == "", raw).otherwise(
        F.concat(body, F.when(body.rlike(r"\A\s*\{\z"), F.lit("")).otherwise(F.lit(",")), more, tail))
    return F.when(raw.startswith("{") & other.startswith("{"), let(
        let(F.json_object_keys(raw), lambda keys: F.array_join(F.filter(bare, lambda m: lacks(keys, m)), ",")), grown)).otherwise(raw)


def mentions(raw: Column, words: Iterable[str]) -> Column:
    """Whether one of the words can be a whole string in ``raw``: where this is false nothing is cut."""
    out = raw.contains("\\")
    for word in words:
        out = out | raw.contains(json.dumps(word, ensure_ascii=False))
    return out


def is_editable(text: Column) -> Column:
    """Whether a text is one JSON object that edits can cut; false for NULL."""
    members = F.regexp_replace(text, rf"(?s)\G{_MEMBER_HEAD}{_VALUE}", "")
    return F.coalesce(F.json_object_keys(text).isNotNull() & members.rlike(r"\A\s*\{?\s*\}\s*\z"), F.lit(False))


def edit_results(
    output_json: Column, fn: Edit | None, when: Column | None = None, only_first: bool = False, **other
) -> Column:
    """The text of an output with every object in ``discovery_results``, or the first, edited.

    ``other`` goes to :func:`edit_members` for the top level. Where ``when`` does not hold, and where
    the text is no JSON object, it is returned as it is.
    """
    edits = {"discovery_results": lambda raw: edit_elements(raw, fn, only_first=only_first)} if fn else {}
    edited = edit_members(output_json, edits, **other)
    condition = F.json_object_keys(output_json).isNotNull()
    condition = condition if when is None else when & condition
    return F.when(condition, F.coalesce(edited, output_json)).otherwise(output_json)
