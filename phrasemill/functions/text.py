"""Small text predicates and edits, all built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def emit(df: DataFrame, condition: Column, *cols: Column) -> DataFrame:
    """Rows of ``cols`` (the first never NULL) where ``condition`` holds.

    A plain filter over computed columns is pushed below them and computes them twice. Here
    condition and columns sit in one generator, so an expensive parse runs once per row.
    """
    kept = df.select(F.inline_outer(F.when(condition, F.array(F.struct(*cols)))))
    return kept.filter(F.col(kept.columns[0]).isNotNull())


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when one of ``words`` is a substring of ``text`` (no word boundaries)."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def quoted(value: str) -> str:
    """A string literal for SQL expression text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_sql(text: str, words: Iterable[str]) -> str:
    """Expression text of :func:`contains_any`; one parsed text is much faster to build than
    hundreds of column calls."""
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def escaped(text: str) -> str:
    """A regex that stands for ``text`` itself."""
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in text)


def replacement(text: str) -> str:
    """A replacement string that stands for ``text`` itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def alternation(words: Iterable[str]) -> str:
    """A regex that finds any of ``words`` as a substring, with common prefixes factored out.

    At each place only the words with the right first letter are tried, so a long list costs
    about as much as a short one. An empty list finds nothing.
    """
    tree: dict = {}
    words = list(words)
    if not words:
        return "(?!)"
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def render(node: dict) -> str:
        if "" in node:  # a shorter word ends here: its match settles the test
            return ""
        parts = [escaped(letter) + render(rest) for letter, rest in node.items()]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return render(tree)


def first_contained(text: Column, words: Iterable[str]) -> Column:
    """First of ``words``, in their order, that occurs in ``text``; NULL if none does."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def strip_edges(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` would remove spaces only)."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def drop_number(line: Column) -> Column:
    """Remove one leading ``12.`` with the white space behind it."""
    return F.regexp_replace(line, r"(?U)\A\d+\.[\s\x1c-\x1f]*", "")


def digest(*cols: Column) -> Column:
    """SHA-256 over the values, each with its length so that borders cannot shift."""
    parts = []
    for c in cols:
        parts += [F.coalesce(F.length(c).cast("string"), F.lit("-")), F.coalesce(c, F.lit(""))]
    return F.unhex(F.sha2(F.concat_ws(":", *parts), 256))
