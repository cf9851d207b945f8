"""Structured parts of a model's answer: Markdown tables and lists, delimited rows, named patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST_ITEM = r"^\s*[-*+]\s+([^\n\r]+)\z"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def _row(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), stripped), lambda c: c != "")


def markdown_table(text: Column) -> Column:
    """(header, rows) of the lines that begin with a bar; cells are trimmed and empty ones left out.

    The second line is the rule below the header; rows of another width than the header's are left out. Null with fewer than three lines.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: stripped(x).startswith("|"))
    header = _row(lines[0])
    rows = F.filter(F.transform(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), _row), lambda r: F.size(r) == F.size(header))
    return F.when(F.size(lines) >= 3, F.struct(header.alias("header"), rows.alias("rows")))


def markdown_list(text: Column) -> Column:
    """The items of lines that begin with a dash, star or plus."""
    items = F.filter(F.split(text, "\n"), lambda x: x.rlike(LIST_ITEM))
    return F.transform(items, lambda x: stripped(F.regexp_extract(x, LIST_ITEM, 1)))


def answer_kind(text: Column) -> Column:
    """What is parsed out of an answer: table, list or text; null and empty answers have no kind."""
    table = text.contains("|") & text.contains("---")
    return F.when(text != "", F.when(table, "table").when(text.rlike(r"(?m)^\s*[-*+]\s"), "list").otherwise("text"))


def delimited(text: Column, delimiter: str = ",") -> Column:
    """The cells of each line that isn't blank; a delimiter between quotes is text, the quotes themselves are left out."""

    def cells(line: Column) -> Column:
        parts = F.transform(F.split(line, '"'), lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(delimiter), F.lit("\u0001"))).otherwise(p))
        return F.transform(F.split(F.array_join(parts, ""), "\u0001"), stripped)

    return F.transform(F.filter(F.split(text, "\n"), lambda x: stripped(x) != ""), cells)


def named_matches(text: Column, patterns: dict[str, str], first: set[str] = frozenset()) -> Column:
    """A struct of all matches of each pattern, or of the first match alone (null without one) for the names in ``first``."""
    found = {name: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for name, p in patterns.items()}
    return F.struct(*[(F.get(v, F.lit(0)) if name in first else v).alias(name) for name, v in found.items()])
