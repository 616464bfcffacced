"""Text helpers as Spark columns."""

from __future__ import annotations

from functools import reduce
from string import Formatter

from pyspark.sql import Column, functions as F

from ledgerleaf.functions.patterns import WHITESPACE, jvm


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def _plain_ends(col: Column) -> Column:
    """Whether the first and the last byte are ASCII that strip() leaves alone; false for an empty text."""
    data, low, high = col.cast("binary"), F.lit(bytearray(b"!")), F.lit(bytearray(b"~"))
    return F.substring(data, 1, 1).between(low, high) & F.substring(data, -1, 1).between(low, high)


def strip_cheaply(col: Column) -> Column:
    """strip() for a column or variable that costs nothing to read again: btrim walks over the whole text and notes the place
    of every character, which most texts, with nothing to strip, can do without."""
    return F.when(_plain_ends(col), col).otherwise(strip(col))


def first_line(col: Column) -> Column:
    """Stripped text up to its first line break, stripped again."""
    cut = strip(F.substring_index(strip(col), "\n", 1))
    return F.when(_plain_ends(col) & ~F.contains(col, F.lit("\n")), col).otherwise(cut)


def lines(col: Column) -> Column:
    return F.split(col, "\n")


def stripped_lines(col: Column) -> Column:
    """Non-blank lines, stripped."""
    return F.filter(F.transform(lines(col), strip_cheaply), lambda line: line != "")


def contains_any(col: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(col, F.lit(w)) for w in words))


def occurrences(col: Column, word: Column) -> Column:
    """Non-overlapping occurrences of an ASCII word; the cheap test spares the copy."""
    gone = F.octet_length(col) - F.octet_length(F.replace(col, word, F.lit("")))
    return F.when(F.contains(col, word), (gone / F.octet_length(word)).cast("int")).otherwise(0)


def capture(col: Column, pattern: str) -> Column:
    """Group 1 of the first match, ignoring case; '' when there is none."""
    return F.regexp_extract(col, jvm(pattern), 1)


def matches(col: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.rlike(col, F.lit(jvm(pattern, ignore_case)))


def fill(template: str, **values: Column) -> Column:
    """Fill the {braces} of a text; a missing value reads None."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("None")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]
