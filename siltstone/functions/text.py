"""Text functions whose results agree between the JVM, DuckDB and Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token pattern with portable classes, white space, and line ends.
TOKEN = r"[a-zA-Z_][\p{L}\p{N}_]*|[а-яёА-ЯЁ]+|\p{Nd}+"
#: Fixed value: the same pattern for Python, whose own classes are Unicode.
PY_TOKEN = r"[a-zA-Z_]\w*|[а-яёА-ЯЁ]+|\d+"
SPACE = r"(?U)[\s\x1c-\x1f]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often it is used.

    Expressions have no local names, and what a lambda captures is computed anew for every
    element; a lambda's own argument is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenize(text: Column) -> Column:
    """Search tokens: identifiers, Cyrillic words and numbers of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Distinct lower-cased words between white space, in order of first occurrence."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SPACE), lambda x: x != ""))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+$", "")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def splitlines(text: Column) -> Column:
    """Lines without their ends; no empty line after a final line end."""
    return let(
        F.split(text, LINE_END, -1),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
    )


def suffix(path: Column) -> Column:
    """The last dotted ending of the file name, with its dot, lower-cased; '' without one.

    A dot that begins the name does not start an ending, and a final dot ends none.
    """
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def duration(seconds: Column, style: str = "short") -> Column:
    """Seconds as text; below zero counts as zero.

    ``short``: ``1h 02m``, ``3m 04s`` or ``5s``, null for null.  ``long``: ``1h 02m 05s`` in the
    first case, ``--`` for null.  ``clock``: ``01:02:05`` or ``03:04``, ``--:--`` for null.
    """
    s = F.greatest(seconds, F.lit(0)).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    if style == "clock":
        shown = F.when(s >= 3600, F.format_string("%02d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%02d:%02d", minutes, rest))
        return F.when(seconds.isNull(), F.lit("--:--")).otherwise(shown)
    hourly = F.format_string("%dh %02dm %02ds", hours, minutes, rest) if style == "long" else F.format_string("%dh %02dm", hours, minutes)
    return (
        F.when(seconds.isNull(), F.lit("--" if style == "long" else None).cast("string"))
        .when(s >= 3600, hourly)
        .when(s >= 60, F.format_string("%dm %02ds", minutes, rest))
        .otherwise(F.format_string("%ds", rest))
    )


def each(array: Column) -> Column:
    """One row an element, and one null row for an empty array, to be filtered out.

    For arrays that cost something to make: a plain ``explode`` lets the optimizer add a
    test of the array's size below it, which makes the array two more times a row.
    """
    return F.explode_outer(array)
