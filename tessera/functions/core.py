"""Core scalar functions where Spark's own spelling differs from PostgreSQL's.

Functions that are the same in both (upper, lower, replace, coalesce, nullif, greatest, least, sqrt, mod,
concat_ws, ...) are used as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Division of whole numbers, towards zero; by zero an error."""
    return F.call_function("div", a, b)


def concat(*parts: Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *parts)


def substring(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; what lies before the first character is cut off, and counts towards the length."""
    start = F.lit(start) if isinstance(start, int) else start
    first = F.greatest(start, F.lit(1))
    if length is None:
        return F.substring(text, first, F.lit(2**31 - 1))
    length = F.lit(length) if isinstance(length, int) else length
    return F.substring(text, first, F.greatest(start + length - first, F.lit(0)))


def trim_chars(text: Column, chars: str = " ", side: str = "both") -> Column:
    """Removes any of the characters from either or both ends."""
    return {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side](text, F.lit(chars))


def left(text: Column, n: int) -> Column:
    """The first characters; none for a negative number."""
    return F.substring(text, 1, max(n, 0))


def right(text: Column, n: int) -> Column:
    """The last characters; none for a negative number."""
    return F.right(text, F.lit(max(n, 0)))


def truncate(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def round_even(x: Column, digits: int = 0) -> Column:
    """Halves to the even neighbour."""
    return F.bround(x, max(digits, 0))


def extract(field: str, t: Column) -> Column:
    """A whole part of a time: Sunday is day 0 of the week, weeks are ISO weeks, seconds have no fraction."""
    parts = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "quarter": F.quarter, "week": F.weekofyear, "doy": F.dayofyear,
        "dow": lambda x: F.dayofweek(x) - 1, "second": lambda x: F.floor(F.second(x)),
    }
    return parts[field.lower()](t).cast("int")


def like(text: Column, pattern: str, escape: str | None = None, ignore_case: bool = False) -> Column:
    """LIKE without a default escape character."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"%": ".*", "_": "."}.get(c) or re.escape(c))
        i += 1
    return text.rlike(("(?is)^" if ignore_case else "(?s)^") + "".join(out) + "\\z")


def between(x: Column, low: Column, high: Column) -> Column:
    """Null if any operand is."""
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), (x >= low) & (x <= high))


def in_values(x: Column, values: list) -> Column:
    """IN with three values of truth: null if unmatched and a value is null."""
    known = [v for v in values if v is not None]
    hit = x.isin(known) if known else F.when(x.isNotNull(), False)
    return hit if len(known) == len(values) else F.when(hit, True)


def any_of(x: Column, op: str, array: Column) -> Column:
    """``x op ANY (array)``."""
    return F.exists(array, lambda e: _compare(x, op, e))


def all_of(x: Column, op: str, array: Column) -> Column:
    """``x op ALL (array)``."""
    return F.forall(array, lambda e: _compare(x, op, e))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def array_length(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def array_to_string(a: Column, separator: str) -> Column:
    """Joins elements, leaving out nulls."""
    return F.array_join(a, separator)


def unnest_together(*arrays: Column) -> Column:
    """A generator of rows of several arrays side by side, the shorter padded with nulls."""
    return F.inline(F.arrays_zip(*arrays))
