"""Label paths as in ltree: dotted texts, with lquery patterns compiled to regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _labels(p: Column) -> Column:
    return F.filter(F.split(p, r"\."), lambda x: x != "")


def nlevel(p: Column) -> Column:
    return F.when(p.isNotNull(), F.size(_labels(p)))


def subltree(p: Column, start: int, end: int) -> Column:
    """Labels from ``start`` to before ``end``, counted from 0."""
    return F.array_join(F.slice(_labels(p), start + 1, max(end - start, 0)), ".")


def subpath(p: Column, offset: int, length: int | None = None) -> Column:
    """Labels from an offset, from the end if negative; a negative length leaves out so many at the end."""
    n = F.size(_labels(p))
    first = F.greatest(n + offset, F.lit(0)) if offset < 0 else F.lit(offset)
    count = n - first if length is None else n - first + length if length < 0 else F.least(F.lit(length), n - first)
    return F.array_join(F.slice(_labels(p), first + 1, F.greatest(count, F.lit(0))), ".")


def index(p: Column, part: Column, offset: int = 0) -> Column:
    """The place of the first occurrence of a path in another from an offset on; -1 if there is none."""
    a, b = _labels(p), _labels(part)
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - F.size(b), F.lit(0))), lambda i: (i >= offset) & (F.slice(a, i + 1, F.size(b)) == b))
    return F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(-1))


def is_ancestor(a: Column, b: Column) -> Column:
    """Whether the first path is the second or above it."""
    return (a == "") | F.startswith(F.concat(b, F.lit(".")), F.concat(a, F.lit(".")))


def lca(a: Column, b: Column) -> Column:
    """The longest common path that is above both."""
    x, y = _labels(a), _labels(b)
    most = F.greatest(F.least(F.size(x), F.size(y)) - 1, F.lit(0))
    same = F.filter(F.sequence(F.lit(0), most), lambda n: F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n))
    return F.array_join(F.slice(x, F.lit(1), F.array_max(same)), ".")


def lquery(pattern: str) -> str:
    """A regular expression over ``path + '.'`` for an lquery.

    Items are separated by dots: ``*`` any labels, ``*{n,m}`` so many; labels joined by ``|``, with ``!`` in
    front for none of them, and ``@`` (any case), ``*`` (prefix) or ``%`` (words between underscores) behind.
    """
    out = []
    for item in pattern.split("."):
        body, _, times = item.partition("{")
        times = "{" + times.replace("{,", "{0,") if times else ""
        times = times.replace("{,", "{0,")
        negated, body = body.startswith("!"), body.removeprefix("!")
        if body == "*":
            out.append(r"(?:[^.]+\.)" + (times or "*"))
            continue
        choices = []
        for choice in body.split("|"):
            label = re.match(r"[^@*%]*", choice)[0]
            flags = choice[len(label) :]
            part = re.escape(label)
            if "%" in flags:
                part = "(?:[^.]*_)?" + part + ("[^._]*" if "*" in flags else "") + "(?:_[^.]*)?"
            elif "*" in flags:
                part += "[^.]*"
            choices.append(f"(?i:{part})" if "@" in flags else part)
        any_of = "(?:" + "|".join(choices) + r")\."
        out.append("(?:" + (rf"(?!{any_of})[^.]+\." if negated else any_of) + ")" + times)
    return "^" + "".join(out) + "$"


def matches(p: Column, pattern: str) -> Column:
    return F.when(p.isNotNull(), F.concat(p, F.when(p == "", "").otherwise(".")).rlike(lquery(pattern)))
