"""Texts that compare without regard to case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COLLATION = "UTF8_LCASE"


def citext(x: Column) -> Column:
    """The text under a collation that compares, groups and joins it by lower case."""
    return F.collate(x, COLLATION)


def citext_eq(a: Column, b: Column) -> Column:
    return citext(a) == citext(b)


def citext_cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(citext(a) < citext(b), -1).when(citext(a) > citext(b), 1).when(citext(a) == citext(b), 0)
