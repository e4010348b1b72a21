"""REST query strings in the style of PostgREST, compiled to plans."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.core import like
from tessera.operators import dml
from tessera.operators.relational import limit_offset

_RESERVED = ("select", "order", "limit", "offset", "on_conflict", "columns")


def _literal(text: str, column: str, df: DataFrame) -> Column:
    return F.lit(text).cast(df.schema[column].dataType)


def condition(df: DataFrame, column: str, text: str) -> Column:
    """``[not.]op.value`` as a column."""
    if text.startswith("not."):
        return ~condition(df, column, text[4:])
    op, _, value = text.partition(".")
    c = F.col(column)
    if op in ("eq", "neq", "gt", "gte", "lt", "lte"):
        v = _literal(value, column, df)
        return {"eq": c == v, "neq": c != v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
    if op in ("like", "ilike"):
        return like(c.cast("string"), value.replace("*", "%"), ignore_case=op == "ilike")
    if op == "is":
        known = {"null": c.isNull(), "not_null": c.isNotNull()}
        return known[value.lower()] if value.lower() in known else c.eqNullSafe(F.lit(value.lower() == "true"))
    if op == "in":
        items = re.findall(r'"((?:[^"\\]|\\.)*)"|([^,()]+)', value)
        return c.isin(*[_literal(re.sub(r"\\(.)", r"\1", q) or b, column, df) for q, b in items])
    raise ValueError(f"unknown operator {op}")


def _columns(df: DataFrame, select: str) -> list[Column]:
    if select.strip() in ("", "*"):
        return [F.col(c) for c in df.columns]
    out = []
    for item in select.split(","):
        alias, _, name = item.strip().rpartition(":")
        name, _, kind = name.partition("::")
        if name == "*":
            out += [F.col(c) for c in df.columns]
        else:
            c = F.col(name).cast(kind) if kind else F.col(name)
            out.append(c.alias(alias or name))
    return out


def _order(text: str) -> list[Column]:
    out = []
    for item in text.split(","):
        name, *words = item.split(".")
        c, down = F.col(name), "desc" in words
        first = "nullsfirst" in words or (down and "nullslast" not in words)
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def _filtered(df: DataFrame, parameters: list[tuple[str, str]]) -> DataFrame:
    for name, value in parameters:
        if name in ("and", "or", "not.and", "not.or"):
            raise NotImplementedError("logical trees are not supported")
        if name not in _RESERVED:
            df = df.where(condition(df, name, value))
    return df


def select(df: DataFrame, query: str, range_: str | None = None) -> DataFrame:
    """Rows of ``?select=...&order=...&limit=...&offset=...&column=op.value``; a Range header ``a-b`` may page."""
    parameters = parse_qsl(query.lstrip("?"), keep_blank_values=True)
    given = dict(parameters)
    rows = _filtered(df, parameters)
    rows = rows.orderBy(*_order(given["order"])) if "order" in given else rows
    limit, offset = given.get("limit"), int(given.get("offset", 0))
    if range_ and limit is None:
        a, b = range_.split("-")
        offset, limit = int(a), int(b) - int(a) + 1 if b else None
    return limit_offset(rows, None if limit is None else int(limit), offset).select(*_columns(df, given.get("select", "*")))


def count(df: DataFrame, query: str) -> DataFrame:
    """One row ``count`` of all that match, whatever the page."""
    return _filtered(df, parse_qsl(query.lstrip("?"), keep_blank_values=True)).agg(F.count("*").alias("count"))


def insert(df: DataFrame, rows: DataFrame, on_conflict: list[str] | None = None, resolution: str = "merge-duplicates") -> dml.Change:
    """POST, with ``Prefer: resolution=merge-duplicates`` or ``ignore-duplicates`` if keys are given."""
    if not on_conflict:
        return dml.insert(df, rows)
    assign = {c: F.col(f"excluded.{c}") for c in rows.columns if c not in on_conflict} if resolution == "merge-duplicates" else None
    return dml.upsert(df, rows, on_conflict, assign)


def _where(df: DataFrame, query: str) -> Column:
    out = F.lit(True)
    for name, value in parse_qsl(query.lstrip("?")):
        if name not in _RESERVED:
            out &= condition(df, name, value)
    return out


def update(df: DataFrame, query: str, values: dict) -> dml.Change:
    """PATCH of the matching rows."""
    return dml.update(df, _where(df, query), {k: F.lit(v) for k, v in values.items()})


def delete(df: DataFrame, query: str) -> dml.Change:
    return dml.delete(df, _where(df, query))


def rpc(spark, function: str, arguments: dict) -> DataFrame:
    """A call of a registered function, arguments in the order of their names."""
    names = sorted(arguments)
    return spark.sql(f"SELECT {function}({', '.join(f':{n}' for n in names)}) AS result", args=arguments)
