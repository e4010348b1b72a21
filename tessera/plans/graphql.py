"""GraphQL collections in the style of pg_graphql, compiled to plans: filters, orders, connections, relationships."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.core import like
from tessera.operators import dml
from tessera.operators.relational import beyond

ORDERS = {
    "AscNullsFirst": lambda c: c.asc_nulls_first(),
    "AscNullsLast": lambda c: c.asc_nulls_last(),
    "DescNullsFirst": lambda c: c.desc_nulls_first(),
    "DescNullsLast": lambda c: c.desc_nulls_last(),
}
MOST_ROWS = 30


def compile_filter(given: dict) -> Column:
    """``{column: {op: value}, and: [...], or: [...], not: {...}}``; an empty and is true, an empty or false."""
    out = F.lit(True)
    for key, value in given.items():
        if key in ("and", "or"):
            joined = F.lit(key == "and")
            for part in value:
                joined = joined & compile_filter(part) if key == "and" else joined | compile_filter(part)
            out &= joined
        elif key == "not":
            out &= ~compile_filter(value)
        else:
            for op, operand in value.items():
                out &= _test(F.col(key), op, operand)
    return out


def _test(c: Column, op: str, value) -> Column:
    if op == "is":
        return {"NULL": c.isNull(), "NOT_NULL": c.isNotNull()}[value]
    if op == "in":
        return c.isin(list(value))
    if op in ("like", "ilike"):
        return like(c, value, ignore_case=op == "ilike")
    if op == "startsWith":
        return c.startswith(value)
    return {"eq": c == value, "neq": c != value, "gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op]


def cursor(keys: list[str]) -> Column:
    """A row's cursor: its key as base64 of JSON."""
    return F.base64(F.to_json(F.array(*[F.col(k).cast("string") for k in keys])).cast("binary"))


def encode_cursor(values: list) -> str:
    return base64.b64encode(json.dumps([str(v) for v in values], separators=(",", ":")).encode()).decode()


def decode_cursor(text: str) -> list[str]:
    return json.loads(base64.b64decode(text))


def node_id(schema: str, table: str, keys: list[str]) -> Column:
    """A global identifier of a row."""
    return F.base64(F.concat(F.lit(json.dumps([schema, table])[:-1] + ","), F.concat_ws(",", *[F.to_json(F.array(F.col(k).cast("string"))) for k in keys]), F.lit("]")).cast("binary"))


def connection(df: DataFrame, keys: list[str], filter: dict | None = None, order_by: list[dict] | None = None, first: int | None = None, last: int | None = None, after: str | None = None, before: str | None = None, offset: int = 0) -> DataFrame:
    """The edges of a collection, each with ``cursor``, ``has_next_page`` and ``has_previous_page``.

    Pages by cursor run in key order; ``orderBy`` pages by offset, the key breaking ties. One row more than
    the page is asked for, to see whether there is a next.
    """
    rows = df.where(compile_filter(filter or {}))
    typed = lambda text: [F.lit(v).cast(df.schema[k].dataType) for k, v in zip(keys, decode_cursor(text), strict=True)]
    rows = rows.where(beyond(keys, typed(after))) if after else rows
    rows = rows.where(beyond(keys, typed(before), True)) if before else rows
    size = min(last if last is not None else first if first is not None else MOST_ROWS, MOST_ROWS)
    asked = [ORDERS[d](F.col(c)) for o in order_by or [] for c, d in o.items()]
    up = asked + [F.col(k).asc() for k in keys]
    order = [F.col(k).desc() for k in keys] if last is not None and not asked else up
    some = rows.orderBy(*order).offset(offset).limit(size + 1)
    listed = some.agg(F.collect_list(F.struct(*df.columns)).alias("r"))  # a page
    more = F.size("r") > size
    out = listed.select(F.posexplode(F.slice("r", 1, size)).alias("__at", "x"), more.alias("more")).select("__at", "x.*", "more")
    forward = last is None
    flags = {"has_next_page": F.col("more") if forward else F.lit(before is not None), "has_previous_page": F.lit(after is not None or offset > 0) if forward else F.col("more")}
    return out.withColumn("cursor", cursor(keys)).withColumns(flags).drop("__at", "more")


def total_count(df: DataFrame, filter: dict | None = None) -> DataFrame:
    return df.where(compile_filter(filter or {})).agg(F.count("*").alias("total_count"))


def with_children(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, name: str, order: str, most: int | None = None) -> DataFrame:
    """Each parent with an array of its children, by one join instead of a lookup for each."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*child.columns).alias("x"))))
    nested = child.groupBy(F.col(child_key).alias("__k")).agg(F.transform(F.slice(items, 1, most) if most else items, lambda i: i["x"]).alias(name))
    joined = parent.join(nested, F.col(parent_key) == F.col("__k"), "left").drop("__k")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def with_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """Each child with its parent as a struct, null if it has none."""
    one = parent.select(F.col(parent_key).alias("__k"), F.struct(*parent.columns).alias(name))
    return child.join(one, F.col(child_key) == F.col("__k"), "left").drop("__k")


def _guarded(change: dml.Change, most: int) -> dml.Change:
    if change.returning.limit(most + 1).count() > most:
        raise ValueError("update or delete impacts too many records")
    return change


def insert_into(df: DataFrame, rows: DataFrame) -> dml.Change:
    return dml.insert(df, rows)


def update_collection(df: DataFrame, set_: dict, filter: dict | None = None, at_most: int = 1) -> dml.Change:
    """Nothing happens, but an error, if more rows match than are allowed."""
    return _guarded(dml.update(df, compile_filter(filter or {}), {k: F.lit(v) for k, v in set_.items()}), at_most)


def delete_from_collection(df: DataFrame, filter: dict | None = None, at_most: int = 1) -> dml.Change:
    return _guarded(dml.delete(df, compile_filter(filter or {})), at_most)
