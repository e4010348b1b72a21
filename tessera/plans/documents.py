"""Document queries in the style of Mongo, compiled to columns over JSON texts."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parsed(doc: Column) -> Column:
    return F.parse_json(doc)


def _path(path: str) -> str:
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in path.split("."))


def field(doc: Column, path: str, kind: str = "variant") -> Column:
    """The value at a dotted path through objects; null if there is none."""
    return _get(_parsed(doc), path, kind)


# What follows takes documents that are parsed already.


def _get(doc: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(doc, _path(path), kind)


def _exists(doc: Column, path: str) -> Column:
    return _get(doc, path).isNotNull()


def _json(value: Column) -> Column:
    return F.to_json(value)


def _text(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def _equal(doc: Column, path: str, value: Any) -> Column:
    """Equality with the value there, or with an element of an array there."""
    found = _get(doc, path)
    same = F.coalesce(_same(found, doc, path, value), F.lit(False))
    items = F.try_variant_get(doc, _path(path), "array<variant>")
    member = F.coalesce(F.exists(items, lambda x: F.to_json(x) == _text(value)), F.lit(False))
    return same | member


def _same(found: Column, doc: Column, path: str, value: Any) -> Column:
    kind = F.schema_of_variant(found)
    if value is None:
        return kind == "VOID"
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (_get(doc, path, "boolean") == value)
    if isinstance(value, (int, float)):
        return _is_number(kind) & (_get(doc, path, "double") == float(value))
    if isinstance(value, str):
        return (kind == "STRING") & (_get(doc, path, "string") == value)
    return F.to_json(found) == _text(value)


def _is_number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)")


def _ordered(doc: Column, path: str, op: str, value: Any) -> Column:
    """Numbers with numbers and texts with texts; anything else is false."""
    kind = F.schema_of_variant(_get(doc, path))
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return F.lit(False)
    able, x = (kind == "STRING", _get(doc, path, "string")) if isinstance(value, str) else (_is_number(kind), _get(doc, path, "double"))
    test = {"$gt": x > value, "$gte": x >= value, "$lt": x < value, "$lte": x <= value}[op]
    return F.coalesce(able & test, F.lit(False))


def compile_filter(query: dict, doc: Column) -> Column:
    """A filter document as a column that is never null; a row's document is parsed once, however much is asked of it."""
    return F.coalesce(F.exists(F.array(_parsed(doc)), lambda parsed: _compiled(query, parsed)), F.lit(False))


def _compiled(query: dict, doc: Column) -> Column:
    out = F.lit(True)
    for key, value in query.items():
        if key in ("$and", "$or", "$nor"):
            parts = [_compiled(q, doc) for q in value]
            joined = F.lit(key == "$and")
            for p in parts:
                joined = joined & p if key == "$and" else joined | p
            out &= ~joined if key == "$nor" else joined
        elif isinstance(value, dict) and value and all(k.startswith("$") for k in value):
            for op, operand in value.items():
                out &= _operator(doc, key, op, operand)
        else:
            out &= _equal(doc, key, value)
    return out


def _operator(doc: Column, path: str, op: str, value: Any) -> Column:
    if op == "$eq":
        return _equal(doc, path, value)
    if op == "$ne":
        return ~_equal(doc, path, value)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return _ordered(doc, path, op, value)
    if op in ("$in", "$nin"):
        hit = F.lit(False)
        for v in value:
            hit |= _equal(doc, path, v)
        return ~hit if op == "$nin" else hit
    if op == "$exists":
        return _exists(doc, path) if value else ~_exists(doc, path)
    if op == "$size":
        return F.coalesce(F.size(F.try_variant_get(doc, _path(path), "array<variant>")) == value, F.lit(False))
    if op == "$not":
        return ~_compiled({path: value}, doc)
    raise ValueError(f"unknown operator {op}")


def find(df: DataFrame, query: dict, doc: str = "doc", id_col: str = "id") -> DataFrame:
    """Matching documents in the order of their ids."""
    return df.where(compile_filter(query, F.col(doc))).orderBy(id_col)


def find_one(df: DataFrame, query: dict, doc: str = "doc", id_col: str = "id") -> DataFrame:
    return find(df, query, doc, id_col).limit(1)


def find_by_id(df: DataFrame, id_: Any, id_col: str = "id") -> DataFrame:
    return df.where(F.col(id_col) == id_)


def _apply(text: str, change: dict, immutable: tuple[str, ...]) -> str:
    data = json.loads(text)
    for op, fields in change.items():
        for path, value in fields.items():
            if path in immutable:
                raise ValueError(f"field {path} is immutable")
            *above, last = path.split(".")
            at = data
            for p in above:
                at = at.setdefault(p, {}) if op != "$unset" else at.get(p, {})
            if op == "$set":
                at[last] = value
            elif op == "$unset":
                at.pop(last, None)
            elif op == "$inc":
                old = at.get(last, 0)
                if isinstance(old, bool) or not isinstance(old, (int, float)):
                    raise ValueError(f"cannot increment {path}")
                at[last] = old + value
            else:
                raise ValueError(f"unknown update operator {op}")
    return json.dumps(data, separators=(",", ":"), ensure_ascii=False)


def update_one(df: DataFrame, query: dict, change: dict, doc: str = "doc", id_col: str = "id", immutable: tuple[str, ...] = ("_id",)) -> DataFrame:
    """The collection with the first match changed by ``$set``, ``$unset`` and ``$inc``."""
    return _updated(df, find_one(df, query, doc, id_col).select(F.col(id_col).alias("__id")), change, doc, id_col, immutable)


def update_many(df: DataFrame, query: dict, change: dict, doc: str = "doc", id_col: str = "id", immutable: tuple[str, ...] = ("_id",)) -> DataFrame:
    return _updated(df, find(df, query, doc, id_col).select(F.col(id_col).alias("__id")), change, doc, id_col, immutable)


def _updated(df: DataFrame, hits: DataFrame, change: dict, doc: str, id_col: str, immutable: tuple[str, ...]) -> DataFrame:
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _apply(t, change, immutable))

    marked = df.join(hits.withColumn("__hit", F.lit(True)), F.col(id_col) == F.col("__id"), "left")
    return marked.withColumn(doc, F.when(F.col("__hit"), apply(F.when(F.col("__hit"), F.col(doc)).otherwise("{}"))).otherwise(F.col(doc))).select(*df.columns)


#: Types of a model's fields, by the variant types that they accept.
TYPES = {"string": "^STRING", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY", "any": ""}


def violations(df: DataFrame, schema: dict[str, dict], doc: str = "doc", strict: bool = True) -> DataFrame:
    """``(…, problem)``: documents that don't fit a model of ``{field: {type, required, nullable}}``, the first problem of each."""
    parsed = _parsed(F.col(doc))
    problem = F.lit(None).cast("string")
    if strict:
        keys = F.json_object_keys(F.col(doc))
        extra = F.array_except(keys, F.array(*map(F.lit, schema)))
        problem = F.when(F.size(extra) > 0, F.concat(F.lit("unknown field "), extra[0]))
    for name, rule in reversed(schema.items()):
        value = F.try_variant_get(parsed, _path(name), "variant")
        kind = F.schema_of_variant(value)
        bad = F.when(value.isNull(), F.lit(f"{name} is required") if rule.get("required") else F.lit(None))
        bad = bad.when(kind == "VOID", F.lit(None) if rule.get("nullable") else F.lit(f"{name} is null"))
        bad = bad.when(~kind.rlike(TYPES[rule.get("type", "any")]), F.lit(f"{name} is no {rule.get('type')}"))
        problem = F.coalesce(bad, problem)
    return df.withColumn("problem", problem).where("problem is not null")


def duplicates(df: DataFrame, unique: str, doc: str = "doc") -> DataFrame:
    """Values of a unique field that several documents have."""
    return df.select(F.to_json(field(F.col(doc), unique)).alias("value")).where("value is not null").groupBy("value").count().where("count > 1")


def insert_many(df: DataFrame, rows: DataFrame, schema: dict[str, dict], doc: str = "doc", unique: tuple[str, ...] = ()) -> DataFrame:
    """The collection with all of the rows, or an error and none."""
    bad = violations(rows, schema, doc).select("problem").limit(1).collect()
    if bad:
        raise ValueError(bad[0].problem)
    both = df.unionByName(rows)
    for name in unique:
        if not duplicates(both, name, doc).isEmpty():
            raise ValueError(f"duplicate value of {name}")
    return both


def equality_index(df: DataFrame, fields: tuple[str, ...], doc: str = "doc", id_col: str = "id") -> DataFrame:
    """``(field, value, id)``: what each document has in each indexed field, as JSON text; write it by field to find by it later."""
    parsed = df.select(F.col(id_col).alias("id"), _parsed(F.col(doc)).alias("v"))
    items = [F.struct(F.lit(f).alias("field"), F.to_json(F.try_variant_get("v", _path(f), "variant")).alias("value")) for f in fields]
    return parsed.select("id", F.inline(F.array(*items))).where("value is not null").select("field", "value", "id")


def indexed_ids(index: DataFrame, query: dict) -> DataFrame:
    """``id`` of the documents that have all of the values of a query of equalities: found by value, met by counting."""
    wanted = index.sparkSession.createDataFrame([(f, _text(v)) for f, v in query.items()], "field string, value string")
    return index.join(F.broadcast(wanted), ["field", "value"]).groupBy("id").agg(F.count_distinct("field").alias("n")).where(F.col("n") == len(query)).select("id")  # as many rows as the query has


def indexed_find(df: DataFrame, index: DataFrame, query: dict, doc: str = "doc", id_col: str = "id") -> DataFrame:
    """``find`` where plain equalities on indexed fields narrow the documents first; the whole query is then asked of what is left."""
    fields = {r.field for r in index.select("field").distinct().collect()}  # a few names
    plain = {f: v for f, v in query.items() if f in fields and isinstance(v, (str, int, float, bool)) and not f.startswith("$")}
    rows = df if not plain else df.join(indexed_ids(index, plain).withColumnRenamed("id", "__found"), F.col(id_col) == F.col("__found"), "left_semi")
    return find(rows, query, doc, id_col)
