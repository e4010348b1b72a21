"""PostgreSQL type names, casts and comparisons."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMES = {
    "boolean": "boolean", "bool": "boolean",
    "smallint": "smallint", "int2": "smallint", "smallserial": "smallint",
    "integer": "int", "int": "int", "int4": "int", "serial": "int", "oid": "int", "regclass": "int", "regtype": "int", "xid": "int", "cid": "int",
    "bigint": "bigint", "int8": "bigint", "bigserial": "bigint",
    "real": "float", "float4": "float", "double precision": "double", "float8": "double", "float": "double",
    "numeric": "decimal(38,18)", "decimal": "decimal(38,18)",
    "text": "string", "name": "string", "varchar": "string", "character varying": "string", "char": "string", "character": "string", "bpchar": "string",
    "bytea": "binary", "uuid": "string", "date": "date", "time": "time(6)", "timestamp": "timestamp_ntz", "timestamptz": "timestamp",
    "timestamp without time zone": "timestamp_ntz", "timestamp with time zone": "timestamp",
    "json": "variant", "jsonb": "variant", "citext": "string collate UTF8_LCASE", "vector": "array<float>", "hstore": "map<string,string>",
    "ltree": "string", "cube": "struct<ll:array<double>,ur:array<double>>",
    "tsvector": "array<struct<word:string,positions:array<int>>>", "tsquery": "string",
}


def spark_type(name: str) -> str:
    """The Spark type of a PostgreSQL type name; lengths of texts don't count, precisions of numbers do."""
    name = " ".join(name.lower().split())
    if name.endswith("[]"):
        return f"array<{spark_type(name[:-2])}>"
    base, args = re.fullmatch(r"([a-z0-9 ]+?)\s*(\(.*\))?", name).groups() if re.fullmatch(r"([a-z0-9 ]+?)\s*(\(.*\))?", name) else (name, None)
    if base not in _NAMES:
        raise ValueError(f"type {name} does not exist")
    if args and base in ("numeric", "decimal"):
        return "decimal" + (args if "," in args else args[:-1] + ",0)")
    return _NAMES[base]


def round_half_away(x: Column) -> Column:
    """The whole number nearest to a double, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def to_int(x: Column, kind: str = "int") -> Column:
    """A number or numeral as a whole number, rounded half away from zero; errors for other texts."""
    return round_half_away(x.cast("double")).cast(kind)


def soft_cast(x: Column, kind: str) -> Column:
    """A cast that gives null where it can't succeed."""
    return x.try_cast(spark_type(kind))


_TRUE, _FALSE = ("t", "true", "y", "yes", "on", "1"), ("f", "false", "n", "no", "off", "0")


def to_bool(x: Column) -> Column:
    """A text as a boolean; null if it is none."""
    x = F.lower(F.trim(x))
    return F.when(x.isin(*_TRUE), True).when(x.isin(*_FALSE), False)


def same_key(a: Column, b: Column) -> Column:
    """Equality as grouping has it: nulls are alike."""
    return a.eqNullSafe(b)
