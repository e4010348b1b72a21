"""The session: its variables, who is asking, and extensions, as statements and as functions in queries."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "tessera.var."
_INSTALLED = "tessera.extensions"

# Defaults of variables.
DEFAULTS = {
    "pg_trgm.similarity_threshold": "0.3",
    "pg_trgm.word_similarity_threshold": "0.6",
    "pg_trgm.strict_word_similarity_threshold": "0.5",
    "search_path": "public",
    "server_version": "15.0",
    "database": "tessera",
    "user": "tessera",
}

# Names of types by object id.
TYPE_NAMES = {
    16: "boolean",
    17: "bytea",
    20: "bigint",
    21: "smallint",
    23: "integer",
    25: "text",
    114: "json",
    700: "real",
    701: "double precision",
    1042: "character",
    1043: "character varying",
    1082: "date",
    1083: "time without time zone",
    1114: "timestamp without time zone",
    1184: "timestamp with time zone",
    1700: "numeric",
    2950: "uuid",
    3614: "tsvector",
    3615: "tsquery",
    3802: "jsonb",
}


def setting(spark: SparkSession, name: str, missing_ok: bool = True) -> str | None:
    """A session variable or its default, kept apart from Spark's own."""
    value = spark.conf.get(_PREFIX + name.lower(), None)
    value = DEFAULTS.get(name.lower()) if value is None else value
    if value is None and not missing_ok:
        raise KeyError(f"unrecognized configuration parameter {name}")
    return value


def set_config(spark: SparkSession, name: str, value: str) -> str:
    spark.conf.set(_PREFIX + name.lower(), value)
    return value


def reset(spark: SparkSession, name: str) -> None:
    spark.conf.unset(_PREFIX + name.lower())


def claim(spark: SparkSession, name: str) -> str | None:
    """A claim of who is asking: a variable of its own, or a member of the claims document."""
    if (own := setting(spark, f"request.jwt.claim.{name}")) is not None:
        return own
    value = (claims(spark) or {}).get(name)
    return value if value is None or isinstance(value, str) else json.dumps(value)


def claims(spark: SparkSession) -> dict | None:
    try:
        found = json.loads(setting(spark, "request.jwt.claims") or "null")
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


# Extensions.


@dataclass(frozen=True)
class Extension:
    """What a set of functions is called elsewhere. They are part of this library; what is installed is only remembered."""

    name: str
    version: str
    module: str | None
    requires: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    external: bool = False


# Names, versions and requirements.
EXTENSIONS = {
    e.name: e
    for e in (
        Extension("btree_gin", "1.3", None),
        Extension("btree_gist", "1.7", None),
        Extension("citext", "1.6", "tessera.functions.citext", types=("citext",)),
        Extension("cube", "1.5", "tessera.functions.geometry", types=("cube",)),
        Extension("earthdistance", "1.1", "tessera.functions.geometry", requires=("cube",)),
        Extension("fuzzystrmatch", "1.1", "tessera.functions.similarity"),
        Extension("hstore", "1.8", "tessera.functions.collections", types=("hstore",)),
        Extension("intarray", "1.5", "tessera.functions.collections"),
        Extension("ltree", "1.2", "tessera.functions.trees", types=("ltree",)),
        Extension("pg_stat_statements", "1.10", None, external=True),
        Extension("pg_trgm", "1.6", "tessera.functions.similarity"),
        Extension("pgcrypto", "1.3", "tessera.functions.crypto"),
        Extension("plpgsql", "1.0", "tessera.functions.routines"),
        Extension("postgis", "3.4.2", None, external=True),
        Extension("timescaledb", "2.15.2", None, external=True),
        Extension("unaccent", "1.1", "tessera.functions.crypto"),
        Extension("uuid-ossp", "1.1", "tessera.functions.crypto"),
        Extension("vector", "0.8.0", "tessera.functions.vectors", types=("vector",)),
    )
}


def installed(spark: SparkSession) -> list[str]:
    return [n for n in spark.conf.get(_INSTALLED, "plpgsql").split(",") if n]


def create_extension(spark: SparkSession, name: str, if_not_exists: bool = False, cascade: bool = False, version: str | None = None) -> None:
    """Notes an extension as installed; what it requires must be, or comes along with ``cascade``."""
    have, found = installed(spark), EXTENSIONS.get(name)
    if found is None:
        raise NotImplementedError(f"extension {name} is not available")
    if name in have:
        if if_not_exists:
            return
        raise ValueError(f"extension {name} already exists")
    if found.external:
        raise NotImplementedError(f"extension {name} runs on an external server, and none is configured")
    if version is not None and version != found.version:
        raise ValueError(f"extension {name} has no version {version}")
    lacks = [r for r in found.requires if r not in have]
    if lacks and not cascade:
        raise ValueError(f"required extension {lacks[0]} is not installed")
    spark.conf.set(_INSTALLED, ",".join([*have, *lacks, name]))


def drop_extension(spark: SparkSession, name: str, if_exists: bool = False, cascade: bool = False, columns: list[str] = ()) -> None:
    """Notes an extension as gone. Others that require it, and ``columns`` of its types, forbid it; only the first yield to ``cascade``."""
    have = installed(spark)
    if name not in have:
        if if_exists:
            return
        raise ValueError(f"extension {name} does not exist")
    if held := set(columns) & set(EXTENSIONS[name].types):
        raise ValueError(f"cannot drop extension {name} because columns of type {sorted(held)[0]} depend on it")
    above = [n for n in have if name in EXTENSIONS[n].requires]
    if above and not cascade:
        raise ValueError(f"cannot drop extension {name} because extension {above[0]} depends on it")
    spark.conf.set(_INSTALLED, ",".join(n for n in have if n != name and n not in above))


def available_extensions(spark: SparkSession) -> DataFrame:
    """``(name, default_version, installed_version, runtime)``."""
    have = installed(spark)
    rows = [(e.name, e.version, e.version if e.name in have else None, "external" if e.external else "native") for e in EXTENSIONS.values()]
    return spark.createDataFrame(rows, "name string, default_version string, installed_version string, runtime string")


# Statements and functions.


def statement(spark: SparkSession, sql: str) -> DataFrame | None:
    """Runs ``SET``, ``SHOW``, ``RESET``, ``CREATE EXTENSION`` or ``DROP EXTENSION``; None for any other text."""
    text = sql.strip().rstrip(";").strip()
    if m := re.fullmatch(r"(?is)set\s+(?:session\s+|local\s+)?([\w.]+)\s*(?:=|\bto\b)\s*(.+)", text):
        value = m[2].strip()
        set_config(spark, m[1], value[1:-1].replace("''", "'") if value[:1] in "'\"" else value)
        return _status(spark, "SET")
    if m := re.fullmatch(r"(?is)show\s+([\w.]+)", text):
        return spark.createDataFrame([(setting(spark, m[1], missing_ok=False),)], f"`{m[1].lower()}` string")
    if m := re.fullmatch(r"(?is)reset\s+([\w.]+)", text):
        reset(spark, m[1])
        return _status(spark, "RESET")
    if m := re.fullmatch(r"(?is)create\s+extension\s+(if\s+not\s+exists\s+)?\"?([\w-]+)\"?(?:\s+with)?(?:\s+schema\s+\w+)?(?:\s+version\s+'?([\w.]+)'?)?(\s+cascade)?", text):
        create_extension(spark, m[2].lower(), bool(m[1]), bool(m[4]), m[3])
        return _status(spark, "CREATE EXTENSION")
    if m := re.fullmatch(r"(?is)drop\s+extension\s+(if\s+exists\s+)?\"?([\w-]+)\"?(?:\s+(cascade|restrict))?", text):
        drop_extension(spark, m[2].lower(), bool(m[1]), (m[3] or "").lower() == "cascade")
        return _status(spark, "DROP EXTENSION")
    return None


def _status(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "status string")


_TRUE = "pg_table_is_visible|pg_type_is_visible|pg_is_in_recovery|pg_function_is_visible|has_schema_privilege|has_table_privilege|has_database_privilege|has_column_privilege"
_AS_TEXT = "pg_get_expr|pg_get_constraintdef|pg_get_indexdef|pg_get_viewdef|pg_get_functiondef"
_NONE = "obj_description|col_description|shobj_description"


def session_functions(spark: SparkSession, text: str, literal: Callable[[str], str | None], mark: Callable[[str], str]) -> str:
    """A query's text with the functions of the session as their values, which are the same for every row.

    ``literal`` reads what a word of the text stands for, ``mark`` makes a word for a value.
    """
    value = lambda v: "CAST(NULL AS STRING)" if v is None else mark(v)
    user, database = setting(spark, "user"), setting(spark, "database")
    schema = (setting(spark, "search_path") or "public").split(",")[0].strip()
    uid = claim(spark, "sub") or None
    if uid is not None and re.search(r"(?i)\bauth\.uid\s*\(", text):
        uid = str(uuid.UUID(uid))  # an error for another text
    known = claims(spark)
    for name, found in (
        ("auth\\.uid", uid),
        ("auth\\.role", claim(spark, "role") or None),
        ("auth\\.jwt", json.dumps(known) if known is not None else None),
        ("current_schema", schema),
        ("current_database", database),
        ("version", "PostgreSQL 15.0 (Tessera)"),
    ):
        text = re.sub(rf"(?i)(?<![\w.]){name}\s*\(\s*\)", lambda m, found=found: value(found), text)
    text = re.sub(r"(?i)(?<![\w.])(current_user|session_user)\b(\s*\(\s*\))?", lambda m: value(user), text)
    text = re.sub(r"(?i)(?<![\w.])current_catalog\b", lambda m: value(database), text)
    text = re.sub(r"(?i)(?<![\w.])pg_backend_pid\s*\(\s*\)", "1", text)

    def call(names: str, change: Callable[[list[str]], str]) -> None:
        nonlocal text
        while m := re.search(rf"(?i)(?<![\w.])({names})\s*\(([^()]*)\)", text):
            text = text[: m.start()] + change([a.strip() for a in m[2].split(",")]) + text[m.end() :]

    call(_TRUE, lambda a: "true")
    call(_AS_TEXT, lambda a: f"CAST({a[0]} AS STRING)")
    call(_NONE, lambda a: "CAST(NULL AS STRING)")
    call("pg_get_userbyid", lambda a: value(user))
    call("pg_encoding_to_char", lambda a: value("UTF8"))
    call("format_type", lambda a: "CASE " + a[0] + "".join(f" WHEN {k} THEN {mark(n)}" for k, n in TYPE_NAMES.items()) + f" ELSE {mark('-')} END")
    call("set_config", lambda a: value(set_config(spark, literal(a[0]), literal(a[1]) or "")))
    call("current_setting", lambda a: value(setting(spark, literal(a[0]), len(a) > 1 and a[1].lower() == "true")))
    return text
