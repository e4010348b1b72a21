"""A catalog of tables, keys and views, and the introspection views and GraphQL schema that follow from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.functions import context


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    keys: tuple[str, ...]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    match: str = "NONE"


@dataclass(frozen=True)
class Table:
    """A table's columns and constraints; a primary key's columns are not null."""

    name: str
    columns: T.StructType
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict, hash=False)
    indexes: tuple[tuple[str, tuple[str, ...]], ...] = ()
    namespace: str = "public"

    def constraints(self) -> list[tuple[str, str, tuple[str, ...], ForeignKey | str | None]]:
        """``(name, kind, columns, detail)``, named as they are when no name is given."""
        out: list = [(f"{self.name}_pkey", "PRIMARY KEY", self.primary_key, None)] if self.primary_key else []
        out += [(f"{self.name}_{'_'.join(c)}_key", "UNIQUE", c, None) for c in self.unique]
        out += [(f"{self.name}_{'_'.join(k.columns)}_fkey", "FOREIGN KEY", k.columns, k) for k in self.foreign_keys]
        return out + [(f"{self.name}_check{i or ''}", "CHECK", (), c) for i, c in enumerate(self.checks)]

    def nullable(self, column: str) -> bool:
        return self.columns[column].nullable and column not in self.primary_key


def type_name(kind: T.DataType) -> str:
    """The PostgreSQL name of a Spark type."""
    if isinstance(kind, T.ArrayType):
        return "ARRAY"
    if isinstance(kind, T.DecimalType):
        return "numeric"
    names = {"tinyint": "smallint", "smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double precision", "string": "text", "binary": "bytea", "boolean": "boolean", "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone", "variant": "jsonb"}
    return names.get(kind.simpleString(), "USER-DEFINED")


#: Columns of the views of ``information_schema``.
_INFORMATION = {
    "tables": "table_catalog string, table_schema string, table_name string, table_type string, is_insertable_into string",
    "columns": "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string",
    "schemata": "catalog_name string, schema_name string, schema_owner string",
    "table_constraints": "constraint_catalog string, constraint_schema string, constraint_name string, table_schema string, table_name string, constraint_type string",
    "key_column_usage": "constraint_schema string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int, position_in_unique_constraint int",
    "constraint_column_usage": "table_schema string, table_name string, column_name string, constraint_schema string, constraint_name string",
    "referential_constraints": "constraint_schema string, constraint_name string, unique_constraint_schema string, unique_constraint_name string, match_option string, update_rule string, delete_rule string",
    "views": "table_catalog string, table_schema string, table_name string, view_definition string, is_updatable string",
}
#: Columns of the views of ``pg_catalog``; those without rows here are always empty.
_PG = {
    "pg_namespace": "oid int, nspname string",
    "pg_class": "oid int, relname string, relnamespace int, relkind string, relnatts int",
    "pg_attribute": "attrelid int, attname string, atttypid int, attnum int, attnotnull boolean",
    "pg_attrdef": "adrelid int, adnum int, adbin string",
    "pg_type": "oid int, typname string",
    "pg_constraint": "oid int, conname string, contype string, conrelid int, confrelid int, conkey array<int>, confkey array<int>",
    "pg_index": "indrelid int, indexname string, indisprimary boolean, indisunique boolean, indkey array<int>",
    "pg_indexes": "schemaname string, tablename string, indexname string, indexdef string",
    "pg_tables": "schemaname string, tablename string, tableowner string",
    "pg_database": "oid int, datname string",
    "pg_roles": "oid int, rolname string, rolsuper boolean",
    "pg_extension": "oid int, extname string, extversion string",
    "pg_available_extensions": "name string, default_version string, installed_version string, runtime string",
    "pg_am": "oid int, amname string",
    "pg_description": "objoid int, classoid int, objsubid int, description string",
    "pg_enum": "oid int, enumtypid int, enumsortorder float, enumlabel string",
    "pg_collation": "oid int, collname string, collnamespace int",
    "pg_settings": "name string, setting string",
    "pg_inherits": "inhrelid int, inhparent int, inhseqno int",
    "pg_locks": "locktype string, relation string, mode string, granted boolean, pid int",
}


class Catalog:
    """Tables and views by name. It lives on the driver, as big as the schema is, however big the tables are."""

    def __init__(self, tables: list[Table] = (), views: dict[str, str] | None = None, database: str = "tessera", owner: str = "tessera"):
        self.tables, self.views, self.database, self.owner = {t.name: t for t in tables}, dict(views or {}), database, owner

    @classmethod
    def of_session(cls, spark: SparkSession, **known: Table) -> Catalog:
        """The tables and temporary views of a session; ``known`` says more of some of them."""
        names = [t.name for t in spark.catalog.listTables() if not t.name.startswith("__")]
        return cls([known.get(n) or Table(n, spark.table(n).schema) for n in names])

    def _oid(self, table: str) -> int:
        return 16384 + list(self.tables).index(table)

    def _position(self, table: str, column: str) -> int:
        return self.tables[table].columns.names.index(column) + 1

    def _schemas(self) -> list[str]:
        return sorted({t.namespace for t in self.tables.values()} | {"public", "information_schema", "pg_catalog"})

    def information_schema(self, spark: SparkSession, view: str) -> DataFrame:
        rows, db, ts = [], self.database, list(self.tables.values())
        if view == "tables":
            rows = [(db, t.namespace, t.name, "BASE TABLE", "YES") for t in ts] + [(db, "public", v, "VIEW", "NO") for v in self.views]
        elif view == "columns":
            rows = [(db, t.namespace, t.name, f.name, i, t.defaults.get(f.name), "YES" if t.nullable(f.name) else "NO", type_name(f.dataType)) for t in ts for i, f in enumerate(t.columns, 1)]
        elif view == "schemata":
            rows = [(db, s, self.owner) for s in self._schemas()]
        elif view == "table_constraints":
            rows = [(db, t.namespace, n, t.namespace, t.name, kind) for t in ts for n, kind, _, _ in t.constraints()]
        elif view == "key_column_usage":
            rows = [(t.namespace, n, t.namespace, t.name, c, i, i if isinstance(more, ForeignKey) else None) for t in ts for n, kind, cs, more in t.constraints() if kind != "CHECK" for i, c in enumerate(cs, 1)]
        elif view == "constraint_column_usage":
            for t in ts:
                for n, kind, cs, more in t.constraints():
                    to, used = (self.tables[more.table], more.keys) if isinstance(more, ForeignKey) else (t, cs)
                    rows += [(to.namespace, to.name, c, t.namespace, n) for c in used]
        elif view == "referential_constraints":
            for t in ts:
                for n, _, _, more in t.constraints():
                    if isinstance(more, ForeignKey):
                        to = self.tables[more.table]
                        target = next((m for m, kind, cs, _ in to.constraints() if kind in ("PRIMARY KEY", "UNIQUE") and cs == more.keys), None)
                        rows.append((t.namespace, n, to.namespace, target, more.match, more.on_update, more.on_delete))
        elif view == "views":
            rows = [(db, "public", v, text, "NO") for v, text in self.views.items()]
        else:
            raise ValueError(f"relation information_schema.{view} does not exist")
        return spark.createDataFrame(rows, _INFORMATION[view])

    def pg_catalog(self, spark: SparkSession, view: str) -> DataFrame:
        if view not in _PG:
            raise ValueError(f"relation pg_catalog.{view} does not exist")
        if view == "pg_available_extensions":
            return context.available_extensions(spark)
        return spark.createDataFrame(getattr(self, f"_{view}", lambda spark: [])(spark), _PG[view])

    def _pg_namespace(self, spark: SparkSession) -> list:
        return [(i, s) for i, s in enumerate(self._schemas(), 11)]

    def _pg_class(self, spark: SparkSession) -> list:
        space = {s: i for i, s in enumerate(self._schemas(), 11)}
        return [(self._oid(t.name), t.name, space[t.namespace], "r", len(t.columns)) for t in self.tables.values()]

    def _pg_attribute(self, spark: SparkSession) -> list:
        types = {v: k for k, v in context.TYPE_NAMES.items()}
        return [(self._oid(t.name), f.name, types.get(type_name(f.dataType), 0), i, not t.nullable(f.name)) for t in self.tables.values() for i, f in enumerate(t.columns, 1)]

    def _pg_attrdef(self, spark: SparkSession) -> list:
        return [(self._oid(t.name), self._position(t.name, c), d) for t in self.tables.values() for c, d in t.defaults.items()]

    def _pg_type(self, spark: SparkSession) -> list:
        return list(context.TYPE_NAMES.items())

    def _pg_constraint(self, spark: SparkSession) -> list:
        rows, code = [], {"PRIMARY KEY": "p", "UNIQUE": "u", "FOREIGN KEY": "f", "CHECK": "c"}
        for t in self.tables.values():
            for n, kind, cs, more in t.constraints():
                to = (self._oid(more.table), [self._position(more.table, k) for k in more.keys]) if isinstance(more, ForeignKey) else (0, None)
                rows.append((32768 + len(rows), n, code[kind], self._oid(t.name), to[0], [self._position(t.name, c) for c in cs], to[1]))
        return rows

    def _indexes(self) -> list[tuple[Table, str, tuple[str, ...], bool, bool]]:
        keys = [(t, n, cs, kind == "PRIMARY KEY", True) for t in self.tables.values() for n, kind, cs, _ in t.constraints() if kind in ("PRIMARY KEY", "UNIQUE")]
        return keys + [(t, n, cs, False, False) for t in self.tables.values() for n, cs in t.indexes]

    def _pg_index(self, spark: SparkSession) -> list:
        return [(self._oid(t.name), n, first, only, [self._position(t.name, c) for c in cs]) for t, n, cs, first, only in self._indexes()]

    def _pg_indexes(self, spark: SparkSession) -> list:
        return [(t.namespace, t.name, n, f"CREATE {'UNIQUE ' * only}INDEX {n} ON {t.namespace}.{t.name} USING btree ({', '.join(cs)})") for t, n, cs, _, only in self._indexes()]

    def _pg_tables(self, spark: SparkSession) -> list:
        return [(t.namespace, t.name, self.owner) for t in self.tables.values()]

    def _pg_database(self, spark: SparkSession) -> list:
        return [(1, self.database)]

    def _pg_roles(self, spark: SparkSession) -> list:
        return [(10, self.owner, True)]

    def _pg_extension(self, spark: SparkSession) -> list:
        return [(i, n, context.EXTENSIONS[n].version) for i, n in enumerate(context.installed(spark), 1)]

    def _pg_am(self, spark: SparkSession) -> list:
        return [(403, "btree"), (405, "hash"), (16000, "hnsw")]

    def graphql_schema(self, spark: SparkSession) -> DataFrame:
        """``(type, kind, field, field_type)``: the types that GraphQL introspection shows, of tables with a primary key."""
        scalars = {"smallint": "Int", "integer": "Int", "bigint": "BigInt", "real": "Float", "double precision": "Float", "numeric": "BigFloat", "boolean": "Boolean", "uuid": "UUID", "date": "Date", "timestamp with time zone": "Datetime", "timestamp without time zone": "Datetime", "jsonb": "JSON"}
        rows, shown = [], [t for t in self.tables.values() if t.primary_key]
        names = {t.name for t in shown}
        for t in shown:
            own = [(f.name, scalars.get(type_name(f.dataType), "String"), t.nullable(f.name)) for f in t.columns]
            rows += [(t.name, "OBJECT", "nodeId", "ID!")] + [(t.name, "OBJECT", c, k if free else f"{k}!") for c, k, free in own]
            rows += [(t.name, "OBJECT", k.table, k.table) for k in t.foreign_keys if k.table in names]
            rows += [(t.name, "OBJECT", f"{o.name}Collection", f"{o.name}Connection") for o in shown for k in o.foreign_keys if k.table == t.name]
            rows += [(f"{t.name}Connection", "OBJECT", f, k) for f, k in (("edges", f"[{t.name}Edge!]!"), ("pageInfo", "PageInfo!"), ("totalCount", "Int!"))]
            rows += [(f"{t.name}Edge", "OBJECT", f, k) for f, k in (("cursor", "String!"), ("node", f"{t.name}!"))]
            rows += [(f"{t.name}Filter", "INPUT_OBJECT", c, f"{k}Filter") for c, k, _ in own] + [(f"{t.name}Filter", "INPUT_OBJECT", x, f"[{t.name}Filter!]" if x != "not" else f"{t.name}Filter") for x in ("and", "or", "not")]
            rows += [(f"{t.name}OrderBy", "INPUT_OBJECT", c, "OrderByDirection") for c, _, _ in own]
            rows += [(f"{t.name}{x}Input", "INPUT_OBJECT", c, k) for x in ("Insert", "Update") for c, k, _ in own]
            rows += [("Query", "OBJECT", f"{t.name}Collection", f"{t.name}Connection")]
            rows += [("Mutation", "OBJECT", f"{verb}{t.name}Collection", f"{t.name}{verb.title().removesuffix('From').removesuffix('Into')}Response") for verb in ("insertInto", "update", "deleteFrom")]
        rows += [("OrderByDirection", "ENUM", x, None) for x in ("AscNullsFirst", "AscNullsLast", "DescNullsFirst", "DescNullsLast")]
        return spark.createDataFrame(rows, "type string, kind string, field string, field_type string")
