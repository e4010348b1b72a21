"""Inserts, updates, deletes and merges as functions from a table to the next one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Change:
    """A table after a statement, and the rows that RETURNING gives."""

    table: DataFrame
    returning: DataFrame


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> Change:
    """Appends rows; columns they lack get their default or null."""
    extra = set(rows.columns) - set(table.columns)
    if extra:
        raise ValueError(f"columns {sorted(extra)} do not exist")
    defaults = defaults or {}
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in table.schema])
    return Change(table.unionByName(full), full)


def update(table: DataFrame, where: Column, assign: dict[str, Column]) -> Change:
    """Sets columns of the rows whose condition is true."""
    hit = F.coalesce(where, F.lit(False))
    marked = table.withColumn("__hit", hit)
    done = marked.select(*[F.when(F.col("__hit"), assign[c].cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in table.columns], "__hit")
    return Change(done.drop("__hit"), done.where("__hit").drop("__hit"))


def delete(table: DataFrame, where: Column) -> Change:
    """Drops the rows whose condition is true."""
    hit = F.coalesce(where, F.lit(False))
    return Change(table.where(~hit), table.where(hit))


def truncate(table: DataFrame, referencing: dict[str, DataFrame] | None = None) -> Change:
    """No rows; an error if another table with rows refers to this one."""
    for name, child in (referencing or {}).items():
        if not child.isEmpty():
            raise ValueError(f"cannot truncate a table referenced in a foreign key constraint of {name}")
    return Change(table.limit(0), table.limit(0))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], assign: dict[str, Column] | None = None, where: Column | None = None) -> Change:
    """``INSERT ... ON CONFLICT (keys) DO NOTHING`` or ``DO UPDATE SET``.

    ``assign`` and ``where`` see the table's columns, and those of the new row as ``excluded.*``. Of new
    rows with one key the first counts when nothing is updated; an update by several is an error. A null
    key never conflicts.
    """
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    some = full.where(whole)
    if assign is not None and not some.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("ON CONFLICT DO UPDATE command cannot affect row a second time")
    once = some.dropDuplicates(keys).unionByName(full.where(~whole))
    same = [F.col(f"t.{k}") == F.col(f"excluded.{k}") for k in keys]
    fresh = once.alias("excluded").join(table.alias("t"), same, "left_anti")
    if assign is None:
        return Change(table.unionByName(fresh), fresh)
    joined = table.withColumn("__in", F.lit(True)).alias("t").join(once.withColumn("__new", F.lit(True)).alias("excluded"), same, "left")
    hit = F.col("excluded.__new").isNotNull() & F.coalesce(where if where is not None else F.lit(True), F.lit(False))
    done = joined.select(*[F.when(hit, assign[c].cast(table.schema[c].dataType)).otherwise(F.col(f"t.{c}")).alias(c) if c in assign else F.col(f"t.{c}").alias(c) for c in table.columns], hit.alias("__hit"))
    return Change(done.drop("__hit").unionByName(fresh), done.where("__hit").drop("__hit").unionByName(fresh))


# Constraints: each function gives the rows that violate it.


def violates_not_null(table: DataFrame, *columns: str) -> DataFrame:
    out = F.lit(False)
    for c in columns:
        out |= F.col(c).isNull()
    return table.where(out)


def violates_check(table: DataFrame, condition: Column) -> DataFrame:
    """A check fails only where it is false; null passes."""
    return table.where(~F.coalesce(condition, F.lit(True)))


def violates_unique(table: DataFrame, *columns: str) -> DataFrame:
    """Keys that occur twice, with their counts; keys with a null never clash."""
    rows = table
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str], match: str = "simple") -> DataFrame:
    """Rows whose foreign key has no parent. Keys with a null pass; under ``full`` a partly null key doesn't."""
    some, every = F.lit(False), F.lit(True)
    for c in columns:
        some |= F.col(c).isNull()
        every &= F.col(c).isNull()
    whole = child.where(~some)
    lost = whole.alias("c").join(parent.alias("p"), [F.col(f"c.{a}") == F.col(f"p.{b}") for a, b in zip(columns, keys, strict=True)], "left_anti")
    return lost.unionByName(child.where(some & ~every)) if match == "full" else lost


def delete_with_children(parent: DataFrame, where: Column, child: DataFrame, columns: list[str], keys: list[str], action: str = "no action", default: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables after a delete from the parent: ``cascade``, ``set null``, ``set default``, ``restrict`` or ``no action``."""
    change = delete(parent, where)
    on = [F.col(f"c.{a}") == F.col(f"p.{b}") for a, b in zip(columns, keys, strict=True)]
    gone = change.returning.select(*keys).distinct()
    hit = child.alias("c").join(gone.alias("p"), on, "left_semi")
    if action in ("restrict", "no action"):
        if not hit.isEmpty():
            raise ValueError("update or delete on table violates foreign key constraint")
        return change.table, child
    rest = child.alias("c").join(gone.alias("p"), on, "left_anti")
    if action == "cascade":
        return change.table, rest
    new = hit.withColumns({c: (default or {}).get(c, F.lit(None)).cast(child.schema[c].dataType) if action == "set default" else F.lit(None).cast(child.schema[c].dataType) for c in columns})
    return change.table, rest.unionByName(new)


# Row-level security.


@dataclass
class Policy:
    """Rows that a role may see (``using``) or write (``check``); permissive ones are joined by OR, restrictive by AND."""

    using: Column
    check: Column | None = None
    permissive: bool = True
    command: str = "all"
    roles: tuple[str, ...] = ("public",)


def visible(policies: list[Policy], command: str = "select", role: str = "public", writing: bool = False) -> Column:
    """One condition for a role and a command; without a permissive policy nothing is visible."""
    mine = [p for p in policies if p.command in ("all", command) and ({"public", role} & set(p.roles))]
    part = lambda p: F.coalesce(p.check if writing and p.check is not None else p.using, F.lit(False))
    open_, strict = F.lit(False), F.lit(True)
    for p in mine:
        if p.permissive:
            open_ |= part(p)
        else:
            strict &= part(p)
    return open_ & strict


def secured(table: DataFrame, policies: list[Policy], command: str = "select", role: str = "public", bypass: bool = False) -> DataFrame:
    return table if bypass else table.where(visible(policies, command, role))


def check_rows(rows: DataFrame, policies: list[Policy], command: str = "insert", role: str = "public") -> DataFrame:
    """The rows to write; an error if a policy forbids one."""
    if not rows.where(~visible(policies, command, role, True)).isEmpty():
        raise PermissionError("new row violates row-level security policy")
    return rows


# Triggers.


@dataclass
class Trigger:
    """What runs ``before``, ``after`` or ``instead of`` a statement.

    At the level of rows it is a function of the statement's rows, those where its condition holds; what it
    returns before a change takes their place, so that rows it leaves out aren't changed. At the level of the
    statement it is called once, with the event's name.
    """

    when: str
    events: tuple[str, ...]
    function: callable
    condition: Column | None = None
    level: str = "row"


def fire(triggers: list[Trigger], when: str, event: str, rows: DataFrame) -> DataFrame:
    """The rows as the triggers leave them; those outside a trigger's condition pass by it."""
    for t in (t for t in triggers if t.level == "row" and t.when == when and event in t.events):
        if t.condition is None:
            rows = t.function(rows)
        else:
            hit = F.coalesce(t.condition, F.lit(False))
            rows = t.function(rows.where(hit)).unionByName(rows.where(~hit))
    return rows


def _announce(triggers: list[Trigger], when: str, event: str) -> None:
    for t in triggers:
        if t.level == "statement" and t.when == when and event in t.events:
            t.function(event)


def statement(table: DataFrame, event: str, triggers: list[Trigger], rows: DataFrame | None = None, where: Column | None = None, assign: dict[str, Column] | None = None) -> Change:
    """An insert of ``rows``, an update, a delete or a truncate with its triggers, those of the statement around those of the rows.

    ``instead of`` triggers take the rows, and the table stays as it is. Triggers after the change see its rows;
    an error of any is an error of the statement.
    """
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    _announce(triggers, "before", event)
    if event == "truncate":
        change = truncate(table)
    else:
        old = table.where(hit)
        new = rows if event == "insert" else update(old, F.lit(True), assign).table if event == "update" else old
        if any(t.when == "instead of" and event in t.events for t in triggers):
            return Change(table, fire(triggers, "instead of", event, new))
        done = fire(triggers, "before", event, new)
        if event == "insert":
            change = insert(table, done)
        elif event == "update":
            change = Change(table.where(~hit).unionByName(done), done)
        else:
            change = Change(table.where(~hit).unionByName(old.exceptAll(done)), done)
        fire(triggers, "after", event, change.returning)
    _announce(triggers, "after", event)
    return change
