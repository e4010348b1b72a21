"""Where queries and the SQL that checks them are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import dialect

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, oracle: str | None = None):
    """Registers a query under its name, with the SQL of the same rows."""

    def register(function):
        QUERIES[function.__name__] = function
        if oracle or sql:
            ORACLE_SQL[function.__name__] = oracle or sql
        return function

    return register


def sql_query(name: str, sql: str, spark: str | None = None, oracle: str | None = None) -> None:
    """Registers a query given as PostgreSQL text, which the dialect rewrites; ``spark`` replaces the rewritten text."""

    def run(session: SparkSession, sf_dir: str) -> DataFrame:
        for table in TABLES:
            if table in sql:
                t(session, sf_dir, table).createOrReplaceTempView(table)
        return session.sql(spark) if spark else dialect.query(session, sql)

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or sql
