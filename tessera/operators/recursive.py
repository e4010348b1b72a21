"""Recursive common table expressions with UNION, as a fixpoint over checkpointed steps."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The guards of a recursion.
MOST_ROUNDS, MOST_ROWS = 100_000, 10_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """A copy in the folder that the cluster shares; a folder of our own only in local mode, where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def recurse(base: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, most_rounds: int = MOST_ROUNDS, most_rows: int = MOST_ROWS) -> DataFrame:
    """``base UNION [ALL] step(new rows)`` until no row is new.

    With ``distinct`` rows found before don't count as new, so cycles end. Each round runs one job: an anti
    join of the step's rows with all rows so far, both partitioned by the rows' values.
    """
    columns = base.columns
    new = checkpointed(base.distinct() if distinct else base)
    found, total = new, new.count()
    for _ in range(most_rounds):
        rows = step(new).toDF(*columns)
        if distinct:
            rows = rows.distinct().alias("n").join(found.alias("o"), [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in columns], "left_anti")
        new = checkpointed(rows)
        if not (n := new.count()):
            return found
        total += n
        if total > most_rows:
            raise RuntimeError(f"recursive query exceeds {most_rows} rows")
        found = checkpointed(found.unionByName(new)) if distinct else found.unionByName(new)
    raise RuntimeError(f"recursive query exceeds {most_rounds} rounds")


def validate_recursive_term(sql: str, name: str) -> None:
    """Raises for a recursive term that SQL forbids."""
    text = re.sub(r"'(?:[^']|'')*'", "''", sql)
    own = rf"\b{re.escape(name)}\b"
    froms = len(re.findall(rf"(?i)\b(?:from|join)\s+{own}|,\s*{own}(?=\s*(?:,|where|join|on|$))", text))
    if froms != 1:
        raise ValueError(f"recursive reference to {name} must appear exactly once in FROM")
    if re.search(rf"(?is)\(\s*select\b[^()]*{own}", text):
        raise ValueError(f"recursive reference to {name} must not appear within a subquery")
    if re.search(rf"(?i)left\s+(outer\s+)?join\s+{own}|full\s+(outer\s+)?join", text) or re.search(rf"(?i){own}(\s+(as\s+)?\w+)?\s+right\s+(outer\s+)?join", text):
        raise ValueError(f"recursive reference to {name} must not appear within an outer join")
    if re.search(r"(?i)\b(count|sum|avg|min|max|array_agg|string_agg|bool_and|bool_or)\s*\(", text):
        raise ValueError("aggregate functions are not allowed in a recursive query's recursive term")
    for clause in ("group by", "order by", "limit", "distinct"):
        if re.search(rf"(?i)\b{clause.replace(' ', r'\s+')}\b", text):
            raise ValueError(f"{clause.upper()} is not allowed in a recursive query's recursive term")


def recurse_sql(spark: SparkSession, name: str, base: str, term: str, distinct: bool = True) -> DataFrame:
    """``WITH RECURSIVE name AS (base UNION [ALL] term)`` for SQL texts."""
    validate_recursive_term(term, name)

    def step(new: DataFrame) -> DataFrame:
        new.createOrReplaceTempView(name)
        return spark.sql(term)

    return recurse(spark.sql(base), step, distinct)
