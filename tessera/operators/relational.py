"""Joins, ordering, paging, top-k and set operations with PostgreSQL semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def ordering(*keys: str) -> list[Column]:
    """Sort columns of ``"name"``, ``"name desc"``, ``"name asc nullsfirst"``: nulls are the largest unless said."""
    out = []
    for key in keys:
        name, *words = key.lower().split() if " " in key else [key]
        name = key.split()[0]
        down = "desc" in words
        first = "nullsfirst" in words or (down and "nullslast" not in words)
        c = F.col(name)
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*ordering(*keys))


def limit_offset(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Negative numbers count as 0."""
    df = df.offset(max(offset, 0)) if offset > 0 else df
    return df if limit is None else df.limit(max(limit, 0))


def after(df: DataFrame, keys: list[str], values: list) -> DataFrame:
    """Rows whose keys are beyond the values in ascending order, key by key: the next page."""
    return df.where(beyond(keys, values))


def beyond(keys: list[str], values: list, descending: bool = False) -> Column:
    out = F.lit(False)
    for i in range(len(keys) - 1, -1, -1):
        c, v = F.col(keys[i]), F.lit(values[i])
        out = ((c < v) if descending else (c > v)) | ((c == v) & out)
    return out


def page(df: DataFrame, keys: list[str], size: int, cursor: list | None = None) -> DataFrame:
    """One row more than a page in key order, so that the caller sees whether there is a next."""
    rows = after(df, keys, cursor) if cursor else df
    return order_by(rows, *keys).limit(size + 1)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on all common columns; a cross join if there are none."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how) if common else left.crossJoin(right)


def not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows of ``x NOT IN (subquery)``: none if the subquery holds a null, and null never qualifies unless it is empty.

    Whether there is a null is found once, so that the join is one of equality, of any size on either side.
    """
    v = values.select(F.col(values.columns[0]).alias("__v"))
    facts = v.agg(F.count("*").alias("__n"), F.coalesce(F.bool_or(F.col("__v").isNull()), F.lit(False)).alias("__null"))
    able = df.crossJoin(F.broadcast(facts)).where((F.col("__n") == 0) | (~F.col("__null") & F.col(column).isNotNull())).drop("__n", "__null")  # facts is one row
    return able.join(v, F.col(column) == F.col("__v"), "left_anti")


def in_subquery(df: DataFrame, column: str, values: DataFrame, name: str) -> DataFrame:
    """Adds ``x IN (subquery)`` with three values of truth."""
    v = values.select(F.col(values.columns[0]).alias("__v"))
    facts = v.agg(F.count("*").alias("__n"), F.coalesce(F.bool_or(F.col("__v").isNull()), F.lit(False)).alias("__has_null"))
    hits = v.where("__v is not null").distinct().withColumn("__hit", F.lit(True))
    out = df.join(hits, F.col(column) == F.col("__v"), "left").crossJoin(F.broadcast(facts))  # facts is one row
    truth = F.when(F.col("__n") == 0, False).when(F.col("__hit"), True).when(F.col(column).isNull() | F.col("__has_null"), None).otherwise(False)
    return out.withColumn(name, truth).drop("__v", "__hit", "__n", "__has_null")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points within ``low <= point <= high``, by equality of buckets of a width: ranges go to every bucket that they touch."""
    p = points.withColumn("__b", F.floor(F.col(point) / width))
    r = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "__b").where(F.col(point).between(F.col(low), F.col(high))).drop("__b")


def _matched(left: DataFrame, right: DataFrame) -> Column:
    out = F.lit(True)
    for a, b in zip(left.columns, right.columns, strict=True):
        out &= F.col(f"__l.{a}").eqNullSafe(F.col(f"__r.{b}"))
    return out


def intersect_all_members(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row that the right has too, as often as the left has it (not the standard's bag semantics: ``intersectAll``)."""
    return left.alias("__l").join(right.alias("__r"), _matched(left, right), "left_semi")


def except_all_members(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row that the right hasn't (not the standard's bag semantics: ``exceptAll``)."""
    return left.alias("__l").join(right.alias("__r"), _matched(left, right), "left_anti")


def first_of_each(df: DataFrame, by: list[str], *keys: str) -> DataFrame:
    """The first row in order of each group."""
    w = Window.partitionBy(*by).orderBy(*ordering(*keys))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_of_each(df: DataFrame, by: list[str], n: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*ordering(*keys))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def window(partition: list[str] = (), order: list[str] = (), rows: tuple[int | None, int | None] | None = None) -> WindowSpec:
    """A window: no order makes all rows peers; ``rows`` bounds a frame, None being unbounded, else the default frame holds."""
    w = Window.partitionBy(*partition)
    w = w.orderBy(*ordering(*order)) if order else w.orderBy(F.lit(1))
    if rows:
        low, high = rows
        w = w.rowsBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)
    return w


def named_windows(**given: dict) -> dict[str, WindowSpec]:
    """Named windows; one with ``base`` refines another, adding an order or a frame that the other hasn't."""
    full: dict[str, dict] = {}
    for name, spec in given.items():
        base = full[spec["base"]] if "base" in spec else {}
        if base and "partition" in spec:
            raise ValueError(f"cannot override PARTITION BY clause of window {spec['base']}")
        if base.get("order") and spec.get("order"):
            raise ValueError(f"cannot override ORDER BY clause of window {spec['base']}")
        if base.get("rows"):
            raise ValueError(f"cannot copy window {spec['base']} because it has a frame clause")
        full[name] = base | {k: v for k, v in spec.items() if k != "base"}
    return {name: window(**spec) for name, spec in full.items()}


def filtered(aggregate, value: Column, condition: Column) -> Column:
    """``aggregate(value) FILTER (WHERE condition)``, also usable over a window."""
    return aggregate(F.when(condition, value))


def ordered_list(value: Column, *order: Column) -> Column:
    """The non-null values of a group as an array, in an order."""
    item = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), item))), lambda x: x["v"])


def ordered_text(value: Column, separator: str, *order: Column) -> Column:
    """The non-null values of a group joined, in an order; null for none."""
    items = ordered_list(value.cast("string"), *order)
    return F.when(F.size(items) > 0, F.array_join(items, separator))


def exact_avg(value: Column) -> Column:
    """The mean of whole numbers as a decimal."""
    return F.avg(value.cast("decimal(28,10)"))
