"""Schema changes as functions from a table to the next one, and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.types import round_half_away, spark_type

_WHOLE = ("smallint", "int", "bigint")


def add_column(df: DataFrame, name: str, kind: str, default: Column | None = None) -> DataFrame:
    """A new last column; rows there are get its default."""
    if name in df.columns:
        raise ValueError(f"column {name} already exists")
    return df.withColumn(name, (F.lit(None) if default is None else default).cast(spark_type(kind)))


def drop_column(df: DataFrame, name: str, if_exists: bool = False) -> DataFrame:
    if name not in df.columns and not if_exists:
        raise ValueError(f"column {name} does not exist")
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns or new in df.columns:
        raise ValueError(f"cannot rename column {old} to {new}")
    return df.withColumnRenamed(old, new)


def alter_type(df: DataFrame, name: str, kind: str, using: Column | None = None) -> DataFrame:
    """A column in another type; numbers become whole numbers by rounding."""
    target = spark_type(kind)
    value = F.col(name) if using is None else using
    if target in _WHOLE and df.schema[name].dataType.typeName() in ("double", "float", "decimal"):
        value = round_half_away(value.cast("double"))
    return df.withColumn(name, value.cast(target))


def set_not_null(df: DataFrame, name: str) -> DataFrame:
    """The same table; an error if the column holds a null."""
    if not df.where(F.col(name).isNull()).isEmpty():
        raise ValueError(f"column {name} contains null values")
    return df


def create_view(df: DataFrame, name: str, replace: bool = True) -> None:
    (df.createOrReplaceTempView if replace else df.createTempView)(name)


def drop_view(spark: SparkSession, name: str, if_exists: bool = True) -> None:
    if not spark.catalog.dropTempView(name) and not if_exists:
        raise ValueError(f"view {name} does not exist")


def create_table_as(df: DataFrame, name: str, by: tuple[str, ...] = (), buckets: int = 0, keys: tuple[str, ...] = ()) -> None:
    """A managed Parquet table, in folders by columns or in buckets by keys, whose joins on these need no shuffle."""
    writer = df.write.partitionBy(*by) if by else df.write
    (writer.bucketBy(buckets, *keys).sortBy(*keys) if buckets else writer).saveAsTable(name)


def explain(df: DataFrame, mode: str = "formatted") -> DataFrame:
    """The plan as rows of text."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
    return df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"))], "line int, plan string")
