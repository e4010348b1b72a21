"""Scans and stores: Parquet tables, VALUES, key-value and document stores as append-only folders, introspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.streaming import log

OPS = "key string, op string, value binary, time long, id string, hash string"


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A table; columns and filters reach the Parquet reader."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def point(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """Rows with one value: row groups whose statistics exclude it aren't read."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(value))


def read(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """A file source by format: Parquet, ORC, CSV, JSON or text."""
    return spark.read.format(format).options(**options).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", by: tuple[str, ...] = (), **options: str) -> None:
    """A file sink by format, optionally in a folder for each value of some columns."""
    df.write.format(format).mode(mode).options(**options).partitionBy(*by).save(path)


def values(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``VALUES``: columns ``column1`` and so on."""
    width = max(map(len, rows))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], [f"column{i + 1}" for i in range(width)])


def single_row(spark: SparkSession, **expressions: Column) -> DataFrame:
    """A SELECT without FROM."""
    return spark.range(1).select(*[c.alias(n) for n, c in expressions.items()])


class KeyValueStore:
    """A folder of operations; the last one on a key in causal order counts."""

    def __init__(self, spark: SparkSession, path: str, writer: str = "w"):
        self.spark, self.path, self.writer = spark, path, writer

    def _ops(self) -> DataFrame:
        try:
            return self.spark.read.schema(OPS).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], OPS)

    def write(self, rows: DataFrame, op: str = "PUT") -> None:
        """Appends operations for all rows ``(key[, value])`` under one tick of the clock."""
        if not rows.where("key is null or key = ''" + (" or value is null or length(value) = 0" if op == "PUT" else "")).isEmpty():
            raise ValueError("key and value must not be empty")
        now = log.clock(self._ops()).first().time + 1
        value = F.col("value").cast("binary") if op == "PUT" else F.lit(None).cast("binary")
        new = rows.select("key", F.lit(op).alias("op"), value.alias("value"), F.lit(now).cast("long").alias("time"), F.lit(self.writer).alias("id"))
        new.withColumn("hash", F.sha2(F.concat_ws("\x1f", "key", "op", F.base64("value"), F.col("time").cast("string"), "id"), 256)).write.mode("append").parquet(self.path)

    def put(self, key: str, value: bytes) -> None:
        self.write(self.spark.createDataFrame([(key, value)], "key string, value binary"))

    def delete(self, key: str) -> None:
        self.write(self.spark.createDataFrame([(key,)], "key string"), "DEL")

    def all(self) -> DataFrame:
        return log.last_writes(self._ops())

    def get(self, key: str) -> DataFrame:
        return log.last_writes(self._ops().where(F.col("key") == key))

    def keys(self) -> DataFrame:
        return self.all().select("key")


class DocumentStore(KeyValueStore):
    """Documents as JSON texts by key, each batch under one tick of the clock."""

    def put_batch(self, docs: DataFrame) -> None:
        """Writes ``(key, doc)``; an error for a document that is no JSON object, and then none is written."""
        bad = docs.where("key is null or key = '' or coalesce(schema_of_variant(try_parse_json(doc)), '') not like 'OBJECT%'")
        if not bad.isEmpty():
            raise ValueError("documents must be JSON objects under a key")
        self.write(docs.select("key", F.encode("doc", "UTF-8").alias("value")))

    def put_all(self, docs: DataFrame, size: int) -> None:
        """The same in batches of about ``size`` documents by a hash of their keys, so that a failure leaves whole batches behind."""
        batches = max(1, -(-docs.count() // size))
        for i in range(batches):
            self.put_batch(docs.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == i))

    def delete_batch(self, keys: DataFrame) -> None:
        self.write(keys.select("key"), "DEL")

    def documents(self) -> DataFrame:
        return self.all().select("key", F.decode("value", "UTF-8").alias("doc"))


def documents_by_key(docs: DataFrame, key: str, ignore_case: bool = False, partial: bool = False) -> DataFrame:
    """Documents whose key equals or holds a text; in keys of several words blanks and dots are alike."""
    c, k = F.col("key"), key
    if ignore_case:
        c, k = F.lower(c), k.lower()
    if " " in k or "." in k:
        c, k = F.translate(c, ".", " "), k.replace(".", " ")
    return docs.where(F.contains(c, F.lit(k)) if partial else c == k)


def object_listing(objects: DataFrame, prefix: str = "", search: str = "", sort_by: str = "name", descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """Object metadata under a prefix, of names that hold a text."""
    if sort_by not in ("name", "created_at", "updated_at", "last_accessed_at"):
        raise ValueError(f"cannot sort by {sort_by}")
    rows = objects.where(F.col("name").startswith(prefix) & F.contains(F.lower("name"), F.lit(search.lower())))
    c = F.col(sort_by)
    return rows.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), "name").offset(offset).limit(limit)


def json_rows(df: DataFrame) -> DataFrame:
    """One column ``row`` of JSON objects, nulls kept, as rows go over HTTP."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))


def text_rows(df: DataFrame) -> DataFrame:
    """Every column in text form, as rows go over the wire: booleans as t and f."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(F.col(c), "t").when(~F.col(c), "f").alias(c) if kinds[c] == "boolean" else F.col(c).cast("string").alias(c) for c in df.columns])
