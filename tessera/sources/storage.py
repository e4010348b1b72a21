"""Storage of tables by row id: one interface, in memory and in folders, and transactions over it."""

from __future__ import annotations

import json
import uuid
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: A stored row: its id, and its columns as JSON; a null document is a tombstone.
ROW = "row_id string, doc string"


class TableStorage(Protocol):
    """Rows ``(row_id, doc)`` of tables, and a catalog document; every write makes a new generation."""

    def scan(self, table: str) -> DataFrame: ...
    def get(self, table: str, row_id: str) -> DataFrame: ...
    def put(self, table: str, rows: DataFrame) -> None: ...
    def delete(self, table: str, ids: DataFrame) -> None: ...
    def truncate(self, table: str) -> None: ...
    def load_catalog(self) -> dict: ...
    def save_catalog(self, catalog: dict) -> None: ...
    def generation(self, table: str) -> int: ...


def _merged(old: DataFrame, rows: DataFrame) -> DataFrame:
    """The old rows but for those that come anew."""
    return old.join(rows.select("row_id"), "row_id", "left_anti").unionByName(rows)


class MemoryStorage:
    """Tables as cached DataFrames of one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.catalog, self.generations = spark, {}, {}, {}

    def _set(self, table: str, rows: DataFrame) -> None:
        self.tables[table], self.generations[table] = rows.cache(), self.generation(table) + 1

    def scan(self, table: str) -> DataFrame:
        return self.tables.get(table, self.spark.createDataFrame([], ROW))

    def get(self, table: str, row_id: str) -> DataFrame:
        return self.scan(table).where(F.col("row_id") == row_id)

    def put(self, table: str, rows: DataFrame) -> None:
        self._set(table, _merged(self.scan(table), rows.select("row_id", "doc")))

    def delete(self, table: str, ids: DataFrame) -> None:
        self._set(table, self.scan(table).join(ids.select("row_id"), "row_id", "left_anti"))

    def truncate(self, table: str) -> None:
        self._set(table, self.spark.createDataFrame([], ROW))

    def load_catalog(self) -> dict:
        return self.catalog

    def save_catalog(self, catalog: dict) -> None:
        self.catalog = json.loads(json.dumps(catalog))

    def generation(self, table: str) -> int:
        return self.generations.get(table, 0)


class FolderStorage:
    """Tables as folders of appended batches, one for each generation; of a row the last batch counts, and deletes are tombstones.

    A batch is complete once it is in its folder, so a lost writer leaves no half of one. Copies of a folder
    on several machines merge by union, as batches are never changed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _batches(self, table: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{ROW}, whole boolean, at long").parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{ROW}, whole boolean, at long")

    def _append(self, table: str, rows: DataFrame, whole: bool = False) -> None:
        at = self.generation(table) + 1
        rows.select("row_id", "doc", F.lit(whole).alias("whole"), F.lit(at).cast("long").alias("at")).write.mode("append").parquet(f"{self.path}/{table}")

    def scan(self, table: str) -> DataFrame:
        rows = self._batches(table)
        emptied = rows.where("whole").agg(F.coalesce(F.max("at"), F.lit(0)).alias("since"))
        last = rows.where("not whole").crossJoin(F.broadcast(emptied)).where("at > since").groupBy("row_id").agg(F.max_by("doc", "at").alias("doc"))  # one row
        return last.where("doc is not null")

    def get(self, table: str, row_id: str) -> DataFrame:
        return self.scan(table).where(F.col("row_id") == row_id)

    def put(self, table: str, rows: DataFrame) -> None:
        self._append(table, rows)

    def delete(self, table: str, ids: DataFrame) -> None:
        self._append(table, ids.select("row_id", F.lit(None).cast("string").alias("doc")))

    def truncate(self, table: str) -> None:
        self._append(table, self.spark.createDataFrame([("", None)], ROW), whole=True)

    def load_catalog(self) -> dict:
        found = self.scan("_catalog").where("row_id = 'catalog'").first()
        return json.loads(found.doc) if found else {}

    def save_catalog(self, catalog: dict) -> None:
        self.put("_catalog", self.spark.createDataFrame([("catalog", json.dumps(catalog, sort_keys=True))], ROW))

    def generation(self, table: str) -> int:
        return self._batches(table).agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]


class Transaction:
    """Read committed: others' commits are seen, one's own writes lie over them until commit; an error spoils all but a rollback."""

    def __init__(self, storage: TableStorage):
        self.storage, self.writes, self.spoilt, self.open = storage, {}, False, True

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("there is no transaction in progress")
        if self.spoilt:
            raise RuntimeError("current transaction is aborted, commands ignored until end of transaction block")

    def scan(self, table: str) -> DataFrame:
        self._check()
        rows = self.storage.scan(table)
        return _merged(rows, self.writes[table]).where("doc is not null") if table in self.writes else rows

    def put(self, table: str, rows: DataFrame) -> None:
        """Rows with a null document are deletes."""
        self._check()
        rows = rows.select("row_id", "doc")
        self.writes[table] = _merged(self.writes[table], rows) if table in self.writes else rows

    def delete(self, table: str, where: Column) -> None:
        self.put(table, self.scan(table).where(where).select("row_id", F.lit(None).cast("string").alias("doc")))

    def run(self, statement) -> DataFrame | None:
        """Runs a function of the transaction; an error of it spoils the transaction."""
        self._check()
        try:
            return statement(self)
        except Exception:
            self.spoilt = True
            raise

    def savepoint(self, name: str) -> None:
        """Accepted without effect."""
        self._check()

    def commit(self) -> bool:
        """Writes all, a table at a time; a spoilt transaction is rolled back instead and gives False."""
        if self.spoilt or not self.open:
            self.rollback()
            return False
        for table, rows in self.writes.items():
            gone = rows.where("doc is null").select("row_id")
            self.storage.put(table, rows.where("doc is not null"))
            if not gone.isEmpty():
                self.storage.delete(table, gone)
        self.writes, self.open = {}, False
        return True

    def rollback(self) -> None:
        self.writes, self.spoilt, self.open = {}, False, False


def new_row_id() -> str:
    return uuid.uuid4().hex
