"""Sessions with the settings that the library's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Semantics, not tuning: times are UTC, and where two maps meet the later entry wins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "100000",
    "spark.sql.cteRecursionRowLimit": "10000000",
}


def session(master: str | None = None, app: str = "tessera", **conf: str) -> SparkSession:
    """A session with the library's settings; ``master`` is left to the cluster if not given."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def register_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Makes the Parquet tables of a folder temporary views."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
