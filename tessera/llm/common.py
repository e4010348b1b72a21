"""What the operators of this subpackage share: worker set-up, lineage cuts, word splitting."""

from __future__ import annotations

import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Memory that Python workers free goes back to the system, as they live on from stage to stage beside the JVM.
_WORKER_ENV = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "4194304", "ARROW_DEFAULT_MEMORY_POOL": "system", "TOKENIZERS_PARALLELISM": "false"}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Sets up Python workers.

    They can import this package, where they see the driver's disk, whatever the working folder; free
    memory is returned; and batches hold 16 MB rather than 64, unless the session says otherwise.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for name, value in _WORKER_ENV.items():
        env.setdefault(name, value)
    if spark.conf.get(_BATCH, "64m") in ("64m", "67108864", "67108864b"):
        spark.conf.set(_BATCH, "16m")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from the session; one of our own only in local mode, where none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Runs the plan once and goes on from a reliable copy in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Seconds between two runs of the driver's collector.
COLLECT_SECONDS = 5.0
_collected = time.monotonic()


def release(*done: DataFrame) -> None:
    """Deletes copies that ``cut`` made and that nothing will read again, and has the shuffle files of steps that are over removed.

    Spark removes these once the driver's collector has seen that nothing refers to them, so it is run here, once in
    ``COLLECT_SECONDS`` at most.
    """
    global _collected
    for df in done:
        spark, file = df.sparkSession, df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            remove(spark, file.get())
        if time.monotonic() - _collected > COLLECT_SECONDS:
            spark._jvm.System.gc()
            _collected = time.monotonic()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the file system that it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of an operator's own can clash with them; ``select("row.*")`` undoes it."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Folds A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
