"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, prepare, whole_row

#: Counters of a Misra-Gries summary, and so the most digests that are ever broadcast (about 130 bytes each, 9 MB in all).
COUNTERS = 65_536


def merge_summary(counts: dict, more: Iterable[tuple[object, int]], counters: int) -> dict:
    """Adds counts to a Misra-Gries summary and lowers it to at most ``counters`` entries."""
    for key, n in more:
        counts[key] = counts.get(key, 0) + n
    if len(counts) > counters:
        least = sorted(counts.values(), reverse=True)[counters]
        counts = {k: n - least for k, n in counts.items() if n > least}
    return counts


def misra_gries(df: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """``(key, low)``: at most ``counters`` values of a column, those that surely make up one in ``counters`` rows or more.

    Each task keeps a summary of its rows; the summaries are added up by key. A value's bound ``low`` is
    short of its count by at most one in ``counters + 1`` of all rows, and one for each task, so that a value
    of more than twice that share is always found. Values met once don't count, nor do nulls.
    """
    prepare(df.sparkSession)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0).drop_null())
            counts = merge_summary(counts, zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True), counters)
        often = [(k, n) for k, n in counts.items() if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["key", "low"])

    found = df.select(F.col(column).cast("string").alias("key")).mapInArrow(summaries, "key string, low long")
    least = max(2, -(-df.count() // counters))  # bounds add up to the rows at most, so no more than ``counters`` reach it
    return found.groupBy("key").agg(F.sum("low").alias("low")).where(F.col("low") >= least)


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One light row per document; the row number tells repeated rows apart and is fixed by the copy on disk."""
    return cut(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256")).withColumn("row", F.monotonically_increasing_id())
    )


def _winners(digests: DataFrame, counters: int) -> DataFrame:
    """The frequent digests, counted exactly, with the row that stays; at most ``counters`` rows."""
    often = cut(misra_gries(digests, "text_sha256", counters).select(F.col("key").alias("text_sha256")))
    found = digests.join(F.broadcast(often), "text_sha256").groupBy("text_sha256")
    return cut(found.agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row.

    Texts are equal when their SHA-256 digests are. Of equal texts the row with the largest id stays; of
    repeated rows with that id, one. A Misra-Gries pass finds the frequent digests; their winners, counted
    exactly, are broadcast (``counters`` rows at most) and decide on the map side, so that a text of any
    number of copies never meets in one task. All other digests are shuffled, 100 bytes a row, without
    their texts. Null texts count as empty, null ids as the least; an empty table gives no row; other
    columns aren't read, whatever their names.
    """
    digests = _digests(docs, id_col, text_col)
    winners = _winners(digests, counters)
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    same = Window.partitionBy("text_sha256")
    light = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    light = light.withColumns({"best": F.max(F.struct("doc_id", "row")).over(same), "group_size": F.count("*").over(same)})
    return heavy.unionByName(light).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that ``exact_duplicates`` keeps, with all their columns, whatever their names.

    The losers of frequent digests go on the map side, and of repeated winners all but one of a task; what is
    left is shuffled once by digest.
    """
    winners = _winners(_digests(docs, id_col, text_col), counters).select("text_sha256", F.col("best.doc_id").alias("keep"), F.lit(True).alias("often"))
    marked = docs.select(whole_row(docs), F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
    marked = marked.join(F.broadcast(winners), "text_sha256", "left").where(F.col("often").isNull() | F.col("id").eqNullSafe(F.col("keep")))
    first = Window.partitionBy("text_sha256").orderBy(F.col("id").desc_nulls_last())
    return marked.withColumn("n", F.row_number().over(first)).where("n = 1").select("row.*")
