"""Causal logs: entries ``(hash, payload, next array<string>, time long, id string)`` whose ``next`` names earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.recursive import checkpointed

#: Later entries last: clock time, clock id, hash.
CAUSAL = ("time", "id", "hash")


def _edges(log: DataFrame) -> DataFrame:
    return log.select("hash", F.explode("next").alias("ref"))


def join(a: DataFrame, b: DataFrame, last: int | None = None) -> DataFrame:
    """Both logs' entries, each once; of a truncated log the last ones."""
    both = a.unionByName(b).dropDuplicates(["hash"])
    return both if last is None else both.orderBy(*[F.desc(c) for c in CAUSAL]).limit(last)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of the first log that the second hasn't."""
    return a.join(b.select("hash"), "hash", "left_anti")


def heads(log: DataFrame) -> DataFrame:
    """Entries that no other refers to."""
    return log.join(_edges(log).select(F.col("ref").alias("hash")), "hash", "left_anti")


def tails(log: DataFrame) -> DataFrame:
    """Entries all of whose references are missing, the first ones among them."""
    known = _edges(log).join(log.select(F.col("hash").alias("ref")), "ref", "left_semi").select("hash")
    return log.join(known, "hash", "left_anti")


def tail_hashes(log: DataFrame) -> DataFrame:
    """References to entries that the log hasn't."""
    return _edges(log).select(F.col("ref").alias("hash")).join(log.select("hash"), "hash", "left_anti").distinct()


def clock(log: DataFrame) -> DataFrame:
    """One row with the log's clock: the greatest time."""
    return log.agg(F.coalesce(F.max("time"), F.lit(0)).alias("time"))


def tick(time: Column) -> Column:
    return time + 1


def merge_clocks(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def add(log: DataFrame, payloads: DataFrame, writer: str) -> DataFrame:
    """The log and new entries on top of all its heads, one for each row of ``payloads(payload)``; empty payloads are an error."""
    if not payloads.where("payload is null or length(payload) = 0").isEmpty():
        raise ValueError("payload must not be empty")
    tops = heads(log).agg(F.array_sort(F.collect_list("hash")).alias("next"))  # as many as writers at work
    new = payloads.select("payload").crossJoin(F.broadcast(tops)).crossJoin(F.broadcast(clock(log)))  # two single rows
    new = new.withColumns({"time": tick(F.col("time")), "id": F.lit(writer)})
    mark = F.sha2(F.concat_ws("\x1f", F.col("payload").cast("string"), F.array_join("next", ","), F.col("time").cast("string"), "id"), 256)
    return log.unionByName(new.withColumn("hash", mark).select(*log.columns)).dropDuplicates(["hash"])


def get(log: DataFrame, key: str) -> DataFrame:
    """The entry with a hash, if any."""
    return log.where(F.col("hash") == key)


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Hashes reachable over ``edges(hash, ref)``, the start among them.

    What is found and the jumps it is found by double in length each round, so a history of n entries takes log n rounds.
    """
    jumps, found = edges.select("hash", "ref").distinct(), checkpointed(start.distinct())
    known = found.count()
    while True:
        found = checkpointed(found.union(found.join(jumps, "hash").select("ref")).distinct())
        if (n := found.count()) == known:
            return found
        known, to = n, jumps.toDF("ref", "to")
        jumps = checkpointed(jumps.join(to, "ref").select("hash", F.col("to").alias("ref")).distinct())


def traverse(log: DataFrame, roots: DataFrame | None = None, amount: int | None = None, end_hash: str | None = None) -> DataFrame:
    """Entries reachable from the roots (the heads by default), newest first, down to ``end_hash``."""
    seen = reachable(_edges(log), (heads(log) if roots is None else roots).select("hash"))
    rows = log.join(seen, "hash", "left_semi")
    if end_hash is not None:
        end = log.where(F.col("hash") == end_hash).select(F.struct(*CAUSAL).alias("end"))
        rows = rows.crossJoin(F.broadcast(end)).where(F.struct(*CAUSAL) >= F.col("end")).drop("end")  # one row
    rows = rows.orderBy(*[F.desc(c) for c in CAUSAL])
    return rows if amount is None else rows.limit(amount)


def last_writes(ops: DataFrame, key: str = "key") -> DataFrame:
    """The last operation on each key in causal order; ``DEL`` removes it. One partial aggregation, no sort."""
    last = ops.groupBy(key).agg(F.max_by(F.struct("op", "value"), F.struct(*CAUSAL)).alias("w"))
    return last.where("w.op <> 'DEL'").select(key, "w.value")


def read_range(log: DataFrame, gt: str | None = None, gte: str | None = None, lt: str | None = None, lte: str | None = None, amount: int | None = None) -> DataFrame:
    """Entries in causal order between hashes: forward from a lower bound, else the last ones up to an upper bound.

    An unknown hash gives nothing. The entries' order is found without numbering the whole log: bounds are
    looked up and compared.
    """
    rows, low, high = log, gt or gte, lt or lte
    at = F.struct(*CAUSAL)
    for bound, test in ((low, (lambda e: at > e) if gt else (lambda e: at >= e)), (high, (lambda e: at < e) if lt else (lambda e: at <= e))):
        if bound is not None:
            end = log.where(F.col("hash") == bound).select(at.alias("__end")).limit(1)
            rows = rows.crossJoin(F.broadcast(end)).where(test(F.col("__end"))).drop("__end")  # one row at most
    if amount is None or amount < 0:
        return rows.orderBy(*CAUSAL)
    if low is not None:
        return rows.orderBy(*CAUSAL).limit(amount)
    return rows.orderBy(*[F.desc(c) for c in CAUSAL]).limit(amount).orderBy(*CAUSAL)


def numbered(log: DataFrame, by: str) -> DataFrame:
    """The place of each entry within its key's history."""
    return log.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy(*CAUSAL)))
