"""Change feeds ``(schema, table, op, old, new, commit_time)``: filters, authorisation, triggers, folding into tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def diff_feed(before: DataFrame, after: DataFrame, keys: list[str], table: str, schema: str = "public", time: Column | None = None) -> DataFrame:
    """The changes between two states of a table, one row each, images as JSON."""
    b = before.select(*keys, F.to_json(F.struct(*before.columns)).alias("old")).alias("b")
    a = after.select(*keys, F.to_json(F.struct(*after.columns)).alias("new")).alias("a")
    both = b.join(a, [F.col(f"b.{k}") == F.col(f"a.{k}") for k in keys], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    op = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE")
    return both.select(F.lit(schema).alias("schema"), F.lit(table).alias("table"), op.alias("op"), "old", "new", (time if time is not None else F.current_timestamp()).alias("commit_time"))


def bound(feed: DataFrame, event: str = "*", schema: str = "*", table: str = "*", filter: str | None = None) -> DataFrame:
    """Changes that a subscription is for; ``col=eq.value`` reads the new row, of deletes the old one, as text."""
    for name, value in (("op", event), ("schema", schema), ("table", table)):
        feed = feed if value == "*" else feed.where(F.col(name) == value)
    if filter:
        column, _, rest = filter.partition("=")
        if not rest.startswith("eq."):
            raise ValueError("only eq filters are supported")
        image = F.when(F.col("op") == "DELETE", F.col("old")).otherwise(F.col("new"))
        feed = feed.where(F.get_json_object(image, f"$.{column}") == rest[3:])
    return feed


def authorised(feed: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Changes of rows that the reader may see; deletes aren't delivered."""
    rows = feed.where(F.col("op") != "DELETE").withColumn("__key", F.get_json_object("new", f"$.{key}"))
    keys = allowed.select(F.col(key).cast("string").alias("__key")).distinct()
    return rows.join(keys, "__key", "left_semi").drop("__key")


def fold(feed: DataFrame, key: str, order: str = "commit_time") -> DataFrame:
    """``(key, row)``: the state of the table after all changes."""
    image = F.coalesce("new", "old")
    rows = feed.withColumn("key", F.get_json_object(image, f"$.{key}"))
    last = rows.groupBy("key").agg(F.max_by(F.struct("op", "new"), F.struct(order, "op")).alias("l"))
    return last.where("l.op <> 'DELETE'").select("key", F.col("l.new").alias("row"))


def windowed_counts(events: DataFrame, time: str, width: str, slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by event-time window, of a stream or a table (beyond what the source of these semantics offers)."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def stream(spark, folder: str, schema: str) -> DataFrame:
    """A feed of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def into_table(feed: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a feed to Parquet exactly once."""
    writer = feed.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def for_each_batch(feed: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return feed.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Rules are broadcast up to this many (about 200 bytes each).
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class TriggerRule:
    """A task for every event whose address starts with a prefix."""

    name: str
    prefix: str
    task: str


def due_tasks(events: DataFrame, rules: list[TriggerRule], done: DataFrame | None = None, address: str = "address", event: str = "event_id") -> DataFrame:
    """``(claim, rule, task, event_id)``: one task for each rule and event, those claimed before left out."""
    given = events.sparkSession.createDataFrame([(r.name, r.prefix, r.task) for r in rules], "rule string, prefix string, task string")
    lengths = F.array(*[F.lit(n) for n in sorted({len(r.prefix) for r in rules})])
    heads = F.transform(F.filter(lengths, lambda n: n <= F.length(address)), lambda n: F.substring(F.col(address), F.lit(1), n))
    hits = events.withColumn("prefix", F.explode(heads)).join(F.broadcast(given) if len(rules) <= BROADCAST_RULES else given, "prefix")
    claim = F.sha2(F.concat_ws("\x1f", "rule", F.col(event).cast("string")), 256).alias("claim")
    out = hits.select(claim, "rule", "task", F.col(event).alias("event_id")).dropDuplicates(["claim"])
    return out if done is None else out.join(done.select("claim"), "claim", "left_anti")


def requeued(claims: DataFrame, now: Column, budget: int) -> DataFrame:
    """Claims past their deadline that may be tried again."""
    return claims.where((F.col("state") == "claimed") & (F.col("deadline") < now) & (F.col("attempts") < budget))


# Task results.


def majority(results: DataFrame, k: int) -> DataFrame:
    """``(task, output, votes, agreed, divergent)``: the output that most workers gave, and who differs."""
    votes = results.groupBy("task", "output").agg(F.count("*").alias("votes"), F.collect_set("worker").alias("workers"))
    w = Window.partitionBy("task").orderBy(F.desc("votes"), F.asc_nulls_last("output"))
    ranked = votes.withColumn("r", F.row_number().over(w))
    best = ranked.where("r = 1").select("task", "output", "votes", (F.col("votes") >= k).alias("agreed"))
    others = ranked.where("r > 1").groupBy("task").agg(F.array_sort(F.flatten(F.collect_list("workers"))).alias("divergent"))
    return best.join(others, "task", "left").withColumn("divergent", F.coalesce("divergent", F.array().cast("array<string>")))


def fan_out(requests: DataFrame, function: Callable[[bytes], bytes], order: str = "seq", payload: str = "payload", parallel: int | None = None) -> DataFrame:
    """Runs a function of bytes over requests in parallel; the results are in the order of the requests."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({order: pdf[order], "result": [function(bytes(x)) for x in pdf[payload]]})

    rows = requests.repartition(parallel) if parallel else requests
    return rows.select(order, payload).mapInPandas(run, f"{order} {requests.schema[order].dataType.simpleString()}, result binary").orderBy(order)


def task(function: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    """A function from bytes to bytes as a column function; null in, null out."""

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else function(bytes(x)))

    return run


def ranked_workers(workers: DataFrame, now: Column, stale_after: float, weights: dict[str, float]) -> DataFrame:
    """Live workers by a weighted score of their capabilities."""
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return workers.where((now - F.col("seen")) <= stale_after).withColumn("score", score).orderBy(F.desc("score"), "worker")


def progress(done: Column, total: Column) -> Column:
    """Percent done; 100 if there is nothing to do."""
    return F.when(total == 0, 100.0).otherwise(done * 100.0 / F.nullif(total, F.lit(0)))
