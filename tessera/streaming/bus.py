"""Events within a driver by type, and topics that several subscribers read."""

from __future__ import annotations

import queue
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Subscription:
    """What was emitted since, in order; of more than ``most`` waiting events the oldest go and are counted in ``missed``."""

    def __init__(self, most: int):
        self.waiting, self.missed, self.open = queue.Queue(), 0, True
        self.most = most

    def offer(self, event: Any) -> None:
        while self.waiting.qsize() >= self.most:
            self.waiting.get_nowait()
            self.missed += 1
        self.waiting.put(event)

    def __iter__(self) -> Iterator[Any]:
        while not self.waiting.empty():
            yield self.waiting.get_nowait()


class EventBus:
    """Typed publishing within one driver: a subscriber of a type gets its events and those of its subtypes."""

    def __init__(self, most: int = 1024):
        self.most, self.subscribers = most, defaultdict(list)

    def subscribe(self, kind: type) -> Subscription:
        new = Subscription(self.most)
        self.subscribers[kind].append(new)
        return new

    def emit(self, event: Any) -> int:
        """How many subscribers got it."""
        mine = [s for kind in type(event).__mro__ for s in self.subscribers.get(kind, ()) if s.open]
        for s in mine:
            s.offer(event)
        return len(mine)

    def close(self, subscription: Subscription) -> None:
        subscription.open = False


def publish(messages: DataFrame, folder: str) -> None:
    """Appends ``(topic, event, payload)`` to the topics of a folder that the cluster shares."""
    messages.select("topic", "event", "payload").write.mode("append").partitionBy("topic").parquet(folder)


def subscribe(spark: SparkSession, folder: str, topic: str, receive: Callable[[DataFrame, int], None], checkpoint: str, event: str = "*") -> StreamingQuery:
    """Hands what has been published on a topic since this checkpoint to a function, each message once."""
    rows = spark.readStream.schema("event string, payload string, topic string").parquet(folder).where(F.col("topic") == topic)
    rows = rows if event == "*" else rows.where(F.col("event") == event)
    return rows.writeStream.foreachBatch(receive).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
