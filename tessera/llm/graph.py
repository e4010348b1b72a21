"""Connected components of an edge table, without gathering nodes or edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, release


#: Few edges stay in few partitions, of so many each, as every round shuffles them several times.
LEAST_PARTS, PART_EDGES = 8, 500_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an edge, component being the least node reached.

    Alternates large-star and small-star rounds (Kiveris et al., Connected Components in MapReduce and
    Beyond) until the edges no longer change; each round is two partial aggregations and two joins whose
    hot keys AQE may split. Null ends, loops and repeated edges are ignored. An empty table gives no row.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    now = cut(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    print_now = _print(now)
    parts = max(LEAST_PARTS, print_now[0] // PART_EDGES)
    while print_now[0]:
        few = now.coalesce(parts)
        both = few.unionByName(few.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").distinct().coalesce(parts))
        print_after = _print(after)
        if print_after == print_now:
            break
        release(now)
        now, print_now = after, print_after
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _print(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
