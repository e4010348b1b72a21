"""Exact top-k search by integer inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, prepare

#: Vectors of an index block; a block of 64 dimensions and 7 slices takes 3.7 MB.
BLOCK_ROWS = 65_536
#: Queries that meet a block at once, on average (1 MB).
CHUNK = 1024
#: Tasks of the search; more blocks share them.
MOST_TASKS = 100_000


def quantise(vector: Column, scale: float = 64.0) -> Column:
    """Floors of the scaled components as longs; null for a vector that is null or holds null, NaN or infinite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


class BitSliced:
    """A block of integer vectors as slices: for each dimension the least value, and bitmaps of the bits above it.

    Rows are in the order given. ``slices[d][b]`` has a bit for each row; ``inverse`` has the complements.
    """

    def __init__(self, low: np.ndarray, slices: list[np.ndarray], rows: int):
        self.low, self.slices, self.rows = low, slices, rows
        self.words = -(-rows // 64)
        self.inverse = [~s for s in slices]
        valid = np.zeros(self.words * 64, np.uint8)
        valid[:rows] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)
        self.free: list[np.ndarray] = []

    @staticmethod
    def slice(vectors: np.ndarray) -> tuple[np.ndarray, list[int], bytes]:
        """Least values, numbers of slices, and the slices of ``vectors`` in a row."""
        low, words = vectors.min(0), -(-len(vectors) // 64)
        above = (vectors - low).astype(np.uint64)
        bits, parts = [int(x).bit_length() for x in above.max(0)], []
        for d, n in enumerate(bits):
            for b in range(n):
                row = np.zeros(words * 64, np.uint8)
                row[: len(vectors)] = (above[:, d] >> np.uint64(b)) & np.uint64(1)
                parts.append(np.packbits(row, bitorder="little").tobytes())
        return low, bits, b"".join(parts)

    @classmethod
    def load(cls, low: list[int], bits: list[int], data: bytes, rows: int) -> BitSliced:
        flat, at, slices = np.frombuffer(data, np.uint64).reshape(-1, -(-rows // 64)), 0, []
        for n in bits:
            slices.append(flat[at : at + n])
            at += n
        return cls(np.array(low, np.int64), slices, rows)

    def _new(self) -> np.ndarray:
        return self.free.pop() if self.free else np.empty(self.words, np.uint64)

    def add(self, query: np.ndarray) -> tuple[int, list[np.ndarray]]:
        """The scores of all rows as ``base`` and slices, the least significant first.

        A component's product is its slices shifted to each bit of the weight, complemented if the weight is
        negative. Carry-save adders turn three bitmaps of a weight into one of it and one of twice it.
        """
        base, level = 0, [[]]  # of each weight: (bitmap, whether it may be overwritten)
        for d, q in enumerate(query.tolist()[: len(self.slices)]):
            base += q * int(self.low[d])
            own, w = (self.slices[d], q) if q > 0 else (self.inverse[d], -q)
            base -= w * ((1 << len(own)) - 1) if q < 0 else 0
            for i in range(w.bit_length()):
                if w >> i & 1:
                    for b in range(len(own)):
                        while len(level) <= i + b:
                            level.append([])
                        level[i + b].append((own[b], False))
        out, j = [], 0
        while j < len(level):
            todo = level[j]
            if len(level) == j + 1 and len(todo) > 1:
                level.append([])
            while len(todo) > 2:
                a, b, c = todo.pop(), todo.pop(), todo.pop()
                u, both = self._new(), self._new()
                np.bitwise_xor(a[0], b[0], out=u)
                np.bitwise_and(a[0], b[0], out=both)
                s = self._new()
                np.bitwise_xor(u, c[0], out=s)
                np.bitwise_and(u, c[0], out=u)
                np.bitwise_or(both, u, out=both)
                self.free += [u, *(x for x, mine in (a, b, c) if mine)]
                todo.append((s, True))
                level[j + 1].append((both, True))
            if len(todo) == 2:
                a, b = todo
                both, s = self._new(), self._new()
                np.bitwise_and(a[0], b[0], out=both)
                np.bitwise_xor(a[0], b[0], out=s)
                self.free += [x for x, mine in todo if mine]
                level[j + 1].append((both, True))
                todo = [(s, True)]
            out.append(todo[0] if todo else (np.zeros(self.words, np.uint64), False))
            j += 1
        self.done = [x for x, mine in out if mine]
        return base, [x for x, _ in out]

    def top(self, query: np.ndarray, k: int, but: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best rows other than ``but``, equal scores by row.

        From the most significant slice down, rows with the bit are taken while they are ``k`` at most; else
        the others drop out. What is undecided at the end has one score, and its first rows fill up.
        """
        base, slices = self.add(query)
        sure, maybe = np.zeros(self.words, np.uint64), self.valid.copy()
        for row in but:
            maybe[row >> 6] &= ~np.uint64(1 << (row & 63))
        n = 0
        for s in reversed(slices):
            high = maybe & s
            m = int(np.bitwise_count(high).sum())
            if n + m > k:
                maybe = high
            else:
                sure |= high
                n += m
                maybe &= ~s
        rows = _set(sure)
        if n < k:
            rows = np.concatenate([rows, _set(maybe)[: k - n]])
        scores = np.full(len(rows), base, np.int64)
        for j, s in enumerate(slices):
            scores += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << j
        self.free += self.done
        return rows, scores


def _set(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(-1, 64)
    at, bit = np.nonzero(bits)
    return words[at] * 64 + bit


_INDEX = "block int, rows long, ids binary, keys binary, low array<long>, bits array<int>, slices binary"


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(block, rows, ids, keys, low, bits, slices)``: bit-sliced blocks of ``vectors(key, vec_id, q)``, rows by id and key within a block."""
    prepare(vectors.sparkSession)
    blocks = max(1, -(-vectors.count() // block_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, parts, block = [], [], [], None
        for batch in batches:
            if batch.num_rows:
                block = batch.column(3)[0].as_py()
                keys.append(batch.column(0).to_numpy())
                ids.append(batch.column(1).to_numpy())
                lists = batch.column(2)
                flat, ends = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                rows = np.zeros((len(ends), int(ends.max(initial=0))), np.int64)
                rows[np.arange(rows.shape[1]) < ends[:, None]] = flat
                parts.append(rows)
        if ids:
            width = max(p.shape[1] for p in parts)
            every, own, at = np.concatenate(ids), np.concatenate(keys), np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])
            order = np.lexsort((own, every))
            low, bits, data = BitSliced.slice(at[order])
            one = [pa.array([block], pa.int32()), pa.array([len(every)], pa.int64()), pa.array([every[order].tobytes()]), pa.array([own[order].tobytes()])]
            yield pa.RecordBatch.from_arrays([*one, pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([bits], pa.list_(pa.int32())), pa.array([data])], ["block", "rows", "ids", "keys", "low", "bits", "slices"])

    dealt = vectors.select("key", "vec_id", "q").repartition(blocks).select("key", "vec_id", "q", F.spark_partition_id().alias("block"))
    return dealt.mapInArrow(run, _INDEX)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: float = 64.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for every row with ``is_query``, that row itself aside.

    Components are quantised to floors of ``scale`` times their value; the score is the integer inner
    product, equal scores go to the smaller id. Chunks of queries meet every block of the index; a block
    returns its ``k`` best and these are ranked. While there are fewer blocks than cores, a block has copies
    that share the chunks. Vectors that are null or hold null or non-finite components, and rows without
    id, take no part; shorter vectors count as padded with zeros. Rows of one id are candidates and queries
    each, so that such a query has a list for each of them. Quantised components must be below 2**40
    in size and scores must fit a long. An empty table gives no row; other columns aren't read.
    """
    spark = prepare(vectors.sparkSession)
    q = vectors.where(is_query.isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vector), scale).alias("q"), is_query.alias("asks"))
    q = cut(q.where("vec_id is not null and q is not null").withColumn("key", F.monotonically_increasing_id()))
    index = cut(build_index(q, block_rows))
    asks, cores = q.where("asks"), spark.sparkContext.defaultParallelism
    n, blocks = asks.count(), 1 + (index.agg(F.max("block")).first()[0] or 0)
    copies = max(1, -(-2 * cores // blocks))
    chunks = max(copies, -(-n // CHUNK))
    chunked = asks.groupBy(F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("key", "vec_id", "q")).alias("queries"))  # of a fixed size
    place = lambda copy: F.col("block") * copies + copy
    held = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(place(F.col("copy")).cast("int").alias("place"), F.lit(0).alias("turn"), *index.columns)
    sent = chunked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select(place(F.pmod("chunk", F.lit(copies))).cast("int").alias("place"), F.lit(1).alias("turn"), "queries")
    tasks = min(blocks * copies, MOST_TASKS)
    dealt = held.unionByName(sent, allowMissingColumns=True).repartitionById(tasks, F.pmod("place", F.lit(tasks)).cast("int")).sortWithinPartitions("place", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = keys = loaded = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["queries"] is None:
                    ids, keys = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["keys"], np.int64)
                    loaded = BitSliced.load(row["low"], row["bits"], row["slices"], row["rows"])
                    continue
                out: list[list] = [[], [], [], []]
                for ask in row["queries"]:
                    first, last = np.searchsorted(ids, [ask["vec_id"], ask["vec_id"] + 1])
                    own = [int(first) + int(j) for j in np.flatnonzero(keys[first:last] == ask["key"])]
                    rows, scores = loaded.top(np.array(ask["q"], np.int64), k, own)
                    out[0] += [ask["key"]] * len(rows)
                    out[1] += [ask["vec_id"]] * len(rows)
                    out[2].append(rows)
                    out[3].append(scores)
                if out[0]:
                    at = np.concatenate(out[2])
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(ids[at]), pa.array(keys[at]), pa.array(np.concatenate(out[3]))], ["asks", "query_id", "vec_id", "key", "score"])

    best = Window.partitionBy("asks").orderBy(F.desc("score"), "vec_id", "key")
    found = dealt.mapInArrow(run, "asks long, query_id long, vec_id long, key long, score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
