"""Exact nearest neighbours, embedding of texts, and retrieval of context."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import DISTANCES


#: Rows of a block, and the fewest for which a table is split among cores.
BLOCK_ROWS, LEAST_ROWS = 65_536, 2048


def nearest(df: DataFrame, vector: str, query: list[float], k: int, op: str = "<->", where: Column | None = None, id_col: str | None = None) -> DataFrame:
    """The ``k`` rows nearest to a vector, with ``dist``; filters come first, rows without a vector last, ties by id."""
    rows = df if where is None else df.where(where)
    target = F.array(*[F.lit(float(x)) for x in query])
    keys = [F.col("dist").asc_nulls_last()] + ([F.col(id_col)] if id_col else [])
    return rows.withColumn("dist", DISTANCES[op](F.col(vector), target)).orderBy(*keys).limit(k)


def nearest_of_each(queries: DataFrame, df: DataFrame, k: int, op: str = "<->", query_id: str = "query_id", query_vector: str = "query", id_col: str = "id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """``(query_id, id, dist, rank)``: the ``k`` nearest rows to every query, exactly.

    Rows are dealt to blocks and queries to chunks, of about ``BLOCK_ROWS`` and ``block`` each; every chunk meets
    every block in a task of its own, which scores it by matrix products and keeps the ``k`` best of each query.
    What is shuffled after are these, not the pairs. Null vectors take no part.
    """
    dealt = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    asks = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).cast("long").alias("id"), F.col(query_vector).alias("v"))
    rows, cores = dealt.count(), df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-rows // BLOCK_ROWS), min(cores, rows // LEAST_ROWS))
    chunks = max(1, -(-asks.count() // block))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = dealt.withColumn("block", of(blocks)).withColumn("chunk", every(chunks))
    asks = asks.withColumn("chunk", of(chunks)).withColumn("block", every(blocks))

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = left["id"].to_numpy(), _matrix(left["v"])
        own, q = right["id"].to_numpy(), _matrix(right["v"])
        out: list[list] = [[], [], []]
        for i in range(0, len(own) if len(ids) else 0, block):
            d = distances(q[i : i + block], x, op)
            for row, query in zip(d, own[i : i + block], strict=True):
                order = np.lexsort((ids, row))[:k] if len(ids) <= 4 * k else _best(row, ids, k)
                out[0] += [query] * len(order)
                out[1].append(ids[order])
                out[2].append(row[order])
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": np.concatenate(out[1]) if out[1] else pa.array([], pa.int64()), "dist": np.concatenate(out[2]) if out[2] else pa.array([], pa.float64())})

    found = dealt.groupBy("block", "chunk").cogroup(asks.groupBy("block", "chunk")).applyInArrow(score, "query_id long, id long, dist double")
    w = Window.partitionBy("query_id").orderBy(F.col("dist").asc_nulls_last(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])
    return near[np.lexsort((ids[near], row[near]))][:k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def distances(q: np.ndarray, x: np.ndarray, op: str) -> np.ndarray:
    if op == "<+>":
        return np.stack([np.abs(x - row).sum(1) for row in q])
    dot = q @ x.T
    if op == "<#>":
        return -dot
    n, m = (q * q).sum(1)[:, None], (x * x).sum(1)[None, :]
    if op == "<->":
        return np.sqrt(np.maximum(n + m - 2 * dot, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - dot / np.sqrt(n * m)


def lsh_candidates(df: DataFrame, vector: str, planes: int = 12, tables: int = 8, seed: int = 1) -> DataFrame:
    """Adds ``buckets``: a key of signs of random projections for each of several tables; near vectors share some."""
    rng = np.random.default_rng(seed)
    dims = df.select(F.size(vector)).first()
    normals = rng.normal(size=(tables, planes, dims[0] if dims else 0)).tolist()
    bit = lambda p: F.when(F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, p)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) > 0, "1").otherwise("0")
    return df.withColumn("buckets", F.array(*[F.concat(F.lit(f"{t}:"), *[bit(p) for p in ps]) for t, ps in enumerate(normals)]))


# Embeddings.


@dataclass(frozen=True)
class HashEmbedder:
    """Unit vectors from the SHA-256 of a text and a counter: the same for the same text, otherwise random."""

    dims: int = 64
    name: str = "hash-sha256"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            raw, i = b"", 0
            while len(raw) < 4 * self.dims:
                raw += hashlib.sha256(i.to_bytes(4, "little") + text.encode()).digest()
                i += 1
            v = np.frombuffer(raw[: 4 * self.dims], "<u4") / 2**31 - 1
            out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
        return out


@dataclass(frozen=True)
class Rule:
    """Which text column of a table is embedded into which vector column."""

    table: str
    text: str
    vector: str
    embedder: HashEmbedder = HashEmbedder()


def embed_column(embedder) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = [t or "" for t in texts]
            yield pd.Series([v if t else None for t, v in zip(texts, embedder.embed(known), strict=True)])

    return convert


def source_hash(text: Column, model: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(model), text), 256)


def refresh(df: DataFrame, rule: Rule) -> DataFrame:
    """The table with current vectors: only rows whose text has changed since, by its hash, are embedded again.

    Rows without a text keep what they have. The hash is in ``_<vector>_srchash``.
    """
    mark, text = f"_{rule.vector}_srchash", F.col(rule.text)
    for name, kind in ((rule.vector, "array<float>"), (mark, "string")):
        df = df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))
    now = source_hash(text, rule.embedder.name)
    stale = text.isNotNull() & (text != "") & ~F.col(mark).eqNullSafe(now)
    fresh = df.where(stale).withColumn(rule.vector, embed_column(rule.embedder)(text)).withColumn(mark, now)
    return df.where(~F.coalesce(stale, F.lit(False))).unionByName(fresh)


def retrieve(df: DataFrame, query: list[float], k: int = 5, id_col: str = "id", text: str = "text", vector: str = "embedding", op: str = "<=>") -> DataFrame:
    """``(id, text, dist)`` of the rows nearest to a query."""
    return nearest(df.where(F.col(vector).isNotNull()), vector, query, k, op, id_col=id_col).select(F.col(id_col).alias("id"), F.col(text).alias("text"), "dist")


def context(retrieved: DataFrame, most: int = 8192, separator: str = "\n\n---\n\n") -> DataFrame:
    """One row ``context``: ``[id] text`` of the nearest rows, as many as fit; the first is cut if it doesn't."""
    piece = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.col("text"))
    order = F.sort_array(F.collect_list(F.struct("dist", "id", F.struct(piece.alias("p")).alias("x"))))  # as many as were retrieved
    pieces = F.transform(order, lambda r: r["x"]["p"])
    first = F.substring(F.element_at(pieces, 1), 1, most)
    grown = F.aggregate(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        F.struct(first.alias("t"), F.lit(True).alias("open")),
        lambda acc, p: F.struct(
            F.when(acc["open"] & (F.length(acc["t"]) + len(separator) + F.length(p) <= most), F.concat(acc["t"], F.lit(separator), p)).otherwise(acc["t"]).alias("t"),
            (acc["open"] & (F.length(acc["t"]) + len(separator) + F.length(p) <= most)).alias("open"),
        ),
    )
    return retrieved.agg(F.when(F.count("*") > 0, grown["t"]).otherwise("").alias("context"))


def embed_stream(feed: DataFrame, rule: Rule, target: str, checkpoint: str):
    """Embeds the rows of a stream as they come: each batch's new texts are appended to a Parquet folder with vector and hash."""

    def one(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.col(rule.text).isNotNull() & (F.col(rule.text) != ""))
        refresh(rows, rule).write.mode("append").parquet(target)

    return feed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer(retrieved: DataFrame, question: str, model: Callable[[str], str], template: str = "Answer from this context.\n\n{context}\n\nQuestion: {question}", most: int = 8192) -> DataFrame:
    """One row ``(context, prompt, answer)``: a prompt from what was retrieved, given to any function from text to text."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(model)

    before, after = template.replace("{question}", question).split("{context}")
    return context(retrieved, most).withColumn("prompt", F.concat(F.lit(before), "context", F.lit(after))).withColumn("answer", ask("prompt"))


#: Embedders by model name, with the hash of what they give for a probe once they are pinned.
_EMBEDDERS: dict[str, tuple] = {}


def fingerprint(embedder) -> str:
    """What an embedder gives for a fixed text, as a digest."""
    return hashlib.sha256(np.asarray(embedder.embed(["probe"])[0], "<f4").tobytes()).hexdigest()


def register_embedder(embedder, pinned: str | None = None) -> str:
    """Makes an embedder known by its name; an error if it doesn't give what it is pinned to."""
    found = fingerprint(embedder)
    known = pinned or (_EMBEDDERS.get(embedder.name) or (None, None))[1]
    if known is not None and known != found:
        raise ValueError(f"model {embedder.name} gives other vectors than it is pinned to")
    _EMBEDDERS[embedder.name] = (embedder, found)
    return found


def embedder_of(name: str):
    if name not in _EMBEDDERS:
        raise KeyError(f"no embedder {name}")
    return _EMBEDDERS[name][0]
