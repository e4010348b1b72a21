"""Repeated passages across documents by a sparse suffix array over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, prepare, release
from tessera.llm.shingles import mix, word_hashes

#: Words of the shortest passage that counts.
PASSAGE = 50
#: Words of a suffix that choose it: of the grams within each passage, the one with the least hash is kept.
GRAM = 8
#: Places of a gram that are compared at once (4 MB); more are dealt to several parts, which are compared with one another after.
COMMON = 10_000

_CONTEXT = np.dtype([("h", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("left", "<u1"), ("right", "<u1"), ("part", "?"), ("words", "<u4", (2 * PASSAGE,))])
_OPEN = np.dtype([("h", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("asks", "?")])


def gram_hashes(words: np.ndarray, width: int = GRAM) -> np.ndarray:
    if len(words) < width:
        return np.empty(0, np.uint64)
    n = len(words) - width + 1
    h = words[:n].copy()
    for i in range(1, width):
        h = mix(h) + words[i : i + n]
    return mix(h)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the suffixes kept: every stretch of ``PASSAGE`` words holds the least of its grams."""
    h = gram_hashes(words)
    span = PASSAGE - GRAM + 1
    if len(h) < span:
        return np.empty(0, np.int64), h[:0]
    at = np.lib.stride_tricks.sliding_window_view(h, span).argmin(1) + np.arange(len(h) - span + 1)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return at, h[at]


def _deal(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = ((mix(rows["h"]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends, rows = np.searchsorted(bucket[order], np.arange(buckets + 1)), rows[order]
    full = np.flatnonzero(np.diff(ends))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([rows[ends[k] : ends[k + 1]].tobytes() for k in full], pa.binary())], ["bucket", "rows"])


_FOUND = ["doc", "start", "end"]


def _gather(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    found: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(bucket, []).append(rows)
    for bucket in list(found):
        yield np.frombuffer(b"".join(found.pop(bucket)), kind)


def _in_two(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether each row's key is that of a row of another document."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    last = np.append(start[1:], len(k)) - 1
    out = np.empty(len(k), bool)
    out[order] = np.repeat(d[start] != d[last], last - start + 1)
    return out


def _anchors(docs: DataFrame) -> DataFrame:
    """``(h, doc, pos)``: the kept suffixes by the hash of their first words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                found = [(doc, *anchors(word_hashes(text.as_py()))) for doc, text in zip(batch.column(0).slice(i, 4000).to_pylist(), batch.column(1).slice(i, 4000), strict=True)]
                if found:
                    doc = np.repeat(np.array([d for d, *_ in found], np.int64), [len(pos) for _, pos, _ in found])
                    pos, h = np.concatenate([pos for _, pos, _ in found]), np.concatenate([h for *_, h in found])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc), pa.array(pos.astype(np.int32))], ["h", "doc", "pos"])

    return docs.select("doc", "text").mapInArrow(emit, "h long, doc long, pos int")


def _sorted_neighbours(h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by gram and words, and how many words each has in common with the row before it; none with another gram's."""
    text = np.ascontiguousarray(np.concatenate([h.astype(">u8").view(np.uint8).reshape(len(h), 8), np.ascontiguousarray(words.astype(">u4")).view(np.uint8).reshape(len(h), -1)], 1))
    order = np.argsort(text.view(f"S{text.shape[1]}").ravel(), kind="stable")
    differ = words[order][1:] != words[order][:-1]
    common = np.where(differ.any(1), differ.argmax(1), words.shape[1])
    common[h[order][1:] != h[order][:-1]] = -1
    return order, np.concatenate(([-1], common))


def _longest(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each row the words that it has in common with the nearer of its neighbours."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(common, np.append(common[1:], -1))
    return out


_STEP = np.uint64(0xD6E8FEB86659FD93)


def _extended(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, start, end)`` of the passages around suffixes, all rows of a gram or of a part of it being there; and what is open.

    Suffixes are sorted, and what is before them, read backwards, is too; neighbours give the longest matches to the
    right and to the left, and suffixes whose two together are too short match nothing here. A match extended by
    ``back`` words to the left needs the rest of a passage to the right: rows with both in common, which are
    stretches of both orders between neighbours of less, are in one class; a class with two documents is a repeat.
    Of a part of a gram, passages without a match stay open, as another part may have one, and one row of each
    repeat stands for it there.
    """
    rows = rows[rows["part"] | _in_two(rows["h"], rows["doc"])]
    if not len(rows):
        return np.empty((0, 3), np.int64), np.empty(0, _OPEN)
    right, left = _sorted_neighbours(rows["h"], rows["words"][:, PASSAGE:]), _sorted_neighbours(rows["h"], rows["words"][:, PASSAGE - 1 :: -1])
    near = _longest(*right) + _longest(*left) >= PASSAGE
    low, high = np.full(len(rows), PASSAGE), np.full(len(rows), -1)
    classes, opened = np.empty((2, len(rows)), np.int64), []
    part = np.flatnonzero(rows["part"])
    if len(part):
        with np.errstate(over="ignore"):
            scale, undo = (np.cumprod(np.full(2 * PASSAGE, x, np.uint64)) for x in (_STEP, np.uint64(pow(int(_STEP), -1, 1 << 64))))
            total = np.zeros((len(part), 2 * PASSAGE + 1), np.uint64)
            np.cumsum((rows["words"][part].astype(np.uint64) + np.uint64(1)) * scale, axis=1, out=total[:, 1:])
    for back in range(PASSAGE - GRAM + 1):
        whole = (rows["left"] >= back) & (rows["right"] >= PASSAGE - back)
        able, hit = np.flatnonzero(near & whole), np.zeros(len(rows), bool)
        if len(able):
            for k, ((order, common), least) in enumerate(((right, PASSAGE - back), (left, back))):
                classes[k, order] = np.cumsum(common < least)
            own = classes[0, able] * (len(rows) + 1) + classes[1, able]
            hit[able] = _in_two(own, rows["doc"][able])
            low[hit], high[hit] = np.minimum(low[hit], back), np.maximum(high[hit], back)
        if len(part):
            stands = np.zeros(len(rows), bool)
            if len(able):
                stands[able[np.unique(own, return_index=True)[1]]] = True
            at = np.flatnonzero((whole & (~hit | stands))[part])
            with np.errstate(over="ignore"):
                h = mix((total[at, 2 * PASSAGE - back] - total[at, PASSAGE - back]) * undo[PASSAGE - back - 1])
            some = np.empty(len(at), _OPEN)
            some["h"], some["doc"], some["start"], some["asks"] = h, rows["doc"][part[at]], rows["pos"][part[at]].astype(np.int64) - back, ~hit[part[at]]
            opened.append(some)
    found = high >= 0
    pos = rows["pos"][found].astype(np.int64)
    return np.stack([rows["doc"][found], pos - high[found], pos - low[found] + PASSAGE], 1), np.concatenate(opened) if opened else np.empty(0, _OPEN)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start_word, n_words)``: the stretches of documents that repeat in other documents.

    A stretch is covered by passages of at least ``PASSAGE`` words that occur, word by word and with A-Z
    folded, in a document of another id; stretches that touch are one. Suffixes are kept at content-chosen
    words only, about one in 22; those whose first ``GRAM`` words are one document's go, the others are sorted,
    compared with neighbours and extended left and right. Suffixes of a gram of more than ``COMMON`` places are
    dealt to parts by document; what has no match in its part is then compared with what the other parts
    have left, a row for each of their repeats included, so that no task ever holds all of a gram. Words are
    compared by 32-bit hashes, ``PASSAGE`` of them at a time. Documents without repeats, with null or
    short texts give no row; rows of one id, of any type, are one document for this purpose, rows
    without id are documents by their text. An empty table gives no row; other columns aren't read.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    own = F.col(id_col).cast("long") if isinstance(kind, T.IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    light = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(own, F.xxhash64(F.lit("no id"), text_col)).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = cut(_anchors(light))
    grams = kept.groupBy("h").agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.count("*").alias("n")).where("x <> y").select("h", F.ceil(F.col("n") / COMMON).cast("int").alias("parts"))
    shared = cut(kept.join(grams, "h").groupBy("doc").agg(F.collect_set(F.struct("pos", "parts")).alias("at")))
    release(kept)
    sums = shared.agg(F.sum(F.size("at")), F.max(F.array_max(F.transform("at", lambda a: a["parts"])))).first()
    buckets = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((sums[0] or 0) // 200_000))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                done = []
                for doc, text, at in zip(*(batch.column(k).slice(i, 500).to_pylist() for k in range(3)), strict=True):
                    words = word_hashes(text)
                    pos, parts = np.array(sorted((a["pos"], a["parts"]) for a in at), np.int64).reshape(-1, 2).T
                    here = pos <= len(words) - GRAM  # else of another row with this id
                    pos, parts = pos[here], parts[here]
                    rows = np.zeros(len(pos), _CONTEXT)
                    padded = np.pad((words >> np.uint64(32)).astype(np.uint32), PASSAGE)
                    turn = mix(np.array([doc], np.int64).view(np.uint64)) % parts.astype(np.uint64)
                    rows["h"], rows["doc"], rows["pos"], rows["part"] = gram_hashes(words)[pos], doc, pos, parts > 1
                    rows["h"] = np.where(parts > 1, mix(rows["h"] + turn * np.uint64(0x9E3779B97F4A7C15)), rows["h"])
                    rows["left"], rows["right"] = np.minimum(pos, PASSAGE), np.minimum(len(words) - pos, PASSAGE)
                    rows["words"] = np.lib.stride_tricks.sliding_window_view(padded, 2 * PASSAGE)[pos]
                    done.append(rows)
                if done and sum(map(len, done)):
                    yield _deal(np.concatenate(done), buckets)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gather(batches, _CONTEXT):
            found, opened = _extended(rows)
            if len(found):
                n = len(found)
                yield pa.RecordBatch.from_arrays([*(pa.array(found[:, k].copy()) for k in range(3)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], [*_FOUND, "bucket", "rows"])
            if len(opened):
                dealt = _deal(opened, buckets)
                yield pa.RecordBatch.from_arrays([pa.nulls(dealt.num_rows, pa.int64())] * 3 + dealt.columns, [*_FOUND, "bucket", "rows"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gather(batches, _OPEN):
            rows = rows[_in_two(rows["h"], rows["doc"]) & rows["asks"]]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows["doc"].copy()), pa.array(rows["start"].copy()), pa.array(rows["start"] + PASSAGE)], _FOUND)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for doc, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and now[0] == doc and start <= now[2]:
                    now[2] = max(now[2], end)
                else:
                    out += [now] if now else []
                    now = [doc, start, end]
        out += [now] if now else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] - r[1] for r in out], pa.int64())], ["doc", "start_word", "n_words"])

    ends = "doc long, start long, end long"
    asked = light.join(shared, "doc").select("doc", "text", "at").mapInArrow(emit, "bucket int, rows binary")
    found = asked.repartition(-(-buckets // 4), "bucket").mapInArrow(compare, f"{ends}, bucket int, rows binary")
    if (sums[1] or 0) > 1:  # a gram has parts
        found = cut(found)
        opened = found.where("bucket is not null").select("bucket", "rows").repartition(-(-buckets // 4), "bucket")
        found = found.where("bucket is null").select(*_FOUND).unionByName(opened.mapInArrow(meet, ends))
    found = found.select(*_FOUND)
    merged = found.repartition("doc").sortWithinPartitions("doc", "start").mapInArrow(merge, "doc long, start_word long, n_words long")
    return merged.join(light.select("doc", F.col("id").alias("doc_id")).distinct(), "doc").select("doc_id", "start_word", "n_words")
