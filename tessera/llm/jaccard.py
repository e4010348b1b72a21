"""Exact n-gram Jaccard join by a token-group matrix.

The matrix is that of LES3 (Li et al., Learning-based Exact Set Similarity Search): sets are partitioned
into groups of similar ones, each group has the union of its tokens, a query's overlap with the union
bounds its overlap with every member, and only groups that qualify are opened. Here the groups are found by
verified links to shared leaders, the matrix is kept as (token, group) rows of the tokens that can decide, and
all sets are queries. Ids of sets and tokens are 64-bit hashes; sets with one id count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import cut, prepare, release, whole_row
from tessera.llm.graph import connected_components
from tessera.llm.shingles import mix, shingle_set, shingle_sets

WIDTH = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A token of so many sets is common: it comes last in the order of tokens.
COMMON = 32
#: Counters of a task's summary of token counts, and the most common tokens that are sent to every task (16 MB).
COUNTERS, COMMON_MOST = 65_536, 1_000_000
#: A common token's sets are dealt to one task for each so many.
SALT_ROWS = 50_000
#: Sets of a group, and so texts that a task holds at once.
GROUP = 32
#: Rounds of linking sets to shared leaders before the matrix is asked.
LEADER_ROUNDS = 1
#: Rounds of leaving out sets that no longer share enough with other components.
PARTNER_ROUNDS = 1
#: Tokens that a query and a group must share, of the first of those that they must share.
FEW = 1
#: Ids that are broadcast to pick texts (16 bytes each); more are joined.
BROADCAST_IDS = 1_000_000


def _need(n: np.ndarray | int):
    """The least overlap that a set of ``n`` tokens has with any set that it links to."""
    return -(-PERCENT * n // 100)


def _spare(n: np.ndarray | int):
    """Tokens that a prefix is longer than needed, and so how many two linked prefixes share at least."""
    return 1 + n // 8


def _must_share(n: Column, m: Column) -> Column:
    """The least number of tokens that the prefixes of two linked sets of these sizes share.

    A common token beyond the lesser of the prefixes' ends is among what the set of that prefix has left, so
    the overlap is at most what the prefixes share and the larger remainder.
    """
    rest = lambda x: F.ceil(x * PERCENT / 100) - 1 - F.floor(x / 8)
    return F.ceil((n + m) * PERCENT / (100 + PERCENT)) - F.greatest(rest(n), rest(m))


def _least_partner(n: Column) -> Column:
    """The least ``_must_share`` of ``n`` with any size that it links to: the smallest partner is the least demanding."""
    return _must_share(n, F.ceil(n * PERCENT / 100))


def _least_must_share(n: Column, low: Column, high: Column) -> Column:
    """The least ``_must_share`` of ``n`` with any size from ``low`` to ``high``.

    Through rounding it may be lower inside than at the ends. Of sizes 56 (7 * 8) apart each is a whole number
    more, first rising by 24, then falling by 11, and so the least one is within 56 of an end.
    """
    sizes = F.array_union(F.sequence(low, F.least(low + 55, high)), F.sequence(F.greatest(high - 55, low), high))
    return F.array_min(F.transform(sizes, lambda m: _must_share(n, m)))


def _set_ids(sets: list[np.ndarray]) -> list[int | None]:
    """A hash of each set, whatever the order; None of empty ones."""
    sizes = np.array([len(s) for s in sets], np.uint64)
    full = np.flatnonzero(sizes)
    out: list[int | None] = [None] * len(sets)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1])).astype(np.int64)
        sums = np.add.reduceat(mix(np.concatenate([sets[i] for i in full])), starts)
        for i, sid in zip(full.tolist(), mix(mix(sizes[full]) + sums).view(np.int64).tolist(), strict=True):
            out[i] = sid
    return out


def _set_id(tokens: np.ndarray) -> int | None:
    return _set_ids([tokens])[0]


def _chunks(texts: pa.Array, size: int = 1000) -> Iterator[tuple[list[np.ndarray], list[int | None]]]:
    """Sets and their ids of some texts at a time."""
    for i in range(0, len(texts), size):
        sets = shingle_sets(texts.slice(i, size).to_pylist(), WIDTH)
        yield sets, _set_ids(sets)


def _merge(tokens: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries: counts added up by token, lowered so that at most ``COUNTERS`` stay."""
    every, at = np.unique(np.concatenate([tokens, more]), return_inverse=True)
    total = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
    if len(every) > COUNTERS:
        total = total - np.partition(total, len(total) - COUNTERS - 1)[len(total) - COUNTERS - 1]
    keep = total > 0
    return every[keep], total[keep]


def _sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n, sid, low)``: each document's set; and with null ``n``, tokens (as ``sid``) with bounds of their counts."""
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "text_key", "n", "sid", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            n, sid, seen, parts, size = [], [], set(), [], 0
            for sets, ids in _chunks(batch.column(2)):
                n += map(len, sets)
                sid += ids
                for s, own in zip(sets, ids, strict=True):
                    if own is not None and own not in seen:
                        seen.add(own)
                        parts.append(s)
                        size += len(s)
                if size > 1_000_000:
                    tokens, counts = _merge(tokens, counts, *np.unique(np.concatenate(parts), return_counts=True))
                    parts, size = [], 0
            if parts:
                tokens, counts = _merge(tokens, counts, *np.unique(np.concatenate(parts), return_counts=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.nulls(len(n), pa.int64())], names)
        often = counts > 1
        if often.any():
            k = int(often.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, n long, sid long, low long")


def _common_tokens(summaries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of at least ``COMMON`` sets, sorted, with lower bounds of their counts; of too many, those above the least power of two that leaves few enough."""
    low = cut(summaries.groupBy("sid").agg(F.sum("low").alias("low")).where(F.col("low") >= COMMON))
    least, left = COMMON, COMMON_MOST
    for r in low.groupBy(F.floor(F.log2("low")).cast("int").alias("bits")).count().orderBy(F.desc("bits")).collect():  # 63 rows at most
        left -= r["count"]
        if left < 0:
            least = 2 << r.bits
            break
    found = low.where(F.col("low") >= least).toArrow()
    tokens, counts = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _prefix(tokens: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first tokens of a set, rare ones before common ones, and how much of the set is rare, of 65535.

    The order is the same for all sets: tokens that aren't common by hash, then common ones by count and hash.
    Two linked sets share at least the lesser ``_spare`` of their prefixes.
    """
    n = len(tokens)
    want = n - _need(n) + _spare(n)
    at, hot = _find(common, tokens)
    rare = tokens[~hot]
    rank = 65535 * len(rare) // n
    if len(rare) < want:
        last = tokens[hot]
        rare = np.concatenate([rare, last[np.lexsort((last, counts[at[hot]]))][: want - len(rare)]])
    return rare[:want], rank


_ENTRY = np.dtype([("key", "<u8"), ("sid", "<i8"), ("rank", "<u2")])


def _postings(docs: DataFrame, common: np.ndarray, counts: np.ndarray, buckets: int) -> DataFrame:
    """``(base, key, sid, rank)``: prefix tokens (``base``) of at least two sets; ``key`` is the part of the token's sets that one task holds.

    The sets of a common token are dealt to as many buckets as its count asks for when they leave the map
    side, so that no task ever holds all of a token's.
    """
    many = -(-counts // SALT_ROWS)
    split = many > 1
    sent = docs.sparkSession.sparkContext.broadcast((common, counts, common[split], many[split]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, sizes, wide, parts = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                seen, keys, sids, ranks, lens = set(), [], [], [], []
                for sets, ids in _chunks(batch.column(0).slice(i, 4000)):
                    for s, sid in zip(sets, ids, strict=True):
                        if sid is None or sid in seen:
                            continue
                        seen.add(sid)
                        prefix, rank = _prefix(s, hot, sizes)
                        keys.append(prefix)
                        sids.append(sid)
                        ranks.append(rank)
                        lens.append(len(prefix))
                if not keys:
                    continue
                token = np.concatenate(keys)
                rows = np.empty(len(token), _ENTRY)
                rows["key"], rows["sid"], rows["rank"] = token, np.repeat(np.array(sids, np.int64), lens), np.repeat(np.array(ranks, np.uint16), lens)
                dealt = mix(token)
                at, is_wide = _find(wide, token)
                if is_wide.any():
                    part = mix(rows["sid"][is_wide].view(np.uint64)) % parts[at[is_wide]].astype(np.uint64)
                    dealt[is_wide] = mix(dealt[is_wide] + part * np.uint64(0x9E3779B97F4A7C15))
                bucket = ((dealt >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = rows[order]
                full = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([rows[ends[k] : ends[k + 1]].tobytes() for k in full], pa.binary())], ["bucket", "rows"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, found = sent.value[2], {}
        for batch in batches:
            for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(bucket, []).append(rows)
        for bucket in list(found):
            rows = np.frombuffer(b"".join(found.pop(bucket)), _ENTRY)
            rows = rows[np.lexsort((rows["sid"], rows["key"]))]
            first = np.concatenate(([True], (rows["key"][1:] != rows["key"][:-1]) | (rows["sid"][1:] != rows["sid"][:-1])))
            rows = rows[first]
            start = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1])))
            size = np.diff(np.append(start, len(rows)))
            rows = rows[np.repeat((size > 1) | _find(wide, rows["key"][start])[1], size)]
            token = rows["key"].copy()
            base, key = mix(token).view(np.int64), mix(token + np.uint64(bucket + 1)).view(np.int64)
            for i in range(0, len(rows), 100_000):
                j = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(base[j]), pa.array(key[j]), pa.array(rows["sid"][j].copy()), pa.array(rows["rank"][j].astype(np.int32))], ["base", "key", "sid", "rank"])

    sent_rows = docs.select("text").mapInArrow(emit, "bucket int, rows binary")
    return sent_rows.repartition(-(-buckets // 4), "bucket").mapInArrow(gather, "base long, key long, sid long, rank int")


def _find(among: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens are among sorted ones, and whether they are."""
    at = np.minimum(np.searchsorted(among, tokens), max(0, len(among) - 1))
    return at, among[at] == tokens if len(among) else np.zeros(len(tokens), bool)


def _runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    kept = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(i).to_numpy() for b in kept]) for i in range(kept[0].num_columns)] if kept else []


def _leader_pairs(postings: DataFrame, turn: int) -> DataFrame:
    """``(a, b, shared)``: in each token's list, one set of each component with one of the component that leads.

    The set with the least rare part leads, the centre of a cluster of edited copies; the sets that stand for
    components change with the turn. A list of m sets gives less than m pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = _columns(batches)
        if not cols:
            return
        key, comp, sid, rank = cols
        chance = mix(sid.view(np.uint64) + np.uint64(turn))
        order = np.lexsort((chance, comp, key))
        key, comp, sid, rank = (x[order] for x in (key, comp, sid, rank))
        one = np.concatenate(([True], (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])))
        key, comp, sid, rank = (x[one] for x in (key, comp, sid, rank))
        order = np.lexsort((mix(comp.view(np.uint64) + np.uint64(turn)), rank, key))
        key, sid = key[order], sid[order]
        start = _runs(key)
        size = np.diff(np.append(start, len(key)))
        lead = np.repeat(sid[start], size)
        rest = np.ones(len(key), bool)
        rest[start] = False
        a, b = lead[rest], sid[rest]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a[start]), pa.array(b[start]), pa.array(np.diff(np.append(start, len(a))).astype(np.int64))], ["a", "b", "shared"])

    dealt = postings.select("key", "comp", "sid", "rank").repartition("key")
    return dealt.mapInArrow(run, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def _band_of(n: str) -> Column:
    """Sizes in bands of a thirtieth or so."""
    return F.floor(F.log(n) / F.log(F.lit(_BAND)))


_BAND = 1.03
#: Linked sets' bands differ by so much at most.
_REACH = 10


def _partners(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """Postings that can still matter, with ``mask``: the size bands, from ``_REACH`` below a set's own, that it may link into.

    A set may link into a band if as many of its tokens as a link to any size there must share are shared
    with sets of the band in other components. Lists with one component left go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sid, comp, band = (batch.column(k).to_numpy() for k in range(3))
            lists = batch.column(3)
            row, flat = np.repeat(np.arange(len(sid)), np.diff(lists.offsets.to_numpy())), lists.flatten()
            low, high, step = flat.field("low").to_numpy(), flat.field("high").to_numpy(), flat.field("band").to_numpy() - band[row]
            hit = (np.abs(step) <= _REACH) & ((low != comp[row]) | (high != comp[row]))
            own, at_own = np.unique(sid, return_inverse=True)
            counts = np.bincount(at_own[row[hit]] * len(steps) + step[hit] + _REACH, minlength=len(own) * len(steps)).reshape(len(own), -1)
            rows = np.empty(len(own), kind)
            rows["sid"], rows["shared"] = own, counts
            bucket = (mix(own.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends, rows = np.searchsorted(bucket[order], np.arange(buckets + 1)), rows[order]
            full = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([rows[ends[k] : ends[k + 1]].tobytes() for k in full], pa.binary())], ["bucket", "rows"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(r, kind) for batch in batches for r in batch.column(1).to_pylist()]
        if not parts:
            return
        rows = np.concatenate(parts)
        sid, at = np.unique(rows["sid"], return_inverse=True)
        total = np.zeros((len(sid), len(steps)), np.int64)
        np.add.at(total, at, rows["shared"])
        row, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sid[row]), pa.array(step - _REACH), pa.array(total[row, step])], ["sid", "step", "shared"])

    steps = range(-_REACH, _REACH + 1)
    kind = np.dtype([("sid", "<i8"), ("shared", "<i4", (len(steps),))])
    buckets = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    banded = postings.select("base", "comp", "sid", _band_of("n").cast("int").alias("band"))
    lists = banded.groupBy("base", "band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))  # however long a token's list is, it has few bands
    lists = lists.groupBy("base").agg(F.collect_list(F.struct("band", "low", "high")).alias("bands"))
    dealt = banded.join(lists, "base").select("sid", "comp", "band", "bands").mapInArrow(run, "bucket int, rows binary")
    shared = dealt.repartition(buckets, "bucket").mapInArrow(add, "sid long, step long, shared long").join(sets.select("sid", "n"), "sid")
    at = _band_of("n") + F.col("step")
    low = F.greatest(F.floor(F.pow(F.lit(_BAND), at)), F.ceil(F.col("n") * PERCENT / 100))
    high = F.least(F.ceil(F.pow(F.lit(_BAND), at + 1)), F.floor(F.col("n") * 100 / PERCENT))
    able = shared.withColumns({"low": low.cast("long"), "high": high.cast("long")}).where("low <= high")
    able = able.withColumn("must", F.when(F.col("low") <= F.col("high"), _least_must_share(F.col("n"), F.col("low"), F.col("high")))).where(F.col("shared") >= F.col("must"))
    able = able.groupBy("sid").agg(F.sum(F.expr(f"shiftleft(1, int(step) + {_REACH})")).alias("mask"), F.greatest(F.min("must"), F.lit(1)).alias("must"))
    left = postings.drop("mask", "must", "sets").join(able, "sid")
    many = left.groupBy("base").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("sets")).where("x <> y").select("base", "sets")
    return cut(left.join(many, "base"))


def _shortened(postings: DataFrame, *by: str) -> DataFrame:
    """The first tokens of each set's in an order that is the same for all, of which two sets share ``_few`` at least if they share as many as they must."""
    order = Window.partitionBy("sid").orderBy(*by)
    counted = postings.withColumns({"k": F.row_number().over(order), "all": F.count("*").over(Window.partitionBy("sid"))})
    return counted.where(F.col("k") <= F.col("all") - F.col("must") + _few(F.col("must"))).drop("k", "all")


def _few(must: Column) -> Column:
    return F.least(must, F.lit(FEW))


def _matrix(postings: DataFrame) -> DataFrame:
    """``(base, g, comp, size, band, mask)``: the token-group matrix, a row for each token of the union of a group's tokens.

    A group's members are of one component and one band of sizes; ``mask`` has the bands that any may link into.
    """
    own = [F.min(c).alias(c) for c in ("comp", "size", "band")]
    return cut(postings.groupBy("base", "g").agg(*own, F.bit_or("mask").alias("mask")))


def _asked_groups(postings: DataFrame, matrix: DataFrame) -> DataFrame:
    """``(sid, g, shared)``: of how many tokens of a query the matrix has a group of another component.

    Of two components the smaller asks, and so every pair of sets is met once; both must be able to link into the other's band.
    """
    bit = lambda mask, at: F.getbit(mask, at)
    bands = F.filter(F.sequence(F.lit(0), F.lit(2 * _REACH)), lambda i: bit(F.col("mask"), i) == 1)
    asks = postings.select("base", "sid", F.struct("size", "comp").alias("mine"), F.col("band").alias("own"), F.explode(F.transform(bands, lambda i: F.col("band") + i - _REACH)).alias("band"))
    held = matrix.select("base", "band", "g", F.struct("size", "comp").alias("its"), F.col("mask").alias("into"))
    met = asks.join(held, ["base", "band"]).where((F.col("mine") < F.col("its")) & (F.col("mine.comp") != F.col("its.comp")) & (bit(F.col("into"), (F.col("own") - F.col("band") + _REACH).cast("int")) == 1))
    return met.groupBy("sid", "g").agg(F.count("*").alias("shared"))


def _open(members: DataFrame, queries: DataFrame) -> DataFrame:
    """``(src, dst)``: verified links of queries ``(g, salt, sid, text)`` to members ``(g, salt, sid, text)`` of their group.

    A group's rows are sorted members first, so a task holds one group and one query. The group's token union
    bounds the overlap before any member is looked at; a query stops at its first link, its group's members
    being linked already.
    """
    rows = members.select("g", "salt", F.lit(0).alias("asks"), "sid", "text").unionByName(queries.select("g", "salt", F.lit(1).alias("asks"), "sid", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, union, links = None, [], None, []
        for batch in batches:
            for g, salt, asks, sid, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if now != (g, salt):
                    now, sets, union = (g, salt), [], None
                if not asks:
                    sets.append((sid, shingle_set(text.as_py(), WIDTH)))
                    continue
                if union is None and sets:
                    union = np.unique(np.concatenate([s for _, s in sets])) if len(sets) > 1 else sets[0][1]
                mine = shingle_set(text.as_py(), WIDTH)
                if union is None or _overlap(mine, union) < _need(len(mine)):
                    continue
                for other, s in sets:
                    if 100 * min(len(s), len(mine)) >= PERCENT * max(len(s), len(mine)):
                        both = _overlap(mine, s)
                        if 100 * both >= PERCENT * (len(s) + len(mine) - both):
                            links.append((sid, other))
                            break
            if len(links) > 10_000:
                yield _links(links)
                links = []
        if links:
            yield _links(links)

    def _links(links: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["src", "dst"])

    return rows.repartition("g", "salt").sortWithinPartitions("g", "salt", "asks").mapInArrow(run, "src long, dst long")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _salts(asked: DataFrame, each: int = 256) -> DataFrame:
    """Deals a group's queries to one task for each so many."""
    n = asked.groupBy("g").agg(F.ceil(F.count("*") / each).cast("int").alias("salts"))
    return cut(asked.join(n, "g").withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int")))


def _verified(asked: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among ``asked(g, sid)`` and ``members(g, sid)``."""
    dealt = _salts(asked)
    blocks = members.join(dealt.select("g", "salt").distinct(), "g").join(texts, "sid")
    found = cut(_open(blocks, dealt.join(texts, "sid")))
    release(dealt)
    return found


def _sized(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sizes allow a link, and that lead or follow in a quarter as many of the shortened lists as a link must share of the whole ones."""
    a, b = sets.select(F.col("sid").alias("a"), F.col("n").alias("na")), sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"))
    return pairs.join(a, "a").join(b, "b").where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT) & (F.col("shared") * 4 >= _must_share(F.col("na"), F.col("nb"))))


def _pick(docs: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """``(sid, text)`` of the wanted sets, from one document of each."""
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    wanted = wanted.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "sid")
    found = docs.join(wanted, (F.xxhash64("text") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return cut(found.select("sid", "text").repartition(parts, "sid").dropDuplicates(["sid"]))


def _able(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """Postings without sets that share too few of their tokens with others to link, and without tokens that are then one set's."""
    enough = postings.groupBy("sid").agg(F.count("*").alias("shared")).join(sets.select("sid", "n"), "sid").where(F.col("shared") >= _least_partner(F.col("n"))).select("sid")
    left = postings.join(enough, "sid")
    return cut(left.join(left.groupBy("base").agg(F.count("*").alias("sets")).where("sets > 1").select("base"), "base"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row: components of documents linked by Jaccard similarity.

    A document's set is that of its 5-word shingles over ASCII-folded words. Documents with equal sets are
    one from the start. Of every set the prefix that must share tokens with any set it links to is dealt by
    token, common tokens last; token lists shrink to links with a leader, verified exactly; what
    still joins two components is asked of the token-group matrix, and a link between any two sets is found
    there if not before. All work on a list is linear but the last, where groups are pruned by their bound.
    Null texts and texts without words have an empty set, link to nothing and are a component of their
    own; null ids are never a component's id unless all are; an empty table gives no row; other columns
    aren't read. Repeated rows are one set and share their component.
    """
    return _components(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text_key, n_shingles, component_id)``."""
    spark = prepare(docs.sparkSession)
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    every = cut(_sets(light))
    rows = every.where("n is not null")
    sets = cut(rows.where("sid is not null").groupBy("sid").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.min("doc_id").alias("least"), F.max("n").alias("n")))
    common, counts = _common_tokens(every.where("n is null"))
    entries = sets.agg(F.sum(F.col("n") * 0.375 + 2)).first()[0] or 0
    buckets = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(entries // 2_000_000))
    dealt = cut(_postings(light, common, counts, buckets))
    postings = _able(dealt, sets)
    release(dealt)
    texts = _pick(light, cut(sets.join(postings.select("sid").distinct(), "sid").select("one.*", "sid")), buckets // 4)
    comps = None
    for turn in range(LEADER_ROUNDS):
        lists = _shortened(postings.join(sets.select("sid", _least_partner(F.col("n")).alias("must")), "sid"), "base")
        pairs = cut(_sized(_leader_pairs(_with_components(lists, comps), turn), sets).select(F.col("a").alias("g"), F.col("b").alias("sid")))
        found = _verified(pairs, pairs.select("g", F.col("g").alias("sid")).distinct(), texts)
        comps = _joined(comps, found)
    now = _with_components(postings, comps)
    mixed = now.groupBy("base").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("base")
    joined = _able(now.join(mixed, "base"), sets)
    release(postings)
    now = joined.join(sets.select("sid", "n"), "sid").select("base", "comp", "sid", "n")
    for _ in range(PARTNER_ROUNDS):  # who goes takes partners from others
        now = _partners(now, sets)
    release(joined)
    members = now.select("comp", "sid", "n").distinct().withColumn("band", _band_of("n").cast("int"))
    count = members.groupBy("comp", "band").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    members = members.join(count, ["comp", "band"]).join(members.groupBy("comp").agg(F.count("*").alias("size")), "comp")
    members = cut(members.join(now.groupBy("sid").agg(F.first("must").alias("must")), "sid").select("sid", "band", "size", "must", F.xxhash64("comp", "band", F.pmod(F.xxhash64("sid"), F.col("groups"))).alias("g")))
    least_of = members.groupBy("g").agg(F.min("must").alias("least"))
    short = _shortened(now, "sets", "base").join(members.select("sid", "g", "size", "band"), "sid")
    matrix = _matrix(short)
    asked = _asked_groups(short, matrix).join(members.select("sid", "must"), "sid").join(least_of, "g")
    asked = asked.where(F.col("shared") >= _few(F.least("must", "least")))
    asked = cut(asked.select("g", "sid"))
    release(matrix, now)
    comps = _joined(comps, _verified(asked, members.select("g", "sid"), texts)).withColumnRenamed("node", "sid")
    joined = sets.join(comps, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    out = rows.join(joined.join(least, "component").select("sid", "component_id"), "sid", "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components with more links, which aren't needed after."""
    known = links if comps is None else links.unionByName(comps.select(F.col("node").alias("src"), F.col("component").alias("dst")))
    found = cut(connected_components(known))
    release(links)
    return found


def _with_components(postings: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return postings.withColumn("comp", F.col("sid"))
    return postings.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the smallest id of each component, with all their columns, whatever their names; documents without words and rows without id all stay."""
    found = _components(docs, id_col, text_col).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = cut(found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"))
    return rows.join(gone, ["id", "key"], "left_anti").select("row.*")
