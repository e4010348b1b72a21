"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, whole_row, word_count

#: No document is taken more often than this, and no source's target is above so many times its size.
MOST_COPIES = 3
#: Buckets of sampling ranks for each source; a bucket's rows are sorted only where the target falls in it.
RANK_BUCKETS = 4096
#: Documents after the threshold, of each source, that may fill up what is missing.
NEXT_ROWS = 64
#: Up to so many sources the per-source table (a row for each size band, of 60 bytes and up to 64 extras) is broadcast, else it is joined.
BROADCAST_SOURCES = 5_000


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = MOST_COPIES) -> dict[str | None, float]:
    """Words to take from each source.

    Sources in code-point order, null last, get the weights in turn. What a target exceeds ``most`` times
    its source's size goes to the other sources by weight until none is above.
    """
    rows = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(rows)}
    size, total = dict(rows), sum(n for _, n in rows) * share
    free, all_w = list(weight), sum(weight.values())
    target = {s: total * weight[s] / all_w for s in free}
    while over := [s for s in free if target[s] > most * size[s]]:
        excess = sum(target[s] - most * size[s] for s in over)
        target |= {s: float(most * size[s]) for s in over}
        free = [s for s in free if s not in set(over)]
        left = sum(weight[s] for s in free)
        for s in free:
            target[s] += excess * weight[s] / left
    return target


def _preference(band: int) -> float:
    """Longer documents are taken more often, in proportion to the bits of their size."""
    return 1.0 + band


def _expected_copies(bands: dict[int, int], target: float, most: int) -> dict[int, float]:
    """Copies wanted of each size band: in proportion to its preference, ``most`` at most, the words adding up to the target."""
    out, left, free = {}, target, sorted(bands)
    while free:
        scale = left / sum(bands[b] * _preference(b) for b in free) if left > 0 else 0.0
        full = [b for b in free if scale * _preference(b) >= most]
        if not full:
            return out | {b: scale * _preference(b) for b in free}
        out |= {b: float(most) for b in full}
        left -= sum(most * bands[b] for b in full)
        free = [b for b in free if b not in set(full)]
    return out


def _band(size: Column) -> Column:
    return F.floor(F.log2(size + 1.0)).cast("int")


class Plan:
    """How often to take a document, as columns over its source, size and draw; small enough to send to every task."""

    def __init__(self, spark: SparkSession, bands: list[tuple], totals: list[tuple]):
        self.bands = spark.createDataFrame(bands, "of string, band int, whole int, odds double, low double, extras array<long>")
        self.totals = spark.createDataFrame(totals, "of string, source_size long, target double")
        self.wide = len(totals) > BROADCAST_SOURCES

    def sent(self, table: DataFrame) -> DataFrame:
        return table if self.wide else F.broadcast(table)

    def copies(self, rows: DataFrame) -> DataFrame:
        """Adds ``copies`` to rows with ``s``, ``size`` and ``draw``."""
        table = self.bands.withColumnRenamed("band", "its_band")
        rows = rows.join(self.sent(table), F.col("s").eqNullSafe(F.col("of")) & (_band(F.col("size")) == F.col("its_band")), "left")
        extra = (F.col("odds") > 0) & ((_rank(F.col("draw"), F.col("odds")) < F.col("low")) | F.array_contains("extras", F.col("draw")))
        return rows.withColumn("copies", F.coalesce(F.col("whole"), F.lit(0)) + F.coalesce(extra, F.lit(False)).cast("int"))


def _draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A document's random number: a hash of its id and text."""
    return F.xxhash64(F.lit(seed), doc_id, text)


def _rank(draw: Column, odds: Column) -> Column:
    """A document's Pareto rank: the odds of a random number by the odds of its inclusion, brought into 0 to 1."""
    u = (F.shiftrightunsigned(draw, 11) + 0.5) / float(1 << 53)
    q = u / (1.0 - u) / F.nullif(odds, F.lit(0.0))
    return q / (1.0 + q)


def _sized(docs: DataFrame, seed: int, id_col: str, source: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.col(source).cast("string").alias("s"), word_count(F.col(text_col)).alias("size"), _draw(seed, F.col(id_col), F.col(text_col)).alias("draw"))


def plan_mix(light: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = MOST_COPIES) -> Plan:
    """Targets, whole copies and sampling thresholds of every source, for rows with ``s``, ``size`` and ``draw``.

    A source's target is spread over its documents as expected copies, more for longer ones; the whole
    part of them is certain. The rest are inclusion probabilities, unequal by size: documents are ordered
    by the odds of their random number over the odds of inclusion, and the first of them are taken up to the
    words that the target still lacks. Histograms of the ranks find where that is, so that no source is
    ever sorted or gathered as a whole. From the document on that no longer fits, those that do still go in,
    and one more if that is nearer: a source misses its target by half that document's words at most.
    The driver holds a row for each source and band of sizes (63 at most).
    """
    spark = light.sparkSession
    found: dict = {}
    numbers: dict = {}
    light = light.withColumn("band", _band(F.col("size")))
    for s, band, n, rows_there in light.groupBy("s", "band").agg(F.sum("size"), F.count("*")).toLocalIterator():  # as many rows as sources by 63 bands
        found.setdefault(s, {})[band] = n
        numbers[s, band] = rows_there
    totals = {s: sum(bands.values()) for s, bands in found.items()}
    targets = source_targets(list(totals.items()), weights, share, most)  # sources without words have a weight too
    rows, need = [], {}
    for s, bands in found.items():
        bands.pop(0, None)  # documents without words
        copies = _expected_copies(bands, targets[s], most)
        whole = {b: min(most, int(e + 1e-12)) for b, e in copies.items()}
        part = {b: max(0.0, e - whole[b]) if whole[b] < most else 0.0 for b, e in copies.items()}
        need[s] = targets[s] - sum(whole[b] * n for b, n in bands.items())
        rows += [(s, b, whole[b], part[b] / (1 - part[b]) if part[b] > 1e-12 else 0.0) for b in bands]
    send = (lambda t: t) if len(found) > BROADCAST_SOURCES else F.broadcast
    base = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "s2 string, band2 int, odds double")
    ranked = light.join(send(base), F.col("s").eqNullSafe(F.col("s2")) & (F.col("band") == F.col("band2"))).where("odds > 0")
    ranked = cut(ranked.select("s", "size", "draw", _rank(F.col("draw"), F.col("odds")).alias("rank")))
    low, width, have, open_ = {s: 0.0 for s in found}, 1.0, {s: 0 for s in found}, {s for s in found if need[s] > 0}
    span: dict = {}  # the width of the bucket where a source's target falls
    for _ in range(4):  # each round looks into the bucket of the last where the target falls
        ask = spark.createDataFrame([(s, low[s], float(need[s] - have[s])) for s in open_], "s3 string, low double, need double")
        inside = ranked.join(send(ask), F.col("s").eqNullSafe(F.col("s3"))).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + width))
        bucket = F.floor((F.col("rank") - F.col("low")) / width * RANK_BUCKETS).cast("int")
        sums = inside.groupBy("s", "need", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
        hit = sums.withColumn("upto", upto).where("upto >= need and upto - words < need").select("s", "bucket", F.expr("upto - words").alias("before"), "n").collect()
        if width == 1.0:
            low |= {s: 2.0 for s in open_ - {r.s for r in hit}}  # all of it is too little
        width, open_ = width / RANK_BUCKETS, {r.s for r in hit if r.n > NEXT_ROWS // 2}
        for r in hit:
            low[r.s], have[r.s], span[r.s] = low[r.s] + r.bucket * width, have[r.s] + r.before, width
        if not open_:
            break
    # Ranks below ``low`` are in. Of the next documents in order those go in that still fit, then one more if that is nearer.
    # They are looked for in a stretch of ranks that should hold some times as many, not in all of a source.
    part = {r[0]: 0 for r in rows}
    for r in rows:
        part[r[0]] += numbers[r[0], r[1]] if r[3] > 0 else 0
    ask = spark.createDataFrame([(s, low[s], low[s] + max(span.get(s, 1.0), 4 * NEXT_ROWS / max(1, part[s]))) for s in found if need[s] > 0 and low[s] < 2], "s3 string, low double, high double")
    near = ranked.join(send(ask), F.col("s").eqNullSafe(F.col("s3"))).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    near = near.groupBy("s", "rank", "draw").agg(F.sum("size").alias("words"))  # repeated rows go together
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("rank", "draw"))).where(F.col("n") <= NEXT_ROWS)
    following: dict = {}
    for r in near.orderBy("s", "n").toLocalIterator():
        following.setdefault(r.s, []).append(r)
    extras: dict = {s: [] for s in found}
    for s, some in following.items():
        for r in some:
            if r.words <= need[s] - have[s]:
                have[s] += r.words
                extras[s].append(r.draw)
        gap = need[s] - have[s]
        spare = [r for r in some if r.draw not in set(extras[s])]
        if spare and abs(gap - (best := min(spare, key=lambda r: abs(gap - r.words))).words) < gap:
            extras[s].append(best.draw)
    return Plan(spark, [(*r, low[r[0]] if need[r[0]] > 0 else 0.0, extras[r[0]]) for r in rows], [(s, n, float(targets[s])) for s, n in totals.items()])


def mix_decisions(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = MOST_COPIES, seed: int = 7, id_col: str = "doc_id", source: str = "source", text_col: str = "text") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for every row.

    A document's size is its number of words; documents without words are never taken, but their sources
    count among those that weights are dealt to. Reruns agree: the random numbers are hashes of id and text,
    and rows that repeat both share one decision. Null sources are one source, last in order; null ids and
    null texts count like others. An empty table gives no row; other columns aren't read.
    """
    light = cut(_sized(docs, seed, id_col, source, text_col, F.col(id_col).alias("doc_id"), F.col(source).alias("source")))
    plan = plan_mix(light, weights, share, most)
    out = plan.copies(light).drop("of").join(plan.sent(plan.totals), F.col("s").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = MOST_COPIES, seed: int = 7, id_col: str = "doc_id", source: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that the mix takes, each as often as it takes it, with all their columns, whatever their names."""
    plan = plan_mix(cut(_sized(docs, seed, id_col, source, text_col)), weights, share, most)
    rows = plan.copies(_sized(docs, seed, id_col, source, text_col, whole_row(docs))).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
