"""Trigram similarity, edit distance and phonetic codes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trigrams(text: Column) -> Column:
    """The sorted distinct trigrams of a text: words are lower-case runs of letters and digits, with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))))
    return F.array_sort(F.array_distinct(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams by all trigrams of both; 0 for two texts without any."""
    return _similarity(trigrams(a), trigrams(b))


def _similarity(x: Column, y: Column) -> Column:
    both, all_ = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(x.isNull() | y.isNull(), None).when(all_ == 0, F.lit(0.0)).otherwise(both / all_).cast("float")


def _trigram_list(text: str) -> list[list[str]]:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return [[f"  {w} "[i : i + 3] for i in range(len(w) + 1)] for w in words]


def _extent(query: str, text: str, strict: bool) -> float:
    """The best similarity of the query's trigrams to a run of the text's, of whole words if strict."""
    mine = {g for w in _trigram_list(query) for g in w}
    parts = [set(w) for w in _trigram_list(text)] if strict else [{g} for w in _trigram_list(text) for g in w]
    best = 0.0
    for i in range(len(parts)):
        run: set[str] = set()
        for part in parts[i:]:
            run |= part
            best = max(best, len(mine & run) / len(mine | run))
    return best


@F.pandas_udf(T.FloatType())
def word_similarity(query: pd.Series, text: pd.Series) -> pd.Series:
    """The greatest similarity of a query to any stretch of a text's trigrams."""
    return pd.Series([None if q is None or t is None else _extent(q, t, False) for q, t in zip(query, text, strict=True)], dtype="float32")


@F.pandas_udf(T.FloatType())
def strict_word_similarity(query: pd.Series, text: pd.Series) -> pd.Series:
    """The same over whole words."""
    return pd.Series([None if q is None or t is None else _extent(q, t, True) for q, t in zip(query, text, strict=True)], dtype="float32")


#: The thresholds of the trigram operators.
THRESHOLDS = {"%": 0.3, "<%": 0.6, "%>": 0.6, "<<%": 0.5, "%>>": 0.5}


def trigram_match(a: Column, op: str, b: Column, threshold: float | None = None) -> Column:
    """``a % b``, ``a <% b`` (word similarity) and ``a <<% b`` (strict), and their mirror images."""
    limit = THRESHOLDS[op] if threshold is None else threshold
    if op == "%":
        return similarity(a, b) >= limit
    measure = strict_word_similarity if len(op) == 3 else word_similarity
    return (measure(a, b) if op.startswith("<") else measure(b, a)) >= limit


def trigram_distance(a: Column, b: Column) -> Column:
    return (1 - similarity(a, b)).cast("float")


#: The longest prefix of which all pairs are listed, and the rows of a key that meet in one part.
MOST_PAIRED, PART = 12, 1000


def _dealt(rows, often, key: str, row: str):
    """Rows with one of ``__parts`` parts of their key by another column; keys that ``often`` has ``__rows`` of up to PART for are one part."""
    many = often.where(F.col("__rows") > PART).select(key, F.ceil(F.col("__rows") / PART).alias("__parts"))
    known = rows.join(many, key, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1).cast("long")))
    return known.withColumn("__part", F.pmod(F.xxhash64(row), "__parts"))


def similar_pairs(left, right, on_left: str, on_right: str, threshold: float = 0.3):
    """Pairs of rows whose columns are similar. Different texts are compared once, and their rows follow from the pairs of texts.

    Trigrams are ordered by how many texts have them, rare ones first. Two similar texts of m and n trigrams share at
    least ``threshold / (1 + threshold) * (m + n)`` and at least ``ceil(threshold * n)``, and so k of the first
    ``n - ceil(threshold * n) + k`` of either. Texts are blocked by two of these where that lists few pairs, by one
    where a text is longer or so short that one may be all it shares. Those that meet are compared if their numbers of trigrams,
    what can still follow and what 64 bits of either show to be its own allow it; no cross join is made, and each pair is met
    at the first trigrams that it shares only.
    """
    keyed = lambda df, name, k: df.where(F.col(name).isNotNull()).withColumn(k, F.unhex(F.sha2(F.col(name).cast("string"), 256)))
    a, b = keyed(left, on_left, "__a"), keyed(right, on_right, "__b")
    side = lambda df, name, k, l, r: df.select(F.col(k).alias("k"), F.col(name).cast("string").alias("text"), F.lit(l).alias("l"), F.lit(r).alias("r"))
    texts = side(a, on_left, "__a", 1, 0).unionAll(side(b, on_right, "__b", 0, 1)).groupBy("k").agg(F.first("text").alias("text"), F.sum("l").alias("l"), F.sum("r").alias("r"))
    each = texts.select("k", "l", "r", F.explode(trigrams(F.col("text"))).alias("g"))
    listed = each.join(each.groupBy("g").agg(F.count("*").alias("df")), "g").groupBy("k", "l", "r").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("g"))
    listed = listed.select("k", "l", "r", F.col("g.g").alias("g"), F.size("g").alias("n"))

    shared = lambda n: F.ceil(n * F.lit(float(threshold)) - 1e-9).cast("int")
    paired = lambda n: (shared(n) > 1) & (n - shared(n) + 2 <= MOST_PAIRED)
    n = F.col("n")
    # Numbers of trigrams up to `low` and from `high` aren't blocked by two; what may meet such a text is blocked by one as well.
    low, high = int(1 / threshold + 1e-9), (MOST_PAIRED - 1) / (1 - threshold) if threshold < 1 else float("inf")
    single = ~paired(n) | (n <= low / threshold + 1e-9) | (n >= (high - 1) * threshold)
    ways = F.array_compact(F.array(F.when(single, 1), F.when(paired(n), 2)))
    blocks = listed.withColumn("way", F.explode(ways)).withColumn("p", F.slice("g", F.lit(1), n - shared(n) + F.col("way")))
    bits = F.aggregate("g", F.lit(0).cast("long"), lambda found, g: found.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))))
    blocks = blocks.select("k", "l", "r", "n", "way", bits.alias("bits"), F.array_join("g", "").alias("g"), "p", F.posexplode("p").alias("before", "s"))
    blocks = blocks.select("k", "l", "r", "n", "way", "bits", "g", "before", "s", F.posexplode(F.when(F.col("way") == 2, F.col("p")).otherwise(F.array("s"))).alias("at", "t"))
    blocks = blocks.where("way = 1 OR at > before").selectExpr("k", "l", "r", "n", "way", "bits", "g", "if(way = 1, before, at) AS at", "if(way = 1, s, concat(s, t)) AS t")

    places = _dealt(blocks, blocks.groupBy("t").agg(F.count("*").alias("__rows")), "t", "k")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))
    x = places.where("l > 0").select("t", "way", F.col("__part").alias("part"), others.alias("other"), F.col("k").alias("__a"), F.col("n").alias("m"), F.col("bits").alias("own"), F.col("g").alias("f"), F.col("at").alias("as"))
    y = places.where("r > 0").select("t", F.col("__part").alias("other"), others.alias("part"), F.col("k").alias("__b"), "n", "bits", "g", "at", "r")
    m, way, grams = F.col("m"), F.col("way"), lambda c: F.regexp_extract_all(c, F.lit("(?s)..."), F.lit(0))
    size = F.least(m, n) >= threshold * F.greatest(m, n) - 1e-9
    can = (F.least(m - F.col("as"), n - F.col("at")) + way - 1) * (1 + threshold) >= threshold * (m + n) - 1e-9
    least = (m + n) * (threshold / (1 + threshold)) - 1e-9
    rest = (F.bit_count(F.expr("own & ~bits")) <= m - least) & (F.bit_count(F.expr("bits & ~own")) <= n - least)
    prefix = lambda c, n: grams(F.substring(c, F.lit(1), 3 * (n - shared(n) + way)))
    first = F.array_join(F.slice(F.array_intersect(prefix("f", m), prefix("g", n)), F.lit(1), way), "") == F.col("t")
    met = x.hint("merge").join(y, ["t", "part", "other"]).where(((way == 2) == (paired(m) & paired(n))) & size & can & rest & first)
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("r") / PART) - 1)).alias("__part")
    pairs = met.select("__a", "__b", "r", _similarity(grams("f"), grams("g")).alias("__s")).where(F.col("__s") >= threshold).select("__a", "__b", "__s", parts)

    rows = b.withColumn("__row", F.monotonically_increasing_id())
    dealt = _dealt(rows, texts.select(F.col("k").alias("__b"), F.col("r").alias("__rows")), "__b", "__row")
    found = pairs.join(a, "__a").hint("merge").join(dealt, ["__b", "__part"])
    return found.withColumn("similarity", F.col("__s")).drop("__a", "__b", "__part", "__parts", "__row", "__s")


def levenshtein_less_equal(a: Column, b: Column, most: int) -> Column:
    """The edit distance if it is at most ``most``, else one more than that."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def weighted_levenshtein(insert: int = 1, delete: int = 1, substitute: int = 1) -> callable:
    """An edit distance with costs, as a function of two columns."""

    @F.pandas_udf("int")
    def distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([None if x is None or y is None else edit_cost(x, y, insert, delete, substitute) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return distance


def edit_cost(a: str, b: str, insert: int, delete: int, substitute: int) -> int:
    row = [j * insert for j in range(len(b) + 1)]
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i * delete
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + delete, row[j - 1] + insert, last + (c != d) * substitute)
    return row[-1]


def soundex(text: Column) -> Column:
    """The code of a text's letters; empty without letters."""
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def difference(a: Column, b: Column) -> Column:
    """How many of the four characters of two soundex codes agree; all if both are empty."""
    x, y = soundex(a), soundex(b)
    same = sum(((F.substring(x, i, 1) == F.substring(y, i, 1)) & (F.substring(x, i, 1) != "")).cast("int") for i in range(1, 5))
    return F.when((x == "") & (y == ""), 4).otherwise(same)
