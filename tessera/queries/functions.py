"""Scalar functions: texts, numbers, times, similarity, vectors, maps, arrays, paths, cubes, the earth, digests, full text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import collections as C
from tessera.functions import citext, core, crypto, geometry, similarity, trees, vectors
from tessera.functions.phonetics import dmetaphone_codes, metaphone_column
from tessera.queries.registry import query, sql_query, t
from tessera.search import fts
from tessera.search import vectors as V
from tessera.types import soft_cast, to_bool, to_int

# Core. F1-F29

sql_query("fn_int_arithmetic", "SELECT n_nationkey, n_nationkey // 7 AS q, n_nationkey % 7 AS r, (n_nationkey - 12) // 5 AS neg, n_nationkey & 6 AS a, n_nationkey | 8 AS o, xor(n_nationkey, 5) AS x FROM nation", spark="SELECT n_nationkey, CAST(n_nationkey div 7 AS INT) AS q, n_nationkey % 7 AS r, CAST((n_nationkey - 12) div 5 AS INT) AS neg, n_nationkey & 6 AS a, n_nationkey | 8 AS o, n_nationkey ^ 5 AS x FROM nation", oracle="SELECT n_nationkey, n_nationkey // 7 AS q, n_nationkey % 7 AS r, CAST(trunc((n_nationkey - 12) / 5.0) AS INTEGER) AS neg, n_nationkey & 6 AS a, n_nationkey | 8 AS o, xor(n_nationkey, 5) AS x FROM nation")
sql_query("fn_text", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, reverse(c_name) AS r, length(c_name) AS n, replace(c_name, '0', 'o') AS rep, coalesce(nullif(c_mktsegment, 'BUILDING'), '?') AS c, greatest(c_custkey, 700) AS g, least(c_custkey, 700) AS le, concat_ws('-', c_name, NULL, 'x') AS cw FROM customer", spark="SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, reverse(c_name) AS r, CAST(length(c_name) AS BIGINT) AS n, replace(c_name, '0', 'o') AS rep, coalesce(nullif(c_mktsegment, 'BUILDING'), '?') AS c, greatest(c_custkey, 700) AS g, least(c_custkey, 700) AS le, concat_ws('-', c_name, NULL, 'x') AS cw FROM customer")


@query("SELECT c_custkey, concat(c_name, NULL, c_mktsegment) AS c, substring(c_name, 0, 4) AS s0, substring(c_name, 3, 5) AS s3, left(c_name, 4) AS l, right(c_name, 3) AS r, ltrim(c_name, 'Cus') AS lt, trim(c_name, 'C1') AS tb, strpos(c_name, '#') AS p FROM customer")
def fn_text_divergent(spark, d):
    n = F.col("c_name")
    return t(spark, d, "customer").select(
        "c_custkey", core.concat(n, F.lit(None), F.col("c_mktsegment")).alias("c"), core.substring(n, 0, 4).alias("s0"), core.substring(n, 3, 5).alias("s3"), core.left(n, 4).alias("l"),
        core.right(n, 3).alias("r"), core.trim_chars(n, "Cus", "left").alias("lt"), core.trim_chars(n, "C1").alias("tb"), F.locate("#", n).cast("long").alias("p"),
    )


@query("SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, sign(c_acctbal) AS s, trunc(c_acctbal) AS t, round(sqrt(abs(c_acctbal)), 9) AS q, round(pow(c_acctbal, 2), 3) AS p, CAST(sign(c_acctbal) * floor(abs(c_acctbal) + 0.5) AS INTEGER) AS i FROM customer")
def fn_numeric(spark, d):
    x = F.col("c_acctbal")
    return t(spark, d, "customer").select("c_custkey", F.abs(x).alias("a"), F.ceil(x).cast("double").alias("c"), F.floor(x).cast("double").alias("f"), F.signum(x).cast("int").alias("s"), core.truncate(x).cast("double").alias("t"), F.round(F.sqrt(F.abs(x)), 9).alias("q"), F.round(F.pow(x, F.lit(2)), 3).alias("p"), to_int(x).alias("i"))


@query("SELECT CAST(i AS DOUBLE) / 2 AS x, round_even(CAST(i AS DOUBLE) / 2, 0) + 0.0 AS r FROM range(-5, 6) g(i)")
def fn_round_even(spark, d):
    return spark.range(-5, 6).select((F.col("id") / 2).alias("x"), (core.round_even(F.col("id") / 2) + 0.0).alias("r"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(extract(dow FROM o_orderdate) AS INTEGER) AS dow, CAST(extract(doy FROM o_orderdate) AS INTEGER) AS doy, CAST(extract(week FROM o_orderdate) AS INTEGER) AS w, CAST(extract(quarter FROM o_orderdate) AS INTEGER) AS q FROM orders")
def fn_extract(spark, d):
    x = F.col("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", *[core.extract(f, x).alias(a) for f, a in (("year", "y"), ("month", "m"), ("day", "d"), ("dow", "dow"), ("doy", "doy"), ("week", "w"), ("quarter", "q"))])


@query("SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS m, CAST(second(ts) AS INTEGER) AS s FROM events")
def fn_extract_time(spark, d):
    x = F.col("ts")
    return t(spark, d, "events").select("event_id", *[core.extract(f, x).alias(f[0]) for f in ("hour", "minute", "second")])


@query("SELECT c_custkey, TRY_CAST(substring(c_name, 10, 3) AS INTEGER) AS i, CASE WHEN c_custkey % 2 = 0 THEN true ELSE false END AS b FROM customer")
def fn_soft_casts(spark, d):
    odd = F.when(F.col("c_custkey") % 2 == 0, "Yes").otherwise("off")
    return t(spark, d, "customer").select("c_custkey", soft_cast(F.substring("c_name", 10, 3), "integer").alias("i"), to_bool(odd).alias("b"))


@query("SELECT n_regionkey, CAST(count(*) AS INTEGER) AS n, string_agg(CASE WHEN n_nationkey > 5 THEN n_name END, ',' ORDER BY n_nationkey) AS joined FROM nation GROUP BY n_regionkey")
def fn_arrays(spark, d):
    items = F.array_sort(F.collect_list(F.struct("n_nationkey", F.when(F.col("n_nationkey") > 5, F.col("n_name")).alias("v"))))
    df = t(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(items, lambda x: x["v"]).alias("a"))
    return df.select("n_regionkey", core.array_length(F.col("a")).alias("n"), core.array_to_string(F.col("a"), ",").alias("joined"))


# Similarity. X1-X9

_TRGM = """WITH w AS (SELECT {key} AS k, list_filter(regexp_split_to_array(lower({col}), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM {table}),
 g AS (SELECT k, list_sort(list_distinct(flatten(list_transform(ws, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))) AS t FROM w)"""


@query(_TRGM.format(key="p_partkey", col="p_name", table="part") + " SELECT k AS p_partkey, t AS grams FROM g")
def trgm_show(spark, d):
    return t(spark, d, "part").select("p_partkey", similarity.trigrams(F.col("p_name")).alias("grams"))


@query(_TRGM.format(key="p_partkey", col="p_name", table="part") + ", q AS (SELECT list_distinct(flatten(list_transform(['almond', 'part'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS t) SELECT k AS p_partkey, CAST(len(list_intersect(g.t, q.t)) AS FLOAT) / len(list_distinct(list_concat(g.t, q.t))) AS sim FROM g, q", oracle=_TRGM.format(key="p_partkey", col="p_name", table="part") + ", q AS (SELECT list_distinct(flatten(list_transform(['almond', 'part'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS t) SELECT k AS p_partkey, round(CAST(CAST(len(list_intersect(g.t, q.t)) AS DOUBLE) / len(list_distinct(list_concat(g.t, q.t))) AS DOUBLE), 5) AS sim FROM g, q")
def trgm_similarity(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(similarity.similarity(F.col("p_name"), F.lit("almond part")).cast("double"), 5).alias("sim"))


@query(_TRGM.format(key="s_suppkey", col="s_name", table="supplier") + " SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.k < b.k WHERE len(list_intersect(a.t, b.t)) >= 0.8 * len(list_distinct(list_concat(a.t, b.t)))")
def trgm_similar_pairs(spark, d):
    s = t(spark, d, "supplier")
    found = similarity.similar_pairs(s.selectExpr("s_suppkey AS a", "s_name AS x"), s.selectExpr("s_suppkey AS b", "s_name AS y"), "x", "y", 0.8)
    return found.where("a < b").select("a", "b")


_GRAMS = "list_transform(range(1, length({w}) + 2), lambda i: substring('  ' || {w} || ' ', i, 3))"
_SIM = "CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b})))"


@query(f"""
    WITH q AS (SELECT {_GRAMS.format(w="'ring'")} AS q),
    w AS (SELECT p_partkey, list_transform(string_split(lower(p_name), ' '), lambda w: {_GRAMS.format(w="w")}) AS ws FROM part),
    g AS (SELECT p_partkey, ws, flatten(ws) AS gs FROM w),
    ends AS (SELECT p_partkey, ws, gs, i, unnest(range(i, len(gs) + 1)) AS j FROM (SELECT p_partkey, ws, gs, unnest(range(1, len(gs) + 1)) AS i FROM g)),
    word AS (SELECT p_partkey, max({_SIM.format(a="list_distinct(gs[i:j])", b="q")}) AS s FROM ends, q GROUP BY 1),
    runs AS (SELECT p_partkey, ws, i, unnest(range(i, len(ws) + 1)) AS j FROM (SELECT p_partkey, ws, unnest(range(1, len(ws) + 1)) AS i FROM g)),
    strict AS (SELECT p_partkey, max({_SIM.format(a="list_distinct(flatten(ws[i:j]))", b="q")}) AS s FROM runs, q GROUP BY 1),
    o AS (SELECT list_distinct(list_concat({_GRAMS.format(w="'hot'")}, {_GRAMS.format(w="'ring'")})) AS o),
    whole AS (SELECT p_partkey, {_SIM.format(a="list_distinct(gs)", b="o")} AS s FROM g, o)
    SELECT p_partkey, round(word.s, 5) AS word, round(strict.s, 5) AS strict, whole.s >= 0.3 AS match, strict.s >= 0.5 AS inside, round(1 - whole.s, 5) AS dist
    FROM word JOIN strict USING (p_partkey) JOIN whole USING (p_partkey)""")
def trgm_word_similarity(spark, d):
    name, rounded = F.col("p_name"), lambda c: F.round(c.cast("double"), 5)
    word, strict = similarity.word_similarity(F.lit("ring"), name), similarity.strict_word_similarity(F.lit("ring"), name)
    return t(spark, d, "part").select("p_partkey", rounded(word).alias("word"), rounded(strict).alias("strict"), similarity.trigram_match(name, "%", F.lit("hot ring")).alias("match"), similarity.trigram_match(F.lit("ring"), "<<%", name).alias("inside"), rounded(similarity.trigram_distance(name, F.lit("hot ring"))).alias("dist"))


@query("SELECT c_custkey, levenshtein(c_name, 'Customer#000000042') AS d, least(levenshtein(c_name, 'Customer#000000042'), 3) AS capped FROM customer")
def lev_distance(spark, d):
    n, other = F.col("c_name"), F.lit("Customer#000000042")
    return t(spark, d, "customer").select("c_custkey", F.levenshtein(n, other).cast("long").alias("d"), similarity.levenshtein_less_equal(n, other, 2).cast("long").alias("capped"))


@query("""
    WITH RECURSIVE r(k, s, i, costs) AS (
        SELECT p_partkey, p_name, 0, list_transform(range(0, 9), lambda j: j * 2) FROM part
        UNION ALL
        SELECT k, s, i + 1, list_reduce(list_prepend([CAST((i + 1) * 3 AS BIGINT)], list_transform(range(1, 9), lambda j: [j])), lambda done, j: list_append(done, least(costs[j[1] + 1] + 3, done[len(done)] + 2, costs[j[1]] + CASE WHEN s[i + 1] <> ('old ring')[j[1]] THEN 4 ELSE 0 END)))
        FROM r WHERE i < length(s)
    )
    SELECT k AS p_partkey, CAST(costs[9] AS INTEGER) AS cost FROM r WHERE i = length(s)""")
def lev_weighted(spark, d):
    return t(spark, d, "part").select("p_partkey", similarity.weighted_levenshtein(2, 3, 4)(F.col("p_name"), F.lit("old ring")).alias("cost"))


_CODE = "translate(replace(replace(upper(regexp_replace({x}, '[^A-Za-z]', '', 'g')), 'H', ''), 'W', ''), 'AEIOUYBFPVCGJKQSXZDTLMNR', '000000111122222222334556')"
_RUNS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '0+', '0', 'g'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g')"


@query(f"""
    WITH n AS (SELECT p_partkey, upper(p_name[1]) AS f, {_RUNS.format(x=_CODE.format(x="p_name"))} AS c, p_name FROM part),
    s AS (SELECT p_partkey, left(f || replace(CASE WHEN f IN ('H', 'W') THEN c ELSE c[2:] END, '0', '') || '000', 4) AS code FROM n)
    SELECT p_partkey, code, CAST((code[1] = 'R')::INT + (code[2] = '3')::INT + (code[3] = '3')::INT + (code[4] = '6')::INT AS INTEGER) AS same FROM s""")
def soundex_difference(spark, d):
    n = F.col("p_name")
    return t(spark, d, "part").select("p_partkey", similarity.soundex(n).alias("code"), similarity.difference(n, F.lit("rated rod")).alias("same"))


# Vectors. X10-X11 V6 E4-E6

_Q = "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def _first(spark, d):
    return [float(x) for x in t(spark, d, "embeddings").where("vec_id = 0").first().embedding]


@query(_Q + " SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS l2, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS ip, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS cos, round(list_sum(list_transform(list_zip(embedding, q), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS l1 FROM embeddings, q")
def vec_distances(spark, d):
    v, q = F.col("embedding"), F.array(*map(F.lit, _first(spark, d)))
    f = {"l2": vectors.l2_distance, "ip": vectors.inner_product, "cos": vectors.cosine_distance, "l1": vectors.l1_distance}
    return t(spark, d, "embeddings").select("vec_id", *[F.round(g(v, q), 6).alias(n) for n, g in f.items()])


@query("SELECT vec_id, len(embedding) AS dims, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vec_norm(spark, d):
    v = F.col("embedding")
    return t(spark, d, "embeddings").select("vec_id", vectors.vector_dims(v).cast("long").alias("dims"), F.round(vectors.vector_norm(v), 6).alias("norm"))


@query(_Q + " SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS dist FROM embeddings, q WHERE label <> 5 ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), vec_id LIMIT 10")
def vec_filtered_top_k(spark, d):
    found = V.nearest(t(spark, d, "embeddings"), "embedding", _first(spark, d), 10, "<->", F.col("label") != 5, "vec_id")
    return found.select("vec_id", F.round("dist", 6).alias("dist"))


@query("SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank BETWEEN 2 AND 10")
def vec_batch_top_k(spark, d):
    e = t(spark, d, "embeddings")
    asks = e.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    found = V.nearest_of_each(asks, e.withColumnRenamed("vec_id", "id"), 10, "<=>")
    return found.where("rank > 1").select("query_id", "id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(_Q + " SELECT string_agg('[' || vec_id || '] label ' || label, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY d, vec_id) AS context FROM (SELECT vec_id, label, list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS d FROM embeddings, q ORDER BY d, vec_id LIMIT 5)")
def rag_context(spark, d):
    docs = t(spark, d, "embeddings").select("vec_id", "embedding", F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))
    return V.context(V.retrieve(docs, _first(spark, d), 5, "vec_id"))


@query("SELECT n_nationkey, sha256('hash-sha256' || chr(31) || n_name) AS mark FROM nation")
def embed_idempotent(spark, d):
    rule = V.Rule("nation", "n_name", "v")
    twice = V.refresh(V.refresh(t(spark, d, "nation"), rule), rule)
    return twice.where("size(v) = 64").select("n_nationkey", F.col("_v_srchash").alias("mark"))


@query("SELECT doc_id, sha256('hash-sha256' || chr(31) || text) AS mark FROM documents WHERE text <> ''")
def embed_documents(spark, d):
    """All documents' texts as vectors, with the mark that tells whether they have changed since."""
    rows = V.refresh(t(spark, d, "documents").select("doc_id", "text"), V.Rule("documents", "text", "v"))
    return rows.where("size(v) = 64").select("doc_id", F.col("_v_srchash").alias("mark"))


# Maps, arrays, paths, cubes, the earth. X12-X20


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type = 'click' AS has, CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS joined, CAST(len(json_keys(props)) + 1 AS INTEGER) AS n, true AS inside, false AS back FROM events")
def map_hstore(spark, d):
    h = F.from_json("props", "map<string,string>")
    more = C.hstore_concat(h, C.hstore(F.array("event_type", "event_type"), F.array(F.col("user_id").cast("string"), F.lit("second"))))
    df = t(spark, d, "events").select("event_id", h.alias("h"), more.alias("m"))
    return df.select("event_id", C.hstore_get(F.col("h"), "k").alias("k"), C.hstore_has(F.col("m"), "click").alias("has"), C.hstore_get(F.col("m"), "click").alias("joined"), F.size(C.hstore_keys(F.col("m"))).alias("n"), C.hstore_contains(F.col("m"), F.col("h")).alias("inside"), C.hstore_contains(F.col("h"), F.col("m")).alias("back"))


@query("WITH a AS (SELECT o_orderkey, list(l_linenumber ORDER BY l_linenumber) AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT o_orderkey, len(x) AS n, list_sort(list_distinct(list_concat(x, [2, 9]))) AS u, list_sort(list_intersect(list_distinct(x), [1, 2])) AS i, list_has_any(x, [3]) AS o, list_has_all(x, [1, 2]) AS c, list_reverse_sort(x) AS r FROM a")
def arr_intarray(spark, d):
    a = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.expr("l_orderkey = o_orderkey")).groupBy("o_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("x"))
    x, ints = F.col("x"), lambda *v: F.array(*map(F.lit, v))
    return a.select("o_orderkey", C.icount(x).cast("long").alias("n"), C.union(x, ints(2, 9)).alias("u"), C.intersection(x, ints(1, 2)).alias("i"), C.overlaps(x, ints(3)).alias("o"), C.contains(x, ints(1, 2)).alias("c"), C.sort(x, True).alias("r"))


@query("SELECT n_nationkey, r_name || '.' || n_name AS path, CAST(2 AS INTEGER) AS levels, r_name AS parent, r_regionkey = 1 AS under, starts_with(r_name, 'A') AS starts FROM nation JOIN region ON n_regionkey = r_regionkey")
def ltree_paths(spark, d):
    df = t(spark, d, "nation").join(t(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    path = F.concat_ws(".", "r_name", "n_name")
    one = t(spark, d, "region").where("r_regionkey = 1").first().r_name
    return df.select("n_nationkey", path.alias("path"), trees.nlevel(path).alias("levels"), trees.subpath(path, 0, 1).alias("parent"), trees.is_ancestor(F.lit(one), path).alias("under"), trees.matches(path, "A*.*").alias("starts"))


@query("SELECT c_custkey, round(sqrt(pow(greatest(c_acctbal - 500, -c_acctbal, 0), 2) + pow(greatest(c_nationkey - 10, 0), 2)), 6) AS d, c_acctbal <= 500 AND c_nationkey <= 10 AND c_acctbal >= 0 AS inside FROM customer")
def cube_distance(spark, d):
    box = geometry.cube(F.array(F.lit(500.0), F.lit(10.0)), F.array(F.lit(0.0), F.lit(0.0)))
    point = geometry.cube(F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")))
    return t(spark, d, "customer").select("c_custkey", F.round(geometry.cube_distance(box, point), 6).alias("d"), geometry.cube_contains(box, point).alias("inside"))


@query("SELECT n_nationkey, round(2 * 6378168 * asin(sqrt(pow(sin(radians(n_nationkey * 3.0 - 30) / 2), 2) + cos(radians(n_nationkey * 3.0 - 30)) * pow(sin(radians(n_nationkey * 7.0) / 2), 2))), 2) AS m FROM nation")
def earth_distance(spark, d):
    here = geometry.ll_to_earth(F.col("n_nationkey") * 3.0 - 30, F.col("n_nationkey") * 7.0)
    return t(spark, d, "nation").select("n_nationkey", F.round(geometry.earth_distance(geometry.ll_to_earth(F.lit(0.0), F.lit(0.0)), here), 2).alias("m"))


@query("SELECT lower(n_name) AS name, count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT lower(n_name) FROM nation) GROUP BY 1")
def citext_group(spark, d):
    both = t(spark, d, "nation").selectExpr("n_name").union(t(spark, d, "nation").selectExpr("lower(n_name)"))
    return both.groupBy(F.expr("n_name COLLATE UTF8_LCASE").alias("k")).agg(F.count("*").alias("n")).select(F.lower(F.col("k").cast("string")).alias("name"), "n")


# Digests and texts. X21-X23


@query("SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, lower(hex(n_name)) AS h, base64(encode(n_name)) AS b FROM nation")
def crypto_digests(spark, d):
    n = F.col("n_name")
    return t(spark, d, "nation").select("n_nationkey", crypto.encode(crypto.digest(n, "md5"), "hex").alias("m"), crypto.encode(crypto.digest(n, "sha256"), "hex").alias("s"), crypto.encode(F.encode(n, "UTF-8"), "hex").alias("h"), crypto.encode(F.encode(n, "UTF-8"), "base64").alias("b"))


_UUID = "h[1:8] || '-' || h[9:12] || '-{v}' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32]"


@query(f"""
    WITH m AS (SELECT n_nationkey, sha256(unhex('373925' || repeat('5c', 61)) || unhex(sha256(unhex('5d534f' || repeat('36', 61)) || encode(n_name)))) AS mac FROM nation),
    v5 AS (SELECT n_nationkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(n_name)) AS h FROM nation),
    v3 AS (SELECT n_nationkey, md5(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(n_name)) AS h FROM nation)
    SELECT n_nationkey, mac, v5.u AS v5, v3.u AS v3 FROM m JOIN (SELECT n_nationkey, {_UUID.format(v=5)} AS u FROM v5) v5 USING (n_nationkey) JOIN (SELECT n_nationkey, {_UUID.format(v=3)} AS u FROM v3) v3 USING (n_nationkey)""")
def crypto_hmac_uuid(spark, d):
    n = F.col("n_name")
    return t(spark, d, "nation").select("n_nationkey", F.lower(F.hex(crypto.hmac(b"key", "sha256")(n))).alias("mac"), crypto.uuid_v5(crypto.NAMESPACES["dns"], n).alias("v5"), crypto.uuid_v3(crypto.NAMESPACES["url"], n).alias("v3"))


@query("SELECT n_nationkey, '$2a$05$CCCCCCCCCCCCCCCCCCCCC.E5YPO9kmyuRGyh0XouQYb4YMJKvyOeW' AS known, n_regionkey = 1 AS opens FROM nation")
def crypto_passwords(spark, d):
    """A published hash, and hashes under new salts that open with the right password only."""
    n = t(spark, d, "nation").withColumn("h", crypto.crypt(F.lit("pass1"), F.lit(crypto.gen_salt("bf", 4))))
    return n.select("n_nationkey", crypto.crypt(F.lit("U*U"), F.lit("$2a$05$CCCCCCCCCCCCCCCCCCCCC.")).alias("known"), (crypto.crypt(F.concat(F.lit("pass"), F.col("n_regionkey").cast("string")), F.col("h")) == F.col("h")).alias("opens"))


@query("SELECT n_nationkey, replace(replace(strip_accents('Ærø çà Señor ' || n_name), 'Æ', 'AE'), 'ø', 'o') AS plain FROM nation")
def text_unaccent(spark, d):
    docs = t(spark, d, "nation").select("n_nationkey", F.concat(F.lit("Ærø çà Señor "), "n_name").alias("x"))
    return docs.select("n_nationkey", crypto.unaccent("x").alias("plain"))


# Full text. T1-T11

# Stems of the words of part names that aren't their own.
_STEM = "CASE w WHEN 'large' THEN 'larg' WHEN 'running' THEN 'run' WHEN 'plates' THEN 'plate' ELSE w END"
_TEXT = "'The running ' || p_name || ' of the plates, ' || p_name"
_WORDS = f"SELECT p_partkey, unnest(string_split(replace(lower({_TEXT}), ',', ''), ' ')) AS w, generate_subscripts(string_split({_TEXT}, ' '), 1) AS i FROM part"
_LEXEMES = f"SELECT p_partkey, {_STEM} AS l, list(i ORDER BY i) AS spots FROM ({_WORDS}) WHERE w NOT IN ('the', 'of') GROUP BY 1, 2"
_QUOTE = "chr(39)"


def _texts(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_name", F.concat(F.lit("The running "), "p_name", F.lit(" of the plates, "), "p_name").alias("text"))


@query(f"SELECT p_partkey, string_agg({_QUOTE} || l || {_QUOTE} || ':' || array_to_string(spots, ','), ' ' ORDER BY l) AS tv FROM ({_LEXEMES}) GROUP BY 1")
def fts_vector(spark, d):
    """Stop words leave gaps in the positions, lexemes are stems."""
    return _texts(spark, d).select("p_partkey", fts.format_tsvector(fts.to_tsvector("english")("text")).alias("tv"))


@query(f"""
    WITH l AS ({_LEXEMES}), r AS (SELECT p_partkey, count(*) AS n, sum(CASE WHEN l IN ('ring', 'small', 'gear') THEN list_sum(list_transform(range(1, len(spots) + 1), lambda j: 0.1::DOUBLE / (j * j))) / 1.644934::DOUBLE ELSE 0 END) / 3 AS rank, bool_or(l IN ('ring', 'small')) AND NOT bool_or(l = 'gear') AS hit FROM l GROUP BY 1)
    SELECT p_partkey, round(rank, 6) AS rank, CAST(n AS INTEGER) AS n FROM r WHERE hit""")
def fts_rank(spark, d):
    words, q = fts.to_tsvector("english")(F.col("text")), fts.to_tsquery("(rings | small) & !gears", "english")
    return _texts(spark, d).select("p_partkey", words.alias("tv")).where(fts.matches(F.col("tv"), q)).select("p_partkey", F.round(fts.ts_rank(F.col("tv"), q).cast("double"), 6).alias("rank"), fts.length(F.col("tv")).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def fts_match_simple(spark, d):
    tv = fts.to_tsvector("simple")(F.col("c_mktsegment"))
    return t(spark, d, "customer").where(fts.matches(tv, fts.to_tsquery("building | machinery", "simple"))).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_name = 'red ring'")
def fts_plain_query(spark, d):
    """All words of a text, stop words aside."""
    return _texts(spark, d).where(fts.matches(fts.to_tsvector()(F.col("text")), fts.plainto_tsquery("the red rings"))).select("p_partkey")


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN w IN ('red', 'ring') THEN '<b>' || w || '</b>' ELSE w END), ' ') AS headline FROM part")
def fts_headline(spark, d):
    q = fts.plainto_tsquery("red rings")
    return t(spark, d, "part").select("p_partkey", fts.ts_headline(q)(F.col("p_name")).alias("headline"))


@query(f"SELECT p_partkey, string_agg({_QUOTE} || l || {_QUOTE}, ' ' ORDER BY l) AS words, CAST(count(*) AS INTEGER) AS n, 7 AS nodes FROM ({_LEXEMES}) GROUP BY 1")
def fts_strip(spark, d):
    tv = fts.to_tsvector()(F.col("text"))
    return _texts(spark, d).select("p_partkey", fts.format_tsvector(fts.strip(tv)).alias("words"), fts.length(tv).alias("n"), F.lit(fts.numnode(fts.to_tsquery("(rings | red) & !the & gear | bolt"))).alias("nodes"))


@query(f"""
    WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part),
    l AS (
        SELECT p_partkey, CASE ws[1] WHEN 'large' THEN 'larg' ELSE ws[1] END AS l, 1 AS spot FROM w WHERE ws <> ['small', 'bolt'] UNION ALL SELECT p_partkey, ws[2], 2 FROM w WHERE ws <> ['small', 'bolt']
        UNION ALL SELECT p_partkey, 'fasten', 2 FROM w WHERE ws = ['small', 'bolt'] UNION ALL SELECT p_partkey, x, 1 FROM w, (VALUES ('crimson'), ('scarlet')) v(x) WHERE ws[1] = 'red'
    )
    SELECT p_partkey, string_agg({_QUOTE} || l || {_QUOTE} || ':' || spot, ' ' ORDER BY l) AS tv FROM l GROUP BY 1""")
def fts_dictionaries(spark, d):
    """A phrase becomes its canonical word, a word gets company."""
    to = fts.to_tsvector("english", fts.parse_dictionary("red:crimson scarlet"), fts.parse_dictionary("bolt small:fasten;never seen:never"))
    return t(spark, d, "part").select("p_partkey", fts.format_tsvector(to("p_name")).alias("tv"))


@query(f"SELECT p_partkey, {_QUOTE} || least('large', p_name[7:]) || {_QUOTE} || ' ' || {_QUOTE} || greatest('large', p_name[7:]) || {_QUOTE} AS tv FROM part WHERE p_name LIKE 'large %' AND p_name NOT LIKE '%gear'")
def fts_raw_casts(spark, d):
    """Words as written: no stems, no stop words."""
    parts = t(spark, d, "part").withColumn("tv", fts.raw_tsvector()("p_name"))
    return parts.where(fts.matches(F.col("tv"), fts.raw_tsquery("large & !gear"))).select("p_partkey", fts.format_tsvector(F.col("tv")).alias("tv"))


@query("""
    SELECT p_partkey, c.code FROM part JOIN (VALUES ('small', 'SML'), ('hot', 'HT'), ('widget', 'WJT'), ('plate', 'PLT'), ('gear', 'JR'), ('red', 'RT'), ('blue', 'BL'), ('bolt', 'BLT'), ('large', 'LRJ'), ('rod', 'RT'), ('ring', 'RNK'), ('gizmo', 'JSM'), ('old', 'OLT'), ('cold', 'KLT'), ('anvil', 'ANFL'), ('new', 'N')) c(word, code)
    ON word = p_name[strpos(p_name, ' ') + 1:]""")
def metaphone_codes(spark, d):
    return t(spark, d, "part").select("p_partkey", metaphone_column(10)(F.substring_index("p_name", " ", -1)).alias("code"))


@query("""
    SELECT p_partkey, c.code, c.alt FROM part JOIN (VALUES ('small', 'SML', 'XML'), ('hot', 'HT', 'HT'), ('red', 'RT', 'RT'), ('blue', 'PL', 'PL'), ('large', 'LRJ', 'LRK'), ('old', 'ALT', 'ALT'), ('cold', 'KLT', 'KLT'), ('new', 'N', 'NF')) c(word, code, alt)
    ON word = p_name[:strpos(p_name, ' ') - 1]""")
def double_metaphone_codes(spark, d):
    both = t(spark, d, "part").select("p_partkey", dmetaphone_codes(F.substring_index("p_name", " ", 1)).alias("c"))
    return both.select("p_partkey", "c.code", "c.alt")


@query("SELECT n_nationkey, lower(n_name) = 'nation_3' AS same, CAST(CASE WHEN lower(n_name) < 'nation_3' THEN -1 WHEN lower(n_name) > 'nation_3' THEN 1 ELSE 0 END AS INTEGER) AS cmp FROM nation")
def citext_compare(spark, d):
    other = F.lit("Nation_3")
    return t(spark, d, "nation").select("n_nationkey", citext.citext_eq(F.col("n_name"), other).alias("same"), citext.citext_cmp(F.col("n_name"), other).alias("cmp"))
