import datetime
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import collections as C
from tessera.functions import context, core, crypto, geometry, routines, similarity, trees, vectors
from tessera.functions.phonetics import dmetaphone, dmetaphone_alt, metaphone
from tessera.search import fts
from tessera.search import vectors as V
from tessera.types import spark_type, to_bool, to_int


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lits(*xs):
    return F.array(*map(F.lit, xs))


def test_types(spark):
    assert [spark_type(n) for n in ("INT4", "numeric(10,2)", "numeric(5)", "text[]", "varchar(9)", "timestamp with time zone", "double precision")] == ["int", "decimal(10,2)", "decimal(5,0)", "array<string>", "string", "timestamp", "double"]
    with pytest.raises(ValueError):
        spark_type("interval")
    assert [value(spark, to_int(F.lit(x))) for x in (2.5, -2.5, "2.5", 2.4)] == [3, -3, 3, 2]
    assert [value(spark, to_bool(F.lit(x))) for x in ("Yes", " off ", "maybe")] == [True, False, None]


@pytest.mark.parametrize(("start", "length", "want"), [(1, 3, "hel"), (0, 2, "h"), (-2, 3, ""), (-2, 5, "he"), (4, None, "lo"), (-3, None, "hello"), (9, 2, "")])
def test_substring(spark, start, length, want):
    assert value(spark, core.substring(F.lit("hello"), start, length)) == want


def test_core(spark):
    v = lambda c: value(spark, c)
    assert v(core.int_div(F.lit(-7), F.lit(2))) == -3 and v(core.truncate(F.lit(-2.7))) == -2 and v(core.round_even(F.lit(2.5))) == 2
    assert v(core.left(F.lit("hello"), -1)) == "" and v(core.concat(F.lit("a"), F.lit(None))) == "a"
    assert v(core.between(F.lit(9), F.lit(1), F.lit(None))) is None and v(core.in_values(F.lit(9), [1, None])) is None
    assert v(core.like(F.lit("a\\b%"), "a\\b%")) and v(core.like(F.lit("a%c"), "a!%c", "!")) and not v(core.like(F.lit("abc"), "a!%c", "!"))
    sunday = F.lit(datetime.date(2024, 3, 3))
    assert v(core.extract("dow", sunday)) == 0 and v(core.extract("week", sunday)) == 9
    assert [tuple(r) for r in spark.range(1).select(core.unnest_together(lits(1, 2), lits("a"))).collect()] == [(1, "a"), (2, None)]
    assert context.set_config(spark, "app.user", "al") == context.setting(spark, "app.user") == "al"


def test_trigrams(spark):
    v = lambda c: value(spark, c)
    assert v(similarity.trigrams(F.lit("Cat"))) == ["  c", " ca", "at ", "cat"]
    assert math.isclose(v(similarity.similarity(F.lit("word"), F.lit("two words"))), 4 / 11, rel_tol=1e-6)
    assert math.isclose(v(similarity.word_similarity(F.lit("word"), F.lit("two words"))), 0.8, rel_tol=1e-6)
    assert math.isclose(v(similarity.strict_word_similarity(F.lit("word"), F.lit("two words"))), 4 / 7, rel_tol=1e-6)
    assert v(similarity.similarity(F.lit(""), F.lit("--"))) == 0.0
    left = spark.createDataFrame([(i, f"name {i % 30} of thing {i}") for i in range(60)], "a long, x string")
    right = left.toDF("b", "y")
    pairs = {(r.a, r.b) for r in similarity.similar_pairs(left, right, "x", "y", 0.7).collect()}
    brute = {(r.a, r.b) for r in left.crossJoin(right).where(similarity.similarity(F.col("x"), F.col("y")) >= 0.7).collect()}
    assert pairs == brute


def test_fuzzy(spark):
    v = lambda c: value(spark, c)
    assert similarity.edit_cost("kitten", "sitting", 1, 1, 1) == 3 and similarity.edit_cost("a", "b", 1, 1, 5) == 2
    assert v(similarity.levenshtein_less_equal(F.lit("extensive"), F.lit("exhaustive"), 2)) == 3
    assert (v(similarity.soundex(F.lit("Anne"))), v(similarity.soundex(F.lit("12")))) == ("A500", "") and v(similarity.difference(F.lit("Anne"), F.lit("Andrew"))) == 2


def test_maps_and_arrays(spark):
    v = lambda c: value(spark, c)
    h = C.hstore(lits("a", "b", "a"), lits("1", None, "3"))
    assert v(h) == {"a": "1", "b": None} and v(C.hstore_get(h, "z")) is None and v(C.hstore_defined(h, "b")) is False
    both = C.hstore_concat(h, C.hstore(lits("b"), lits("2")))
    assert v(both) == {"a": "1", "b": "2"} and v(C.hstore_contains(both, C.hstore(lits("b"), lits("2")))) and not v(C.hstore_contains(both, h))
    assert v(C.hstore_delete(both, lits("a"))) == {"b": "2"} and v(C.hstore_matrix(both)) == [["a", "1"], ["b", "2"]] and v(C.hstore_to_json(h)) == '{"a":"1","b":null}'
    a = lits(1, 1, 2, 1)
    assert v(C.uniq(a)) == [1, 2, 1] and v(C.idx(a, F.lit(2))) == 3 and v(C.idx(a, F.lit(9))) == 0
    assert [v(C.subarray(lits(1, 2, 3, 4), *x)) for x in ((2, 2), (-2,), (1, -1), (3, 9))] == [[2, 3], [3, 4], [1, 2, 3], [3, 4]]
    assert v(C.without(a, lits(1))) == [2] and v(C.union(lits(3, 1), lits(2, 1))) == [1, 2, 3]


def test_paths(spark):
    v = lambda c: value(spark, c)
    p = F.lit("Top.Science.Astronomy.Cosmology")
    assert v(trees.nlevel(p)) == 4 and v(trees.subltree(p, 1, 2)) == "Science" and v(trees.subpath(p, -2)) == "Astronomy.Cosmology" and v(trees.subpath(p, 0, -1)) == "Top.Science.Astronomy"
    assert v(trees.index(p, F.lit("Science.Astronomy"))) == 1 and v(trees.index(p, F.lit("Nope"))) == -1
    assert v(trees.is_ancestor(F.lit("Top.Science"), p)) and not v(trees.is_ancestor(F.lit("Top.Sci"), p)) and v(trees.lca(p, F.lit("Top.Science.Maths"))) == "Top.Science"
    for pattern, want in {"*.Astronomy.*": True, "Top.*{1}.Astronomy.*": True, "Top.*{2}.Astronomy.*": False, "Top.science@.*": True, "Top.!Science.*": False, "Top.Sci*.Astro*|Bio*.*": True, "*.Foo|Cosmology": True}.items():
        assert v(trees.matches(p, pattern)) is want, pattern


def test_cubes_and_earth(spark):
    v = lambda c: value(spark, c)
    a, b = geometry.cube(lits(0.0, 0.0), lits(1.0, 1.0)), geometry.cube(lits(4.0, 5.0, 0.0))
    assert v(geometry.cube_distance(a, b)) == 5 and not v(geometry.cube_overlaps(a, b)) and v(geometry.cube_ll_coord(b, 9)) == 0 and v(geometry.cube_is_point(b))
    assert v(geometry.cube_enlarge(a, -1.0)).asDict() == {"ll": [0.5, 0.5], "ur": [0.5, 0.5]}
    quarter = geometry.earth_distance(geometry.ll_to_earth(F.lit(0.0), F.lit(0.0)), geometry.ll_to_earth(F.lit(90.0), F.lit(0.0)))
    assert math.isclose(v(quarter), math.pi / 2 * geometry.EARTH_RADIUS, rel_tol=1e-9)
    assert math.isclose(v(geometry.latitude(geometry.ll_to_earth(F.lit(12.0), F.lit(34.0)))), 12, rel_tol=1e-9)


def test_vectors(spark):
    v = lambda c: value(spark, c)
    a, b, z = lits(1.0, 2.0), lits(4.0, 6.0), lits(0.0, 0.0)
    assert v(vectors.l2_distance(a, b)) == 5 and v(vectors.l1_distance(a, b)) == 7 and v(vectors.negative_inner_product(a, b)) == -16 and math.isnan(v(vectors.cosine_distance(a, z)))
    assert v(vectors.l2_normalize(z)) == [0.0, 0.0]
    with pytest.raises(Exception, match="different vector dimensions"):
        v(vectors.l2_distance(a, lits(1.0)))
    items = spark.createDataFrame([(i, "rare" if i % 10 == 0 else "common", [float(i), 0.0, 0.0]) for i in range(200)] + [(999, "rare", None)], "id int, category string, v array<float>")
    assert [r.id for r in V.nearest(items, "v", [0, 0, 0], 5, id_col="id").collect()] == [0, 1, 2, 3, 4]
    assert [r.id for r in V.nearest(items, "v", [0, 0, 0], 25, where=F.col("category") == "rare", id_col="id").collect()][-2:] == [190, 999]
    asks = items.where("id in (5, 50)").selectExpr("id AS query_id", "v AS query")
    got = {(r.query_id, r["rank"]): r.id for r in V.nearest_of_each(asks, items.where("v is not null"), 3, "<->", vector="v").collect()}
    assert got == {(5, 1): 5, (5, 2): 4, (5, 3): 6, (50, 1): 50, (50, 2): 49, (50, 3): 51}


def test_embedding_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id int, body string")
    rule = V.Rule("docs", "body", "embedding")
    once = V.refresh(docs, rule)
    marked = once.withColumn("embedding", F.when(F.col("id") == 1, F.array(F.lit(7.0)).cast("array<float>")))
    assert {r.id: r.embedding for r in V.refresh(marked, rule).collect()} == {1: [7.0], 2: None, 3: None}
    assert V.context(V.retrieve(once.withColumnRenamed("body", "text"), V.HashEmbedder().embed(["a"])[0], 5)).first().context == "[1] a"


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "dogs bark"), (2, "a fat cat"), (3, "fat cats and fat rats")], "id int, body string").withColumn("tv", fts.to_tsvector()("body"))
    q = fts.to_tsquery("fat | cat | rat")
    ranked = docs.where(fts.matches(F.col("tv"), q)).orderBy(F.desc(fts.ts_rank(F.col("tv"), q)))
    assert [r.id for r in ranked.collect()] == [3, 2]
    one = docs.where("id = 2").select(fts.ts_rank(F.col("tv"), fts.to_tsquery("cat")).alias("r")).first().r
    assert abs(one - 0.06079271) < 1e-6
    assert fts.vector("The Fat Rats and the well-known rat") == [("fat", [2]), ("known", [6]), ("rat", [3, 7]), ("well", [6]), ("well-known", [6])]
    assert str(fts.to_tsquery("!dogs & the & Running")) == "!'dog' & 'run'"
    assert fts.to_tsquery("the") is None and fts.numnode(fts.plainto_tsquery("fat cats")) == 3
    for bad in ("", "a &", "(a", "a b"):
        with pytest.raises(ValueError):
            fts.to_tsquery(bad)
    text = spark.createDataFrame([("A cat sat. " + "filler " * 60 + "The fat cats ran.",)], "t string").select(fts.ts_headline(fts.to_tsquery("fat & cat"))("t").alias("h")).first().h
    assert "<b>fat</b> <b>cats</b>" in text
    assert fts.parse_tsvector("'b c':3,1 a:2 d") == [("a", [2]), ("b c", [1, 3]), ("d", [])]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("electricity", "electr"), ("happy", "happi"), ("controlling", "control"), ("sky", "sky"), ("adoption", "adopt"), ("probate", "probat"), ("roll", "roll"), ("ate", "ate"), ("ties", "tie"), ("news", "news"), ("play", "play"), ("cry", "cri"), ("rats", "rat"), ("gas", "gas"), ("skies", "sky"), ("generalizations", "gener"), ("hopefulness", "hope"), ("using", "use")])
def test_porter(word, stem):
    assert fts.porter(word) == stem


def test_crypto(spark):
    v = lambda c: value(spark, c)
    name = "www.example.org"
    assert v(crypto.uuid_v5(crypto.NAMESPACES["dns"], F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name)) and v(crypto.uuid_v3(crypto.NAMESPACES["url"], F.lit(name))) == str(uuid.uuid3(uuid.NAMESPACE_URL, name))
    assert v(F.lower(F.hex(crypto.hmac(b"key", "md5")(F.lit("The quick brown fox jumps over the lazy dog"))))) == "80070713463e7749b90c2dc24911e275"
    assert v(crypto.decode(crypto.encode(F.lit("hi").cast("binary"), "base64"), "base64").cast("string")) == "hi" and crypto.escape_bytes(b"a\\\x00\xff") == "a\\\\\\000\\377"
    assert crypto.plain("Éric Straße Ærø łódź") == "Eric Strasse AEro lodz"


def test_routines(spark):
    routines.create_sql_function(spark, "tessera_t1", [("a", "int"), ("b", "int")], "int", "SELECT 1; SELECT $1 * b", strict=True)
    body = "DECLARE x int; BEGIN x := a + 1; IF x > 3 THEN IF x > 9 THEN RETURN 'huge'; END IF; RETURN 'big'; END IF; RETURN 'small'; END;"
    routines.create_plpgsql_function(spark, "tessera_t2", [("a", "int")], "text", body)
    assert tuple(spark.sql("SELECT tessera_t1(6, 7), tessera_t1(NULL, 7), tessera_t2(1), tessera_t2(3), tessera_t2(20)").first()) == (42, None, "small", "big", "huge")


@pytest.mark.parametrize(
    ("word", "code"),
    [
        ("GUMBO", "KM"), ("phone", "FN"), ("Thompson", "0MPSN"), ("Thomas", "0MS"), ("school", "SKL"), ("science", "SNS"), ("Knight", "NFT"), ("what", "HT"), ("wright", "RFT"), ("xylophone", "SLFN"),
        ("aeon", "EN"), ("judge", "JJ"), ("McCartney", "MKKRTN"), ("schwa", "XW"), ("caution", "KXN"), ("Otto", "OT"), ("hugh", "HF"), ("ghost", "FST"), ("Yes", "YS"), ("yield", "YLT"), ("box", "BKS"),
        ("a1b2c3", "ABK"), ("   ae   ", "E"), ("", ""), ("123 456", ""), ("Christmas", "KRSTMS"), ("nation", "NXN"), ("thumb", "0M"),
    ],
)
def test_metaphone(word, code):
    assert metaphone(word) == code


@pytest.mark.parametrize(
    ("word", "code", "alt"),
    [
        ("gumbo", "KMP", "KMP"), ("metaphone", "MTFN", "MTFN"), ("Schmidt", "XMT", "SMT"), ("smith", "SM0", "XMT"), ("Thompson", "TMPS", "TMPS"), ("Xavier", "SF", "SFR"), ("jose", "HS", "HS"),
        ("filipowicz", "FLPT", "FLPF"), ("Wasserman", "ASRM", "FSRM"), ("breaux", "PR", "PR"), ("zhao", "J", "J"), ("focaccia", "FKX", "FKX"), ("McHugh", "MK", "MK"), ("island", "ALNT", "ALNT"),
        ("sugar", "XKR", "SKR"), ("cabrillo", "KPRL", "KPR"), ("edge", "AJ", "AJ"), ("edgar", "ATKR", "ATKR"), ("dumb", "TM", "TM"), ("thumb", "0M", "TM"), ("campbell", "KMPL", "KMPL"),
        ("raspberry", "RSPR", "RSPR"), ("czerny", "SRN", "XRN"), ("Yankelovich", "ANKL", "ANKL"), ("Jankelowicz", "JNKL", "ANKL"), ("", "", ""), ("123", "", ""), ("Church", "XRX", "XRK"), ("Caesar", "SSR", "SSR"),
        ("Michael", "MKL", "MXL"), ("Pizza", "PS", "PTS"), ("Accident", "AKST", "AKST"), ("Arnow", "ARN", "ARNF"),
    ],
)
def test_double_metaphone(word, code, alt):
    assert (dmetaphone(word), dmetaphone_alt(word)) == (code, alt)
