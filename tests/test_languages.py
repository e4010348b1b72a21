import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import documents, graphql, rest
from tessera.sources import schema, stores
from tessera.streaming import changes, log

DOCS = [
    (1, {"n": 1, "s": "a", "tags": ["x", "y"], "o": {"k": None}}),
    (2, {"n": 2.5, "s": "b", "tags": []}),
    (3, {"n": "2", "o": {"k": {"d": True}}}),
    (4, {"tags": "x", "n": True}),
]


def ids(spark, query):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in DOCS], "id int, doc string")
    return [r.id for r in documents.find(df, query).collect()]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ({}, [1, 2, 3, 4]),
        ({"n": 1}, [1]),
        ({"tags": "x"}, [1, 4]),
        ({"tags": ["x", "y"]}, [1]),
        ({"tags": {"$ne": "x"}}, [2, 3]),
        ({"n": {"$gt": 1}}, [2]),
        ({"n": {"$gte": "1"}}, [3]),
        ({"o.k": None}, [1]),
        ({"o.k.d": True}, [3]),
        ({"s": {"$in": ["a", "z"]}}, [1]),
        ({"s": {"$nin": ["a"]}}, [2, 3, 4]),
        ({"s": {"$exists": False}}, [3, 4]),
        ({"tags": {"$size": 0}}, [2]),
        ({"$or": []}, []),
        ({"$nor": [{"n": 1}, {"s": "b"}]}, [3, 4]),
        ({"n": {"$gt": 0, "$lt": 2}}, [1]),
    ],
)
def test_document_filters(spark, query, want):
    assert ids(spark, query) == want


def test_document_writes(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in DOCS], "id int, doc string")
    after = {r.id: json.loads(r.doc) for r in documents.update_one(df, {"s": {"$exists": True}}, {"$inc": {"n": 2}, "$set": {"o.z": 1}, "$unset": {"s": ""}}).collect()}
    assert after[1] == {"n": 3, "tags": ["x", "y"], "o": {"k": None, "z": 1}} and after[2] == DOCS[1][1]
    model = {"n": {"type": "number", "required": True}, "s": {"type": "string"}, "tags": {"type": "array"}, "o": {"type": "object"}}
    assert sorted((r.id, r.problem) for r in documents.violations(df, model).collect()) == [(3, "n is no number"), (4, "n is no number")]
    new = spark.createDataFrame([(9, '{"n":1}')], "id int, doc string")
    assert documents.insert_many(df, new, model).count() == 5
    with pytest.raises(ValueError, match="duplicate"):
        documents.insert_many(df, new, model, unique=("n",))
    with pytest.raises(ValueError, match="required"):
        documents.insert_many(df, new.withColumn("doc", F.lit("{}")), model)


@pytest.fixture
def posts(spark):
    return spark.createDataFrame([(1, "Alpha", 10, 1), (2, "beta", None, 1), (3, "Gamma, x", 30, 2), (4, "delta", 30, None)], "id int, title string, views int, author_id int")


def test_rest(spark, posts):
    get = lambda q, **k: [tuple(r) for r in rest.select(posts, q, **k).collect()]
    assert get("select=id&views=gte.30&order=id.desc") == [(4,), (3,)]
    assert get("select=t:title&title=ilike.*A&order=views.desc.nullslast,id") == [("delta",), ("Alpha",), ("beta",)]
    assert get('select=id&title=in.("Gamma, x",beta)&order=id') == [(2,), (3,)]
    assert get("select=id&views=is.null") == [(2,)] and get("select=id&author_id=not.is.null&order=id", range_="1-1") == [(2,)]
    assert rest.count(posts, "views=eq.30&limit=1").first()["count"] == 2
    with pytest.raises(NotImplementedError):
        rest.select(posts, "or=(id.eq.1,id.eq.2)")
    new = spark.createDataFrame([(1, "A"), (7, "N")], "id int, title string")
    assert {(r.id, r.title, r.views) for r in rest.insert(posts, new, ["id"]).table.where("id in (1, 7)").collect()} == {(1, "A", 10), (7, "N", None)}


def test_graphql(spark, posts):
    page = graphql.connection(posts, ["id"], {"views": {"is": "NOT_NULL"}}, first=2)
    assert [(r.id, r.has_next_page, r.has_previous_page) for r in page.collect()] == [(1, True, False), (3, True, False)]
    after = page.collect()[-1].cursor
    assert [(r.id, r.has_next_page) for r in graphql.connection(posts, ["id"], after=after).collect()] == [(4, False)]
    assert [r.id for r in graphql.connection(posts, ["id"], order_by=[{"views": "DescNullsLast"}]).collect()] == [3, 4, 1, 2]
    assert graphql.connection(posts, ["id"], {"or": []}).count() == 0 and graphql.connection(posts, ["id"], {"and": []}).count() == 4
    with pytest.raises(ValueError):
        graphql.update_collection(posts, {"title": "x"})
    assert graphql.delete_from_collection(posts, {"id": {"eq": 2}}).table.count() == 3
    authors = spark.createDataFrame([(1, "Al"), (3, "Cy")], "aid int, name string")
    assert {(r.aid, len(r.posts)) for r in graphql.with_children(authors, posts, "aid", "author_id", "posts", "id").collect()} == {(1, 2), (3, 0)}
    assert {(r.id, r.author and r.author.name) for r in graphql.with_parent(posts, authors, "author_id", "aid", "author").collect()} == {(1, "Al"), (2, "Al"), (3, None), (4, None)}


ENTRY = "hash string, payload string, next array<string>, time long, id string"


def test_log(spark):
    a = spark.createDataFrame([("a", "1", [], 1, "x"), ("b", "2", ["a"], 2, "x"), ("c", "3", ["a"], 2, "y")], ENTRY)
    b = spark.createDataFrame([("c", "3", ["a"], 2, "y"), ("d", "4", ["c", "z"], 3, "y")], ENTRY)
    both = log.join(a, b)
    h = lambda df: [r.hash for r in df.collect()]
    assert sorted(h(both)) == ["a", "b", "c", "d"] and sorted(h(log.heads(both))) == ["b", "d"] and h(log.tails(both)) == ["a"] and h(log.tail_hashes(both)) == ["z"]
    assert h(log.diff(b, a)) == ["d"] and h(log.traverse(both)) == ["d", "c", "b", "a"] and h(log.traverse(both, both.where("hash = 'd'"))) == ["d", "c", "a"]
    assert h(log.read_range(both, gte="b", amount=2)) == ["b", "c"] and h(log.read_range(both, lte="c", amount=2)) == ["b", "c"] and h(log.read_range(both, gt="nope")) == []
    assert log.clock(both).first().time == 3


def test_key_value_store(spark, tmp_path):
    s = stores.KeyValueStore(spark, str(tmp_path / "kv"))
    assert s.all().count() == 0
    s.put("a", b"1")
    s.put("b", b"2")
    s.put("a", b"3")
    s.delete("b")
    assert {(r.key, bytes(r.value)) for r in s.all().collect()} == {("a", b"3")}
    with pytest.raises(ValueError):
        s.put("", b"1")


def test_feeds(spark, tmp_path):
    before = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    after = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    feed = changes.diff_feed(before, after, ["id"], "t")
    assert sorted(r.op for r in feed.collect()) == ["DELETE", "INSERT", "UPDATE"]
    assert changes.bound(feed, "DELETE", filter="id=eq.1").count() == 1 and changes.authorised(feed, after.where("id = 3"), "id").count() == 1
    assert {json.loads(r.row)["v"] for r in changes.fold(feed, "id").collect()} == {"B", "c"}
    feed.write.parquet(str(tmp_path / "in"))
    stream = changes.bound(changes.stream(spark, str(tmp_path / "in"), feed.schema.simpleString()[7:-1].replace(":", " ")), "INSERT")
    changes.into_table(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_votes(spark):
    results = spark.createDataFrame([("t", "x", "w1"), ("t", "x", "w2"), ("t", "y", "w3"), ("u", "z", "w1")], "task string, output string, worker string")
    assert {(r.task, r.output, r.votes, r.agreed, tuple(r.divergent)) for r in changes.majority(results, 2).collect()} == {("t", "x", 2, True, ("w3",)), ("u", "z", 1, False, ())}


def test_files(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "id % 2 AS part")
    for kind in ("parquet", "orc", "json", "csv"):
        stores.write(df, str(tmp_path / kind), kind, by=("part",), **({"header": "true"} if kind == "csv" else {}))
        assert stores.read(spark, str(tmp_path / kind), kind, **({"header": "true"} if kind == "csv" else {})).count() == 5
    df.createOrReplaceTempView("tessera_ids")
    found = schema.Catalog.of_session(spark)
    assert "tessera_ids" in {r.table_name for r in found.information_schema(spark, "tables").collect()}
    assert {r.column_name for r in found.information_schema(spark, "columns").where("table_name = 'tessera_ids'").collect()} == {"id", "part"}
