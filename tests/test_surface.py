import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import context, crypto, routines
from tessera.operators import database, dml, locks, relational
from tessera.plans import dialect, documents
from tessera.search import index
from tessera.search import vectors as V
from tessera.sources import schema, storage, stores
from tessera.streaming import bus, changes, log


def one(spark, sql, *args):
    row = dialect.query(spark, sql, list(args) or None).first()
    return tuple(row)


@pytest.fixture(scope="module")
def tables(spark):
    spark.createDataFrame([(1, 7, 2.5, "a"), (2, -7, 1.0, None)], "id int, n int, x double, s string").createOrReplaceTempView("tessera_rows")


def test_texts_in_quotes_stay(spark, tables):
    assert one(spark, "SELECT 'costs $1 and x::int', 'concat(a, b)', 'ORDER BY z', $1, 'it''s -- no' /* $2 */ -- $3", 5) == ("costs $1 and x::int", "concat(a, b)", "ORDER BY z", 5, "it's -- no")
    assert one(spark, "SELECT 'a\\n', \"n\" FROM tessera_rows WHERE s LIKE 'a' AND id = 1") == ("a\\n", 7)
    assert one(spark, "SELECT $$it's$$, $2, $1", "x", "y") == ("it's", "y", "x")


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("n / 2", 3), ("n / 2.0", 3.5), ("(n + 1) / 3", 2), ("n * 3 / 2", 10), ("x / 2", 1.25), ("n / id / 2", 3), ("abs(n) / length('ab')", 3), ("(n / 2)::text", "3"),
        ("7 / 2", 3), ("coalesce(n, 1) / 2", 3), ("x::int / 2", 1), ("n % 4 / 2", 1), ("-n / 2", -3), ("CASE WHEN n / 2 = 3 THEN 'yes' ELSE 'no' END", "yes"),
    ],
)
def test_whole_numbers_divide_whole(spark, tables, text, value):
    assert one(spark, f"SELECT {text} FROM tessera_rows WHERE id = 1")[0] == value


def test_forms(spark, tables):
    assert one(spark, "SELECT v, s COLLATE \"C\" FROM upper('q') AS t(v), tessera_rows WHERE id = 1") == ("Q", "a")
    assert one(spark, "SELECT version FROM version()")[0].startswith("PostgreSQL") and one(spark, "SELECT x.current_schema FROM current_schema() x") == ("public",)
    assert one(spark, "SELECT extract(dow FROM now()) BETWEEN 0 AND 6, trim(BOTH 'x' FROM upper('xax')), n IS DISTINCT FROM abs(n) FROM tessera_rows WHERE id = 2") == (True, "XAX", True)
    with pytest.raises(NotImplementedError):
        dialect.query(spark, "SELECT * FROM generate_series(1, 3)")


def test_variables_and_claims(spark):
    dialect.query(spark, "SET app.name = 'it''s'")
    assert dialect.query(spark, "SHOW app.name").first()[0] == "it's" and one(spark, "SELECT current_setting('app.name')") == ("it's",)
    dialect.query(spark, "RESET app.name")
    with pytest.raises(KeyError):
        dialect.query(spark, "SELECT current_setting('app.name')")
    assert one(spark, "SELECT current_setting('app.name', true), auth.uid(), current_setting('pg_trgm.similarity_threshold')")[0] is None
    context.set_config(spark, "request.jwt.claims", '{"sub": "no uuid", "role": "r", "n": {"k": 1}}')
    assert one(spark, "SELECT auth.role()") == ("r",) and context.claim(spark, "n") == '{"k": 1}'
    with pytest.raises(ValueError):
        dialect.query(spark, "SELECT auth.uid()")
    context.reset(spark, "request.jwt.claims")
    assert one(spark, "SELECT auth.jwt(), auth.role()") == (None, None)


def test_extensions(spark):
    spark.conf.unset("tessera.extensions")
    with pytest.raises(ValueError, match="required"):
        dialect.query(spark, "CREATE EXTENSION earthdistance")
    dialect.query(spark, "CREATE EXTENSION earthdistance CASCADE")
    for bad in ("CREATE EXTENSION cube", "DROP EXTENSION cube", "DROP EXTENSION hstore", "CREATE EXTENSION hstore VERSION '9'"):
        with pytest.raises(ValueError):
            dialect.query(spark, bad)
    for bad in ("postgis", "nonsense"):
        with pytest.raises(NotImplementedError):
            context.create_extension(spark, bad)
    dialect.query(spark, "DROP EXTENSION cube CASCADE")
    assert context.installed(spark) == ["plpgsql"]
    context.create_extension(spark, "hstore")
    with pytest.raises(ValueError, match="columns"):
        context.drop_extension(spark, "hstore", cascade=True, columns=["hstore"])
    spark.conf.unset("tessera.extensions")


def test_catalog_views(spark):
    a = schema.Table("a", spark.createDataFrame([], "k int, v string").schema, ("k",), (("v",),), checks=("k > 0",), defaults={"v": "'x'"})
    b = schema.Table("b", spark.createDataFrame([], "a_k int").schema, foreign_keys=(schema.ForeignKey(("a_k",), "a", ("k",), "CASCADE"),))
    c = schema.Catalog([a, b], {"w": "SELECT 1"})
    rows = lambda view: [tuple(r) for r in c.information_schema(spark, view).collect()]
    assert [r[2:] for r in rows("table_constraints")] == [("a_pkey", "public", "a", "PRIMARY KEY"), ("a_v_key", "public", "a", "UNIQUE"), ("a_check", "public", "a", "CHECK"), ("b_a_k_fkey", "public", "b", "FOREIGN KEY")]
    assert rows("referential_constraints") == [("public", "b_a_k_fkey", "public", "a_pkey", "NONE", "NO ACTION", "CASCADE")]
    assert [(r[3], r[5], r[6]) for r in rows("columns")] == [("k", None, "NO"), ("v", "'x'", "YES"), ("a_k", None, "YES")] and rows("views")[0][2] == "w"
    for view in schema._PG:
        assert c.pg_catalog(spark, view).columns
    assert [tuple(r) for r in c.pg_catalog(spark, "pg_index").select("indexname", "indisprimary", "indkey").collect()] == [("a_pkey", True, [1]), ("a_v_key", False, [2])]
    with pytest.raises(ValueError):
        c.pg_catalog(spark, "pg_nothing")
    fields = {(r.type, r.field): r.field_type for r in c.graphql_schema(spark).collect()}
    assert fields["a", "k"] == "Int!" and fields["aFilter", "v"] == "StringFilter" and ("b", "a_k") not in fields


@pytest.mark.parametrize("kind", ["memory", "folder"])
def test_storage_and_transactions(spark, tmp_path, kind):
    place = storage.MemoryStorage(spark) if kind == "memory" else storage.FolderStorage(spark, str(tmp_path / "rows"))
    rows = lambda *pairs: spark.createDataFrame(list(pairs), storage.ROW)
    held = lambda: {r.row_id: r.doc for r in place.scan("t").collect()}
    assert held() == {} and place.generation("t") == 0
    place.put("t", rows(("1", "a"), ("2", "b")))
    place.put("t", rows(("2", "c"), ("3", "d")))
    place.delete("t", rows(("1", None)))
    assert held() == {"2": "c", "3": "d"} and place.generation("t") == 3 and place.get("t", "2").first().doc == "c"
    one, two = storage.Transaction(place), storage.Transaction(place)
    one.put("t", rows(("4", "e")))
    one.delete("t", F.col("row_id") == "2")
    one.savepoint("s")
    assert {r.row_id for r in one.scan("t").collect()} == {"3", "4"} and held() == {"2": "c", "3": "d"}
    assert one.commit() and held() == {"3": "d", "4": "e"}
    with pytest.raises(ZeroDivisionError):
        two.run(lambda own: 1 / 0)
    with pytest.raises(RuntimeError, match="aborted"):
        two.scan("t")
    assert not two.commit()
    place.truncate("t")
    place.save_catalog({"v": 1})
    assert held() == {} and place.load_catalog() == {"v": 1}


def test_document_store(spark, tmp_path):
    store = stores.DocumentStore(spark, str(tmp_path / "docs"))
    docs = lambda *pairs: spark.createDataFrame(list(pairs), "key string, doc string")
    store.put_all(docs(*((f"k{i}", f'{{"n":{i}}}') for i in range(20))), 6)
    store.delete_batch(docs(("k1", None)))
    for bad in (("x", "[1]"), ("x", "nonsense"), ("", "{}"), ("x", None)):
        with pytest.raises(ValueError):
            store.put_batch(docs(("ok", "{}"), bad))
    assert {r.key for r in store.documents().collect()} == {f"k{i}" for i in range(20)} - {"k1"}


def test_index_of_documents(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":"x"}'), (2, '{"a":1,"b":"y"}'), (3, '{"b":"x"}'), (4, '{"a":"1"}')], "id int, doc string")
    held = documents.equality_index(df, ("a", "b"))
    for query in ({"a": 1}, {"a": 1, "b": "x"}, {"b": "x", "a": {"$exists": False}}, {"a": "1"}, {}):
        assert [r.id for r in documents.indexed_find(df, held, query).collect()] == [r.id for r in documents.find(df, query).collect()]


def test_index_definitions():
    d = index.IndexDefinition.parse("CREATE INDEX i ON items USING hnsw (v vector_cosine_ops) WITH (m = 8, ef_construction = 32);")
    assert (d.name, d.table, d.column, d.operator, d.m, d.ef_construction) == ("i", "items", "v", "<=>", 8, 32)
    for options in ("m = 1", "m = 101", "ef_construction = 3", "m = 40, ef_construction = 64", "speed = 9"):
        with pytest.raises(ValueError):
            index.IndexDefinition.parse(f"CREATE INDEX ON items USING hnsw (v vector_l2_ops) WITH ({options})")
    with pytest.raises(ValueError):
        index.IndexDefinition.parse("CREATE INDEX ON items USING hnsw (v other_ops)")


@pytest.mark.parametrize("ops", ["vector_l2_ops", "vector_cosine_ops", "vector_ip_ops"])
def test_index_recall(spark, tmp_path, ops):
    """Clustered vectors, more of them than are scanned: the recall of the ten nearest is 0.9 at least."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id long, v array<double>").repartition(4)
    it = index.VectorIndex(spark, index.IndexDefinition("i", "t", "v", ops), str(tmp_path / "i"))
    it.build(df)
    op, hits = it.definition.operator, 0
    for q in range(0, 4000, 400):
        want = np.lexsort((np.arange(4000), V.distances(x[q : q + 1], x, op)[0]))[:10]
        got = it.search(x[q].tolist(), 10).collect()
        assert [r.dist for r in got] == sorted(r.dist for r in got)
        hits += len({r.id for r in got} & set(want.tolist()))
    assert hits >= 90


def test_index_follows_its_table(spark, tmp_path):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(100, 4)).tolist())], "id long, v array<double>")
    made = index.Runtime(spark, str(tmp_path / "all"))
    it = made.create("CREATE INDEX i ON t USING hnsw (v vector_l2_ops)")
    assert made.nearest("t", df, "v", "<=>", [0.0] * 4, 3) is None and it.reconcile(df.limit(0)) == "rebuilt" and it.search([0.0] * 4, 3).count() == 0
    assert [it.reconcile(x) for x in (df, df, df.where("id <> 7"), df.where("id < 50"))] == ["rebuilt", "current", "added", "rebuilt"] and it.verify()
    moved = df.where("id < 50").withColumn("v", F.when(F.col("id") == 3, F.array(*[F.lit(0.0)] * 4)).otherwise(F.col("v")))
    assert it.reconcile(moved) == "added" and made.nearest("t", moved, "v", "<->", [0.0] * 4, 1).first().id == 3
    with pytest.raises(ValueError, match="exists"):
        made.create("CREATE INDEX i ON t USING hnsw (v vector_l2_ops)")


def test_bus():
    class Base: ...

    class Own(Base): ...

    events = bus.EventBus(most=2)
    all_, own = events.subscribe(Base), events.subscribe(Own)
    assert [events.emit(e) for e in (Base(), Own(), Own())] == [1, 2, 2]
    assert [type(e) for e in all_] == [Own, Own] and all_.missed == 1 and len(list(own)) == 2
    events.close(own)
    assert events.emit(Own()) == 1


def test_embedders_are_pinned():
    found = V.register_embedder(V.HashEmbedder(dims=8, name="probe"))
    assert V.register_embedder(V.HashEmbedder(dims=8, name="probe"), found) == found and V.embedder_of("probe").dims == 8
    with pytest.raises(ValueError):
        V.register_embedder(V.HashEmbedder(dims=16, name="probe"))


def test_passwords():
    assert crypto.crypt_text("U*U", "$2a$05$CCCCCCCCCCCCCCCCCCCCC.") == "$2a$05$CCCCCCCCCCCCCCCCCCCCC.E5YPO9kmyuRGyh0XouQYb4YMJKvyOeW"
    h = crypto.crypt_text("secret", crypto.gen_salt("bf", 4))
    assert crypto.crypt_text("secret", h) == h and crypto.crypt_text("other", h) != h and crypto.crypt_text("x" * 80, h) == crypto.crypt_text("x" * 72, h)
    for bad in (lambda: crypto.gen_salt("bf", 3), lambda: crypto.crypt_text("x", "$1$abc")):
        with pytest.raises(ValueError):
            bad()


def test_routines_with_types_and_queries(spark):
    spark.range(4).createOrReplaceTempView("tessera_four")
    body = "DECLARE n bigint; note text := 'n is n'; half int = 2.6; BEGIN SELECT count(*) INTO n FROM tessera_four; IF a > n THEN RETURN note; END IF; RETURN half; END;"
    routines.create_plpgsql_function(spark, "tessera_t3", [("a", "int")], "text", body)
    assert tuple(spark.sql("SELECT tessera_t3(9), tessera_t3(1)").first()) == ("n is n", "2")


def test_not_in(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    of = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    got = lambda v: sorted(str(r.x) for r in relational.not_in(df, "x", v).collect())
    assert got(of(1)) == ["2"] and got(of(1, None)) == [] and got(of()) == ["1", "2", "None"]


def test_logs_grow_and_are_traversed(spark):
    rows = [(f"h{i:03}", "p", [f"h{i - 1:03}"] if i else [], i, "w") for i in range(70)] + [("z", "p", ["h010", "gone"], 99, "w")]
    whole = spark.createDataFrame(rows, "hash string, payload string, next array<string>, time long, id string")
    assert {r.hash for r in log.traverse(whole, whole.where("hash = 'z'")).collect()} == {"z", *(f"h{i:03}" for i in range(11))}
    assert log.traverse(whole).count() == 71 and log.traverse(whole, amount=2).first().hash == "z"
    grown = log.add(whole, spark.createDataFrame([("new",)], "payload string"), "me")
    top = log.heads(grown).collect()
    assert [(r.payload, r.next, r.time) for r in top] == [("new", ["h069", "z"], 100)] and log.get(grown, top[0].hash).count() == 1
    with pytest.raises(ValueError):
        log.add(whole, spark.createDataFrame([("",)], "payload string"), "me")


def test_rules_of_triggers(spark):
    events = spark.createDataFrame([(1, "/a/b"), (2, "/a"), (3, ""), (4, None)], "event_id int, address string")
    rules = [changes.TriggerRule("all", "", "t"), changes.TriggerRule("a", "/a", "t"), changes.TriggerRule("ab", "/a/b", "t")]
    assert {(r.rule, r.event_id) for r in changes.due_tasks(events, rules).collect()} == {("all", 1), ("all", 2), ("all", 3), ("a", 1), ("a", 2), ("ab", 1)}


def test_locks(spark):
    held = locks.LockManager()
    assert all((b in locks.CONFLICTS[a]) == (a in locks.CONFLICTS[b]) for a in locks.CONFLICTS for b in locks.CONFLICTS)
    a, b = locks.table("a"), locks.table("b")
    assert held.acquire(1, a, "RowExclusive") and held.acquire(2, a, "RowExclusive") and held.acquire(2, b, "Share")
    assert not held.acquire(1, b, "RowExclusive")  # waits for the second session
    with pytest.raises(locks.Deadlock):
        held.acquire(2, a, "Share")
    with pytest.raises(locks.LockNotAvailable):
        held.acquire(3, b, "Exclusive", nowait=True)
    assert held.snapshot(spark).where("not granted").count() == 1
    held.end(2)
    assert held.acquire(1, b, "RowExclusive") and not held.waits
    assert held.call(1, "pg_advisory_lock", 5) is None and not held.call(2, "pg_try_advisory_lock", 5)
    held.end(1)
    assert not held.call(2, "pg_try_advisory_lock", 5)
    held.call(1, "pg_advisory_unlock_all")
    assert held.call(2, "pg_try_advisory_lock", 5)
    df = spark.range(6)
    assert locks.select_for(held, 1, df, "t", "id", F.col("id") < 3).count() == 3
    assert [r.id for r in locks.select_for(held, 2, df, "t", "id", F.col("id") < 5, skip_locked=True).collect()] == [3, 4]
    with pytest.raises(locks.LockNotAvailable):
        locks.select_for(held, 3, df, "t", "id", F.col("id") == 4, nowait=True)
    assert locks.select_for(held, 3, df, "t", "id", F.col("id") > 9).count() == 0


def test_windows_in_order_by(spark, tables):
    rows = dialect.query(spark, "SELECT id, n AS m FROM tessera_rows ORDER BY rank() OVER (ORDER BY n) DESC, s, x LIMIT 5")
    assert rows.columns == ["id", "m"] and [r.id for r in rows.collect()] == [1, 2]
    assert [r.id for r in dialect.query(spark, "SELECT id FROM tessera_rows ORDER BY (SELECT max(n) FROM tessera_rows), id DESC").collect()] == [2, 1]


def test_statements_with_triggers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, s string")
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    taken = []
    instead = [dml.Trigger("instead of", ("insert", "delete"), lambda x: taken.append(x) or x)]
    assert rows(dml.statement(df, "insert", instead, rows=df).table) == rows(df) and len(taken) == 1
    assert rows(dml.statement(df, "delete", [], where=F.col("id") == 2).table) == [(1, "a")]
    kept = [dml.Trigger("before", ("delete",), lambda x: x.dropDuplicates())]
    assert rows(dml.statement(df, "delete", kept, where=F.col("id") == 2).table) == [(1, "a"), (2, "b")]
    assert dml.statement(df, "truncate", []).table.count() == 0 and rows(dml.statement(df, "update", [], where=F.lit(None).cast("boolean"), assign={"s": F.lit("z")}).table) == rows(df)

    def refuse(event):
        raise ValueError(event)

    with pytest.raises(ValueError, match="truncate"):
        dml.statement(df, "truncate", [dml.Trigger("after", ("truncate",), refuse, level="statement")])


def test_schema_statements(spark):
    db = database.Database(spark, "tessera_test_")
    for name in ("a", "b", "c", "d"):
        spark.sql(f"DROP TABLE IF EXISTS tessera_test_{name}")
    db.execute("CREATE TABLE a (k int PRIMARY KEY, v text DEFAULT 'x' NOT NULL, n numeric(8,2) CHECK (n > 0))")
    db.execute("CREATE TABLE b (id int, a_k int REFERENCES a ON DELETE SET NULL, CONSTRAINT u UNIQUE (id, a_k))")
    db.execute("CREATE TABLE IF NOT EXISTS a (other int)")
    for bad in ("CREATE TABLE a (k int)", "CREATE TABLE z (k int, k int)", "DROP VIEW nothing", "DROP TABLE a", "ALTER TABLE gone ADD x int", "CREATE VIEW a AS SELECT 1"):
        with pytest.raises(ValueError):
            db.execute(bad)
    row = lambda *v, names="k int, n double": spark.createDataFrame([v], names)
    assert [tuple(r)[:2] for r in db.insert("a", row(1, 2.5)).collect()] == [(1, "x")]
    for bad in (row(1, 2.0), row(2, -1.0), row(None, 1.0)):
        with pytest.raises(ValueError):
            db.insert("a", bad)
    with pytest.raises(ValueError, match="foreign"):
        db.insert("b", row(1, 9, names="id int, a_k int"))
    db.insert("b", row(1, 1, names="id int, a_k int"))
    for text in (
        "CREATE UNIQUE INDEX i ON b (id)", "ALTER TABLE a RENAME TO c", "ALTER TABLE c ALTER n TYPE int", "ALTER TABLE c ALTER COLUMN v DROP NOT NULL", "ALTER TABLE c ALTER COLUMN v SET DEFAULT 'y'", "ALTER TABLE c RENAME n TO m",
        "CREATE TABLE d AS SELECT m / 2 AS h FROM c", "DROP INDEX i", "DROP TABLE IF EXISTS gone", "CREATE OR REPLACE VIEW w AS SELECT c.k, h FROM c, d",
    ):
        db.execute(text)
    assert [tuple(r) for r in db.query("SELECT * FROM w").collect()] == [(1, 1)] and db.catalog.tables["b"].foreign_keys[0].table == "c"
    assert db.catalog.tables["c"].checks == ("m > 0",) and db.insert("c", row(2, 7, names="k int, m int")).first().v == "y"
    with pytest.raises(ValueError, match="depends"):
        db.execute("DROP TABLE c")
    for name in ("b", "c", "d"):
        db.execute(f"DROP TABLE {name}")
    assert not db.catalog.tables
