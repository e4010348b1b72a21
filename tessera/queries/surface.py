"""The session, texts in the dialect, stores, storage, catalogs, routines, indexes and topics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import context, routines
from tessera.operators import database, ddl, dml, locks
from tessera.operators.recursive import checkpointed
from tessera.plans import dialect, documents, rest
from tessera.queries.languages import _events, _log
from tessera.queries.registry import query, sql_query, t
from tessera.search import index
from tessera.search import vectors as V
from tessera.sources import schema, storage, stores
from tessera.streaming import bus, changes, log


def _folder(spark) -> str:
    """A new folder where the cluster keeps its checkpoints."""
    checkpointed(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/tessera-{uuid.uuid4().hex}"


# Numbers and the session. F1-F3 F18 F20 F24-F27 A15 M17 P18-P22 S6 X26

sql_query("dialect_division", "SELECT n_nationkey, n_nationkey / 7 AS q, (n_nationkey - 12) / 5 AS neg, n_nationkey * 3 / 4 AS chain, (n_nationkey / 2.0)::float8 AS half, n_regionkey / nullif(n_nationkey, 0) AS z FROM nation", oracle="SELECT n_nationkey, n_nationkey // 7 AS q, (n_nationkey - 12) // 5 AS neg, n_nationkey * 3 // 4 AS chain, CAST(n_nationkey AS DOUBLE) / 2.0 AS half, n_regionkey // nullif(n_nationkey, 0) AS z FROM nation")
sql_query("dialect_fractions", "SELECT c_custkey, round((c_acctbal / 3 + c_acctbal * 2 - 1)::float8, 6) AS f, round((c_acctbal::numeric(20,2) * 3 + 0.25)::float8, 4) AS n FROM customer", oracle="SELECT c_custkey, round(c_acctbal / 3 + c_acctbal * 2 - 1, 6) AS f, round(CAST(CAST(c_acctbal AS DECIMAL(20,2)) * 3 + 0.25 AS DOUBLE), 4) AS n FROM customer")
sql_query("dialect_means", "SELECT n_regionkey, avg(n_nationkey)::float8 AS a, avg(DISTINCT n_nationkey)::float8 AS d, sum(n_nationkey) AS s, count(*) / 2 AS c FROM nation GROUP BY n_regionkey", oracle="SELECT n_regionkey, avg(n_nationkey) AS a, avg(DISTINCT n_nationkey) AS d, CAST(sum(n_nationkey) AS BIGINT) AS s, count(*) // 2 AS c FROM nation GROUP BY n_regionkey")
sql_query("dialect_times", "SELECT o_orderkey, o_orderdate < now() AS past, o_orderdate::date <= current_date AS also, to_char(o_custkey, '999') AS c FROM orders", oracle="SELECT o_orderkey, o_orderdate < CAST(now() AS TIMESTAMP) AS past, CAST(o_orderdate AS DATE) <= current_date AS also, CAST(o_custkey AS VARCHAR) AS c FROM orders")
sql_query("dialect_uuids", "SELECT n_regionkey, count(DISTINCT u) AS n, min(length(u)) AS len FROM (SELECT n_regionkey, gen_random_uuid()::text AS u FROM nation) x GROUP BY n_regionkey", oracle="SELECT n_regionkey, count(DISTINCT u) AS n, CAST(min(length(u)) AS INTEGER) AS len FROM (SELECT n_regionkey, CAST(gen_random_uuid() AS VARCHAR) AS u FROM nation) x GROUP BY n_regionkey")
sql_query("dialect_from_function", "SELECT n_nationkey, v.x || n_name AS x FROM upper('abc') AS v(x), nation", oracle="SELECT n_nationkey, v.x || n_name AS x FROM (SELECT upper('abc') AS x) v, nation")
sql_query("dialect_forms", "SELECT n_nationkey, n_name COLLATE \"C\" < 'NATION_2' AS low, ROW(n_nationkey, n_regionkey) AS r, -n_nationkey AS neg, +n_regionkey AS pos, NOT (n_regionkey = 1) AS other FROM nation", oracle="SELECT n_nationkey, n_name < 'NATION_2' AS low, [n_nationkey, n_regionkey] AS r, -n_nationkey AS neg, +n_regionkey AS pos, NOT (n_regionkey = 1) AS other FROM nation")
sql_query("dialect_columns_first", "SELECT n_nationkey, user FROM (SELECT n_nationkey, n_name AS user FROM nation) x", oracle='SELECT n_nationkey, n_name AS "user" FROM nation')


@query("SELECT n_nationkey, 'costs $1 and x::int, it''s' AS t, 'a\\b' || n_name AS s FROM nation WHERE n_regionkey = 1 AND n_name LIKE '%A%'")
def dialect_literals(spark, d):
    t(spark, d, "nation").createOrReplaceTempView("nation")
    return dialect.query(spark, "SELECT n_nationkey, 'costs $1 and x::int, it''s' AS t, $2 || n_name AS s FROM nation /* $3 */ WHERE n_regionkey = $1 AND n_name LIKE '%A%' -- $4", [1, "a\\b"])


@query("""
    SELECT n_nationkey, '6f9619ff-8b86-d011-b42d-00c04fc964ff' AS uid, 'editor' AS role, 'public' AS s, 'al' AS own, 'x' AS made, CAST(NULL AS VARCHAR) AS missing, 'integer' AS type, true AS may, CAST(NULL AS VARCHAR) AS comment, 0.3 AS similar
    FROM nation""")
def dialect_session(spark, d):
    """Who is asking, variables and their defaults."""
    t(spark, d, "nation").createOrReplaceTempView("nation")
    for text in ("""SET request.jwt.claims = '{"sub": "6f9619ff-8b86-d011-b42d-00c04fc964ff", "role": "editor"}'""", "SET app.own TO 'al'", "SET app.gone = 1", "RESET app.gone"):
        dialect.query(spark, text)
    text = """SELECT n_nationkey, auth.uid() AS uid, auth.role() AS role, current_schema() AS s, current_setting('app.own') AS own, set_config('app.made', 'x', false) AS made, current_setting('app.gone', true) AS missing,
              format_type(23, NULL) AS type, has_table_privilege('nation', 'select') AS may, obj_description(n_nationkey) AS comment, current_setting('pg_trgm.similarity_threshold')::float8 AS similar FROM nation"""
    return dialect.query(spark, text)


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def rls_by_claims(spark, d):
    """A policy that asks for a claim: only the claimed region is seen."""
    t(spark, d, "nation").createOrReplaceTempView("nation")
    context.set_config(spark, "request.jwt.claim.region", "2")
    seen = dml.Policy(F.col("n_regionkey") == int(context.claim(spark, "region")))
    return dml.secured(t(spark, d, "nation"), [seen]).select("n_nationkey")


@query("SELECT * FROM (VALUES ('btree_gin', '1.3', 'native'), ('cube', '1.5', 'native'), ('earthdistance', '1.1', 'native'), ('plpgsql', '1.0', 'native')) v(name, installed_version, runtime)")
def extensions_installed(spark, d):
    for name in ("earthdistance", "cube", "btree_gin", "hstore", "citext"):
        dialect.query(spark, f"DROP EXTENSION IF EXISTS {name} CASCADE")
    for text in ("CREATE EXTENSION earthdistance CASCADE", "CREATE EXTENSION IF NOT EXISTS btree_gin VERSION '1.3'", "CREATE EXTENSION hstore", "DROP EXTENSION hstore"):
        dialect.query(spark, text)
    return context.available_extensions(spark).where("installed_version is not null").select("name", "installed_version", "runtime")


# Windows. W15 W18

sql_query("win_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 20 FOLLOWING) AS n FROM orders")
sql_query("win_in_order_by", "SELECT o_orderkey FROM orders ORDER BY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC), o_orderkey LIMIT 20")


# Stores. S9-S18 S20 S22


@query("SELECT c_name AS key, CASE WHEN c_nationkey = 3 THEN 'new' ELSE c_mktsegment END AS value FROM customer WHERE c_nationkey <> 4")
def kv_last_values(spark, d):
    """Puts of all customers, then of some anew, then deletes of others."""
    store, c = stores.KeyValueStore(spark, _folder(spark)), t(spark, d, "customer")
    store.write(c.select(F.col("c_name").alias("key"), F.encode("c_mktsegment", "UTF-8").alias("value")))
    store.write(c.where("c_nationkey = 3").select(F.col("c_name").alias("key"), F.encode(F.lit("new"), "UTF-8").alias("value")))
    store.write(c.where("c_nationkey = 4").select(F.col("c_name").alias("key")), "DEL")
    return store.all().select("key", F.decode("value", "UTF-8").alias("value"))


@query("SELECT p_name || '.' || p_partkey AS key FROM part WHERE contains(lower(replace(p_name || '.' || p_partkey, '.', ' ')), 'part 1')")
def kv_documents_by_key(spark, d):
    docs = t(spark, d, "part").select(F.concat_ws(".", "p_name", F.col("p_partkey").cast("string")).alias("key"))
    return stores.documents_by_key(docs, "Part 1", ignore_case=True, partial=True)


@query("SELECT CAST(event_id AS VARCHAR) AS key FROM events WHERE event_type <> 'click'")
def doc_store_batches(spark, d):
    """Documents in batches, some deleted again."""
    store, docs = stores.DocumentStore(spark, _folder(spark)), _events(spark, d).select(F.col("id").cast("string").alias("key"), "doc")
    store.put_batch(docs)
    store.delete_batch(docs.where(F.get_json_object("doc", "$.event_type") == "click"))
    return store.documents().select("key")


@query("SELECT n_name AS payload, (SELECT count(DISTINCT user_id) FROM events) AS below, (SELECT max(event_id) + 1 FROM events) AS time FROM nation")
def log_add(spark, d):
    """Entries on top of all heads are the heads then."""
    grown = log.add(_log(spark, d), t(spark, d, "nation").select(F.col("n_name").alias("payload")), "me")
    return log.heads(grown).select("payload", F.size("next").cast("long").alias("below"), "time")


@query("SELECT p_brand || '/' || p_partkey AS name FROM part WHERE starts_with(p_brand, 'Brand#1') AND contains(p_brand || '/' || p_partkey, '7') ORDER BY 1 DESC LIMIT 20 OFFSET 3")
def object_listing(spark, d):
    objects = t(spark, d, "part").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("name"))
    return stores.object_listing(objects, "Brand#1", "7", "name", True, 20, 3)


@query("SELECT CAST(c_custkey AS VARCHAR) AS row_id, CASE WHEN c_nationkey = 3 THEN 'moved' ELSE c_mktsegment END AS segment FROM customer WHERE c_nationkey <> 4")
def storage_folder(spark, d):
    return _stored(storage.FolderStorage(spark, _folder(spark)), t(spark, d, "customer"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS row_id, CASE WHEN c_nationkey = 3 THEN 'moved' ELSE c_mktsegment END AS segment FROM customer WHERE c_nationkey <> 4")
def storage_memory(spark, d):
    return _stored(storage.MemoryStorage(spark), t(spark, d, "customer"))


def _stored(place: storage.TableStorage, customers):
    rows = customers.select(F.col("c_custkey").cast("string").alias("row_id"), F.to_json(F.struct("c_mktsegment")).alias("doc"))
    place.put("customer", rows)
    place.truncate("customer")
    place.put("customer", rows)
    moved = customers.where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("row_id"), F.lit('{"c_mktsegment":"moved"}').alias("doc"))
    place.put("customer", moved)
    place.delete("customer", customers.where("c_nationkey = 4").select(F.col("c_custkey").cast("string").alias("row_id")))
    return place.scan("customer").select("row_id", F.get_json_object("doc", "$.c_mktsegment").alias("segment"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS row_id, n_name AS name FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'x', 'NEW'")
def transaction_commit(spark, d):
    """A commit of deletes and a new row; a second transaction is rolled back, a third one fails and so commits nothing."""
    place, n = storage.FolderStorage(spark, _folder(spark)), t(spark, d, "nation")
    place.put("nation", n.select(F.col("n_nationkey").cast("string").alias("row_id"), F.to_json(F.struct("n_name", "n_regionkey")).alias("doc")))
    one, two, three = (storage.Transaction(place) for _ in range(3))
    one.delete("nation", F.get_json_object("doc", "$.n_regionkey") == "1")
    one.put("nation", spark.createDataFrame([("x", '{"n_name":"NEW"}')], storage.ROW))
    two.delete("nation", F.lit(True))
    two.rollback()
    one.commit()
    three.delete("nation", F.lit(True))
    try:
        three.run(lambda own: own.scan("nation").select("no_such_column"))
    except Exception:  # noqa: BLE001
        three.commit()
    return place.scan("nation").select("row_id", F.get_json_object("doc", "$.n_name").alias("name"))


@query("SELECT CAST(to_json(struct_pack(n_nationkey := n_nationkey, n_name := nullif(n_name, 'NATION_3'), large := n_regionkey > 2)) AS VARCHAR) AS row FROM nation")
def sink_json_rows(spark, d):
    return stores.json_rows(t(spark, d, "nation").selectExpr("n_nationkey", "nullif(n_name, 'NATION_3') AS n_name", "n_regionkey > 2 AS large"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_acctbal > 0 THEN 't' ELSE 'f' END AS owes FROM customer")
def sink_text_rows(spark, d):
    return stores.text_rows(t(spark, d, "customer").selectExpr("c_custkey", "c_acctbal > 0 AS owes"))


@query("SELECT * FROM (VALUES ('relation', 'nation', 'RowShareLock', true, 1), ('relation', 'nation', 'RowShareLock', true, 2), ('advisory', '7', 'AdvisoryLock', true, 1), ('advisory', '7', 'AdvisoryLock', false, 2)) v(locktype, relation, mode, granted, pid) UNION ALL SELECT 'tuple', 'nation', 'ExclusiveLock', true, CASE WHEN n_regionkey = 1 THEN 1 ELSE 2 END FROM nation WHERE n_regionkey IN (1, 2)")
def schema_locks(spark, d):
    """Two sessions: rows for update, and a key that one holds and the other waits for."""
    held, _ = _locking(spark, d)
    held.call(1, "pg_advisory_lock", 7)
    held.call(2, "pg_advisory_lock", 7)
    return held.snapshot(spark)


@query("SELECT * FROM nation WHERE n_regionkey = 2")
def select_skip_locked(spark, d):
    """Rows for update but for those that another session holds."""
    return _locking(spark, d)[1]


def _locking(spark, d):
    held, n = locks.LockManager(), t(spark, d, "nation")
    locks.select_for(held, 1, n, "nation", "n_nationkey", F.col("n_regionkey") == 1)
    return held, locks.select_for(held, 2, n, "nation", "n_nationkey", F.col("n_regionkey").isin(1, 2), skip_locked=True)


@query("SELECT true AS mine, false AS others, true AS shared, true AS given_back, false AS again, true AS then_theirs")
def lock_functions(spark, d):
    held = locks.LockManager()
    said = [held.call(1, "pg_try_advisory_lock", 1, 2), held.call(2, "pg_try_advisory_xact_lock", 1, 2), held.call(2, "pg_try_advisory_lock_shared", 9) and held.call(1, "pg_try_advisory_xact_lock_shared", 9)]
    said += [held.call(1, "pg_advisory_unlock", 1, 2), held.call(1, "pg_advisory_unlock", 1, 2), held.call(2, "pg_try_advisory_lock", 1, 2)]
    return spark.createDataFrame([tuple(said)], "mine boolean, others boolean, shared boolean, given_back boolean, again boolean, then_theirs boolean")


@query("SELECT n_nationkey, upper(reverse(n_name)) AS out FROM nation")
def task_bytes(spark, d):
    """A task is any function from bytes to bytes."""
    run = changes.task(lambda data: data[::-1].upper())
    return t(spark, d, "nation").select("n_nationkey", F.decode(run(F.encode("n_name", "UTF-8")), "UTF-8").alias("out"))


def _catalog(spark, d) -> schema.Catalog:
    of = lambda name, **more: schema.Table(name, t(spark, d, name).schema, **more)
    nation = of("nation", primary_key=("n_nationkey",), unique=(("n_name",),), foreign_keys=(schema.ForeignKey(("n_regionkey",), "region", ("r_regionkey",), "CASCADE"),), checks=("n_regionkey >= 0",))
    customer = of("customer", primary_key=("c_custkey",), foreign_keys=(schema.ForeignKey(("c_nationkey",), "nation", ("n_nationkey",), "SET NULL"),), defaults={"c_acctbal": "0"}, indexes=(("customer_segment", ("c_mktsegment", "c_nationkey")),))
    return schema.Catalog([of("region", primary_key=("r_regionkey",)), nation, customer, *(of(n) for n in ("supplier", "part", "orders", "lineitem", "events"))], {"rich": "SELECT * FROM customer WHERE c_acctbal > 9000"})


@query("SELECT table_name, column_name, ordinal_position, CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp without time zone' WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type = 'DOUBLE' THEN 'double precision' ELSE lower(data_type) END AS data_type FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')")
def schema_columns(spark, d):
    return _catalog(spark, d).information_schema(spark, "columns").select("table_name", "column_name", "ordinal_position", "data_type")


@query("SELECT table_name, 'BASE TABLE' AS table_type FROM information_schema.tables WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events') UNION ALL SELECT 'rich', 'VIEW'")
def schema_tables(spark, d):
    return _catalog(spark, d).information_schema(spark, "tables").select("table_name", "table_type")


@query("""
    SELECT * FROM (VALUES ('customer_c_nationkey_fkey', 'FOREIGN KEY', 'customer', 'c_nationkey', 'nation', 'n_nationkey', 'SET NULL'), ('customer_pkey', 'PRIMARY KEY', 'customer', 'c_custkey', 'customer', 'c_custkey', NULL),
        ('nation_n_name_key', 'UNIQUE', 'nation', 'n_name', 'nation', 'n_name', NULL), ('nation_n_regionkey_fkey', 'FOREIGN KEY', 'nation', 'n_regionkey', 'region', 'r_regionkey', 'CASCADE'),
        ('nation_pkey', 'PRIMARY KEY', 'nation', 'n_nationkey', 'nation', 'n_nationkey', NULL), ('region_pkey', 'PRIMARY KEY', 'region', 'r_regionkey', 'region', 'r_regionkey', NULL)) v(name, kind, tab, col, to_tab, to_col, on_delete)""")
def schema_constraints(spark, d):
    """Keys from four views joined, as clients ask for them."""
    view = lambda name: _catalog(spark, d).information_schema(spark, name)
    kind = view("table_constraints").select(F.col("constraint_name").alias("name"), F.col("constraint_type").alias("kind"))
    own = view("key_column_usage").select(F.col("constraint_name").alias("name"), F.col("table_name").alias("tab"), F.col("column_name").alias("col"))
    to = view("constraint_column_usage").select(F.col("constraint_name").alias("name"), F.col("table_name").alias("to_tab"), F.col("column_name").alias("to_col"))
    rule = view("referential_constraints").select(F.col("constraint_name").alias("name"), F.col("delete_rule").alias("on_delete"))
    return kind.join(own, "name").join(to, "name").join(rule, "name", "left")


@query("SELECT table_name, count(*) AS columns FROM information_schema.columns WHERE table_name IN ('nation', 'region') GROUP BY 1 ORDER BY 1")
def schema_by_query(spark, d):
    """The views by name within a query, beside a table expression, a view and a subquery."""
    t(spark, d, "nation").createOrReplaceTempView("nation")
    ddl.create_view(t(spark, d, "region"), "region")
    text = "WITH mine AS (SELECT 'nation' AS n UNION ALL SELECT 'region') SELECT c.table_name, count(*) AS columns FROM information_schema.columns c, mine, (SELECT relname FROM pg_catalog.pg_class) k WHERE c.table_name = mine.n AND k.relname = mine.n GROUP BY 1 ORDER BY 1"
    return dialect.query(spark, text)


@query("SELECT schema_name FROM (VALUES ('information_schema'), ('pg_catalog'), ('public')) v(schema_name)")
def schema_schemata(spark, d):
    return _catalog(spark, d).information_schema(spark, "schemata").select("schema_name")


@query("SELECT 'rich' AS table_name, 'SELECT * FROM customer WHERE c_acctbal > 9000' AS view_definition")
def schema_views(spark, d):
    return _catalog(spark, d).information_schema(spark, "views").select("table_name", "view_definition")


@query("SELECT table_name AS relname, column_name AS attname, CAST(ordinal_position AS INTEGER) AS attnum FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')")
def schema_pg_attributes(spark, d):
    c = _catalog(spark, d)
    tables, columns = c.pg_catalog(spark, "pg_class"), c.pg_catalog(spark, "pg_attribute")
    return tables.join(columns, F.col("oid") == F.col("attrelid")).select("relname", "attname", "attnum")


@query("SELECT * FROM (VALUES ('nation', 'region', 'region'), ('nation', 'customerCollection', 'customerConnection'), ('region', 'nationCollection', 'nationConnection'), ('customer', 'nation', 'nation')) v(type, field, field_type) UNION ALL SELECT table_name, column_name, CASE WHEN column_name LIKE '%key' AND column_name <> 'c_custkey' THEN 'Int' WHEN column_name = 'c_custkey' THEN 'BigInt' WHEN data_type = 'DOUBLE' THEN 'Float' ELSE 'String' END || CASE WHEN (table_name, column_name) IN (('region', 'r_regionkey'), ('nation', 'n_nationkey'), ('customer', 'c_custkey')) THEN '!' ELSE '' END FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer')")
def gql_introspection(spark, d):
    found = _catalog(spark, d).graphql_schema(spark)
    return found.where("type IN ('region', 'nation', 'customer') AND field <> 'nodeId'").select("type", "field", "field_type")


# Documents and REST. D7 D10 Q4


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' AND CAST(json_extract(props, '$.k') AS INTEGER) = 7 AND value > 10")
def doc_indexed_find(spark, d):
    docs = _events(spark, d)
    return documents.indexed_find(docs, documents.equality_index(docs, ("event_type", "props.k")), {"event_type": "click", "props.k": 7, "value": {"$gt": 10}}).select("id")


@query("SELECT event_id AS id FROM events UNION ALL SELECT -1 - event_id FROM events WHERE event_type = 'click'")
def doc_insert_many(spark, d):
    docs = _events(spark, d)
    new = docs.where(F.get_json_object("doc", "$.event_type") == "click").select((-1 - F.col("id")).alias("id"), "doc")
    model = {"event_id": {"type": "number", "required": True}, "event_type": {"type": "string"}, "value": {"type": "number", "nullable": True}, "props": {"type": "object"}, "tags": {"type": "array"}}
    return documents.insert_many(docs, new, model).select("id")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100 + n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def rest_upsert(spark, d):
    n = t(spark, d, "nation")
    some = n.where("n_regionkey = 1")
    new = some.withColumn("n_name", F.lower("n_name")).unionByName(some.withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast("int")))
    return rest.insert(n, new, ["n_nationkey"]).table.select("n_nationkey", "n_name")


@query("SELECT * FROM nation UNION ALL SELECT 100 + n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def rest_insert_ignore(spark, d):
    n = t(spark, d, "nation")
    some = n.where("n_regionkey = 1")
    new = some.withColumn("n_name", F.lower("n_name")).unionByName(some.withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast("int")))
    return rest.insert(n, new, ["n_nationkey"], "ignore-duplicates").table


# Routines, triggers, plans. M6 M12 M14 M15 V7


@query("SELECT n_nationkey, n_nationkey * 10 + n_regionkey AS v, CASE WHEN n_regionkey <> 0 THEN n_regionkey + 1 END AS w FROM nation")
def udf_sql(spark, d):
    routines.create_sql_function(spark, "tessera_mix", [("a", "int"), ("b", "int")], "int", "SELECT 1; SELECT $1 * 10 + b")
    routines.create_sql_function(spark, "tessera_next", [("a", "int")], "int", "SELECT a + 1", strict=True)
    n = t(spark, d, "nation").selectExpr("n_nationkey", "n_regionkey", "nullif(n_regionkey, 0) AS x")
    return n.selectExpr("n_nationkey", "tessera_mix(b => n_regionkey, a => n_nationkey) AS v", "tessera_next(x) AS w")


@query("SELECT c_nationkey, round(exp(avg(ln(abs(c_acctbal) + 1))), 6) AS m FROM customer GROUP BY c_nationkey")
def udf_aggregate(spark, d):
    """A geometric mean as an aggregate of one's own."""
    import numpy as np

    mean = routines.aggregate_function("double precision", lambda v: float(np.exp(np.log(v).mean())))
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.round(mean(F.abs("c_acctbal") + 1), 6).alias("m"))


@query("SELECT p_partkey, CAST(i AS INTEGER) AS at, w AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def udf_table(spark, d):
    routines.create_table_function(spark, "tessera_words", "at int, word string", lambda text: enumerate(text.split(" "), 1))
    t(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, w.at, w.word FROM part, LATERAL tessera_words(p_name) w")


@query("SELECT 100 + n_nationkey AS n_nationkey, CASE WHEN n_regionkey > 2 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey + 1 AS n_regionkey FROM nation")
def dml_triggers(spark, d):
    """Two triggers before an insert: one for rows under a condition, one for all."""
    n = t(spark, d, "nation")
    fired = [dml.Trigger("before", ("insert",), lambda rows: rows.withColumn("n_name", F.lower("n_name")), F.col("n_regionkey") > 2), dml.Trigger("before", ("insert", "update"), lambda rows: rows.withColumn("n_regionkey", F.col("n_regionkey") + 1)), dml.Trigger("after", ("delete",), lambda rows: rows.limit(0))]
    new = dml.fire(fired, "before", "insert", n.withColumn("n_nationkey", F.col("n_nationkey") + 100))
    return dml.insert(n, new).returning


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 2 OR n_nationkey > 12")
def dml_statement_triggers(spark, d):
    """An update whose rows a trigger changes again, then a delete that a trigger keeps from some rows."""
    seen = []
    fired = [
        dml.Trigger("before", ("update", "delete"), seen.append, level="statement"),
        dml.Trigger("before", ("update",), lambda new: new.withColumn("n_name", F.concat("n_name", F.lit("!")))),
        dml.Trigger("before", ("delete",), lambda old: old.limit(0), F.col("n_nationkey") > 12),
        dml.Trigger("after", ("update", "delete"), seen.append, level="statement"),
    ]
    once = dml.statement(t(spark, d, "nation"), "update", fired, where=F.col("n_regionkey") == 1, assign={"n_name": F.upper("n_name")})
    out = dml.statement(once.table, "delete", fired, where=F.col("n_regionkey") == 2).table
    if seen != ["update", "update", "delete", "delete"]:
        raise AssertionError(seen)
    return out.select("n_nationkey", "n_name")


@query("SELECT true AS scans, true AS pushed")
def explain_plan(spark, d):
    plan = ddl.explain(t(spark, d, "orders").where("o_custkey = 7").select("o_orderkey"))
    return plan.agg(F.max(F.contains("plan", F.lit("parquet"))).alias("scans"), F.max(F.contains("plan", F.lit("EqualTo(o_custkey,7)"))).alias("pushed"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def ddl_create_table(spark, d):
    """A managed table in buckets; groups by the bucket key need no shuffle."""
    name = f"tessera_{uuid.uuid4().hex}"
    ddl.create_table_as(t(spark, d, "nation"), name, buckets=4, keys=("n_regionkey",))
    out = checkpointed(spark.table(name).groupBy("n_regionkey").agg(F.count("*").alias("n")))
    spark.sql(f"DROP TABLE {name}")
    return out


@query("SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, 'new' AS note FROM nation WHERE n_regionkey > 1")
def ddl_statements(spark, d):
    """Tables, keys, an index and a view by statements; rows by inserts that are checked; columns added, renamed, retyped and dropped."""
    db = database.Database(spark, f"tessera_{uuid.uuid4().hex[:8]}_")
    for text in (
        "CREATE TABLE region (r_regionkey int PRIMARY KEY, r_name text NOT NULL)",
        "CREATE TABLE nation (n_nationkey int, n_name varchar(25) UNIQUE, n_regionkey int REFERENCES region ON DELETE CASCADE, spare numeric(10,2) DEFAULT 1.5 CHECK (spare > 0), PRIMARY KEY (n_nationkey))",
        "CREATE INDEX by_region ON nation (n_regionkey)",
    ):
        db.execute(text)
    db.insert("region", t(spark, d, "region"))
    db.insert("nation", t(spark, d, "nation"))
    for text in (
        "ALTER TABLE nation RENAME COLUMN n_nationkey TO id", "ALTER TABLE nation ALTER COLUMN n_regionkey TYPE text", "ALTER TABLE nation ADD COLUMN note text DEFAULT 'new'", "ALTER TABLE nation DROP COLUMN spare", "ALTER TABLE nation RENAME TO states",
        "CREATE VIEW far AS SELECT id, n_name AS name, n_regionkey AS region, note FROM states WHERE n_regionkey::int > 1",
    ):
        db.execute(text)
    out = checkpointed(db.query("SELECT * FROM far"))
    for text in ("DROP VIEW far", "DROP TABLE states", "DROP TABLE region"):
        db.execute(text)
    return out


# Vector indexes, answers, topics, progress. V1-V5 E3 E7 R4 R11 R16


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS dist FROM embeddings, q ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), vec_id LIMIT 10")
def ann_small_table(spark, d):
    """An index of few rows answers exactly."""
    e = t(spark, d, "embeddings")
    made = index.Runtime(spark, _folder(spark))
    made.create("CREATE INDEX e_idx ON embeddings USING hnsw (embedding vector_l2_ops) WITH (m = 16, ef_construction = 64)", "vec_id")
    q = [float(x) for x in e.where("vec_id = 0").first().embedding]
    return made.nearest("embeddings", e, "embedding", "<->", q, 10).select("id", F.round("dist", 6).alias("dist"))


@query("SELECT 'added' AS first, 'current' AS again, 'rebuilt' AS after_deletes, true AS sound, count(*) FILTER (WHERE label > 4) AS n FROM embeddings")
def ann_reconcile(spark, d):
    """An index follows its table: rows come in, nothing happens, too many go."""
    e = t(spark, d, "embeddings")
    it = index.VectorIndex(spark, index.IndexDefinition("i", "embeddings", "embedding", "vector_cosine_ops"), _folder(spark), "vec_id")
    it.build(e.where("label <> 5"))
    said = [it.reconcile(df) for df in (e, e, e.where("label > 4"))]
    return spark.createDataFrame([(*said, it.verify(), it._manifest().n)], "first string, again string, after_deletes string, sound boolean, n long")


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT upper('Use: ' || string_agg('[' || vec_id || '] label ' || label, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY d, vec_id) || ' to say: what?') AS answer FROM (SELECT vec_id, label, list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS d FROM embeddings, q ORDER BY d, vec_id LIMIT 5)")
def rag_answer(spark, d):
    """Any function from text to text may answer; here one that shouts."""
    docs = t(spark, d, "embeddings").select("vec_id", "embedding", F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))
    q = [float(x) for x in t(spark, d, "embeddings").where("vec_id = 0").first().embedding]
    return V.answer(V.retrieve(docs, q, 5, "vec_id"), "what?", str.upper, "Use: {context} to say: {question}").select("answer")


@query("SELECT event_id AS id, 'e' || event_id AS payload FROM events WHERE event_type = 'click'")
def topic_messages(spark, d):
    """What is published on one topic arrives once at its subscriber."""
    folder, got = _folder(spark), _folder(spark)
    bus.publish(t(spark, d, "events").select(F.col("event_type").alias("topic"), F.col("event_id").cast("string").alias("event"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("payload")), folder)
    for _ in range(2):
        bus.subscribe(spark, folder, "click", lambda rows, _: rows.write.mode("append").parquet(got), f"{folder}-seen").awaitTermination()
    return spark.read.schema("event string, payload string").parquet(got).select(F.col("event").cast("long").alias("id"), "payload")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') * 100.0 / count(*) AS percent FROM events GROUP BY user_id")
def sync_progress(spark, d):
    done = t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("done"), F.count("*").alias("total"))
    return done.select("user_id", changes.progress(F.col("done"), F.col("total")).alias("percent"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events")
def log_numbered(spark, d):
    return log.numbered(_log(spark, d), "id").select(F.col("id").cast("long").alias("user_id"), F.col("time").alias("event_id"), F.col("seq").cast("long").alias("seq"))
