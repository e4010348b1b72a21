"""Document, REST and GraphQL queries, the PostgreSQL dialect, routines, logs, feeds and task results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import routines
from tessera.plans import dialect, documents, graphql, rest
from tessera.queries.registry import query, sql_query, t
from tessera.streaming import changes, log

# Documents. D1-D10


def _events(spark, d):
    return t(spark, d, "events").select(F.col("event_id").alias("id"), F.to_json(F.struct("event_id", "event_type", "value", F.from_json("props", "k int").alias("props"), F.array("event_type", F.lit("all")).alias("tags"))).alias("doc"))


_EVENTS = "SELECT event_id AS id FROM events WHERE "


@query(_EVENTS + "CAST(json_extract(props, '$.k') AS INTEGER) > 50 AND event_type <> 'click'")
def doc_find(spark, d):
    return documents.find(_events(spark, d), {"props.k": {"$gt": 50}, "event_type": {"$ne": "click"}}).select("id")


@query(_EVENTS + "(event_type = 'click' OR CAST(json_extract(props, '$.k') AS INTEGER) <= 10) AND NOT CAST(json_extract(props, '$.k') AS INTEGER) IN (3, 4)")
def doc_logic(spark, d):
    return documents.find(_events(spark, d), {"$or": [{"tags": "click"}, {"props.k": {"$lte": 10}}], "$nor": [{"props.k": {"$in": [3, 4]}}]}).select("id")


@query(_EVENTS + "true")
def doc_exists_size(spark, d):
    return documents.find(_events(spark, d), {"tags": {"$size": 2}, "missing": {"$exists": False}, "props": {"$exists": True}, "$and": []}).select("id")


@query("SELECT event_id AS id, CASE WHEN event_id = 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) + 5 ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
def doc_update(spark, d):
    found = documents.update_one(_events(spark, d), {"event_id": {"$gte": 0}}, {"$inc": {"props.k": 5}, "$set": {"seen": True}, "$unset": {"value": 1}})
    return found.select("id", documents.field(F.col("doc"), "props.k", "int").alias("k"))


@query(_EVENTS + "event_type = 'click'")
def doc_violations(spark, d):
    docs = _events(spark, d).withColumn("doc", F.when(F.contains("doc", F.lit('"event_type":"click"')), F.replace("doc", F.lit('"props"'), F.lit('"other"'))).otherwise(F.col("doc")))
    schema = {"event_id": {"type": "number", "required": True}, "event_type": {"type": "string"}, "value": {"type": "number", "nullable": True}, "props": {"type": "object", "required": True}, "tags": {"type": "array"}}
    return documents.violations(docs, schema).select("id")


# REST. Q1-Q5


@query("SELECT c_custkey AS id, c_name FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE 'Cust%1' AND NOT c_nationkey = 3 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 2")
def rest_select(spark, d):
    return rest.select(t(spark, d, "customer"), "select=id:c_custkey,c_name&c_acctbal=gte.1000&c_mktsegment=in.(BUILDING,MACHINERY)&c_name=like.Cust*1&c_nationkey=not.eq.3&order=c_acctbal.desc,c_custkey&limit=20&offset=2")


@query("SELECT count(*) AS count FROM customer WHERE c_nationkey = 3")
def rest_count(spark, d):
    return rest.count(t(spark, d, "customer"), "c_nationkey=eq.3&limit=2")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def rest_update(spark, d):
    return rest.update(t(spark, d, "customer"), "c_nationkey=eq.3", {"c_mktsegment": "X"}).table.select("c_custkey", "c_mktsegment")


@query("SELECT * FROM nation WHERE n_regionkey <> 2")
def rest_delete(spark, d):
    return rest.delete(t(spark, d, "nation"), "n_regionkey=eq.2").table


@query("SELECT 42 AS result")
def rest_rpc(spark, d):
    routines.create_sql_function(spark, "tessera_add", [("a", "int"), ("b", "int")], "int", "SELECT $1 + b")
    return rest.rpc(spark, "tessera_add", {"b": 2, "a": 40})


# GraphQL. Q6-Q10, J12


@query("SELECT c_custkey FROM customer WHERE (c_acctbal > 5000 OR starts_with(c_mktsegment, 'B')) AND NOT c_nationkey IN (1, 2) ORDER BY c_custkey LIMIT 10")
def gql_connection(spark, d):
    wanted = {"or": [{"c_acctbal": {"gt": 5000}}, {"c_mktsegment": {"startsWith": "B"}}], "not": {"c_nationkey": {"in": [1, 2]}}}
    return graphql.connection(t(spark, d, "customer"), ["c_custkey"], wanted, first=10).select("c_custkey")


@query("SELECT o_orderkey, true AS has_next_page, true AS has_previous_page FROM orders WHERE o_orderkey > 20 ORDER BY o_orderkey LIMIT 5")
def gql_after_cursor(spark, d):
    return graphql.connection(t(spark, d, "orders"), ["o_orderkey"], first=5, after=graphql.encode_cursor([20])).select("o_orderkey", "has_next_page", "has_previous_page")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 50 ORDER BY o_orderkey DESC LIMIT 4")
def gql_before_cursor(spark, d):
    return graphql.connection(t(spark, d, "orders"), ["o_orderkey"], last=4, before=graphql.encode_cursor([50])).select("o_orderkey")


@query("SELECT count(*) AS total_count FROM orders WHERE o_orderstatus = 'F'")
def gql_total_count(spark, d):
    return graphql.total_count(t(spark, d, "orders"), {"o_orderstatus": {"eq": "F"}})


@query("SELECT r_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def gql_children(spark, d):
    both = graphql.with_children(t(spark, d, "region"), t(spark, d, "nation"), "r_regionkey", "n_regionkey", "nations", "n_nationkey")
    return both.select("r_regionkey", F.transform("nations", lambda n: n["n_name"]).alias("names"))


@query("SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def gql_parent(spark, d):
    return graphql.with_parent(t(spark, d, "nation"), t(spark, d, "region"), "n_regionkey", "r_regionkey", "region").select("n_nationkey", F.col("region.r_name").alias("r_name"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'Q' ELSE n_name END AS n_name FROM nation")
def gql_mutation(spark, d):
    return graphql.update_collection(t(spark, d, "nation"), {"n_name": "Q"}, {"n_nationkey": {"eq": 3}}).table.select("n_nationkey", "n_name")


# The dialect. §7.3

sql_query("dialect_casts", "SELECT o_orderkey, (o_totalprice / 3)::int AS third, o_custkey::text AS c, extract(dow FROM o_orderdate) AS dow FROM orders", oracle="SELECT o_orderkey, CAST(round(o_totalprice / 3) AS INTEGER) AS third, CAST(o_custkey AS VARCHAR) AS c, CAST(extract(dow FROM o_orderdate) AS INTEGER) AS dow FROM orders")
sql_query("dialect_any_like", "SELECT p_partkey FROM part WHERE p_size = ANY (ARRAY[1, 2, 3]) AND p_name ILIKE '%A%'", oracle="SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3) AND p_name ILIKE '%A%'")
sql_query("dialect_window_filter", "SELECT o_orderkey, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS s FROM orders", oracle="SELECT o_orderkey, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC), 2) AS s FROM orders")
sql_query("dialect_order_nulls", "SELECT n_name, row_number() OVER (ORDER BY nullif(n_regionkey, 3) DESC, n_name) AS rn FROM nation ORDER BY nullif(n_regionkey, 3) DESC, n_name LIMIT 7", oracle="SELECT n_name, row_number() OVER (ORDER BY nullif(n_regionkey, 3) DESC NULLS FIRST, n_name) AS rn FROM nation ORDER BY nullif(n_regionkey, 3) DESC NULLS FIRST, n_name LIMIT 7")


@query("SELECT o_orderkey, o_custkey // 7 AS q FROM orders WHERE o_custkey > 100 AND o_orderstatus = 'O'")
def dialect_params(spark, d):
    t(spark, d, "orders").createOrReplaceTempView("orders")
    return dialect.query(spark, "SELECT o_orderkey, o_custkey / 7 AS q FROM orders WHERE o_custkey > $2 AND o_orderstatus = $1", ["O", 100], {"o_custkey"})


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'zero' WHEN n_regionkey * 2 > 5 THEN 'big' ELSE 'small' END AS size FROM nation")
def udf_plpgsql(spark, d):
    body = "DECLARE x int; BEGIN x := k * 2; IF k = 0 THEN RETURN 'zero'; ELSIF x > 5 THEN RETURN 'big'; ELSE RETURN 'small'; END IF; END;"
    routines.create_plpgsql_function(spark, "tessera_size", [("k", "int")], "text", body, strict=True)
    return t(spark, d, "nation").select("n_nationkey", F.expr("tessera_size(n_regionkey)").alias("size"))


# Logs. R5-R10, S14, S19


def _log(spark, d):
    """All events as entries: each refers to its user's event before."""
    name = lambda c: F.concat(F.lit("h"), F.lpad(c.cast("string"), 19, "0"))
    before = F.expr("lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id)")
    return t(spark, d, "events").select(name(F.col("event_id")).alias("hash"), F.col("event_type").alias("payload"), F.when(before.isNotNull(), F.array(name(before))).otherwise(F.array().cast("array<string>")).alias("next"), F.col("event_id").alias("time"), F.col("user_id").cast("string").alias("id"))


_H = "'h' || lpad(CAST(event_id AS VARCHAR), 19, '0')"


@query(f"SELECT {_H} AS hash FROM events QUALIFY event_id = max(event_id) OVER (PARTITION BY user_id)")
def log_heads(spark, d):
    return log.heads(_log(spark, d)).select("hash")


@query(f"SELECT {_H} AS hash FROM events QUALIFY event_id = min(event_id) OVER (PARTITION BY user_id)")
def log_tails(spark, d):
    return log.tails(_log(spark, d)).select("hash")


@query(f"SELECT {_H} AS hash FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events) WHERE event_type <> 'click' AND after = 'click'")
def log_tail_hashes(spark, d):
    """References of clicks to entries that a log of clicks alone hasn't."""
    return log.tail_hashes(_log(spark, d).where("payload = 'click'")).select("hash")


@query(f"SELECT {_H} AS hash FROM events")
def log_join(spark, d):
    whole = _log(spark, d)
    return log.join(whole.where("payload <> 'click'"), whole.where("payload <> 'view'")).select("hash")


@query(f"SELECT {_H} AS hash FROM events ORDER BY event_id DESC LIMIT 50")
def log_join_truncated(spark, d):
    whole = _log(spark, d)
    return log.join(whole.where("payload <> 'click'"), whole.where("payload <> 'view'"), 50).select("hash")


@query(f"SELECT {_H} AS hash FROM events WHERE event_type = 'click'")
def log_diff(spark, d):
    whole = _log(spark, d)
    return log.diff(whole, whole.where("payload <> 'click'")).select("hash")


@query(f"SELECT {_H} AS hash FROM events WHERE user_id = (SELECT max_by(user_id, event_id) FROM events)")
def log_traverse(spark, d):
    """What the log's last entry is built on."""
    whole = _log(spark, d)
    return log.traverse(whole, whole.agg(F.max("hash").alias("hash"))).select("hash")


@query(f"SELECT {_H} AS hash FROM events WHERE event_id > 100")
def log_range(spark, d):
    return log.read_range(_log(spark, d), gt="h" + "100".zfill(19)).select("hash")


@query(f"SELECT {_H} AS hash FROM events WHERE event_id < 900 ORDER BY event_id DESC LIMIT 10")
def log_range_last(spark, d):
    return log.read_range(_log(spark, d), lt="h" + "900".zfill(19), amount=10).select("hash")


@query(f"SELECT {_H} AS hash, event_type AS payload FROM events WHERE event_id = 100")
def log_get(spark, d):
    return log.get(_log(spark, d), "h" + "100".zfill(19)).select("hash", "payload")


@query("SELECT max(event_id) + 1 AS now, greatest(max(event_id), 7) AS merged FROM events")
def log_clock(spark, d):
    time = F.col("time")
    return log.clock(_log(spark, d)).select(log.tick(time).alias("now"), log.merge_clocks(time, F.lit(7)).alias("merged"))


@query("SELECT user_id AS key, max_by(value, event_id) AS value FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'click'")
def lww_last_writes(spark, d):
    ops = t(spark, d, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "click", "DEL").otherwise("PUT").alias("op"), "value", F.col("event_id").alias("time"), F.lit("w").alias("id"), F.lit("h").alias("hash"))
    return log.last_writes(ops)


# Feeds and tasks. R1-R3, R12-R16


@query("SELECT CASE WHEN n_nationkey < 5 THEN 'DELETE' WHEN n_nationkey >= 20 THEN 'INSERT' ELSE 'UPDATE' END AS op, n_nationkey AS k FROM nation WHERE n_nationkey < 5 OR n_nationkey >= 20 OR n_regionkey = 1")
def cdc_diff_feed(spark, d):
    nation = t(spark, d, "nation")
    after = nation.where("n_nationkey >= 5").withColumn("n_name", F.when(F.col("n_regionkey") == 1, F.lower("n_name")).otherwise(F.col("n_name")))
    feed = changes.diff_feed(nation.where("n_nationkey < 20"), after, ["n_nationkey"], "nation")
    return feed.select("op", F.get_json_object(F.coalesce("new", "old"), "$.n_nationkey").cast("int").alias("k"))


def _feed(spark, d):
    return t(spark, d, "events").select(F.lit("public").alias("schema"), F.lit("events").alias("table"), F.when(F.col("event_type") == "click", "DELETE").otherwise("UPDATE").alias("op"), F.to_json(F.struct("user_id", "value")).alias("old"), F.when(F.col("event_type") != "click", F.to_json(F.struct("user_id", "value"))).alias("new"), F.col("event_id").alias("commit_time"))


@query("SELECT event_id FROM events WHERE event_type <> 'click' AND user_id = 7")
def cdc_bound(spark, d):
    return changes.bound(_feed(spark, d), "UPDATE", table="events", filter="user_id=eq.7").select(F.col("commit_time").alias("event_id"))


@query("SELECT event_id FROM events WHERE event_type <> 'click' AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def cdc_authorised(spark, d):
    mine = t(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    return changes.authorised(_feed(spark, d), mine, "user_id").select(F.col("commit_time").alias("event_id"))


@query("SELECT CAST(user_id AS VARCHAR) AS key FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'click'")
def cdc_fold(spark, d):
    return changes.fold(_feed(spark, d), "user_id").select("key")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def cdc_windowed_counts(spark, d):
    return changes.windowed_counts(t(spark, d, "events"), "ts", "1 hour", by=("event_type",)).select("start", "event_type", "n")


@query("SELECT 'clicks' AS rule, event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 'all', event_id FROM events")
def trigger_due_tasks(spark, d):
    e = t(spark, d, "events").select("event_id", F.concat(F.lit("/events/"), "event_type").alias("address"))
    rules = [changes.TriggerRule("clicks", "/events/click", "count"), changes.TriggerRule("all", "/events/", "log")]
    return changes.due_tasks(e.unionByName(e), rules).select("rule", "event_id")


@query("SELECT user_id AS task, event_type AS output, count(*) AS votes FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1")
def task_majority(spark, d):
    results = t(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("output"), F.col("event_id").cast("string").alias("worker"))
    return changes.majority(results, 2).select("task", "output", "votes")


@query("SELECT n_nationkey AS seq, reverse(n_name) AS result FROM nation")
def task_fan_out(spark, d):
    requests = t(spark, d, "nation").select(F.col("n_nationkey").alias("seq"), F.encode("n_name", "UTF-8").alias("payload"))
    return changes.fan_out(requests, lambda x: x[::-1]).select("seq", F.decode("result", "UTF-8").alias("result"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS worker, round(s_acctbal * 0.5 + s_nationkey * 2, 6) AS score FROM supplier WHERE s_nationkey >= 5")
def task_ranked_workers(spark, d):
    workers = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("worker"), F.col("s_acctbal").alias("cpu"), F.col("s_nationkey").alias("ram"), F.col("s_nationkey").alias("seen"))
    return changes.ranked_workers(workers, F.lit(25), 20, {"cpu": 0.5, "ram": 2.0}).select("worker", F.round("score", 6).alias("score"))
