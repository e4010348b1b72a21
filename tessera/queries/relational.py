"""Scans, predicates, joins, aggregation, windows, ordering, set operations and recursion over the test tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.functions import core
from tessera.operators import ddl, dml, recursive
from tessera.operators import relational as R
from tessera.queries.registry import query, sql_query, t
from tessera.sources import stores


# Scans and predicates. S1 S2 S8 P1-P25


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_projected(spark, d):
    return stores.scan(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def scan_point(spark, d):
    return stores.point(spark, f"{d}/orders.parquet", "o_custkey", 7).select("o_orderkey", "o_totalprice")


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL)) v(column1, column2)")
def scan_values(spark, d):
    return stores.values(spark, [(1, "a"), (2,)])


@query("SELECT 1 AS one, 'x' AS x")
def scan_no_from(spark, d):
    return stores.single_row(spark, one=F.lit(1), x=F.lit("x"))


sql_query("filter_conjunction", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", spark="SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= timestamp_ntz'1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
sql_query("pred_three_valued", "SELECT n_nationkey, (nullif(n_regionkey, 0) > 2) IS TRUE AS yes, (nullif(n_regionkey, 0) > 2) IS NOT FALSE AS maybe, nullif(n_regionkey, 0) IS NULL AS unknown FROM nation")
sql_query("pred_distinct_from", "SELECT n_nationkey, nullif(n_regionkey, 1) IS DISTINCT FROM nullif(n_regionkey, 2) AS differs FROM nation")
sql_query("pred_case", "SELECT o_orderstatus, sum(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) AS n_large, sum(CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 0 END) AS n_urgent FROM orders GROUP BY o_orderstatus", oracle="SELECT o_orderstatus, CAST(sum(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) AS BIGINT) AS n_large, CAST(sum(CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS n_urgent FROM orders GROUP BY o_orderstatus")


@query("SELECT n_nationkey, nullif(n_regionkey, 2) BETWEEN 1 AND nullif(n_nationkey, 5) AS inside FROM nation WHERE n_regionkey <> 2 AND n_nationkey <> 5 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_regionkey = 2 OR n_nationkey = 5")
def pred_between_nulls(spark, d):
    low = F.nullif(F.col("n_regionkey"), F.lit(2))
    return t(spark, d, "nation").select("n_nationkey", core.between(low, F.lit(1), F.nullif(F.col("n_nationkey"), F.lit(5))).alias("inside"))


@query("SELECT n_nationkey, n_regionkey IN (1, 3, NULL) AS hit FROM nation")
def pred_in_list_null(spark, d):
    return t(spark, d, "nation").select("n_nationkey", core.in_values(F.col("n_regionkey"), [1, 3, None]).alias("hit"))


@query("SELECT n_nationkey, n_regionkey IN (SELECT nullif(r_regionkey, 0) FROM region WHERE r_regionkey < 3) AS hit FROM nation")
def pred_in_subquery_projected(spark, d):
    values = t(spark, d, "region").where("r_regionkey < 3").select(F.nullif(F.col("r_regionkey"), F.lit(0)).alias("v"))
    return R.in_subquery(t(spark, d, "nation"), "n_regionkey", values, "hit").select("n_nationkey", "hit")


@query("SELECT n_nationkey, n_regionkey IN (1, 2) AS any_eq, n_regionkey > 0 AND n_regionkey > 1 AS all_gt FROM nation")
def pred_any_all(spark, d):
    one, two = F.array(F.lit(1), F.lit(2)), F.array(F.lit(0), F.lit(1))
    return t(spark, d, "nation").select("n_nationkey", core.any_of(F.col("n_regionkey"), "=", one).alias("any_eq"), core.all_of(F.col("n_regionkey"), ">", two).alias("all_gt"))


@query(r"SELECT p_partkey, p_name LIKE '%a_e%' AS plain, p_name ILIKE '%A%' AS folded, 'a\b' LIKE 'a\b' AS backslash FROM part")
def pred_like(spark, d):
    name = F.col("p_name")
    return t(spark, d, "part").select("p_partkey", core.like(name, "%a_e%").alias("plain"), core.like(name, "%A%", ignore_case=True).alias("folded"), core.like(F.lit("a\\b"), "a\\b").alias("backslash"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def pred_distinct(spark, d):
    return t(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT unnest([1, 2, 3]) AS a, unnest(['x', 'y']) AS b")
def project_unnest_together(spark, d):
    ints, texts = F.array(*map(F.lit, (1, 2, 3))), F.array(F.lit("x"), F.lit("y"))
    return spark.range(1).select(ints.alias("i"), texts.alias("s")).select(core.unnest_together(F.col("i"), F.col("s"))).toDF("a", "b")


sql_query("pred_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql_query("pred_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql_query("pred_scalar_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql_query("pred_concat_operator", "SELECT c_custkey, c_name || '/' || c_mktsegment AS tag, c_name || NULL AS nothing FROM customer", spark="SELECT c_custkey, c_name || '/' || c_mktsegment AS tag, CAST(c_name || NULL AS STRING) AS nothing FROM customer", oracle="SELECT c_custkey, c_name || '/' || c_mktsegment AS tag, CAST(NULL AS VARCHAR) AS nothing FROM customer")

# Joins. J1-J12

sql_query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
sql_query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000")
sql_query("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F'")
sql_query("join_full", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey * 20")
sql_query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql_query("join_using", "SELECT k, a.n_name AS a_name, b.r_name AS b_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
sql_query("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("join_multi", "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
sql_query("join_theta", "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey = b.s_nationkey")


@query("SELECT a.n_name, b.r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
def join_natural(spark, d):
    return R.natural_join(t(spark, d, "nation").selectExpr("n_regionkey AS k", "n_name"), t(spark, d, "region").selectExpr("r_regionkey AS k", "r_name")).select("n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_semi(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.expr("o_custkey = c_custkey"), "left_semi").select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2)")
def join_anti_not_in(spark, d):
    return R.not_in(t(spark, d, "nation"), "n_regionkey", t(spark, d, "region").where("r_regionkey < 2").select("r_regionkey")).select("n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 1) FROM region WHERE r_regionkey < 2)")
def join_anti_not_in_null(spark, d):
    values = t(spark, d, "region").where("r_regionkey < 2").select(F.nullif(F.col("r_regionkey"), F.lit(1)).alias("v"))
    return R.not_in(t(spark, d, "nation"), "n_regionkey", values).select("n_nationkey")


@query("SELECT o_orderkey, CAST(lo AS DOUBLE) AS band FROM orders JOIN (SELECT i * 50000.0 AS lo, i * 50000.0 + 49999.99 AS hi FROM range(0, 12) r(i)) b ON o_totalprice BETWEEN CAST(lo AS DOUBLE) AND CAST(hi AS DOUBLE)")
def join_range(spark, d):
    bands = spark.range(12).selectExpr("id * 50000D AS lo", "id * 50000D + 49999.99D AS hi")
    return R.range_join(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "lo", "hi", 50000).selectExpr("o_orderkey", "lo AS band")


# Aggregates. A1-A15

sql_query("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql_query("agg_global_empty", "SELECT count(*) AS n, sum(o_custkey) AS s, min(o_orderdate) AS m FROM orders WHERE o_orderkey < 0", oracle="SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, min(o_orderdate) AS m FROM orders WHERE o_orderkey < 0")
sql_query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND sum(o_totalprice) > 1000000")
sql_query("agg_count_kinds", "SELECT count(*) AS n, count(nullif(c_mktsegment, 'BUILDING')) AS n_not_null, count(DISTINCT c_mktsegment) AS n_distinct FROM customer")
sql_query("agg_distinct_many", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus")
sql_query("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS large FROM orders GROUP BY o_orderpriority")
sql_query("agg_bool", "SELECT c_nationkey, bool_and(c_acctbal > 0) AS every_positive, bool_or(c_acctbal > 9900) AS any_rich, every(c_custkey > 0) AS all_keys FROM customer GROUP BY c_nationkey", oracle="SELECT c_nationkey, bool_and(c_acctbal > 0) AS every_positive, bool_or(c_acctbal > 9900) AS any_rich, bool_and(c_custkey > 0) AS all_keys FROM customer GROUP BY c_nationkey")
sql_query("agg_expressions", "SELECT n_regionkey * 10 AS k, count(*) + max(n_nationkey) AS v FROM nation GROUP BY n_regionkey ORDER BY count(*), 1")


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_string_agg(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(R.ordered_text(F.col("n_name"), "|", F.col("n_name")).alias("names"))


@query("SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) FILTER (WHERE n_nationkey <> 3) AS keys FROM nation GROUP BY n_regionkey")
def agg_array_agg(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(R.ordered_list(F.nullif(F.col("n_nationkey"), F.lit(3)), F.col("n_nationkey")).alias("keys"))


@query("SELECT o_orderstatus, CAST(round(avg(o_custkey), 6) AS DOUBLE) AS a FROM orders GROUP BY o_orderstatus")
def agg_exact_avg(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(R.exact_avg(F.col("o_custkey")), 6).cast("double").alias("a"))


# Windows. W1-W18

sql_query(
    "win_ranking",
    "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, round(percent_rank() OVER p, 9) AS pr, round(cume_dist() OVER p, 9) AS cd, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderstatus)",
    spark="SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER p AS BIGINT) AS rk, CAST(dense_rank() OVER p AS BIGINT) AS dr, round(percent_rank() OVER p, 9) AS pr, round(cume_dist() OVER p, 9) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderstatus)",
)
sql_query("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, -1.0) OVER w AS after2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", spark="SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, -1.0D) OVER w AS after2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql_query("win_values", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql_query("win_rows_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders")
sql_query("win_default_frame", "SELECT n_nationkey, count(*) OVER (ORDER BY n_regionkey) AS peers, sum(n_nationkey) OVER (PARTITION BY n_regionkey) AS whole FROM nation", oracle="SELECT n_nationkey, count(*) OVER (ORDER BY n_regionkey) AS peers, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey) AS BIGINT) AS whole FROM nation")
sql_query("win_over_group", "SELECT c_nationkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, c_nationkey) AS place FROM customer GROUP BY c_nationkey", spark="SELECT c_nationkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC, c_nationkey) AS BIGINT) AS place FROM customer GROUP BY c_nationkey")


@query("SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n_f FROM orders")
def win_filter(spark, d):
    return t(spark, d, "orders").select("o_orderkey", R.filtered(F.count, F.lit(1), F.col("o_orderstatus") == "F").over(R.window(["o_custkey"])).alias("n_f"))


@query("SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation")
def win_named_refined(spark, d):
    w = R.named_windows(base={"partition": ["n_regionkey"]}, ordered={"base": "base", "order": ["n_name"]})
    return t(spark, d, "nation").select("n_nationkey", F.row_number().over(w["ordered"]).cast("long").alias("rn"), F.count("*").over(w["base"]).alias("n"))


@query("SELECT n_nationkey, rank() OVER (PARTITION BY n_regionkey) AS r FROM nation")
def win_no_order(spark, d):
    return t(spark, d, "nation").select("n_nationkey", F.rank().over(R.window(["n_regionkey"])).cast("long").alias("r"))


# Order and limits. O1-O6


@query("SELECT n_nationkey, row_number() OVER (ORDER BY nullif(n_regionkey, 2) ASC NULLS LAST, n_nationkey) AS up, row_number() OVER (ORDER BY nullif(n_regionkey, 2) DESC NULLS FIRST, n_nationkey) AS down FROM nation")
def sort_nulls(spark, d):
    df = t(spark, d, "nation").withColumn("k", F.nullif(F.col("n_regionkey"), F.lit(2)))
    return df.select("n_nationkey", F.row_number().over(R.window(order=["k", "n_nationkey"])).cast("long").alias("up"), F.row_number().over(R.window(order=["k desc", "n_nationkey"])).cast("long").alias("down"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def topk_offset(spark, d):
    return R.limit_offset(R.order_by(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice desc", "o_orderkey"), 20, 5)


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def topk_of_each(spark, d):
    return R.top_of_each(t(spark, d, "orders"), ["o_custkey"], 3, "o_totalprice desc", "o_orderkey").selectExpr("o_custkey", "o_orderkey", "CAST(rank AS BIGINT) AS rank")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) ORDER BY l_orderkey, l_linenumber LIMIT 11")
def page_keyset(spark, d):
    return R.page(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 10, [100, 2])


# Set operations and recursion. U1-U11

sql_query("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql_query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("set_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
sql_query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
sql_query("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql_query("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql_query("set_nested", "(SELECT n_regionkey AS k FROM nation EXCEPT SELECT 2) UNION (SELECT r_regionkey FROM region WHERE r_regionkey = 2)")
sql_query("cte_plain", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (SELECT max(s) AS m FROM big) SELECT o_custkey FROM big, top WHERE s > 0.9 * m")
sql_query("rec_union_all", "WITH RECURSIVE f(n, a, b) AS (SELECT 1, 0, 1 UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 20) SELECT n, a FROM f")


@query("SELECT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def set_intersect_all_members(spark, d):
    return R.intersect_all_members(t(spark, d, "customer").selectExpr("c_nationkey AS k"), t(spark, d, "supplier").selectExpr("s_nationkey AS k"))


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_except_all_members(spark, d):
    return R.except_all_members(t(spark, d, "customer").selectExpr("c_custkey AS k"), t(spark, d, "orders").selectExpr("o_custkey AS k"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), r(n) AS (SELECT 3 UNION SELECT b FROM r JOIN e ON a = n) SELECT CAST(n AS BIGINT) AS n FROM r")
def rec_reachable(spark, d):
    edges = t(spark, d, "lineitem").selectExpr("l_partkey AS a", "l_suppkey AS b").distinct()
    return recursive.recurse(spark.sql("SELECT 3L AS n"), lambda new: new.join(edges, new.n == edges.a).select("b"))


@query("WITH RECURSIVE up(k) AS (SELECT 24 UNION SELECT (k * 7 + 3) % 25 FROM up) SELECT k FROM up")
def rec_cycle_sql(spark, d):
    return recursive.recurse_sql(spark, "up", "SELECT 24 AS k", "SELECT (k * 7 + 3) % 25 FROM up")


# Writes, constraints and policies. M1-M9


@query("SELECT * FROM nation UNION ALL SELECT 100, 'NEW', NULL")
def dml_insert(spark, d):
    return dml.insert(t(spark, d, "nation"), spark.sql("SELECT 100 AS n_nationkey, 'NEW' AS n_name")).table


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_update(spark, d):
    return dml.update(t(spark, d, "nation"), F.col("n_regionkey") == 1, {"n_name": F.lower("n_name")}).table


@query("SELECT * FROM nation WHERE n_regionkey = 1")
def dml_delete_returning(spark, d):
    return dml.delete(t(spark, d, "nation"), F.col("n_regionkey") == 1).returning


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'x' || n_nationkey ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 50, 'x50', 9")
def dml_upsert(spark, d):
    new = spark.sql("SELECT * FROM VALUES (0, 'x0', 9), (1, 'x1', 9), (2, 'x2', 9), (50, 'x50', 9) AS v(n_nationkey, n_name, n_regionkey)")
    return dml.upsert(t(spark, d, "nation"), new, ["n_nationkey"], {"n_name": F.col("excluded.n_name")}).table


@query("SELECT * FROM nation UNION ALL SELECT 50, 'x50', 9")
def dml_upsert_nothing(spark, d):
    new = spark.sql("SELECT * FROM VALUES (0, 'x0', 9), (50, 'x50', 9) AS v(n_nationkey, n_name, n_regionkey)")
    return dml.upsert(t(spark, d, "nation"), new, ["n_nationkey"]).table


@query("SELECT * FROM nation WHERE false")
def dml_truncate(spark, d):
    return dml.truncate(t(spark, d, "nation")).table


@query("SELECT n_name FROM nation WHERE n_regionkey > 2 AND length(n_name) > 6")
def constraint_check(spark, d):
    return dml.violates_check(t(spark, d, "nation"), (F.col("n_regionkey") <= 2) | (F.length("n_name") <= 6)).select("n_name")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def constraint_unique(spark, d):
    return dml.violates_unique(t(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 3)")
def fk_orphans(spark, d):
    return dml.orphans(t(spark, d, "customer"), ["c_nationkey"], t(spark, d, "nation").where("n_regionkey <> 3"), ["n_nationkey"]).select("c_custkey")


@query("SELECT c_custkey, CASE WHEN n_regionkey <> 3 THEN c_nationkey END AS c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def fk_set_null(spark, d):
    nation, customer = t(spark, d, "nation"), t(spark, d, "customer")
    return dml.delete_with_children(nation, F.col("n_regionkey") == 3, customer, ["c_nationkey"], ["n_nationkey"], "set null")[1].select("c_custkey", "c_nationkey")


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3")
def fk_cascade(spark, d):
    nation, customer = t(spark, d, "nation"), t(spark, d, "customer")
    return dml.delete_with_children(nation, F.col("n_regionkey") == 3, customer, ["c_nationkey"], ["n_nationkey"], "cascade")[1].select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE (c_nationkey = 3 OR c_mktsegment = 'BUILDING') AND c_acctbal > 0")
def rls_policies(spark, d):
    rules = [dml.Policy(F.col("c_nationkey") == 3), dml.Policy(F.col("c_mktsegment") == "BUILDING"), dml.Policy(F.col("c_acctbal") > 0, permissive=False)]
    return dml.secured(t(spark, d, "customer"), rules).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE false")
def rls_default_deny(spark, d):
    return dml.secured(t(spark, d, "customer"), []).select("c_custkey")


@query("SELECT c_custkey AS id, CAST(sign(c_acctbal) * floor(abs(c_acctbal) + 0.5) AS BIGINT) AS c_acctbal, 'new' AS note FROM customer")
def ddl_alter_table(spark, d):
    df = ddl.drop_column(t(spark, d, "customer").drop("c_name", "c_nationkey"), "c_mktsegment")
    return ddl.add_column(ddl.alter_type(ddl.rename_column(df, "c_custkey", "id"), "c_acctbal", "bigint"), "note", "text", F.lit("new"))


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def ddl_view(spark, d):
    ddl.create_view(t(spark, d, "nation").where("n_regionkey = 1"), "tessera_view")
    return spark.sql("SELECT n_name FROM tessera_view")
