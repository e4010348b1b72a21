import pytest
from pyspark.sql import functions as F

from tessera.operators import dml, recursive
from tessera.operators import relational as R
from tessera.plans import dialect


def rows(df):
    return [tuple(r) for r in df.collect()]


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_window_goldens(spark):
    t = table(spark, [(10,), (20,), (20,), (30,)], "v int")
    w = R.window(order=["v"])
    got = rows(t.select("v", F.row_number().over(w), F.rank().over(w), F.dense_rank().over(w), F.sum("v").over(w), F.sum("v").over(R.window(order=["v"], rows=(None, 0))), F.sum("v").over(R.window(order=["v"], rows=(-1, 1))), F.last_value("v").over(w)).orderBy("v"))
    assert [r[1] for r in got] == [1, 2, 3, 4] and [r[2] for r in got] == [1, 2, 2, 4] and [r[3] for r in got] == [1, 2, 2, 3]
    assert [r[4] for r in got] == [10, 50, 50, 80] and [r[5] for r in got] == [10, 30, 50, 80] and [r[6] for r in got] == [30, 50, 70, 50] and [r[7] for r in got] == [10, 20, 20, 30]
    emp = table(spark, [("a", 100), ("a", 200), ("b", 300)], "dept string, sal int")
    w = R.window(["dept"], ["sal"])
    assert rows(emp.where("dept = 'a'").select("sal", F.percent_rank().over(w), F.cume_dist().over(w)).orderBy("sal")) == [(100, 0.0, 0.5), (200, 1.0, 1.0)]
    five = table(spark, [(i,) for i in range(1, 6)], "v int")
    assert [r[1] for r in rows(five.select("v", F.ntile(2).over(R.window(order=["v"]))).orderBy("v"))] == [1, 1, 1, 2, 2]


def test_nulls_are_last_and_not_counted(spark):
    t = table(spark, [(1,), (None,), (2,)], "v int")
    assert [r[0] for r in rows(R.order_by(t, "v"))] == [1, 2, None] and [r[0] for r in rows(R.order_by(t, "v desc"))] == [None, 2, 1]
    assert rows(t.select(F.count("v").over(R.window())).distinct()) == [(2,)]


def test_recursion_goldens(spark):
    edges = table(spark, [(1, 2), (2, 3), (3, 1)], "src int, dst int")
    reach = recursive.recurse(spark.sql("SELECT 2 AS n"), lambda new: new.join(edges, new.n == edges.src).select("dst"))
    assert sorted(rows(reach)) == [(1,), (2,), (3,)]
    fib = dialect.query(spark, "WITH RECURSIVE f(a, b) AS (SELECT 0, 1 UNION ALL SELECT b, a + b FROM f WHERE b < 200) SELECT count(*) AS n, max(a) AS m FROM f WHERE a <= 144")
    assert fib.first().m == 144
    with pytest.raises(RuntimeError):
        recursive.recurse(spark.sql("SELECT 1 AS n"), lambda new: new.selectExpr("n + 1"), most_rounds=3)
    assert rows(recursive.recurse(spark.sql("SELECT 1 AS n"), lambda new: new.where("n < 4").selectExpr("n + 1"), distinct=False).agg(F.count("*"))) == [(4,)]


@pytest.mark.parametrize("term", ["SELECT 1 FROM r a JOIN r b ON true", "SELECT count(*) FROM r", "SELECT n FROM t LEFT JOIN r ON true", "SELECT n FROM r ORDER BY n", "SELECT n FROM t WHERE n IN (SELECT n FROM r)", "SELECT DISTINCT n FROM r", "SELECT n FROM r GROUP BY n"])
def test_recursive_terms_that_are_refused(term):
    with pytest.raises(ValueError):
        recursive.validate_recursive_term(term, "r")


def test_joins_and_sets_goldens(spark):
    org, usr = table(spark, [(1, "a"), (2, "b")], "id int, name string"), table(spark, [(1, 1, "Al"), (2, 2, "Bo"), (3, None, "Carol")], "uid int, org_id int, uname string")
    on = usr.org_id == org.id
    assert [usr.join(org, on, how).count() for how in ("inner", "left", "right")] == [2, 3, 2] and usr.crossJoin(org).count() == 6
    n = table(spark, [(1,), (1,), (2,), (3,), (3,)], "n int")
    assert n.distinct().count() == 3 and n.union(n).count() == 10
    some = table(spark, [(1,), (None,)], "n int")
    assert rows(R.intersect_all_members(n, some)) == [(1,), (1,)] and sorted(rows(R.except_all_members(n, some))) == [(2,), (3,), (3,)]
    assert rows(R.not_in(n, "n", some)) == [] and R.not_in(n, "n", some.where("n is null").limit(0)).count() == 5
    got = dict(rows(R.in_subquery(n.distinct(), "n", some, "x")))
    assert got == {1: True, 2: None, 3: None}


def test_grouping_goldens(spark):
    sales = table(spark, [("e", 10), ("e", 20), ("w", 5), ("w", 5), ("w", 5)], "region string, amount int")
    got = {r[0]: r[1:] for r in rows(sales.groupBy("region").agg(F.count("*"), F.sum("amount"), R.exact_avg(F.col("amount"))))}
    assert got["e"][:2] == (2, 30) and got["e"][2] == 15 and got["w"][:2] == (3, 15)
    assert rows(sales.groupBy().agg(R.ordered_text(F.col("region"), "-", F.col("amount"), F.col("region")), R.ordered_list(F.col("amount"), -F.col("amount")))) == [("w-w-w-e-e", [20, 10, 5, 5, 5])]


def test_upserts(spark):
    t = table(spark, [(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    new = table(spark, [(2, "B"), (3, "c"), (None, "m")], "id int, v string")
    key = lambda r: str(r)
    changed = dml.upsert(t, new, ["id"], {"v": F.col("excluded.v")}, F.col("t.v") != "z")
    assert sorted(rows(changed.table), key=key) == sorted([(1, "a"), (2, "B"), (3, "c"), (None, "n"), (None, "m")], key=key)
    assert sorted(rows(changed.returning), key=key) == sorted([(2, "B"), (3, "c"), (None, "m")], key=key)
    with pytest.raises(ValueError):
        dml.upsert(t, new.union(new), ["id"], {"v": F.col("excluded.v")})
    assert dml.upsert(t, new.union(new), ["id"]).table.count() == 3 + 1 + 2


def test_foreign_keys_policies_triggers(spark):
    parent, child = table(spark, [(1,), (2,)], "id int"), table(spark, [(10, 1), (11, 2), (12, None), (13, 9)], "cid int, pid int")
    assert rows(dml.orphans(child, ["pid"], parent, ["id"])) == [(13, 9)]
    with pytest.raises(ValueError):
        dml.delete_with_children(parent, F.col("id") == 1, child, ["pid"], ["id"])
    assert sorted(dml.delete_with_children(parent, F.col("id") == 1, child, ["pid"], ["id"], "set default", {"pid": F.lit(7)})[1].select("pid").collect(), key=str)[1:] != []
    docs = table(spark, [(1, "al", 5), (2, "bo", 6), (3, None, 7)], "id int, owner string, val int")
    mine = dml.Policy(F.col("owner") == "al")
    assert rows(dml.secured(docs, [mine]).select("id")) == [(1,)] and dml.secured(docs, []).count() == 0 and dml.secured(docs, [], bypass=True).count() == 3
    with pytest.raises(PermissionError):
        dml.check_rows(docs, [mine])
    double = dml.Trigger("before", ("insert",), lambda df: df.withColumn("val", F.col("val") * 2), F.col("val") > 5)
    assert sorted(r[2] for r in rows(dml.fire([double], "before", "insert", docs))) == [5, 12, 14]


def test_dialect_rules():
    assert "NULLS LAST" in dialect.rewrite("SELECT a FROM t ORDER BY a") and "DESC NULLS FIRST" in dialect.rewrite("SELECT a FROM t ORDER BY a DESC LIMIT 3")
    assert dialect.rewrite("SELECT a FROM t ORDER BY a NULLS FIRST").count("NULLS") == 1
    assert "concat_ws('', a, b)" in dialect.rewrite("SELECT concat(a, b) FROM t")
    assert "concat(a" not in dialect.rewrite("SELECT concat(a, concat(b, c)) FROM t").replace("concat_ws", "")
    assert dialect.integer_division("SELECT a / 2, b / 2, 'a / 2'", {"a"}) == "SELECT a div 2, b / 2, 'a / 2'"
    assert "dayofweek(ts) - 1" in dialect.rewrite("SELECT extract(dow FROM ts) FROM t")
