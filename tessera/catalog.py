"""Every registered query of the relational library, with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.relational import order_by
from tessera.queries import functions as _functions
from tessera.queries import languages as _languages
from tessera.queries import relational as _relational
from tessera.queries import surface as _surface
from tessera.queries.registry import ORACLE_SQL, QUERIES, query, t

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("""
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_discount > 0.02 GROUP BY n_name HAVING count(*) > 10 ORDER BY revenue DESC, n_name LIMIT 10""")
def flagship_revenue_by_nation(spark, d):
    """Scan, filter, four-way join, grouping, HAVING and a top-k."""
    sales = t(spark, d, "lineitem").where("l_discount > 0.02").join(t(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    sales = sales.join(t(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(t(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    out = sales.groupBy("n_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.count("*").alias("n_lines"))
    return order_by(out.where("n_lines > 10"), "revenue desc", "n_name").limit(10)


_AREAS = (_functions, _languages, _relational, _surface)  # importing them registers their queries
