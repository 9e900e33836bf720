"""Relational operators over the star tables; each text runs in both engines unless two are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, ORACLES = {}, {}


def _both(name: str, text: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    QUERIES[f"rel_{name}"], ORACLES[f"rel_{name}"] = run, oracle or text


_both("filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND (l_returnflag = 'R' OR l_linestatus = 'O') AND l_discount IN (0.01, 0.05) AND l_shipdate IS NOT NULL AND NOT l_tax > 0.06")
_both("like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' AND p_brand NOT LIKE 'Brand#1_'")
_both("is_true", "SELECT c_custkey, (c_acctbal > 5000) IS TRUE AS rich, (c_acctbal > 5000) IS NOT FALSE AS maybe FROM customer")
_both("join_inner", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 300000")
_both("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey")
_both("join_right", "SELECT s.s_suppkey, n.n_name FROM nation n RIGHT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND n.n_regionkey = 1")
_both("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 1) b ON a.k = b.k")
_both("join_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
_both("join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
_both("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
_both("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
_both("join_self", "SELECT a.l_orderkey, a.l_linenumber AS l1, b.l_linenumber AS l2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_quantity = b.l_quantity")
_both("cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n WHERE n.n_nationkey < 5")
_both("group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(DISTINCT l_suppkey) AS sup FROM lineitem GROUP BY l_returnflag, l_linestatus")
_both("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
_both("global", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS c, min(o_orderdate) AS d FROM orders")
_both("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_both("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_both("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_both("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
_both("window", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3 FROM orders")
_both("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_both("offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 10")
_both("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_both("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_both("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20")
_both("cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big JOIN top ON n = m")
_both("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
_both("correlated", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(p2.p_retailprice) + 50 FROM part p2 WHERE p2.p_brand = p.p_brand)")
_both("case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS kind, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS seg FROM customer")
_both("cast", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, CAST(l_orderkey AS VARCHAR(20)) AS k, CAST(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem WHERE l_orderkey < 500", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INT) AS q, CAST(l_orderkey AS VARCHAR) AS k, CAST(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem WHERE l_orderkey < 500")
_both("dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS t FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ'1997-01-01 00:00:00'", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, date_trunc('month', o_orderdate)::TIMESTAMP AS t FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")
_both("strings", "SELECT c_custkey, upper(substring(c_name, 1, 4)) AS u, length(c_mktsegment) AS n, replace(c_name, '#', '-') AS r, concat(c_mktsegment, '/', c_nationkey) AS j FROM customer")
_both("json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
_both("approx", "SELECT l_returnflag, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.2 * count(DISTINCT l_partkey) AS close FROM lineitem GROUP BY l_returnflag", "SELECT DISTINCT l_returnflag, true AS close FROM lineitem")
