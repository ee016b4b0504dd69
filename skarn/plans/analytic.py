"""Aggregates, grouping sets and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.offsets import shifted
from .spec import Query

NUM = "(VALUES ('x', 1, 10.5), ('x', 2, NULL), ('y', NULL, 3.25), ('y', 4, 4.75), (NULL, 5, 1.0)) AS t(g, i, d)"

AGGREGATES = [
    Query("a0_flagship", "SELECT l_returnflag, l_linestatus, CAST(SUM(l_quantity) AS BIGINT) AS sum_qty, ROUND(AVG(l_quantity), 6) AS avg_qty, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"),
    Query("a1_group_by", "SELECT c_mktsegment AS seg, c_nationkey % 5 AS m, COUNT(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey % 5"),
    Query("a1_group_expression", "SELECT CASE WHEN p_size < 20 THEN 'small' ELSE 'large' END AS size_class, COUNT(*) AS n FROM part GROUP BY CASE WHEN p_size < 20 THEN 'small' ELSE 'large' END"),
    Query("a2_count_star", "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F'"),
    Query("a3_count", f"SELECT g, COUNT(i) AS ci, COUNT(d) AS cd, COUNT(*) AS c FROM {NUM} GROUP BY g"),
    Query("a4_sum", "SELECT o_orderpriority AS p, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderpriority"),
    Query("a4_sum_null", "SELECT SUM(x) IS NULL AS none FROM (VALUES (CAST(NULL AS INTEGER)), (NULL)) AS t(x)"),
    Query("a4_sum_decimal", "SELECT l_returnflag AS f, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS s FROM lineitem GROUP BY l_returnflag"),
    Query("a5_avg", "SELECT p_brand, ROUND(AVG(p_size), 8) AS a, ROUND(AVERAGE(p_size), 8) AS b FROM part GROUP BY p_brand", "SELECT p_brand, ROUND(AVG(p_size), 8) AS a, ROUND(AVG(p_size), 8) AS b FROM part GROUP BY p_brand"),
    Query("a6_min_max", "SELECT c_nationkey AS k, MIN(c_name) AS lo, MAX(c_name) AS hi, MIN(c_acctbal) AS a, MAX(c_acctbal) AS b FROM customer GROUP BY c_nationkey"),
    Query("a6_min_max_time", "SELECT o_orderstatus AS s, MIN(o_orderdate) AS first_day, MAX(o_orderdate) AS last_day FROM orders GROUP BY o_orderstatus"),
    Query("a7_string_agg", "SELECT n_regionkey AS k, STRING_AGG(n_name, '; ') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS k, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey"),
    Query("a7_string_agg_null", "SELECT STRING_AGG(x, ',') WITHIN GROUP (ORDER BY x) AS s FROM (VALUES ('b'), (NULL), ('a')) AS t(x)", "SELECT 'a,b' AS s"),
    Query("a8_empty_global", "SELECT COUNT(*) AS n, SUM(o_custkey) IS NULL AS s, MAX(o_orderkey) IS NULL AS m FROM orders WHERE o_orderkey < 0"),
    Query("a9_grouping_sets", "SELECT o_orderstatus AS s, o_orderpriority AS p, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"),
    Query("a10_rollup", "SELECT r_name, n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"),
    Query("a10_partial_rollup", "SELECT o_orderstatus AS s, o_orderpriority AS p, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, ROLLUP (o_orderpriority)"),
    Query("a11_cube", "SELECT l_returnflag AS f, l_linestatus AS s, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    Query("a11_cube_repeated", "SELECT l_returnflag AS f, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_returnflag)", "SELECT l_returnflag AS f, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag)"),
    Query("a12_grouping", "SELECT l_returnflag AS f, l_linestatus AS s, GROUPING(l_returnflag) AS gf, GROUPING(l_returnflag, l_linestatus) AS g, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
          "SELECT l_returnflag AS f, l_linestatus AS s, CAST(GROUPING(l_returnflag) AS INTEGER) AS gf, CAST(GROUPING(l_returnflag, l_linestatus) AS INTEGER) AS g, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    Query("a13_having", "SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND NOT MAX(o_totalprice) < 1000 AND MIN(o_orderkey) IS NOT NULL AND COUNT(*) BETWEEN 11 AND 40"),
    Query("a13_having_subquery", "SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > (SELECT COUNT(*) / 30 FROM customer) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"),
    Query("a13_having_grouping", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag) HAVING GROUPING(l_returnflag) = 1", "SELECT CAST(NULL AS VARCHAR) AS l_returnflag, COUNT(*) AS n FROM lineitem"),
    Query("a14_order_aggregate", "SELECT c_mktsegment AS s, COUNT(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY COUNT(*) DESC, c_mktsegment LIMIT 3"),
    Query("a15_implicit_group", "SELECT COUNT(*) AS n FROM nation HAVING COUNT(*) > 5"),
    Query("a16_distinct", "SELECT o_orderstatus AS s, COUNT(DISTINCT o_custkey) AS n, CAST(SUM(DISTINCT o_custkey % 7) AS BIGINT) AS t FROM orders GROUP BY o_orderstatus"),
    Query("a17_nested", "SELECT p_brand, ROUND(SUM(p_size) / COUNT(*) + 1, 8) AS x FROM part GROUP BY p_brand", "SELECT p_brand, ROUND(CAST(SUM(p_size) AS DOUBLE) / COUNT(*) + 1, 8) AS x FROM part GROUP BY p_brand"),
    Query("a18_statistics", "SELECT c_mktsegment AS s, ROUND(STDDEV_SAMP(c_nationkey), 8) AS sd, MEDIAN(c_nationkey) AS m, COUNT(*) FILTER (WHERE c_acctbal < 0) AS neg FROM customer GROUP BY c_mktsegment"),
    Query("a19_arithmetic", "SELECT p_partkey, p_size / 4 AS q, p_size % 7 AS r, p_size / (p_size - 10) AS z, p_size % (p_size - 10) AS y, p_size + 2 * 3 - 1 AS s FROM part",
          "SELECT p_partkey, p_size / 4 AS q, p_size % 7 AS r, p_size / nullif(p_size - 10, 0) AS z, p_size % nullif(p_size - 10, 0) AS y, p_size + 2 * 3 - 1 AS s FROM part"),
]

O = "o_custkey, o_orderkey"
WINDOWS = [
    Query("w1_row_number", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
          "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rn FROM orders"),
    Query("w1_row_number_bare", "SELECT MAX(rn) AS m, COUNT(DISTINCT rn) AS n FROM (SELECT ROW_NUMBER() OVER () AS rn FROM customer) AS t", "SELECT CAST(count(*) AS INTEGER) AS m, count(*) AS n FROM customer"),
    Query("w2_rank", "SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part",
          "SELECT p_partkey, CAST(RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS r FROM part"),
    Query("w3_dense_rank", "SELECT p_partkey, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part",
          "SELECT p_partkey, CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS r FROM part"),
    Query("w4_percent_rank", "SELECT p_partkey, ROUND(PERCENT_RANK() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS r FROM part"),
    Query("w5_cume_dist", "SELECT p_partkey, ROUND(CUME_DIST() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS r FROM part"),
    Query("w6_ntile", "SELECT c_custkey, NTILE(7) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS b FROM customer",
          "SELECT c_custkey, CAST(NTILE(7) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INTEGER) AS b FROM customer"),
    Query("w6_ntile_bare", "SELECT b, COUNT(*) AS n FROM (SELECT NTILE(4) OVER () AS b FROM nation) AS t GROUP BY b", "SELECT * FROM (VALUES (1, CAST(7 AS BIGINT)), (2, 6), (3, 6), (4, 6)) AS t(b, n)"),
    Query("w7_count", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, COUNT(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS c FROM orders"),
    Query("w8_sum", "SELECT l_orderkey, l_linenumber, CAST(SUM(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS s FROM lineitem"),
    Query("w9_avg", "SELECT l_orderkey, l_linenumber, ROUND(AVG(l_quantity) OVER (PARTITION BY l_orderkey), 8) AS a FROM lineitem"),
    Query("w10_min", "SELECT o_orderkey, MIN(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM orders"),
    Query("w11_max", "SELECT o_orderkey, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM orders"),
    Query("w12_lag", f"SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, {O}) AS a, LAG(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, {O}) AS b FROM orders",
          f"SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, {O}) AS a, LAG(o_orderkey, 2, CAST(-1 AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, {O}) AS b FROM orders"),
    Query("w12_lag_by_row", build=lambda e: shifted(e.table("orders").select("o_custkey", "o_orderkey"), F.col("o_orderkey"), F.col("o_orderkey") % 3 + 1, ["o_custkey"], [F.col("o_orderkey")], "prev", F.lit(-1)),
          oracle="WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) SELECT a.o_custkey, a.o_orderkey, coalesce(b.o_orderkey, -1) AS prev FROM r a LEFT JOIN r b ON a.o_custkey = b.o_custkey AND b.rn = a.rn - (a.o_orderkey % 3 + 1)"),
    Query("w13_lead", f"SELECT o_orderkey, LEAD(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY {O}) AS a FROM orders"),
    Query("w14_first_value", f"SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, {O}) AS f FROM orders"),
    Query("w15_last_value", f"SELECT o_orderkey, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY {O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders"),
    Query("w16_nth_value", f"SELECT o_orderkey, NTH_VALUE(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY {O}) AS l FROM orders"),
    Query("w17_partition_nulls", "SELECT g, i, COUNT(*) OVER (PARTITION BY g) AS n FROM (VALUES (NULL, 1), (NULL, 2), ('a', 3)) AS t(g, i)"),
    Query("w18_window_nulls", "SELECT i, ROW_NUMBER() OVER (ORDER BY i) AS up, ROW_NUMBER() OVER (ORDER BY i DESC) AS down FROM (VALUES (2), (NULL), (1)) AS t(i)", "SELECT i, CAST(row_number() OVER (ORDER BY i ASC NULLS LAST) AS INTEGER) AS up, CAST(row_number() OVER (ORDER BY i DESC NULLS FIRST) AS INTEGER) AS down FROM (VALUES (2), (NULL), (1)) AS t(i)"),
    Query("w19_rows", f"SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY {O} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY {O} ROWS 2 PRECEDING) AS c FROM orders"),
    Query("w20_range", "SELECT p_partkey, CAST(SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS c FROM part"),
    Query("w20_range_offset", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c FROM part"),
    Query("w21_default_frame", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS peers, COUNT(*) OVER (PARTITION BY p_brand) AS every FROM part"),
    Query("w23_named", f"SELECT o_orderkey, RANK() OVER w AS r, LAST_VALUE(o_orderkey) IGNORE NULLS OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY {O})", f"SELECT o_orderkey, CAST(RANK() OVER w AS INTEGER) AS r, LAST_VALUE(o_orderkey IGNORE NULLS) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY {O})"),
    Query("w24_order_of_work", "SELECT DISTINCT n_regionkey, COUNT(*) OVER (PARTITION BY n_regionkey) AS n FROM nation WHERE n_nationkey > 3 ORDER BY n_regionkey LIMIT 3"),
    Query("w27_only_in_order", "SELECT n_name FROM nation ORDER BY RANK() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC), n_regionkey DESC LIMIT 7",
          "SELECT n_name FROM (SELECT n_name, n_regionkey, rank() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) AS r FROM nation) ORDER BY r, n_regionkey DESC LIMIT 7"),
    Query("w25_over_groups", "SELECT n_regionkey AS k, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC, n_regionkey) AS r FROM nation GROUP BY n_regionkey",
          "SELECT n_regionkey AS k, COUNT(*) AS n, CAST(RANK() OVER (ORDER BY COUNT(*) DESC, n_regionkey) AS INTEGER) AS r FROM nation GROUP BY n_regionkey"),
    Query("w26_nested", "SELECT p_partkey, CASE WHEN RANK() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1 THEN 'first' ELSE 'later' END AS c, 100 * COUNT(*) OVER (PARTITION BY p_brand) + 1 AS x FROM part"),
]

QUERIES = [*AGGREGATES, *WINDOWS]
