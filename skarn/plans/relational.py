"""Scans, projections, predicates, joins, sorting, set operations and common tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .spec import Query

T3 = "(VALUES (1, 10), (2, NULL), (NULL, 30), (4, 40)) AS t(a, b)"
CREW = "(VALUES (1, 'Ada', 10), (2, 'Bo', 10), (3, 'Cy', 20), (4, 'Dee', 30), (5, 'Eli', 30), (6, 'Fay', NULL)) AS e(id, name, dept)"
DECKS = "(VALUES (10, 'Bridge'), (20, 'Galley'), (30, 'Engine'), (40, 'Hold')) AS d(id, deck)"


SCANS = [
    Query("s1_scan", "SELECT * FROM nation"),
    Query("s2_resolve", "SELECT R_NAME AS r_name FROM PUBLIC.REGION", "SELECT r_name FROM region"),
    Query("s3_discovery", "SELECT TABLE_NAME AS table_name FROM INFORMATION_SCHEMA.TABLES",
          "SELECT unnest(['region','nation','customer','supplier','part','orders','lineitem','events','documents','embeddings','pages','benchmark','labels','conversations']) AS table_name"),
    Query("s4_in_memory", "WITH m AS (SELECT n_name, n_regionkey FROM nation WHERE n_nationkey < 10) SELECT a.n_name AS x, b.n_name AS y FROM m a JOIN m b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name"),
    Query("s5_values_statement", "VALUES (1, 'a', 2.5), (2, NULL, 3.5)", "SELECT * FROM (VALUES (1, 'a', 2.5), (2, NULL, 3.5)) AS t(column1, column2, column3)"),
    Query("s5_values_from", "SELECT v.id, v.label, n.n_name FROM (VALUES (1, 'one'), (2, 'two')) AS v(id, label) JOIN nation n ON n.n_nationkey = v.id"),
    Query("s5_values_unnamed", "SELECT column1, column2 FROM (VALUES (1, 'x'), (2, 'y')) AS v", "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) AS t(column1, column2)"),
    Query("s6_unnest", "SELECT e.vec_id, u.x FROM embeddings e CROSS JOIN UNNEST(e.embedding) AS u(x)", "SELECT vec_id, unnest(embedding) AS x FROM embeddings"),
    Query("s6_unnest_left", "SELECT p.id, u.tag FROM (SELECT 1 AS id, ARRAY['a', 'b'] AS tags UNION ALL SELECT 2, CAST(NULL AS ARRAY<STRING>)) AS p LEFT JOIN UNNEST(p.tags) AS u(tag) ON TRUE",
          "SELECT * FROM (VALUES (1, 'a'), (1, 'b'), (2, NULL)) AS t(id, tag)"),
    Query("s7_ordinality", "SELECT e.vec_id, u.x, u.pos FROM embeddings e CROSS JOIN UNNEST(e.embedding) WITH ORDINALITY AS u(x, pos)",
          "SELECT vec_id, unnest(embedding) AS x, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS pos FROM embeddings"),
    Query("s8_unnest_literal", "SELECT x, x * x AS sq FROM UNNEST(ARRAY[3, 1, 2]) AS u(x)", "SELECT x, x * x AS sq FROM (VALUES (3), (1), (2)) AS u(x)"),
    Query("s9_table_unnest", "SELECT v.model, g.gear, g.pos FROM (SELECT 'Coupe' AS model, ARRAY[3, 4, 5] AS gears UNION ALL SELECT 'Truck', ARRAY[3, 4]) AS v CROSS JOIN TABLE(UNNEST(v.gears) WITH ORDINALITY) AS g(gear, pos)",
          "SELECT * FROM (VALUES ('Coupe', 3, 1), ('Coupe', 4, 2), ('Coupe', 5, 3), ('Truck', 3, 1), ('Truck', 4, 2)) AS t(model, gear, pos)"),
    Query("s10_lateral", "SELECT n.n_name, t.c_name, t.c_acctbal FROM nation n CROSS JOIN LATERAL (SELECT c_name, c_acctbal FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) AS t"),
    Query("s10_lateral_left", "SELECT c.c_custkey, t.n_orders FROM customer c LEFT JOIN LATERAL (SELECT COUNT(*) AS n_orders FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AS t ON TRUE"),
    Query("s11_derived", "SELECT d.seg, d.n FROM (SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY c_mktsegment) AS d(seg, n) WHERE d.n > 10"),
    Query("s12_sample_system", "SELECT COUNT(*) AS n FROM lineitem TABLESAMPLE SYSTEM (50 PERCENT) REPEATABLE (7)", "SELECT CAST(count(*) / 2 AS BIGINT) AS n FROM lineitem"),
    Query("s13_sample_bernoulli", "SELECT l_orderkey, l_linenumber FROM lineitem TABLESAMPLE BERNOULLI (10) REPEATABLE (7)", None),
    Query("s13_bernoulli_share", "SELECT (SELECT COUNT(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem TABLESAMPLE BERNOULLI (10) REPEATABLE (7) EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem TABLESAMPLE BERNOULLI (10) REPEATABLE (7)) AS t) AS differing, (SELECT COUNT(*) FROM lineitem TABLESAMPLE BERNOULLI (10) REPEATABLE (7)) BETWEEN (SELECT COUNT(*) FROM lineitem) * 0.08 AND (SELECT COUNT(*) FROM lineitem) * 0.12 AS near",
          "SELECT CAST(0 AS BIGINT) AS differing, TRUE AS near"),
    Query("s14_sample_rows", "SELECT COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS d FROM orders TABLESAMPLE (100 ROWS) REPEATABLE (7)", "SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS d"),
    Query("s15_repeatable", "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders TABLESAMPLE (50 ROWS) REPEATABLE (3) EXCEPT SELECT o_orderkey FROM orders TABLESAMPLE (50 ROWS) REPEATABLE (3)) AS t", "SELECT CAST(0 AS BIGINT) AS n"),
    Query("s16_info_tables", "SELECT TABLE_SCHEMA AS s, TABLE_TYPE AS t, COUNT(*) AS n FROM INFORMATION_SCHEMA.TABLES GROUP BY TABLE_SCHEMA, TABLE_TYPE", "SELECT 'PUBLIC' AS s, 'BASE TABLE' AS t, CAST(14 AS BIGINT) AS n"),
    Query("s17_info_columns", "SELECT COLUMN_NAME AS c, ORDINAL_POSITION AS p, DATA_TYPE AS t FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME = 'orders'",
          "SELECT * FROM (VALUES ('o_orderkey', 1, 'BIGINT'), ('o_custkey', 2, 'BIGINT'), ('o_orderstatus', 3, 'VARCHAR'), ('o_totalprice', 4, 'DOUBLE'), ('o_orderdate', 5, 'TIMESTAMP'), ('o_orderpriority', 6, 'VARCHAR')) AS t(c, p, t)"),
    Query("s19_metadata", build=lambda e: e.schemas().select(F.col("TABLE_SCHEM").alias("s")), oracle="SELECT unnest(['PUBLIC', 'INFORMATION_SCHEMA']) AS s"),
    Query("s20_no_from", "SELECT 1 + 1 AS two, 'x' AS x"),
]

PROJECTIONS = [
    Query("p1_star_join", "SELECT * FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey",
          "SELECT a.n_nationkey AS a__n_nationkey, a.n_name AS a__n_name, a.n_regionkey AS a__n_regionkey, b.n_nationkey AS b__n_nationkey, b.n_name AS b__n_name, b.n_regionkey AS b__n_regionkey FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey"),
    Query("p2_qualified_star", "SELECT r.*, n.n_name, n.n_nationkey + 100 AS k FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey"),
    Query("p3_label", "SELECT p_size + 1, p_partkey FROM part", 'SELECT p_size + 1 AS "p_size + 1", p_partkey FROM part'),
    Query("p4_quoted", 'SELECT "c_name" AS "Customer Name", c_custkey AS "select" FROM customer WHERE "c_custkey" < 50'),
    Query("p5_comments", "SELECT /* all -- of it */ r_name -- the name\nFROM region /* '--' */ WHERE r_name <> '--x'"),
    Query("p6_where", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02 AND l_returnflag = 'R'"),
    Query("p7_comparisons", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 150000 AND o_orderstatus <> 'F' AND o_custkey != 7 AND o_orderdate <= TIMESTAMP '1996-12-31 00:00:00' AND o_orderkey > 3 AND o_orderpriority = '1-URGENT'"),
    Query("p8_boolean", "SELECT p_partkey FROM part WHERE NOT (p_size < 10 OR p_size > 40) AND ((p_brand = 'Brand#11' OR p_retailprice > 1000) AND NOT p_size = 25)"),
    Query("p9_is_null", f"SELECT a, b, b IS NULL AS bn, a IS NOT NULL AS an FROM {T3} WHERE a IS NULL OR b IS NULL"),
    Query("p10_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 OR p_retailprice NOT BETWEEN 901 AND 2000"),
    Query("p11_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)"),
    Query("p11_in_null", f"SELECT a FROM {T3} WHERE a IN (1, NULL)"),
    Query("p12_like", "SELECT n_name FROM nation WHERE n_name LIKE 'NATION_1_' OR n_name LIKE '%\\_2' OR n_name NOT LIKE 'NATION%'", "SELECT n_name FROM nation WHERE n_name LIKE 'NATION_1_' OR n_name LIKE '%\\_2' OR n_name NOT LIKE 'NATION%'"),
    Query("p12_like_escape", "SELECT n_name FROM nation WHERE n_name LIKE 'NATION#_1%' ESCAPE '#'"),
    Query("p13_ilike", "SELECT r_name FROM region WHERE r_name ILIKE 'a%' OR r_name ILIKE '%EAST'"),
    Query("p14_similar", "SELECT r_name FROM region WHERE r_name SIMILAR TO '(AS|EU)%' OR r_name SIMILAR TO 'A[FM]_+ICA'", "SELECT r_name FROM region WHERE regexp_full_match(r_name, '(AS|EU).*') OR regexp_full_match(r_name, 'A[FM].+ICA')"),
    Query("p14_not_similar", "SELECT r_name FROM region WHERE r_name NOT SIMILAR TO '%A'", "SELECT r_name FROM region WHERE NOT regexp_full_match(r_name, '.*A')"),
    Query("p14_similar_column", "SELECT r.r_name, p.pat FROM region r JOIN (VALUES ('(AS|EU)%', 1), ('A_IA', 2), ('%A', 3), ('[B-M]%', 4), ('50!%', 5)) AS p(pat, k) ON r.r_name SIMILAR TO p.pat ESCAPE '!'",
          "SELECT r.r_name, p.pat FROM region r JOIN (VALUES ('(AS|EU)%', '(AS|EU).*'), ('A_IA', 'A.IA'), ('%A', '.*A'), ('[B-M]%', '[B-M].*'), ('50!%', '50%')) AS p(pat, re) ON regexp_full_match(r.r_name, p.re)"),
    Query("p14_similar_end", "SELECT t.x FROM (VALUES ('ASIA'), ('ASIA\n'), ('EASIA')) AS t(x) WHERE t.x SIMILAR TO 'ASIA'", "SELECT 'ASIA' AS x"),
    Query("p15_regexp_like", "SELECT r_name FROM region WHERE REGEXP_LIKE(r_name, '^a.*a$', 'i')", "SELECT r_name FROM region WHERE regexp_matches(r_name, '^a.*a$', 'i')"),
    Query("p16_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)"),
    Query("p16_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)"),
    Query("p17_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    Query("p17_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    Query("p17_not_in_nulls", f"SELECT a FROM {T3} WHERE a NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey > 2) OR a NOT IN (SELECT b FROM {T3.replace('AS t(', 'AS u(')})", "SELECT * FROM (VALUES (1), (2)) AS t(a)"),
    Query("p18_any", "SELECT s_suppkey FROM supplier WHERE s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)"),
    Query("p18_all", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT s_acctbal FROM supplier)"),
    Query("p18_some_equal", "SELECT n_name FROM nation WHERE n_regionkey = SOME (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')"),
    Query("p18_all_correlated", "SELECT n_name FROM nation n WHERE n.n_nationkey >= ALL (SELECT m.n_nationkey FROM nation m WHERE m.n_regionkey = n.n_regionkey)", "SELECT n_name FROM nation n WHERE n.n_nationkey = (SELECT max(m.n_nationkey) FROM nation m WHERE m.n_regionkey = n.n_regionkey)"),
    Query("p18_reversed", "SELECT r_name FROM region WHERE ALL (SELECT n_nationkey FROM nation WHERE n_nationkey > 2) > r_regionkey", "SELECT r_name FROM region WHERE r_regionkey < 3"),
    Query("p18_empty", "SELECT r_name FROM region WHERE r_regionkey > ALL (SELECT n_nationkey FROM nation WHERE n_nationkey < 0) AND NOT r_regionkey > ANY (SELECT n_nationkey FROM nation WHERE n_nationkey < 0)", "SELECT r_name FROM region"),
    Query("p19_scalar_subquery", "SELECT c.c_custkey, (SELECT MAX(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c WHERE c.c_acctbal > (SELECT AVG(c_acctbal) FROM customer)"),
    Query("p19_alias_in_subquery", "SELECT n_regionkey AS grp, (SELECT COUNT(*) FROM nation m WHERE m.n_regionkey = grp) AS members FROM nation mc ORDER BY grp, n_name", "SELECT n_regionkey AS grp, count(*) OVER (PARTITION BY n_regionkey) AS members FROM nation"),
    Query("p18_equal_all", "SELECT r_name FROM region WHERE r_regionkey = ALL (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') OR r_regionkey <> ANY (SELECT 1)", "SELECT r_name FROM region WHERE r_regionkey = (SELECT max(r_regionkey) FROM region WHERE r_name = 'ASIA') OR r_regionkey <> 1"),
    Query("p20_case", "SELECT p_partkey, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS simple, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS searched FROM part"),
    Query("p21_distinct", "SELECT DISTINCT p_brand, p_size % 3 AS m FROM part"),
    Query("p22_qualifier", "SELECT l.l_orderkey FROM lineitem l WHERE l.l_linenumber = 7"),
    Query("p23_boolean_column", "SELECT t.id FROM (VALUES (1, TRUE), (2, FALSE), (3, NULL)) AS t(id, ok) WHERE t.ok"),
    Query("p24_select_all", "SELECT ALL r_name FROM region"),
    Query("p25_names", "SELECT n_name, r.r_name FROM nation JOIN region r ON n_regionkey = r_regionkey WHERE n_nationkey < 5"),
    Query("q1_nulls", f"SELECT a FROM {T3} WHERE NOT (b = 10) OR b < 5"),
    Query("q21_quoted_case", 'SELECT "n_name" AS "N" FROM nation WHERE N_NATIONKEY < 3'),
    Query("q_1_positional", "SELECT c_custkey FROM customer WHERE c_nationkey = ? AND c_acctbal > ?", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 500.5", params=[3, 500.5]),
    Query("q_2_named", "SELECT o_orderkey, ':x' AS lit FROM orders WHERE o_orderstatus = :st AND o_totalprice > :p AND o_custkey <> :p", "SELECT o_orderkey, ':x' AS lit FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000 AND o_custkey <> 200000", params={"st": "O", "p": 200000}),
    Query("q_3_typed", "SELECT CAST(:d AS DATE) AS d, :t AS t, :n IS NULL AS n", "SELECT DATE '2024-02-29' AS d, 'it''s \\ ok' AS t, TRUE AS n", params={"d": "2024-02-29", "t": "it's \\ ok", "n": None}),
    Query("q_4_batch", build=lambda e: [a.union(b) for a, b in [e.batch("SELECT n_name FROM nation WHERE n_nationkey = ?", [[1], [2]])]][0], oracle="SELECT n_name FROM nation WHERE n_nationkey IN (1, 2)"),
    Query("q_5_pushdown", build=lambda e: e.spark.createDataFrame([(str("GreaterThan(l_quantity,49.0)" in p["pushed_filters"]), p["read_schema"]) for p in e.pushdown("SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")], "pushed string, columns string"),
          oracle="SELECT 'True' AS pushed, 'struct<l_orderkey:bigint,l_quantity:double>' AS columns"),
]

JOINS = [
    Query("j1_inner", "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 250000"),
    Query("j1_theta", "SELECT a.n_name AS x, b.r_name AS y FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey AND a.n_regionkey <> b.r_regionkey"),
    Query("j2_comma", "SELECT s.s_name, n.n_name, r.r_name FROM supplier s, nation n, region r WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name = 'EUROPE'"),
    Query("j3_left", f"SELECT e.name, d.deck FROM {CREW} LEFT JOIN {DECKS} ON e.dept = d.id"),
    Query("j4_right", f"SELECT e.name, d.deck FROM {CREW} RIGHT OUTER JOIN {DECKS} ON e.dept = d.id"),
    Query("j5_full", f"SELECT e.name, d.deck FROM {CREW} FULL OUTER JOIN {DECKS} ON e.dept = d.id"),
    Query("j6_cross", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b"),
    Query("j7_self", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"),
    Query("j8_using", "SELECT k, a.x, b.y FROM (VALUES (1, 'a'), (2, 'b'), (NULL, 'n')) AS a(k, x) JOIN (VALUES (2, 'p'), (3, 'q'), (NULL, 'm')) AS b(k, y) USING (k)"),
    Query("j8_using_full", "SELECT k, a.x, b.y FROM (VALUES (1, 'a'), (2, 'b')) AS a(k, x) FULL JOIN (VALUES (2, 'p'), (3, 'q')) AS b(k, y) USING (k)"),
    Query("j9_multiway", "SELECT r.r_name, COUNT(*) AS n, CAST(SUM(l.l_quantity) AS BIGINT) AS q FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"),
    Query("j10_lateral_source", "SELECT r.r_name, t.n_name FROM region r, LATERAL (SELECT n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey > 20) AS t"),
    Query("j11_semi_anti", "SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity = 50) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity = 1)"),
    Query("j12_natural", "SELECT k, x, y FROM (VALUES (1, 'a'), (2, 'b')) AS a(k, x) NATURAL JOIN (VALUES (2, 'p')) AS b(k, y)"),
    Query("j14_qualified", "SELECT a.n_name AS n1, nation.n_name AS n2 FROM nation a JOIN nation ON a.n_nationkey = nation.n_regionkey"),
]

SORTS = [
    Query("o1_order", "SELECT c_custkey, c_acctbal * 2 AS dbl FROM customer ORDER BY c_nationkey DESC, dbl, c_custkey LIMIT 25"),
    Query("o2_null_order", f"SELECT b FROM {T3} ORDER BY b LIMIT 3", f"SELECT b FROM {T3} ORDER BY b ASC NULLS LAST LIMIT 3"),
    Query("o2_null_order_desc", f"SELECT b FROM {T3} ORDER BY b DESC LIMIT 2", f"SELECT b FROM {T3} ORDER BY b DESC NULLS FIRST LIMIT 2"),
    Query("o2_null_explicit", f"SELECT a FROM {T3} ORDER BY a NULLS FIRST LIMIT 2"),
    Query("o3_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    Query("o4_fetch", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 20 ROWS FETCH NEXT 7 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 20"),
    Query("o4_fetch_one", "SELECT o_orderkey FROM orders ORDER BY o_orderkey FETCH FIRST ROW ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1"),
    Query("o5_nested_limits", "SELECT k FROM (SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 3) AS t ORDER BY k DESC LIMIT 5"),
    Query("o6_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20"),
    Query("o7_ordinal", "SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2 LIMIT 6"),
]

A = "(SELECT * FROM (VALUES (1), (1), (2), (3), (NULL), (NULL)) AS a(x))"
B = "(SELECT * FROM (VALUES (1), (3), (3), (4), (NULL)) AS b(x))"
SETS = [
    Query("u1_union", f"SELECT x FROM {A} AS a UNION SELECT x FROM {B} AS b"),
    Query("u2_union_all", f"SELECT x FROM {A} AS a UNION ALL SELECT x FROM {B} AS b"),
    Query("u3_intersect", f"SELECT x FROM {A} AS a INTERSECT SELECT x FROM {B} AS b"),
    Query("u4_intersect_all", f"SELECT x FROM {A} AS a INTERSECT ALL SELECT x FROM {B} AS b"),
    Query("u5_except", f"SELECT x FROM {A} AS a EXCEPT SELECT x FROM {B} AS b"),
    Query("u6_except_all", f"SELECT x FROM {A} AS a EXCEPT ALL SELECT x FROM {B} AS b"),
    Query("u7_precedence", f"SELECT x FROM {A} AS a UNION ALL SELECT x FROM {B} AS b INTERSECT SELECT 3 AS x"),
    Query("u7_parentheses", f"(SELECT x FROM {A} AS a UNION ALL SELECT x FROM {B} AS b) EXCEPT (SELECT 3 AS x UNION SELECT 4)"),
    Query("u8_labels", "SELECT r_name AS label, r_regionkey AS k FROM region UNION SELECT n_name, n_nationkey FROM nation"),
    Query("u9_ordered", "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region ORDER BY x DESC LIMIT 4"),
    Query("u9_ordinal_fetch", "SELECT r_regionkey AS k FROM region UNION ALL SELECT n_nationkey FROM nation ORDER BY 1 DESC OFFSET 2 ROWS FETCH FIRST 3 ROWS ONLY", "SELECT r_regionkey AS k FROM region UNION ALL SELECT n_nationkey FROM nation ORDER BY 1 DESC LIMIT 3 OFFSET 2"),
    Query("u10_nulls_equal", "SELECT CAST(NULL AS INTEGER) AS x INTERSECT SELECT CAST(NULL AS INTEGER)"),
    Query("c1_with", "WITH big(k, t) AS (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) FROM orders GROUP BY o_custkey), rich AS (SELECT k FROM big WHERE t > 1000000) SELECT c.c_name, b.t FROM customer c JOIN big b ON b.k = c.c_custkey WHERE c.c_custkey IN (SELECT k FROM rich)"),
    Query("c2_recursive", "WITH n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 150) SELECT COUNT(*) AS c, MAX(i) AS m FROM n", "SELECT CAST(150 AS BIGINT) AS c, 150 AS m"),
    Query("c2_recursive_union", "WITH RECURSIVE g(a, b) AS (SELECT * FROM (VALUES (1, 2), (2, 3), (3, 1), (3, 4), (5, 6)) AS t(a, b)), r(n) AS (SELECT 1 UNION SELECT g.b FROM r JOIN g ON g.a = r.n) SELECT n FROM r", "SELECT * FROM (VALUES (1), (2), (3), (4)) AS t(n)"),
    Query("c2_recursive_terms", "WITH r(n) AS (SELECT 1 UNION SELECT n + 2 FROM r WHERE n < 6 UNION SELECT n * 3 FROM r WHERE n < 6) SELECT n FROM r", "SELECT * FROM (VALUES (1), (3), (5), (7), (9), (15)) AS t(n)"),
]

QUERIES = [*SCANS, *PROJECTIONS, *JOINS, *SORTS, *SETS]
