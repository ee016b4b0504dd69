from __future__ import annotations

import datetime as dt

import pytest

from skarn.api import Engine
from skarn.operators.sampling import fixed_sample, system_sample
from skarn.sources.shell import Shell
from skarn.streaming.events import session_counts, tumbling_counts


@pytest.fixture(scope="module")
def harbour(spark, tmp_path_factory):
    """Small tables with a nested column, nulls and a second schema."""
    root = tmp_path_factory.mktemp("harbour")
    save = lambda rows, schema, path: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(root / path))
    save([(1, "Ada", "Quist"), (2, "Bo", "Ström"), (3, "Cy", "Vale"), (4, "Dee", "Moor"), (5, "Eli", "Nash")], "id int, first_name string, last_name string", "employees.parquet")
    save([(1, "Bridge"), (2, "Galley"), (3, "Engine")], "id int, department string", "departments.parquet")
    save([(1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 3, 4), (5, 3, 5)], "id int, department int, employee int", "employee_department.parquet")
    save([(1, "Lamp", ["brass", "old"], [(5, "Ina"), (4, "Joss")]), (2, "Rope", ["hemp"], [(3, "Kit")]), (3, "Sail", [], [])],
         "id int, name string, tags array<string>, reviews array<struct<rating int, user string>>", "products.parquet")
    save([("Coracle", 6), ("Dinghy", 4)], "model string, cyl int", "cars/mtcars.parquet")
    save([(9,)], "x int", "cars/deep/hidden.parquet")
    return str(root)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_schemas_and_case(spark, harbour):
    e = Engine(spark, harbour)
    assert rows(e.sql("SELECT model FROM Cars.MTCARS WHERE mtcars.cyl = 4")) == [("Dinghy",)]
    assert {(t.schema, t.name) for t in e.catalog.tables} == {("PUBLIC", n) for n in ("employees", "departments", "employee_department", "products")} | {("cars", "mtcars")}
    with pytest.raises(ValueError):
        e.sql("SELECT 1 FROM cars.nothing")
    with pytest.raises(Exception, match="NOTHING|nothing"):
        e.sql("SELECT nothing FROM employees")
    strict = Engine.from_url(spark, f"db:{harbour}?caseSensitive=true")
    with pytest.raises(Exception, match="(?i)employees"):
        strict.sql("SELECT id FROM EMPLOYEES")


def test_records_unnest_to_columns(spark, harbour):
    e = Engine(spark, harbour)
    q = "SELECT p.name, r.rating, r.user, r.pos FROM products p CROSS JOIN UNNEST(p.reviews) WITH ORDINALITY AS r(rating, user, pos) ORDER BY p.id, r.pos"
    assert rows(e.sql(q)) == [("Lamp", 5, "Ina", 1), ("Lamp", 4, "Joss", 2), ("Rope", 3, "Kit", 1)]
    left = "SELECT p.name, t.tag FROM products p LEFT JOIN UNNEST(p.tags) AS t(tag) ON TRUE ORDER BY p.id, t.tag"
    assert rows(e.sql(left)) == [("Lamp", "brass"), ("Lamp", "old"), ("Rope", "hemp"), ("Sail", None)]


def test_grouping_and_windows(spark, harbour):
    e = Engine(spark, harbour)
    q = """SELECT d.department, COUNT(*) AS n, GROUPING(d.department) AS g FROM employee_department ed JOIN departments d ON d.id = ed.department
           GROUP BY ROLLUP (d.department) ORDER BY GROUPING(d.department), d.department"""
    assert rows(e.sql(q)) == [("Bridge", 2, 0), ("Engine", 2, 0), ("Galley", 1, 0), (None, 5, 1)]
    w = "SELECT e.first_name, ROW_NUMBER() OVER (PARTITION BY ed.department ORDER BY e.id) AS rn FROM employees e JOIN employee_department ed ON ed.employee = e.id ORDER BY e.id"
    assert [r[1] for r in rows(e.sql(w))] == [1, 2, 1, 1, 2]


def test_correlated_and_quantified(spark, harbour):
    e = Engine(spark, harbour)
    q = "SELECT first_name FROM employees e WHERE e.id >= ALL (SELECT x.employee FROM employee_department x WHERE x.department = (SELECT y.department FROM employee_department y WHERE y.employee = 5)) ORDER BY e.id"
    assert rows(e.sql(q)) == [("Eli",)]


def test_labels_parameters_and_unique_names(spark, harbour):
    e = Engine(spark, harbour)
    assert e.sql("SELECT id + 1, COUNT(*) OVER () FROM employees").columns == ["id + 1", "COUNT(*) OVER ()"]
    assert e.sql("SELECT * FROM employees a JOIN departments b ON a.id = b.id").columns == ["a__id", "first_name", "last_name", "b__id", "department"]
    assert rows(e.sql("SELECT id FROM employees WHERE first_name = :n OR first_name = :n", {"n": "Ada"})) == [(1,)]
    with pytest.raises(ValueError):
        e.sql("SELECT :x AS x", {"x": float("nan")})


def test_invalid_casts_and_division(spark, harbour):
    e = Engine(spark, harbour)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        e.sql("SELECT CAST('x' AS INT) AS a").collect()
    assert rows(e.sql("SELECT 7 / 0 AS a, 7 % 0 AS b, 7 / 2 AS c")) == [(None, None, 3.5)]


def test_years_after_9999_have_no_sign_in_text(spark, harbour):
    e = Engine(spark, harbour)
    far = "(SELECT CAST(777600000001500 AS TIMESTAMP) AS t, CAST(777600000001500 AS DATE) AS d, '+7' AS s, -7 AS n)"
    q = f"SELECT CAST(t AS STRING) AS a, CAST(t + INTERVAL '1' DAY AS VARCHAR(11)) AS b, CAST(d AS TEXT) AS c, CONVERT(d, VARCHAR) AS e, CONCAT(s, d, n) AS f, CAST(s AS VARCHAR) AS g, CAST(n AS VARCHAR) AS h FROM {far}"
    assert rows(e.sql(q)) == [("26611-03-02 00:00:01.5", "26611-03-03", "26611-03-02", "26611-03-02", "+726611-03-02-7", "+7", "-7")]
    assert rows(e.sql(f"SELECT CAST(CAST(t AS STRING) AS TIMESTAMP) = t AS a, CAST(CAST(d AS STRING) AS DATE) = d AS b FROM {far}")) == [(True, True)]
    assert rows(e.sql("SELECT CAST(CAST(253402300799500 AS TIMESTAMP) AS STRING) AS a, CAST(CAST(253402300800500 AS TIMESTAMP) AS STRING) AS b")) == [("9999-12-31 23:59:59.5", "10000-01-01 00:00:00.5")]


def test_casts_to_text_of_parameters_subqueries_and_columns(spark, harbour):
    e = Engine(spark, harbour)
    assert rows(e.sql("SELECT CAST(? AS VARCHAR) AS a, CAST(? + 1 AS VARCHAR) AS b", ["+x", 4])) == [("+x", "5")]
    assert rows(e.sql("SELECT CAST((SELECT MAX(id) FROM departments) AS VARCHAR) AS a, CAST(SUM(id) OVER () AS VARCHAR) AS b FROM employees LIMIT 1")) == [("3", "15")]
    q = "SELECT DISTINCT CAST(e.id AS VARCHAR) FROM employees e UNION SELECT CONVERT(id, VARCHAR) FROM departments"
    assert rows(e.sql(f"SELECT id FROM ({q}) AS q WHERE id = '5'")) == [("5",)]
    plan = e.sql("SELECT CAST(id + 1 AS VARCHAR) AS a FROM employees")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "typeof" not in plan and "ltrim" not in plan


def test_plans_send_no_table_to_every_executor(spark):
    """Quantified comparisons are no nested loops, NOT IN is no broadcast of the subquery."""
    from skarn.plans import QUERIES

    from .compare import DATA

    plan = lambda q: QUERIES[q](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    spark_conf = ("p18_any", "p18_all", "p18_all_correlated", "p18_reversed", "p17_not_in_subquery")
    assert not [q for q in spark_conf if "NestedLoop" in plan(q) or "CartesianProduct" in plan(q)]
    assert "isNullAwareAntiJoin" not in plan("p17_not_in_subquery") and "LeftAnti" in plan("p17_not_in_subquery")


def test_arguments_are_evaluated_once(spark, harbour):
    e = Engine(spark, harbour)
    text = "first_name"
    for _ in range(8):
        text = f"CONCAT({text}, 'x')"
    assert len(e.explain_rewrite(f"SELECT {text} AS s FROM employees")) < 4000
    assert rows(e.sql(f"SELECT {text} AS s FROM employees WHERE id = 1")) == [("Ada" + "x" * 8,)]
    assert rows(e.sql("SELECT SOUNDEX(CONCAT(first_name, last_name)) AS s, DIFFERENCE(UPPER(first_name), LOWER(first_name)) AS d FROM employees WHERE id = 1")) == [("A323", 4)]
    q = "SELECT CONCAT(department, MAX(id)) AS s, TRUNC(SUM(id) / 2, 1) AS h FROM departments GROUP BY department ORDER BY CONCAT(department, MAX(id))"
    assert rows(e.sql(q))[0][0] == "Bridge1"
    assert rows(e.sql("SELECT JSON_OBJECT(UPPER('k') VALUE CONCAT('a', 'b'), 'n' VALUE NULL) AS j")) == [('{"K":"ab","n":null}',)]


def test_names_of_the_statement_only(spark, harbour):
    """Columns are looked up in the tables that a statement names, not in those that others did."""
    e = Engine(spark, harbour)
    e.sql("SELECT p.name, r.rating FROM products p CROSS JOIN UNNEST(p.reviews) AS r(rating, user)")
    assert rows(e.sql("SELECT t.k, u.x FROM (SELECT 1 AS k, ARRAY[5, 6] AS reviews) AS t CROSS JOIN UNNEST(t.reviews) AS u(x)")) == [(1, 5), (1, 6)]


def test_sampling(spark):
    df = spark.range(0, 320, 1, 5)
    for seed in range(4):
        assert system_sample(df, 50, seed).count() == 160
        ids = [r[0] for r in system_sample(df, 10, seed).collect()]
        assert ids == list(range(ids[0], 320, 10))
    assert system_sample(df, 0).count() == 0 and system_sample(df, 100).count() == 320
    assert fixed_sample(df, 17, 1).count() == 17 and fixed_sample(df, 900, 1).count() == 320
    assert system_sample(df.limit(0), 50, 1).count() == 0


def test_recursion_over_a_cycle(spark, harbour):
    e = Engine(spark, harbour)
    q = """WITH edges(a, b) AS (SELECT * FROM (VALUES (1, 2), (2, 3), (3, 1), (4, 5)) AS t(a, b)),
                reach(n) AS (SELECT 1 UNION SELECT edges.b FROM reach JOIN edges ON edges.a = reach.n) SELECT n FROM reach ORDER BY n"""
    assert rows(e.sql(q)) == [(1,), (2,), (3,)]


def test_shell(spark, harbour):
    s = Shell(lambda: spark)
    assert "error" in s.run("SELECT 1") and "unknown" in s.run("/what")
    assert s.run(f"/connect {harbour}").startswith("opened")
    assert "PUBLIC.employees" in s.run("/list") and s.run("/list cars") == "cars.mtcars"
    assert s.run("/describe cars.mtcars") == "model string\ncyl int"
    assert s.run("SELECT id FROM departments WHERE id < 2;") == "id\n--\n1"
    assert "2 schemas" in s.run("/info") and "/exit" in s.run("/help")
    s.run("/close")
    s.run("/exit")
    assert s.done


def test_streams_and_tables_agree(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    data = [(i, at + dt.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], 1.0) for i in range(60)]
    events = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for k, f in enumerate((tumbling_counts, session_counts)):
        out = f(stream).writeStream.format("memory").queryName(f"out{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).outputMode("complete" if k == 0 else "append").trigger(availableNow=True).start()
        out.awaitTermination(120)
        got, want = set(rows(spark.table(f"out{k}"))), set(rows(f(events)))
        assert got == want if k == 0 else got <= want
