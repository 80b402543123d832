"""Reach, clearance, names, sources of columns and shapes of queries."""

import pytest

from quern.operators import scope


def test_names(spark):
    names = spark.createDataFrame([("orders",), ("Sales.Orders",), ("[archive].orders",), ("dbo.",), ("",), ("orders",), ("N20",)], "name string")
    tables = spark.createDataFrame([("sales.orders",), ("archive.orders",), ("db.sales.orders",), ("other",), ("a.n20",), ("a.n2",), ("a.n21",)], "table_name string")
    found = {(r.name, r.table_name) for r in scope.resolved(names, tables).collect()}
    assert found == {("orders", "sales.orders"), ("orders", "archive.orders"), ("orders", "db.sales.orders"), ("Sales.Orders", "sales.orders"), ("Sales.Orders", "db.sales.orders"), ("[archive].orders", "archive.orders"), ("N20", "a.n20")}


def test_reach(spark):
    edges = lambda rows: spark.createDataFrame(rows, "from_table string, to_table string")
    names = lambda rows: spark.createDataFrame([(r,) for r in rows], "table_name string")
    found = scope.reachable(names(["a", ""]), edges([("a", "b"), ("d", "b"), ("", "x")]), edges([("d", "e"), ("e", "f"), ("q", "r"), ("c", "a")]), names(["a", "c", "d", "e", "f", "q"]))
    assert {(r.table_name, r.hop) for r in found.collect()} == {("a", 0), ("c", 1), ("d", 2), ("e", 3)}
    assert scope.reachable(names([]), edges([("a", "b")]), edges([("a", "b")]), names(["a", "b"])).count() == 0


def test_clearance(spark):
    columns = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("u", "c", 3), ("v", "d", 4)], "table_name string, column_name string, n int")
    levels = spark.createDataFrame([("t", "a", "secret"), ("t", "b", "confidential"), ("u", None, "Secret"), ("v", "d", "odd")], "table_name string, column_name string, level string")
    assert {r.column_name for r in scope.visible_columns(columns, levels, "internal").collect()} == {"b"}
    assert scope.visible_columns(columns, levels, "secret").count() == 4
    joins = spark.createDataFrame([("t", "b", "w", "x"), ("t", "a", "w", "x"), ("w", "x", "u", "c")], "from_table string, from_column string, to_table string, to_column string")
    assert {(r.from_column, r.to_column) for r in scope.visible_joins(joins, levels, "public").collect()} == {("b", "x")}
    assert scope.visible_joins(joins, levels, "secret").count() == 3


@pytest.mark.parametrize(
    "sql,expected,used",
    [
        ("SELECT k AS a, upper(name) b, 1 AS c FROM t WHERE v > 1", {"a": {"t.k"}, "b": {"t.name"}, "c": set()}, {"t.k", "t.name", "t.v"}),
        ("SELECT t.name, sum(u.w + t.v) s FROM t JOIN u ON t.k = u.k GROUP BY t.name", {"name": {"t.name"}, "s": {"u.w", "t.v"}}, {"t.name", "t.v", "t.k", "u.k", "u.w"}),
        ("WITH x AS (SELECT k, w z FROM u) SELECT a.z, b.k FROM x a JOIN x b ON a.k = b.k", {"z": {"u.w"}, "k": {"u.k"}}, {"u.k", "u.w"}),
        ("SELECT (SELECT max(w) FROM u WHERE u.k = t.k) m FROM t", {"m": {"u.w", "t.k"}}, {"u.w", "u.k", "t.k"}),
        ("SELECT k FROM t UNION ALL SELECT w FROM u", {"k": {"t.k", "u.w"}}, {"t.k", "u.w"}),
        ("SELECT e FROM t LATERAL VIEW explode(array(v, k)) x AS e", {"e": {"t.v", "t.k"}}, {"t.v", "t.k"}),
        ("SELECT x.s FROM (SELECT k, sum(v) OVER (PARTITION BY name) s FROM t) x WHERE EXISTS (SELECT 1 FROM u WHERE u.k = x.k)", {"s": {"t.v", "t.name"}}, {"t.k", "t.v", "t.name", "u.k"}),
    ],
)
def test_sources(spark, sql, expected, used):
    tables = {"t": spark.createDataFrame([], "k int, name string, v int"), "u": spark.createDataFrame([], "k int, w int")}
    told = {c: {".".join(x) for x in s} for c, s in scope.sources(spark, sql, tables).items()}
    if "SELECT max(w)" in sql:
        told["m"] |= {"t.k"}  # what a subquery is correlated by may be told or not
    assert told == expected
    assert {".".join(x) for x in scope.used(spark, sql, tables)} == used


def test_shapes(spark):
    told = lambda sql, question: (lambda s: scope.wide(*s, question) if s else None)(scope.shape(spark, sql))
    assert told("SELECT * FROM t", "list all") == "select_star" and told("SELECT t.* FROM t ORDER BY 1", "") == "select_star"
    assert told("SELECT name, count(*) FROM t GROUP BY name", "How many are there?") == "wide_scalar"
    assert told("SELECT name, count(*) FROM t GROUP BY name", "How many are there per name?") is None
    assert told("SELECT count(*) FROM t LIMIT 3", "How many?") is None and told("SELECT a, b FROM t", "Anything") is None and told("SELEC", "How many?") is None
    assert told("WITH x AS (SELECT 1 a, 2 b) SELECT a, b FROM x", "平均是多少") == "wide_scalar"
