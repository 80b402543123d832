"""What the gate for users' SQL refuses, and that workspaces do not see each other."""

import pytest

from quern.plans import guard


@pytest.fixture()
def space(spark):
    spark.range(3).createOrReplaceTempView("secret")
    made = guard.Workspace(spark)
    made.register("orders", spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, name string, v int"))
    yield made
    spark.catalog.dropTempView("secret")


REFUSED = {
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret": "unknown_table",
    "SELECT b.* FROM (WITH secret AS (SELECT 1 x) SELECT * FROM secret) a, secret b": "unknown_table",
    "WITH a AS (WITH secret AS (SELECT 1 x) SELECT * FROM secret) SELECT * FROM a, secret": "unknown_table",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a": "unknown_table",
    "SELECT * FROM orders WHERE k IN (SELECT id FROM secret)": "unknown_table",
    "SELECT (SELECT max(id) FROM secret) FROM orders": "unknown_table",
    "SELECT * FROM orders, LATERAL (SELECT * FROM secret)": "unknown_table",
    "SELECT * FROM orders WHERE EXISTS (WITH x AS (SELECT * FROM secret) SELECT * FROM x)": "unknown_table",
    "SELECT * FROM global_temp.secret": "unknown_table",
    "SELECT * FROM parquet.`/etc`": "unknown_table",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM orders": "unknown_function",
    "SELECT k FROM orders ORDER BY reflect('java.lang.System', 'exit', 1)": "unknown_function",
    "SELECT transform(array(1), x -> try_reflect('a', 'b')) FROM orders": "unknown_function",
    "SELECT input_file_name() FROM orders": "unknown_function",
    "SELECT sum(k) OVER (PARTITION BY own_function(k)) FROM orders": "unknown_function",
    "SELECT * FROM range(10)": "table_function",
    "SELECT * FROM IDENTIFIER('sec' || 'ret')": "computed_name",
    "SELECT TRANSFORM(k) USING 'cat' FROM orders": "not_read_only",
    "WITH a AS (SELECT 1) INSERT INTO orders SELECT * FROM a": "not_read_only",
    "DROP VIEW secret": "not_read_only",
    "SELECT 1; SELECT 2": "multiple_statements",
    "SELECT * FROM (": "not_parsed",
}


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, space, sql):
    spark.udf.register("own_function", lambda x: x)
    with pytest.raises(guard.Refused) as refused:
        space.query(sql)
    assert refused.value.code == REFUSED[sql]


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("WITH o AS (SELECT * FROM orders) SELECT k FROM o ORDER BY k", [1, 2]),
        ("WITH orders AS (SELECT 9 k) SELECT k FROM orders", [9]),
        ("WITH o AS (SELECT 7 k), p AS (SELECT * FROM o) SELECT k FROM p WHERE k > (SELECT max(k) FROM Orders)", [7]),
        ("WITH RECURSIVE r AS (SELECT 1 n UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT n FROM r ORDER BY n", [1, 2, 3, 4]),
        ("SELECT count(DISTINCT upper(name)) FROM orders o WHERE EXISTS (SELECT 1 FROM orders p WHERE p.k = o.k)", [2]),
    ],
)
def test_allowed(space, sql, expected):
    assert [r[0] for r in space.query(sql).collect()] == expected


def test_two_workspaces_with_other_policies(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    one, two = guard.Workspace(spark), guard.Workspace(spark)
    one.register("t", rows, masks={"name": "null"})
    two.register("t", rows, filters=["k = 2"])
    first = one.query("SELECT * FROM t ORDER BY k")
    assert [tuple(r) for r in two.query("SELECT * FROM t").collect()] == [(2, "b")]
    assert [tuple(r) for r in first.collect()] == [(1, None), (2, None)]
    assert not {t.name for t in spark.catalog.listTables()} & {"t"}
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("quern_")]
