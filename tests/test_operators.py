"""Golden cases of operators that the queries do not reach: refusals, odd rows, streams, files."""

import datetime

import pytest

from pyspark.sql import functions as F

from quern.functions import scalar
from quern.operators import discovery, documents, governance, graph, knowledge, monitor, retrieval, text
from quern.plans import guard, metrics
from quern.sources import tables
from quern.streaming import trend


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(1, None, 10.0, datetime.datetime(2024, 1, 1)), (2, "a", 0.0, datetime.datetime(2024, 2, 1)), (3, "a", 5.0, datetime.datetime(2024, 4, 1)), (4, "b", None, datetime.datetime(2024, 5, 9))]
    return spark.createDataFrame(rows, "id long, kind string, price double, at timestamp_ntz")


@pytest.fixture
def catalog(orders):
    price = lambda agg, **more: metrics.Simple("orders", agg, "price", time_column="at", **more)
    return metrics.Catalog(
        {"orders": lambda: orders},
        {
            "sum": price("sum"),
            "late": price("sum", filter="id > 2"),
            "share": metrics.Ratio("late", "sum"),
            "loop": metrics.Derived("other + 1"),
            "other": metrics.Derived("loop + 1"),
            "odd": metrics.Simple("orders", "mode", "price"),
            "timeless": metrics.Simple("orders", "count"),
        },
        {"orders": {"sort": "kind", "twice": "kind", "id": "price"}},
    )


def test_null_keys_meet_and_zero_gives_null(catalog):
    found = {r.sort: r.value for r in metrics.compile_metric(catalog, "share", ("sort",)).collect()}
    assert found == {None: None, "a": 1.0, "b": None}
    assert metrics.compile_metric(catalog, "share").first().value == pytest.approx(1 / 3)


@pytest.mark.parametrize(
    ("name", "by", "code", "more"),
    [
        ("loop", (), "metric_cycle", {}),
        ("none", (), "metric_unresolved", {}),
        ("odd", (), "metric_invalid", {}),
        ("sum", ("nothing",), "unknown_column", {}),
        ("sum", ("id",), "unknown_column", {}),  # a physical column and the logical name of another
        ("timeless", (), "time_filter_unavailable", {"time_from": "2024-01-01"}),
        ("sum", ("at@minute",), "time_filter_unsupported", {}),
    ],
)
def test_refusals(catalog, name, by, code, more):
    with pytest.raises(metrics.MetricError) as refused:
        metrics.compile_metric(catalog, name, by, **more)
    assert refused.value.code == code


def test_guard(spark, orders):
    space = guard.Workspace(spark, most_rows=3)
    space.register("orders", orders, {"kind": "hash"}, ["id <> 1"])
    assert space.query("select * from orders").count() == 3
    assert space.query("with x as (select id from orders) select count(*) as n from x; -- all").first().n == 3
    assert space.query("select id from orders where kind = 'a'").count() == 0
    for sql, code in (("drop table orders", "not_read_only"), ("select 1; select 2", "multiple_statements"), ("select * from secrets", "unknown_table"), ("select * from orders join t on true", "unknown_table")):
        with pytest.raises(guard.Refused) as refused:
            space.query(sql)
        assert refused.value.code == code
    assert guard.position(guard.cursor(7)) == 7
    for token in ("x", guard.cursor(-1), guard.cursor(10**9), "é"):
        with pytest.raises(guard.Refused):
            guard.position(token)


def test_ring_and_meeting_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("a", "b")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.levels(edges, start, 3).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r) for r in graph.closure(edges).collect()} == {(x, y) for x in "abc" for y in "abc"}
    assert {tuple(r) for r in graph.degrees(edges).collect()} == {("a", 2), ("b", 2), ("c", 3)}
    assert graph.levels(edges, start.limit(0), 2).count() == 0


def test_noise_and_chunks(spark):
    lines = spark.createDataFrame([(x,) for x in ["1", "1234", "iv", "XLII", "——", "----", "12345", "1.2", "v-1", "abc", "-----"]], "line string")
    assert [r[0] for r in lines.select(text.noise("line")).collect()] == [True] * 6 + [False] * 5
    docs = spark.createDataFrame([(1, "x" * 25), (2, ""), (3, None), (4, "y" * 10)], "doc_id long, text string")
    assert {(r.doc_id, r.chunk, len(r.content)) for r in text.chunks(docs, 10, 2).collect()} == {(1, 0, 10), (1, 1, 10), (1, 2, 9), (4, 0, 10)}


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in retrieval.above(rows, [2.0, 0.0], -2.0, 9).collect()] == [(1, 1.0), (2, 0.0), (3, 0.0), (4, -1.0)]


def test_even_split_and_last_write(spark):
    amounts, parts = spark.createDataFrame([(1, 10), (2, None)], "k int, amount long"), spark.createDataFrame([(1, i) for i in range(4)] + [(2, 0)], "k int, part int")
    assert {(r.k, r.allocated) for r in monitor.even_split(amounts, parts, "k", "amount").collect()} == {(1, 3), (2, None)}
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 1, 7)], "k string, seq int, v int")
    assert {tuple(r) for r in monitor.last_write_wins(rows, ["k"], "seq").collect()} == {("a", 2, None), ("b", 1, 7)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, name string, value double")
    assert governance.check(none, [governance.Rule("n", "rowCount"), governance.Rule("d", "duplicateValues", "id")]).where("passed").count() == 2
    assert governance.profile(none, ["id", "name"]).count() == 2 and monitor.shares(none, "name", "value", 5).count() == 0
    assert governance.containment(none, "id", none, "id").first().containment is None


def test_sources(spark, orders, tmp_path):
    for kind in ("parquet", "orc", "csv", "json"):
        tables.write(orders, kind, f"{tmp_path}/{kind}", by=("kind",) if kind == "parquet" else ())
        schema = None if kind in ("parquet", "orc") else "id long, kind string, price double, at timestamp_ntz"
        assert tables.read(spark, kind, f"{tmp_path}/{kind}", schema).count() == 4
    with pytest.raises(ValueError, match="schema"):
        tables.read(spark, "csv", str(tmp_path))
    assert dict(tables.described(orders)) == {"id": "integer", "kind": "string", "price": "number", "at": "datetime"}


def test_streams_leave_late_rows_out(spark, tmp_path):
    early = [(1, "a", "2024-01-01 00:01:00", 1.0), (2, "a", "2024-01-01 00:02:00", 2.0), (2, "a", "2024-01-01 00:02:00", 2.0), (3, "b", "2024-01-01 02:00:00", 4.0)]
    late = [(4, "a", "2024-01-01 00:03:00", 100.0), (5, "b", "2024-01-01 03:00:00", 1.0)]
    schema = "id long, kind string, at timestamp, value double"
    for rows in (early, late):
        spark.createDataFrame(rows, "id long, kind string, at string, value double").selectExpr("id", "kind", "cast(at as timestamp) at", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        sums = trend.trend(stream, "at", "5 minutes", "10 minutes", ["kind"], "value")
        trend.into_table(sums, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    found = {(r.kind, r.total, r.sum_value) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert ("a", 3, 5.0) in found and not any(s and s >= 100 for _, _, s in found)


def test_unique_and_sessions(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:01:00"), (1, "a", "2024-01-01 00:01:30"), (2, "a", "2024-01-01 00:20:00"), (3, "b", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "id long, kind string, at string").selectExpr("id", "kind", "cast(at as timestamp) at").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, kind string, at timestamp").parquet(f"{tmp_path}/in")
    trend.into_table(trend.unique(stream(), "at", "10 minutes", ["id"]), f"{tmp_path}/one", f"{tmp_path}/s1").awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/one").collect()) == [1, 2, 3]
    trend.into_table(trend.sessions(stream(), "at", "5 minutes", "10 minutes", ["kind"]), f"{tmp_path}/two", f"{tmp_path}/s2").awaitTermination(60)
    assert sorted((r.kind, r.total) for r in spark.read.parquet(f"{tmp_path}/two").collect()) == [("a", 1), ("a", 2)]


def test_table_grids(spark):
    html = "<table><tr><th colspan=2>merged<th>c1</tr><tr><td rowspan='2'>r</td><td> v1\n x</td></tr><tr><td>v2</td></tr></table><p>no</p><table></table>"
    assert documents.grids(html) == [[["merged", "", "c1"], ["r", "v1 x"], ["r", "v2"]]]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>")], "page_id long, html string")
    assert {(r.page_id, r.row_no, len(r.cells)) for r in documents.tables(pages).collect()} == {(1, 0, 3), (1, 1, 2), (1, 2, 2)}


def test_packs(spark):
    docs = spark.createDataFrame([(1, "1. First\nabc\n12\ndefg\n" + "y" * 30 + "\n2. Next\nend"), (2, None), (3, "")], "doc_id long, text string")
    found = [(r.doc_id, r.pack, r.content, r.lines) for r in documents.pack(docs, 20, text.NOISE, text.HEADING).orderBy("pack").collect()]
    assert found == [(1, 0, "[1. First]\nabc\ndefg", 2), (1, 1, "[1. First]\n" + "y" * 30, 1), (1, 2, "[2. Next]\nend", 1)]


def test_signatures():
    base = "the quick brown fox jumps over the lazy dog and runs on " * 40
    assert documents.signature(None) is None and documents.signature("abc") is None
    assert documents.signature(base) == documents.signature("  " + base.upper() + "\n") < 1 << 63
    assert bin(documents.signature(base) ^ documents.signature(base + "indeed")).count("1") < 20


def test_diverse(spark):
    rows = [(1, 10, 1.0, ["a", "b"]), (1, 11, 0.99, ["a", "b"]), (1, 12, 0.8, ["c"]), (2, 5, 0.1, None)]
    items = spark.createDataFrame(rows, "q long, i long, score double, tokens array<string>")
    assert {tuple(r) for r in documents.diverse(items, "q", "i", 2).collect()} == {(1, 10, 0), (1, 12, 1), (2, 5, 0)}


def test_rules_and_merging(spark):
    facts = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("a", "p", "c")], "s string, p string, o string")
    rule = knowledge.Rule((knowledge.Atom("?x", "p", "?y"), knowledge.Atom("?y", "p", "?z")), knowledge.Atom("?x", "p", "?z"))
    assert {(r.s, r.o) for r in knowledge.concluded(facts, rule).collect()} == {("b", "a"), ("c", "b"), ("a", "a"), ("c", "c")}
    with pytest.raises(ValueError, match="share"):
        knowledge.matches(facts, (knowledge.Atom("?x", "p", "b"), knowledge.Atom("?y", "p", "c")))
    rows = spark.createDataFrame([(i, i // 2) for i in range(1, 8)] + [(i, (i + 1) // 2) for i in range(1, 8)] + [(90, None), (91, 77)], "thing long, key long")
    assert {tuple(r) for r in knowledge.merged(rows, "thing", "key").collect()} == {(i, 1) for i in range(1, 8)} | {(91, 91)}


def test_discovery_of_odd_tables(spark):
    none = spark.createDataFrame([], "a long, b long")
    some = spark.createDataFrame([(1, 1), (1, None), (None, 2)], "a long, b long")
    assert discovery.overlap(none, "a", some, "a").first().overlap is None
    assert tuple(discovery.row_overlap(some, "a", some.withColumnsRenamed({"a": "x", "b": "y"}), "x").first()) == (5, 4)
    assert {tuple(r) for r in discovery.changes(some.where("a = 1").limit(1), spark.createDataFrame([(1, None), (3, 3)], "a long, b long"), "a").collect()} == {(1, "changed"), (3, "added")}


def test_scalar_functions(spark):
    rows = spark.createDataFrame([("abcdefghij", "1,234.5", "userName_id"), ("short", "1.2.3", "A"), ("", "", ""), (None, None, None)], "a string, b string, c string")
    found = rows.select(scalar.mask_sample(F.col("a")), scalar.number(F.col("b")), scalar.split_name(F.col("c")), scalar.words(F.col("a")), scalar.identity(F.col("a"), F.col("b"), length=8)).collect()
    assert [r[0] for r in found] == ["abcd**ghij", "*****", "", None] and [r[1] for r in found] == [1234.5, None, None, None]
    assert [r[2] for r in found] == [["user", "name", "id"], ["a"], [], None] and found[3][3] == [] and found[2][4] == found[3][4] != found[0][4]
    cjk = spark.createDataFrame([("知识库 of 库",)], "a string").select(scalar.words(F.col("a"))).first()[0]
    assert cjk == ["of", "知识", "识库", "库"]
    equal = spark.sql("select stack(4, 1D, 1D, 1.5D, 1.9D, 1D, 2D, null, 0.4D) as (a, b)").select(scalar.cell_equal(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in equal] == [True, True, False, True]
    assert str(spark.range(1).select(scalar.excel_date(F.lit(45292.7))).first()[0]) == "2024-01-01"


def test_two_hop_pairs_of_hubs_loops_and_nulls(spark):
    from quern.operators import graph

    made = [("v2", x) for x in "abc"] + [("v1", "a"), ("b", "v1"), ("v1", "v1"), ("a", "c"), ("v1", None)] + [("h", f"x{i}") for i in range(6)]
    found = graph.two_hop_pairs(spark.createDataFrame(made, "src string, dst string"), 4)
    both = {(a, b) for a, b in made if a and b} | {(b, a) for a, b in made if a and b}
    degree = {n: len({b for a, b in both | {("v1", None)} if a == n}) for n, _ in both}
    wanted = {}
    for via, a in both:
        for other, c in both:
            if via == other and degree[via] <= 4 and a < c and via not in (a, c) and (a, c) not in both:
                wanted[a, c] = min(via, wanted.get((a, c), via))
    assert {(r.a, r.c): r.via for r in found.collect()} == wanted and wanted
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join LeftAnti") < text.index("Aggregate [a#")  # each pair once before it is looked up


def test_percentiles_of_groups_without_reading_them_in_one_task(spark):
    from quern.plans import metrics

    made = [(g, float(x * x % 97) if x % 5 else None) for g in ("a", "b", None) for x in range(60)] + [("c", None), ("d", 4.0), ("e", float("nan")), ("e", 1.0)]
    rows = spark.createDataFrame(made, "g string, x double")
    for agg, share in (("percentile", 95), ("percentile", 37.5), ("median", None)):
        catalog = metrics.Catalog({"t": lambda: rows, "none": lambda: rows.limit(0)}, {"m": metrics.Simple("t", agg, "x", percentile=share), "n": metrics.Simple("none", agg, "x", percentile=share)})
        exact = metrics.aggregate(catalog.metrics["m"]).alias("value")
        by = lambda found: sorted((str(r.g), str(r.value)) for r in found.collect())
        found = metrics.compile_metric(catalog, "m", ("g",))
        assert by(found) == by(rows.groupBy("g").agg(exact)) and found.schema["value"].dataType == rows.groupBy("g").agg(exact).schema["value"].dataType
        assert [r.value for r in metrics.compile_metric(catalog, "n").collect()] == [None]
        assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
