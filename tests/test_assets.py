"""Assets and lineage importers on small rows: nulls, ties, repeated rows, empty tables."""

import json

from pyspark.sql import functions as F

from quern.operators import assets
from quern.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_replaced_keeps_what_is_wanted_and_counts_repeats_once(spark):
    now = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None)], "k int, v string")
    then = spark.createDataFrame([(1, "b"), (2, None), (3, "c"), (3, "c")], "k int, v string")
    assert rows(assets.replaced(now, then)) == [(1, "a", "remove"), (3, "c", "add")]
    assert rows(assets.replaced(now, then, spark.createDataFrame([(3,)], "k int"))) == [(3, "c", "add")]
    assert rows(assets.replaced(now.limit(0), then.limit(0))) == []


def test_replaced_deals_rows_over_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(assets, "ROWS", 10)
    now, then = (spark.range(a, b).selectExpr("id % 30 as k", "id as v") for a, b in ((0, 60), (20, 90)))
    for ids in (None, spark.range(20, 40).toDF("k")):
        found = assets.replaced(now, then, ids)
        kept = [x for x in [*range(20), *range(60, 90)] if ids is None or x % 30 >= 20]
        assert rows(found) == sorted(((x % 30, x, "remove" if x < 20 else "add") for x in kept), key=str)
        assert found.rdd.getNumPartitions() == (13 if ids is None else 15)


def test_fields_are_filled_from_the_second(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "p", "y")], "k int, f string, g string")
    b = spark.createDataFrame([(1, "q", "z"), (3, "r", None)], "k int, f string, g string")
    assert rows(assets.filled_from(a, b, "k")) == [(1, "q", "x", "both"), (2, "p", "y", "first"), (3, "r", None, "second")]


def test_waiting_and_blank_rows(spark):
    jobs = spark.createDataFrame([("a", 1, "done"), ("a", 2, "pending"), ("a", 3, "done"), ("b", 1, None), ("b", 2, "pending")], "g string, n int, s string")
    waits = assets.waiting_before(jobs, "g", F.col("s") == "pending", ["n"])
    assert rows(waits.where("waits").select("g", "n")) == [("a", 3)]
    assert waits.where("not waits").count() == 4
    assert rows(assets.without_blanks(jobs, "g", F.col("s") == "done").select("g", "n")) == [("a", 2), ("b", 1), ("b", 2)]
    assert rows(assets.without_blanks(jobs.where("s = 'done'"), "g", F.col("s") == "done").select("g", "n")) == [("a", 1), ("a", 3)]


def test_merge_map_takes_the_largest_then_the_least_key(spark):
    pages = spark.createDataFrame([(1, "T", 5), (2, "t", 9), (3, "t", 9), (4, "u", None), (5, None, 1), (6, None, 2)], "k int, t string, n int")
    assert rows(assets.merge_map(pages, F.lower("t"), "k", "n")) == [(1, 2), (3, 2)]


def test_pages_tell_whether_more_follows(spark):
    five = spark.range(5)
    assert rows(assets.page_of(five, [F.col("id")], 2, 1)) == [(1, True, 3), (2, True, 3)]
    assert rows(assets.page_of(five, [F.col("id")], 2, 3)) == [(3, False, None), (4, False, None)]
    assert rows(assets.page_of(five, [F.col("id")], 2, 9)) == []


def test_identities_by_several_spellings(spark):
    log = spark.createDataFrame([("user:7",), ("7",), ("u-8",), ("user:99999999999999999999",), (None,)], "s string")
    known = spark.createDataFrame([(7,), (7,)], "user_id long")
    told = assets.identified(log, "s", [r"^user:(\d+)$", r"^(\d+)$", r"^u-(\d+)$"], known, "user_id")
    assert rows(told) == sorted([("user:7", 7), ("7", 7), ("u-8", None), ("user:99999999999999999999", None), (None, None)], key=str)


def test_mentions(spark):
    pairs = [("Ada Byron", "by Ada Byron."), ("Ada-Byron", "ADA BYRON wrote"), ("Ada Byron", "Ada alone"), ("Ada Byron", "nobody"), ("", "text"), (None, "text"), ("Ada", None)]
    told = spark.createDataFrame(pairs, "n string, t string").select("n", "t", assets.mentions(F.col("n"), F.col("t")).alias("how"))
    assert {(r.n, r.t): r.how for r in told.collect()} == dict(zip(pairs, ["verbatim", "normalised", "parts", None, None, None, None], strict=True))


def test_index_problems_and_unreferenced(spark):
    files = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "k int, f string")
    index = spark.createDataFrame([(1,), (2,), (9,), (9,), (None,)], "k int")
    found = rows(assets.index_problems(files, index.where("k is not null"), "k", ["f"]))
    assert found == [(2, "no f"), (3, "no f"), (3, "not indexed"), (9, "no file")]


def test_lineage_rows_come_from_json_and_csv(spark, tmp_path):
    edge = {"src_table": "a", "src_column": "x", "dst_table": "b", "dst_column": "y", "origin": "elsewhere"}
    (tmp_path / "e.json").write_text("\n".join(json.dumps(e) for e in (edge, edge, {"src_table": "a"})))
    (tmp_path / "e.csv").write_text("dst_table,src_table,src_column,dst_column\nb,a,x,y\n,a,x,y\n")
    for kind in ("json", "csv"):
        assert rows(tables.lineage_rows(spark, kind, str(tmp_path / f"e.{kind}"))) == [("a", "x", "b", "y", "platform")]


def test_openlineage_events_give_edges(spark):
    place = lambda n: {"namespace": "db", "name": n}
    facet = {"columnLineage": {"fields": {"total": {"inputFields": [{**place("a"), "field": "x"}, {**place("b"), "field": "y"}]}}}}
    events = [json.dumps({"inputs": [place("a"), place("b")], "outputs": [{**place("c"), "facets": facet}, place("d")]}), "no event", None, "{}"]
    told = tables.openlineage_edges(spark.createDataFrame([(e,) for e in events], "e string"), "e")
    assert rows(told) == sorted([("db.a", "x", "db.c", "total"), ("db.b", "y", "db.c", "total"), ("db.a", None, "db.d", None), ("db.b", None, "db.d", None)], key=str)
