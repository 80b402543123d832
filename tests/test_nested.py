"""JSON taken apart and saved, paths against plain search, columns by which tables are grouped against one pass."""

import random

from quern.operators import documents, graph, nested


def test_unnested(spark):
    rows = [(1, '[{"a": 1, "b": " x "}, {"b": ""}, {"a": "no", "c": 3}]', "old"), (2, None, None), (3, "[]", None), (4, "nonsense", None), (5, '[{"a": 2', None)]
    docs = spark.createDataFrame(rows, "id int, j string, b string")
    found = [tuple(r) for r in nested.unnested(docs, "j", "a bigint, b string").select("id", "position", "a", "b").where("id < 5").collect()]
    assert sorted(found, key=str) == [(1, 0, 1, "x"), (1, 1, None, None), (1, 2, None, None)]
    assert nested.unnested(docs, "j", "a bigint", outer=True).where("id in (2, 3)").count() == 2


def test_objects_of_texts_that_were_cut():
    assert nested.objects('[{"b": 1, "a": {"x": "}"}}, {"c": [{"d": 2}, {"e": 3}], "f"') == ['{"a":{"x":"}"},"b":1}', '{"d":2}', '{"e":3}']
    assert nested.objects('noise {not json} {"k": "ü"} {"k": ') == ['{"k":"ü"}'] and nested.objects(None) == nested.objects("{{{") == []


def test_salvaged_rows(spark):
    docs = spark.createDataFrame([(1, '{"a":1}{"b":2', "own"), (2, None, "own")], "id int, t string, object string")
    assert [tuple(r) for r in nested.salvaged(docs, "t").collect()] == [(1, '{"a":1}{"b":2', 0, '{"a":1}')]


EDGE = "src string, src_column string, dst string, dst_column string, kind string, confidence double, origin string"


def test_ranked_paths(spark):
    rng = random.Random(6)
    edges = [(f"t{rng.randrange(6)}", rng.choice(["a", "b"]), f"t{rng.randrange(6)}", rng.choice(["a", None]), rng.choice(["join", "lineage"]), rng.choice([1.0, 0.8]), rng.choice(["declared", "manual"])) for _ in range(20)]
    ways = [(s, (k, s, sc, d, dc, False, o), w) for s, sc, d, dc, k, w, o in edges if k == "join" or (sc and dc)]
    ways += [(d, (k, d, dc, s, sc, True, o), w) for s, sc, d, dc, k, w, o in edges if k == "join" or (sc and dc)]
    plain = lambda steps: tuple(tuple((x is not None, x) if not isinstance(x, bool) else x for x in s) for s in steps)
    front, found, cut = [([], ["t0"], 1.0)], [], False
    for turn in range(3):
        longer = []
        for steps, path, score in front:
            for at, step, w in ways:
                if at == path[-1] and step[3] not in path:
                    longer.append(([*steps, step], [*path, step[3]], score * w * (0.5 if step[0] == "lineage" else 1) * (0.9 if turn else 1)))
        bonus = lambda x: 1.5 if x[1][-1] in ("t3", "t4") else 1.0
        longer.sort(key=lambda x: (-x[2] * bonus(x), plain(x[0])))
        cut |= len(longer) > 20
        front = longer[:20]
        found += [(round(x[2] * bonus(x), 6), x) for x in front]
    told = sorted((f for f in found if len(f[1][0]) >= 2), key=lambda f: (-f[0], plain(f[1][0])))
    expected = [(i + 1, ">".join(x[1]), len(x[0]), sum(s[0] == "lineage" for s in x[0]), x[1][-1] in ("t3", "t4"), score, cut or len(told) > 9) for i, (score, x) in enumerate(told[:9])]
    rows = graph.ranked_paths(spark.createDataFrame(edges, EDGE), "t0", ["t3", "t4"], 3, 20, 9, 2).orderBy("place").collect()
    assert [tuple(r) for r in rows] == expected and len(expected) > 4
    assert graph.ranked_paths(spark.createDataFrame(edges, EDGE), "nowhere", [], 3).count() == 0


def test_group_columns_over_ranges(spark):
    rng = random.Random(8)
    rows = [(t, i, rng.choice("ab") if t == "x" else "c", i // 7, None if i % 3 else "n") for t in ("x", "y", "z") for i in range(90)]
    docs = spark.createDataFrame(rows, "t string, i int, a string, b int, c string").repartition(7)
    found = {(r.t, r.column_name): r.changes for r in documents.group_columns(docs, ["i"], ["a", "b", "c"], "t").collect()}
    expected = {}
    for t in "xyz":
        own = sorted((r for r in rows if r[0] == t), key=lambda r: r[1])
        for k, name in ((2, "a"), (3, "b"), (4, "c")):
            changes = sum(x[k] != y[k] for x, y in zip(own, own[1:]))
            if 2 * changes <= len(own) and len({r[k] for r in own} - {None}) >= 2:
                expected[t, name] = changes
    assert found == expected and found


def test_numbers_in_one_form(spark):
    from pyspark.sql import functions as F

    from quern.functions import scalar

    groups = [["10", "10.0", "+10.00", "010", "1e1", " 10 "], ["0", "-0", "0.000", "+0", "0e5"], ["-1.5", "-01.50", "-15e-1"], [".5", "0.5", "00.50"], ["001x"], ["abc", " abc "], ["", None], ["1.2.3"], ["100"], ["12345678901234567890123"]]
    rows = spark.createDataFrame([(i, v) for i, g in enumerate(groups) for v in g], "i int, v string").select("i", scalar.norm_number(F.col("v")).alias("n"))
    told = {}
    for r in rows.collect():
        told.setdefault(r.i, set()).add(r.n)
    assert all(len(s) == 1 for s in told.values()) and len({s for g in told.values() for s in g}) == len(groups)


def test_stale_edges_and_signatures(spark):
    from quern.operators import catalog, repository

    edges = spark.createDataFrame([(1, "platform", "2024-01-01"), (2, "manual", "2020-01-01"), (3, "platform", None), (4, "platform", "soon"), (5, "platform", "2024-03-01T00:00:00")], "id int, origin string, last_seen_at string")
    assert {r.id: r.stale for r in catalog.with_stale(edges, "2024-03-02").collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert not catalog.with_stale(edges, "2024-03-02", 0).where("stale").count()
    docs = spark.createDataFrame([(1, "ready", 0, "2024-01-02"), (2, "ready", 0, "2024-01-01"), (3, "new", 0, "2024-01-01"), (4, "ready", 1, "2024-01-01"), (5, "ready", 0, "2024-01-03")], "id int, status string, is_deleted int, created_at string")
    signed = spark.createDataFrame([(5, None, "2024-01-01"), (1, 7, "2024-01-01")], "document_id int, simhash long, updated_at string").withColumn("updated_at", __import__("pyspark").sql.functions.to_timestamp("updated_at"))
    assert [r.id for r in repository.without_signature(docs, signed, 9).collect()] == [2]
    assert [r.id for r in repository.tried_again(docs, signed, "2024-01-02 00:00:01", 86_400, 9).collect()] == [5] and not repository.tried_again(docs, signed, "2024-01-01 10:00:00", 86_400, 9).count()
