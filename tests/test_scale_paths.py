"""Operators without SQL, and their paths for long chains and large groups, against brute force in plain Python."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quern.operators import discovery, documents, graph, knowledge, repository, retrieval, rounds
from quern.plans import guard


def test_long_chains_have_one_winner(spark):
    n = 700
    rows = [(i, k) for i in range(n) for k in (f"k{i}", f"k{i + 1}")] + [(5000, "alone"), (None, "k1"), (7, None)]
    random.Random(1).shuffle(rows)
    found = dict(map(tuple, knowledge.merged(spark.createDataFrame(rows, "thing long, key string"), "thing", "key").collect()))
    assert found == {i: 0 for i in range(n)} | {5000: 5000}


def test_closure_of_a_deep_hierarchy(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(151, 152), (152, 151)], "src long, dst long")
    pairs = {tuple(r) for r in graph.closure(edges).collect()}
    assert pairs == {(j, i) for i in range(151) for j in range(i, 151)} | {(a, b) for a in (151, 152) for b in (151, 152)}
    assert {r.node for r in graph.cyclic(edges).collect()} == {151, 152}


def test_levels_rise_until_nothing_changes_and_pins_hold(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    marks, pins = spark.createDataFrame([(0, 3), (20, 1)], "node long, level int"), spark.createDataFrame([(30, 0)], "node long, level int")
    assert dict(map(tuple, graph.propagated(edges, marks).collect())) == {i: 3 for i in range(41)}
    assert dict(map(tuple, graph.propagated(edges, marks, pins).collect())) == {i: 3 if i < 30 else 0 for i in range(41)}


@pytest.mark.parametrize("width", [60, 86_400])
def test_intervals_of_any_length(spark, width):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(4000)) for _ in range(200)]
    spans = [(rng.randrange(3), a := rng.randrange(4000), a + rng.randrange(-5, 900), i) for i in range(60)]
    at = lambda c: F.timestamp_seconds(c)
    left = spark.createDataFrame(rows, "k int, s long").select("k", "s", at("s").alias("at"))
    right = spark.createDataFrame(spans, "k int, a long, b long, i long").select("k", at("a").alias("first"), at("b").alias("last"), "i")
    found = sorted((r.k, r.s, r.i) for r in discovery.in_interval(left, right, "k", "at", width).collect())
    assert found == sorted((k, s, i) for k, s in rows for j, a, b, i in spans if j == k and a <= s <= b)


def greedy(items, most, weight=0.7):
    left, chosen = sorted(items, key=lambda r: (-r[1], r[0])), []
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    while left and len(chosen) < most:
        best = max(left, key=lambda r: weight * r[1] - (1 - weight) * max((like(set(r[2]), set(c[2])) for c in chosen), default=0.0))
        chosen.append(best)
        left.remove(best)
    return [r[0] for r in chosen]


def test_diverse_looks_at_every_item(spark):
    rng = random.Random(3)
    rows = [("big", i, round(0.4 / (1 + i / 500), 6), ["same", "words"]) for i in range(1500)] + [("big", 9999, 0.05, ["quite", "new"])]
    rows += [("small", i, rng.random(), rng.sample("abcdef", 3)) for i in range(20)] + [("odd", 1, 0.5, None), ("odd", 2, 0.5, [])]
    found = {}
    for r in documents.diverse(spark.createDataFrame(rows, "q string, i long, score double, tokens array<string>"), "q", "i", 4).orderBy("q", "rank").collect():
        found.setdefault(r.q, []).append(r.i)
    assert found == {q: greedy([(i, s, t or []) for k, i, s, t in rows if k == q], 4) for q in ("big", "small", "odd")}
    assert 9999 in found["big"]


def test_fused_ranks_every_item(spark):
    rng = random.Random(4)
    one, two = [(i, rng.choice([0.0, 1.0, rng.random()])) for i in range(3000)], [(i, rng.random()) for i in range(2000, 4000)]
    found = {r.id: r.score for r in retrieval.fused([(spark.createDataFrame(x, "id long, score double"), w) for x, w in ((one, 1.0), (two, 0.5))], "id", 4000).collect()}
    expected = {}
    for x, w in ((one, 1.0), (two, 0.5)):
        for n, (_, i) in enumerate(sorted((-s, i) for i, s in x if s > 0)):
            expected[i] = expected.get(i, 0) + w / (60 + n)
    assert found.keys() == expected.keys() and all(abs(found[i] - expected[i]) < 1e-7 for i in found)


def test_numbers_follow_the_order(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("id")).repartition(7)
    assert all(r.n == r.id for r in rounds.numbered(rows, [F.col("id")], "n").collect())


def test_near_signatures_and_alike_documents(spark):
    rng = random.Random(5)
    texts = []
    for i in range(60):
        lines = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(9)) for _ in range(30)]
        texts.append(lines)
        if i % 3 == 0:
            texts.append([*lines[:-2], "an end of its own", ""])
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = documents.signatures(docs)
    marks = {r.doc_id: r.signature for r in signed.collect() if r.signature is not None}
    near = {(r.query_id, r.doc_id) for r in documents.near(signed, signed.where("doc_id % 2 = 0"), 0.8, block=7, part=20).collect()}
    assert near == {(a, b) for a in marks if a % 2 == 0 for b in marks if a != b and 1 - bin(marks[a] ^ marks[b]).count("1") / 64 >= 0.8}
    found = {(r.query_id, r.doc_id) for r in documents.alike(docs, docs.where("doc_id % 2 = 0"), 0.8).collect()}

    def ratio(a, b):
        one, two, both = a.split("\n"), b.split("\n"), 0
        left = list(two)
        for line in one:
            if line in left:
                left.remove(line)
                both += 1
        return 2 * both / (len(one) + len(two))

    known = dict(rows)
    assert found == {(a, b) for a, b in {(a, b) for a in marks if a % 2 == 0 for b in marks if a != b and 1 - bin(marks[a] ^ marks[b]).count("1") / 64 >= 0.75} if ratio(known[a], known[b]) >= 0.8}
    assert len(found) > 10


def test_row_packs(spark):
    rows = [("t", i, "g" if i < 4 else "h", "x" * 10) for i in range(9)] + [("u", 0, None, "y" * 50)]
    found = [tuple(r) for r in documents.row_packs(spark.createDataFrame(rows, "t string, n int, g string, line string"), "t", "n", "g", "line", 25).orderBy("t", "pack").collect()]
    assert [(t, p, n) for t, p, n, _ in found] == [("t", 0, 2), ("t", 1, 2), ("t", 2, 2), ("t", 3, 2), ("t", 4, 1), ("u", 0, 1)]
    assert found[0][3] == "x" * 10 + "\n" + "x" * 10


@pytest.mark.parametrize(
    "sql",
    ["SELECT * FROM orders, secret", "SELECT * FROM `parquet`.`/etc/x`", "SELECT (SELECT max(v) FROM secret) FROM orders", "SELECT * FROM orders WHERE id IN (SELECT id FROM secret)", "WITH a AS (SELECT * FROM secret) SELECT * FROM a", "SELECT * FROM range(3)", "SELECT * FROM other.orders", 'SELECT * FROM orders JOIN "x'],
)
def test_no_table_slips_through(spark, sql):
    space = guard.Workspace(spark)
    space.register("orders", spark.createDataFrame([(1, "a")], "id long, kind string"))
    with pytest.raises(guard.Refused):
        space.query(sql)


def test_words_in_quotes_are_no_statements(spark):
    space = guard.Workspace(spark)
    space.register("orders", spark.createDataFrame([(1, "drop; x")], "id long, kind string"))
    assert space.query("WITH a AS (SELECT * FROM orders) SELECT id FROM a, (SELECT 'drop ; from secret' AS s) WHERE kind <> \"; delete\"").count() == 1


def test_results_compared_and_voted(spark):
    one = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert tuple(repository.same_rows(one, one.repartition(3)).first()) == (True, True)
    assert tuple(repository.same_rows(one, one.distinct()).first()) == (False, True)
    assert tuple(repository.same_rows(one.limit(0), one.limit(0)).first()) == (True, True)
    runs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "x"), (5, None)], "run int, answer string")
    assert tuple(repository.voted(runs, "run", "answer").first()) == (1, 2)


def paired(edges, most):
    both = {(a, b) for a, b in edges if a and b} | {(b, a) for a, b in edges if a and b}
    near = {}
    for a, b in {x for a, b in edges for x in ((a, b), (b, a))}:
        near.setdefault(a, set()).add(b)
    found = {}
    for via in sorted(x for x in near if x and len(near[x]) <= most):
        for a in near[via] - {via, None}:
            for c in near[via] - {via, None}:
                if a < c and (a, c) not in both:
                    found.setdefault((a, c), via)
    return {(a, via, c) for (a, c), via in found.items()}


def test_two_hop_pairs_send_lists_and_no_pairs(spark):
    rows = [(f"v{i}", f"e{i * 29 + j}") for i in range(60) for j in range(29)]
    jvm, context = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()

    def sent():  # records by stage
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = sent()
    found = {tuple(r) for r in graph.two_hop_pairs(spark.createDataFrame(rows, "src string, dst string"), 30).select("a", "via", "c").collect()}
    assert found == paired(rows, 30) and len(found) == 60 * 29 * 14
    assert len(rows) < sum(n for stage, n in sent().items() if stage not in before) < len(found) / 4


@pytest.mark.parametrize("kind", ["string", "long"])
def test_two_hop_pairs_in_many_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(graph, "BLOCK", 60)  # where names are divided; a few of them fill blocks of their own
    rng = random.Random(6)
    name = str if kind == "string" else int
    rows = [(name(rng.randrange(1, 40)), name(rng.choice([100, 101, 150, rng.randrange(100, 200)]))) for _ in range(300)]
    rows += [(name(rng.randrange(1, 200)), name(rng.randrange(1, 200))) for _ in range(60)] + [(name(7), None), (None, name(8))] + [(name(900), name(i)) for i in range(1, 30)]
    edges = spark.createDataFrame(rows, f"src {kind}, dst {kind}").repartition(3)
    found = graph.two_hop_pairs(edges, 12).collect()
    assert {(r.a, r.via, r.c) for r in found} == paired(rows, 12) and len(found) == len(paired(rows, 12)) > 300
    ends = spark.createDataFrame([(v, sorted(b for a, b in set(rows) if a == v and b)) for v in {a for a, _ in rows if a}], f"via {kind}, ends array<{kind}>")
    cuts = graph._cuts(ends, 3000)
    assert len(cuts) == 49 and max(cuts.count(c) for c in cuts) > 2
    assert graph.two_hop_pairs(edges.limit(0), 12).collect() == []


def test_two_hop_pairs_of_a_block_in_pieces(monkeypatch):
    rng = random.Random(7)
    lists = [(f"v{i}", sorted(rng.sample([f"e{j}" for j in range(50)], rng.randrange(2, 20)))) for i in range(80)]
    batches = [pa.RecordBatch.from_pydict({"via": [v for v, _ in part], "ends": [e for _, e in part]}) for part in (lists[:50], lists[50:])]
    wanted = {}
    for via, ends in sorted(lists):
        for i, a in enumerate(ends):
            for c in ends[i + 1 :]:
                wanted.setdefault((a, c), via)
    monkeypatch.setattr(graph, "BLOCK", 100)
    shared = type("Shared", (), {"value": sorted(["e10", "e2", "e2", "e2", "e2", "e30", "e4"])})
    dealt = pa.Table.from_batches(graph._dealt(shared)(iter(batches)))
    found = []
    for block in sorted(set(dealt["block"].to_pylist())):
        made = list(graph._met(iter(dealt.filter(pc.equal(dealt["block"], block)).to_batches())))
        found += [(r["a"], r["c"], r["via"]) for part in made for r in part.to_pylist()]
    assert sorted(set(dealt["block"].to_pylist())) == list(range(8))
    assert sorted(found) == sorted((a, c, via) for (a, c), via in wanted.items())
