"""Increments against rebuilds, impact and walks against plain loops, identity against all pairs."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from quern.operators import identity, increments


def test_facts_equal_a_rebuild(spark):
    rng = random.Random(2)
    say = lambda n: {(f"a{rng.randrange(12)}", rng.randrange(3), f"s{rng.randrange(6)}") for _ in range(n)}
    rows = lambda items, kind="a string, b int, source string": spark.createDataFrame(sorted(items), kind)
    told = say(60)
    state = increments.facts(rows(list(told) + list(told)[:9]).union(rows([("x", 1, None)])), ["a", "b"], buckets=5)
    count = lambda items: {k: len({s for a, b, s in items if (a, b) == k}) for k in {(a, b) for a, b, _ in items}}
    for turn in range(4):
        add, remove = say(12), set(rng.sample(sorted(told), 15)) | say(3)
        if turn == 3:
            add, remove = set(), set(told)
        delta = [(*x, "add") for x in add] + [(*x, "remove") for x in remove]
        before, told = told, (told - remove) | add
        change = increments.apply(state, rows(delta, "a string, b int, source string, op string"))
        old, new = count(before), count(told)
        assert {(r.a, r.b): (r.before, r.after) for r in change.collect()} == {k: (old.get(k, 0), new.get(k, 0)) for k in old.keys() | new.keys() if old.get(k, 0) != new.get(k, 0)}
        again = increments.apply(state, rows(delta, "a string, b int, source string, op string"))
        assert again.count() == 0 and {(r.a, r.b): r.support for r in state.facts(spark).collect()} == new
    assert increments.apply(state, rows([], "a string, b int, source string, op string")).count() == 0
    empty = increments.facts(rows([]), ["a", "b"])
    assert increments.apply(empty, rows([("q", 1, "s", "add")], "a string, b int, source string, op string")).count() == 1 and empty.facts(spark).first().support == 1


LINK = "page string, target string, kind string, relation string, evidence array<string>"


def test_links(spark):
    now = spark.createDataFrame([("p", "q", "supported_relation", "owns", ["e1", "e2"]), ("p", "r", "navigation", "", []), ("x", "q", "supported_relation", "owns", ["e3"]), ("y", "q", "supported_relation", "has", ["e1", "e4"])], LINK)
    new = spark.createDataFrame([("p", "q", "supported_relation", "owns", ["e9"]), ("x", "z", "navigation", None, None), ("y", "q", "supported_relation", "has", ["e1", "e4", "e5"])], LINK)
    rebuilt = spark.createDataFrame([("x",)], "page string")
    both = increments.merged_links(now, new, rebuilt)
    assert {(r.page, r.target, r.kind, r.relation, tuple(r.evidence or ())) for r in both.collect()} == {
        ("p", "q", "supported_relation", "owns", ("e1", "e2")), ("p", "r", "navigation", "", ()), ("x", "z", "navigation", "", ()), ("y", "q", "supported_relation", "has", ("e1", "e4", "e5")),
    }
    live = spark.createDataFrame([("e4",), ("e9",), ("e4",)], "evidence_id string")
    left = increments.withdrawn_links(now.union(spark.createDataFrame([("p", "q", "navigation", "", [])], LINK)), live, spark.createDataFrame([("x",)], "page string"))
    assert {(r.page, r.target, r.kind, r.relation, tuple(r.evidence)) for r in left.collect()} == {("p", "q", "navigation", "", ()), ("p", "r", "navigation", "", ()), ("y", "q", "supported_relation", "has", ("e4",))}
    assert left.count() == 3


def test_impact(spark):
    pages = lambda rows: spark.createDataFrame(rows, "path string, title string, description string")
    links = lambda rows: spark.createDataFrame(rows, "path string, target string")
    before = pages([("a/1", "one", "x"), ("a/2", "two", "x"), ("b/3", "three", "x"), ("c/4", "four", "x"), ("top", "t", "x"), ("d/e/5", "five", "x")])
    after = pages([("a/1", "ONE", "x"), ("a/2", "two", "x"), ("b/3", "three", "y"), ("top", "t", "x"), ("d/e/5", "five", "x"), ("d/6", "six", "x")])
    old = links([("a/2", "a/1"), ("a/1", "top"), ("b/3", "a/2"), ("c/4", "b/3"), ("d/e/5", "c/4")])
    new = links([("a/2", "a/1"), ("a/1", "top"), ("b/3", "top"), ("d/6", "d/e/5")])
    found = increments.impact(before, after, old, new, spark.createDataFrame([("a/1",), ("b/3",), ("c/4",), ("d/6",)], "path string"))
    assert {(r.path, r.action) for r in found.collect()} == {
        ("a/1", "render"), ("a/2", "render"), ("b/3", "render"), ("top", "render"), ("d/6", "render"), ("d/e/5", "render"), ("c/4", "remove"), ("a", "index"), ("b", "index"), ("d", "index"),
    }
    assert increments.impact(before, after, old, new, spark.createDataFrame([], "path string")).count() == 0


def test_dependents(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("x", "y")], "node string, on string")
    found = increments.dependents(edges, spark.createDataFrame([("a",)], "node string"))
    assert {(r.node, r["round"]) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def plain_walk(occurrences, seeds):
    by_label, by_record = defaultdict(set), defaultdict(set)
    for r, label in occurrences:
        by_label[label].add(r)
        by_record[r].add(label)
    queue, queued, found = deque((s, None) for s in sorted(set(seeds))), set(seeds), []
    while queue:
        label, via = queue.popleft()
        for r in sorted(by_label[label]):
            if r not in {x for x, *_ in found}:
                found.append((r, label, via))
                for other in sorted(by_record[r]):
                    if other not in queued:
                        queued.add(other)
                        queue.append((other, r))
    return found


@pytest.mark.parametrize("cuts", [[1000], [1, 4, 1000], [3] * 12 + [1000]])
def test_walks_find_the_same_however_cut(spark, cuts):
    rng = random.Random(11)
    occurrences = [(f"r{rng.randrange(40):02d}", f"l{rng.randrange(45):02d}") for _ in range(90)]
    rows = spark.createDataFrame(occurrences + occurrences[:5], "record string, label string").repartition(3)
    expected = plain_walk(occurrences, ["l01", "l07"])
    walk = increments.begin(rows, spark.createDataFrame([("l07",), ("l01",), (" ",), ("l01",)], "label string"))
    for n, most in enumerate(cuts):
        before = walk.found
        walk = increments.go_on(increments.Walk.of(walk.token), rows, most)
        assert walk.found == min(before + most, len(expected))
        if n == len(cuts) - 1:
            break
    assert [(r.record, r.label, r.via) for r in walk.records(spark).orderBy("place").collect()] == expected and walk.exhausted and 10 < len(expected) < 40
    with pytest.raises(increments.Stale):
        increments.go_on(walk, rows.limit(3), 5)
    with pytest.raises(increments.Stale):
        increments.Walk.of("nonsense")


FORM = "id long, name string, aliases array<string>, related array<string>, explicit_id string, kind string, context string"


def plain_decision(a, b):
    norm = lambda x: " ".join((x or "").lower().split())
    listed = lambda x: {norm(y) for y in x or []} - {""}
    (na, la, ra, ia, ka, ca), (nb, lb, rb, ib, kb, cb) = ((norm(x[1]), listed(x[2]) - listed(x[3]), listed(x[3]), (x[4] or "").strip(), x[5], norm(x[6])) for x in (a, b))
    if ia and ib:
        return ("same", "explicit_identifier") if ia == ib else ("different", "conflicting_identifier")
    if nb in ra or na in rb:
        return "different", "relation_not_alias"
    if ka != kb:
        return "undetermined", "topic_kept_separate"
    name, alias = na == nb != "", nb in la or na in lb
    if (name or alias) and ca == cb != "":
        return "same", "name_and_context" if name else "alias_and_context"
    return "undetermined", "same_name_other_context" if name or alias else "no_identifier"


def test_identity(spark):
    rng = random.Random(5)
    names = ["Acme", "ACME  ", "acme corp", "Beta", "", None]
    forms = [(i, rng.choice(names), rng.sample(["acme", "Acme Corp", "beta", ""], rng.randrange(3)), rng.sample(["acme", "beta"], 1) if rng.random() < 0.15 else None, rng.choice([None, None, None, "1", "2", " "]), rng.choice(["entity", "entity", "topic", None]), rng.choice(["x", "y", "", None])) for i in range(40)]
    rows = spark.createDataFrame(forms, FORM)
    pairs = [(a[0], b[0]) for i, a in enumerate(forms) for b in forms[i + 1 :]]
    found = {(r.left, r.right): (r.decision, r.basis) for r in identity.decided(spark.createDataFrame(pairs, "left long, right long"), rows).collect()}
    assert found == {(a, b): plain_decision(forms[a], forms[b]) for a, b in pairs} and len(set(found.values())) == 8
    plain = [f for f in forms if not f[3] and not (f[4] or "").strip()]
    group = {f[0]: f[0] for f in plain}
    for a in plain:
        for b in plain:
            if a[0] < b[0] and found[a[0], b[0]][0] == "same":
                old, new = max(group[a[0]], group[b[0]]), min(group[a[0]], group[b[0]])
                group = {k: new if v == old else v for k, v in group.items()}
    told = identity.groups(spark.createDataFrame(plain, FORM)).collect()
    assert {r.id: r.same_as for r in told} == group and not any(r.conflict for r in told)


def test_conflicts_of_groups(spark):
    forms = [(1, "Acme", ["Acme Corp"], None, "7", "e", "x"), (2, "acme corp", None, None, None, "e", "x"), (3, "Acme", None, None, "8", "e", "x"), (4, "old", ["new"], None, None, "e", "x"), (5, "new", ["old"], None, None, "e", "x"), (6, "New", None, ["old"], None, "e", "x"), (7, "alone", None, None, None, "e", None)]
    found = {r.id: (r.same_as, r.conflict) for r in identity.groups(spark.createDataFrame(forms, FORM)).collect()}
    assert found == {1: (1, True), 2: (1, True), 3: (1, True), 4: (4, True), 5: (4, True), 6: (4, True), 7: (7, False)}


def test_evidence_of_links_is_dealt_over_as_many_tasks_as_are_asked_for(spark):
    links = spark.createDataFrame([(f"p{i}", f"t{i % 5}", "supported_relation", r, [f"e{i}", f"e{i + 1}"]) for i in range(40) for r in "ab"], "page string, target string, kind string, relation string, evidence array<string>")
    live, gone = spark.createDataFrame([(f"e{i}",) for i in range(20)], "evidence_id string"), spark.createDataFrame([("p3",)], "page string")
    found = increments.withdrawn_links(links, live, gone, parts=7)
    supported = [(f"p{i}", f"t{i % 5}", "supported_relation", r, sorted(f"e{j}" for j in (i, i + 1) if j < 20)) for i in range(20) if i != 3 for r in "ab"]
    assert sorted(map(tuple, found.collect())) == sorted(supported + [(f"p{i}", f"t{i % 5}", "navigation", "", []) for i in range(20, 40)])
    assert found.rdd.getNumPartitions() == 7
