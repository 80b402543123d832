"""Joins of names against all pairs, cycles against strongly connected components, names and values of personal data."""

import random

from quern.operators import catalog, discovery, governance, graph


def test_names_bound_as_all_pairs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abC_") for _ in range(rng.randrange(1, 6)))
    terms, columns = [(word(), word()) for _ in range(60)] + [("", "x"), ("x", None)], [word() for _ in range(80)] + ["", "x"]
    found = {(r.term, r.column_name): r.score for r in catalog.bound(spark.createDataFrame(terms, "term string, alias string"), spark.createDataFrame([(c,) for c in columns], "column_name string")).collect()}
    expected = {}
    for t, a in terms:
        for c in columns:
            x, y = t.lower(), c.lower()
            score = 1.0 if x == y != "" else 0.8 if x and y and (x in y or y in x) else 0.7 if y and a is not None and a.lower() == y else 0
            if score:
                expected[t, c] = max(score, expected.get((t, c), 0))
    assert found == expected and len(set(found.values())) == 3


def test_suffix_candidates_as_all_pairs(spark):
    rng = random.Random(2)
    columns = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))), "".join(rng.choice("abc") for _ in range(rng.randrange(2, 7))) + rng.choice(["_id", "_key", "code", ""])) for _ in range(60)]
    found = {(r.table_name, r.column_name, r.parent): r.fit for r in discovery.suffix_candidates(spark.createDataFrame(columns, "table_name string, column_name string")).collect()}
    import re

    expected = {}
    for t, c in set(columns):
        if re.search("(key|id|code)$", c) and len(stem := re.sub("^[a-z]_|_?(key|id|code)$", "", c)) >= 3:
            fits = sorted((0 if p == stem else 1 if p.startswith(stem) or stem.startswith(p) else 2, p) for p in {x for x, _ in columns} if p != t and (p in stem or stem in p))
            expected |= {(t, c, p): f for f, p in fits[:5]}
    assert found == expected and len(found) > 30


def test_cycles(spark):
    rng = random.Random(3)
    for n, m in ((12, 14), (25, 30), (8, 20), (6, 4)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 105), (105, 104), (200, 200)]
        reach = {x: {b for a, b in edges if a == x} for x in {y for e in edges for y in e}}
        for _ in reach:
            reach = {x: s | {z for y in s for z in reach[y]} for x, s in reach.items()}
        found = [r.node for r in graph.cyclic(spark.createDataFrame(edges, "src int, dst int")).collect()]
        assert sorted(found) == sorted(x for x in reach if x in reach[x])
    assert graph.cyclic(spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")).count() == 0


def test_names_of_personal_data(spark):
    names = ["salary", "passport_no", "name", "user_name", "full_name", "tel", "mail", "phone_id", "id_card_no", "email_address", "客户姓名", "住址2", "account_no", "cname", "mobilephone", None, "Birth-Day", "login_surname"]
    found = {r.column_name: (r.kind, r.level, tuple(r.tags or ())) for r in governance.named_kinds(spark.createDataFrame([(n,) for n in names], "column_name string")).collect()}
    kinds = {n: k for n, (k, *_) in found.items() if k}
    assert kinds == {"salary": "salary", "passport_no": "passport", "name": "name", "full_name": "name", "id_card_no": "id_card", "email_address": "email", "客户姓名": "name", "住址2": "address", "account_no": "bank_card", "Birth-Day": "birth"}
    assert found["passport_no"][1:] == ("secret", ("PII", "PASSPORT")) and found["tel"] == (None, None, ())


def test_known_patterns_find_what_the_plain_ones_do(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123456789X.@a +-市") for _ in range(rng.randrange(0, 60))) for _ in range(800)] + ["x@y.zz", "11010519491231002X", "13800138000", None, "a" + "1" * 17 + "x", "1" * 17 + "xx", "a 192.168.0.1 b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = {k: rows.where(rows.text.rlike(p)).count() for k, p in governance.PATTERNS.items()}
    assert {r.kind: r.rows_hit for r in governance.scan(rows, "text").collect()} == plain and min(plain.values()) > 0
