"""Signatures of many texts at once, most alike documents and totals in intervals, against plain Python."""

import random

from pyspark.sql import functions as F

from quern.operators import discovery, documents


def test_signatures_of_many_texts_are_those_of_each():
    rng = random.Random(3)
    texts = [None, "", "abc", "Abcde", "ab" * 900, "x" * 70, "㐀é ﬁne \U0001f600" * 9]
    texts += ["".join(rng.choice("abcdefg \n") for _ in range(rng.randrange(400))) for _ in range(60)]
    large = "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))
    for some in (texts, [*texts, large]):
        assert documents.signatures_of(some, {}) == [documents.signature(t) for t in some]
    assert documents.signatures_of(texts, {}, most=100) == [documents.signature(t, most=100) for t in texts]
    assert [list(range(*x)) for x in documents.together([1, 2, 9, 1], 3)] == [[0, 1], [2], [3]]


def test_grams_of_a_text_are_hashed_once(monkeypatch):
    asked, plain = [], documents.hashlib.blake2b
    monkeypatch.setattr(documents.hashlib, "blake2b", lambda gram, **how: asked.append(gram) or plain(gram, **how))
    documents.signatures_of(["abcdefgh" * 500] * 3, {})
    assert len(asked) == len(set(asked)) == 8


def test_most_alike_against_all_pairs(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for i in range(12):
        lines = [f"line {rng.randrange(40)} of the text, which says {'yes no maybe'.split()[rng.randrange(3)]}" for _ in range(rng.randrange(1, 14))]
        rows.append((len(rows), "\n".join(lines)))
        for _ in range(rng.randrange(4)):
            copy = list(lines)
            copy[rng.randrange(len(copy))] += rng.choice(["", "!", " and more"])
            rows.append((len(rows), "\n".join(copy)))
    rows += [(100 + i, rows[0][1]) for i in range(15)] + [(200, None), (201, ""), (202, ""), (None, rows[0][1])]
    met, sharing = [], documents.sharing
    monkeypatch.setattr(documents, "sharing", lambda *x: met.append(sharing(*x)) or met[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, documents.alike(docs, docs.where("doc_id % 2 = 0"), 0.8, 10).collect()))
    marks = {k: documents.signature(t) for k, t in rows if k is not None}
    expected = []
    for q, text in rows:
        if q is None or q % 2 or marks[q] is None:
            continue
        rated = []
        for d, other in rows:
            if d in (None, q) or marks[d] is None or (bits := (marks[q] ^ marks[d]).bit_count()) > 16:
                continue
            a, b = text.split("\n"), other.split("\n")
            ratio = round(2 * sum(min(a.count(x), b.count(x)) for x in set(a)) / (len(a) + len(b)), 6)
            if ratio >= 0.8:
                rated.append((-ratio, -d, round(1 - bits / 64, 6)))
        expected += [(q, -d, near, -ratio, i + 1) for i, (ratio, d, near) in enumerate(sorted(rated)[:10])]
    assert len(expected) > 100 and found == sorted(expected)
    assert met[0].count() < 60  # equal texts are one, and texts without a line in common do not meet


def test_totals_in_intervals(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(2), 3600 * rng.randrange(200), float(rng.randrange(9))) for _ in range(300)]
    spans = [(rng.randrange(2), 3600 * (s := rng.randrange(200)), 3600 * (s + rng.randrange(-2, 30)), i // 2) for i in range(60)] * 2
    at = lambda c: F.timestamp_seconds(c).alias(c)
    known = spark.createDataFrame(rows, "k int, at long, v double").select("k", at("at"), "v")
    asked = spark.createDataFrame(spans, "k int, first long, last long, name int").select("k", at("first"), at("last"), "name")
    found = {r.name: (r.n, r.total) for r in discovery.totals_in_interval(known, asked, "k", "at", "name", "v").collect()}
    expected = {}
    for k, first, last, name in spans:
        held = [v for key, t, v in rows if key == k and first <= t <= last]
        if held:
            n, total = expected.get(name, (0, 0.0))
            expected[name] = (n + len(held), total + sum(held))
    assert found == expected
    joined = discovery.totals_in_interval(known.withColumn("at", F.lit(0).cast("timestamp")), asked, "k", "at", "name", "v")
    assert joined.count() == len({n for k, first, last, n in spans if first <= 0 <= last})
