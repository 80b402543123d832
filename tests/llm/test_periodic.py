"""Runs against all stretches tried one by one, the query of op13 against a plain version, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import periodic, queries


def brute(s):
    found = {}
    for q in range(1, len(s) // 2 + 1):
        x = 0
        while x + q < len(s):
            y = x
            while y + q < len(s) and s[y] == s[y + q]:
                y += 1
            if y + q - x >= max(12, 2 * q):
                found[x, y + q] = min(q, found.get((x, y + q), q))
            x = y + 1
    return sorted(((x, y - x, q) for (x, y), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_kept(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12).flatmap(lambda x: st.integers(1, 5).map(lambda k: x * k)), max_size=9))
def test_runs_of_few_letters(parts):
    s = [x for p in parts for x in p]
    assert periodic.runs(s) == brute(s)
    words = [b"%d" % x for x in s]
    both = periodic.of_texts([words, [], words[::-1], words])
    assert both == [brute(s), [], brute(s[::-1]), brute(s)]
    assert periodic.kept(words, both[0]) == plain_kept(words, both[0])


def test_runs_in_random_words():
    rng = random.Random(5)
    for _ in range(60):
        s = []
        while len(s) < rng.randrange(20, 400):
            part = [rng.randrange(40) for _ in range(rng.randrange(1, 40))]
            s += part * rng.choice([1, 1, 1, 2, 3]) + part[: rng.randrange(len(part))] * rng.randrange(2)
        assert periodic.of_texts([[b"%d" % x for x in s]])[0] == brute(s)


def test_long_periodic_texts():
    same = [b"a"] * 20_000
    assert periodic.of_texts([same]) == [[(0, 20_000, 1)]]
    block = [b"%d" % x for x in np.random.default_rng(1).integers(0, 900, 3000)]
    assert periodic.of_texts([[b"x", *block * 3, b"y"]])[0] == [(1, 9000, 3000)]


def expected(key, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found).encode()
    return key, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(b" ".join(plain_kept(words, found)))


def test_op13(spark, tmp_path):
    rng = random.Random(8)
    rows = [(100, None), (101, ""), (102, " \t\n"), (103, "a " * 30), (104, "b"), (105, "x y " * 6), (106, "x y " * 5), (107, "é ü " * 14 + "\x0b\x1c q")]
    for i in range(60):
        words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 120))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words[:50] + words[10:30] * rng.randrange(4) + words[50:])))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 3
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_periodic(spark, str(tmp_path)).collect()
    assert found[0].asDict().keys() == {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}
    assert {tuple(r) for r in found} == {expected(*r) for r in rows}


def test_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 12, "own", 5), (1, "a " * 12, "own", 5), (None, None, None, None)], "doc_id long, text string, collapsed string, start int")
    found = periodic.detected(docs).collect()
    assert [(r.doc_id, r.start, [tuple(x) for x in r.runs], r.collapsed) for r in found] == [(1, 5, [(0, 12, 1)], "a"), (1, 5, [(0, 12, 1)], "a"), (None, None, [], "")]
    assert periodic.detected(docs.limit(0)).count() == 0
