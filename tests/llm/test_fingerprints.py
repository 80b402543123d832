"""Edited texts exactly, likeness against generalised Jaccard, in plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest

from quern.llm import fingerprints
from quern.llm.order import successors


def jaccard(a, b):
    one, two = (Counter(w for w in re.split(r"[\x20\x09-\x0d]+", x) if w) for x in (a, b))
    every = set(one) | set(two)
    return sum(min(one[w], two[w]) for w in every) / sum(max(one[w], two[w]) for w in every) if every else 1.0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "bé", "😀", "c"]) + str(rng.randrange(60)) for _ in range(rng.randrange(1, 150))) for _ in range(120)]
    return [(i * 7 - 20, t) for i, t in enumerate([*texts, None, "", "x", texts[3], " \t "])]


def test_edited_texts_and_likeness(spark, rows):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, next_id string")
    found = {r.doc_id: r for r in fingerprints.compared(docs, 32).collect()}
    assert len(found) == len(rows)
    off = []
    for n, (key, text) in enumerate(rows):
        own, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        r = found[key]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if own == edited:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1.0
        off += [r.near_edited - jaccard(own, edited), r.near_next - jaccard(own, after)]
    assert abs(sum(off) / len(off)) < 0.02 and sum(x * x for x in off) / len(off) < 0.01
    assert found[rows[3][0]].fingerprint == found[rows[123][0]].fingerprint
    assert found[rows[120][0]].fingerprint == found[rows[121][0]].fingerprint == ""


def test_repeated_rows_null_keys_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d e f"), (2, "x y")], "doc_id long, text string")
    found = fingerprints.compared(docs).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "2", "None"]
    assert next(r for r in found if r.doc_id is None).near_next is None
    assert fingerprints.compared(docs.limit(0)).count() == 0


def test_successors(spark):
    keys = spark.createDataFrame([(i * i % 1009,) for i in range(2000)] + [(None,)], "k long")
    ranked = sorted({i * i % 1009 for i in range(2000)})
    assert {tuple(r) for r in successors(keys).collect()} == set(zip(ranked, ranked[1:] + ranked[:1], strict=True))


def test_likeness_of_long_texts(spark):
    rng, rows, true = random.Random(3), [], []
    for pair in range(8):
        known = [f"{pair}-{i}" for i in range(10_000)]
        other = [w if rng.random() < 0.7 else f"x{w}" for w in known]
        texts = [" ".join(w for i, w in enumerate(words) for _ in range(max(1, 1000 // (i + 1)))) for words in (known, other)]
        rows += [(2 * pair + i, t) for i, t in enumerate(texts)]
        true.append(jaccard(*texts))
    made = fingerprints.signatures(spark.createDataFrame(rows, "k long, text string").repartition(8), ["k"], samples=128)
    found = {r.k: r.signature for r in made.collect()}
    near = [sum(a == b for a, b in zip(found[2 * i], found[2 * i + 1], strict=True)) / 128 for i in range(8)]
    assert abs(sum(near) - sum(true)) / 8 < 0.04
