"""Recall against brute force, exact scores and ties, rows that take no part."""

import math

import numpy as np
import pytest

from quern.llm import ann


def brute(rows, asked, k):
    good = {key: np.array(v, float) for key, v in rows if key is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    found = {}
    for q in asked & good.keys():
        scores = sorted((-float((v * good[q]).sum()), key) for key, v in good.items() if key != q)[:k]
        found[q] = [(key, -s) for s, key in scores]
    return found


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    data = (rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))).astype(np.float32)
    data[400:460] = data[10]  # copies: ties
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 3]
    return rows + [(20 * (i + 100), v) for i, v in enumerate(odd)] + [(None, rows[5][1]), rows[7]]


@pytest.mark.parametrize("block", [200, 16_384])
def test_recall_scores_and_ties(spark, rows, monkeypatch, block):
    monkeypatch.setattr(ann, "CANDIDATES", block)
    monkeypatch.setattr(ann, "QUERIES", block // 4)
    vectors = spark.createDataFrame([(k, v, 0.5) for k, v in rows], "vec_id long, embedding array<float>, length double")
    indexed = ann.index(vectors, 16)
    found = {}
    for r in ann.search(indexed, indexed.where("key % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = brute(rows, {k for k, _ in rows if k is not None and k % 20 == 0}, 20)
    assert found.keys() == expected.keys()
    hits = sum(len({k for k, _ in found[q]} & {k for k, _ in expected[q]}) for q in expected)
    assert hits >= 0.97 * 20 * len(expected)
    assert [k for k, _ in found[400]] == [k for k, _ in expected[400]]
    for q in found:
        exact = dict(expected[q])
        assert all(k not in exact or abs(exact[k] - s) < 1e-12 for k, s in found[q])


def test_few_candidates_and_empty_table(spark):
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    indexed = ann.index(few, 2)
    rows = ann.search(indexed, indexed.where("key = 0"), 20).collect()
    assert sorted((r.rank, r.vec_id) for r in rows) == [(1, 1), (2, 2), (3, 3)]
    assert ann.search(ann.index(few.limit(0), 2), indexed, 20).count() == 0


def test_ids_of_other_widths_and_repeated_ones(spark):
    rng = np.random.default_rng(2)
    data = [[float(x) for x in v] for v in rng.normal(size=(30, 64))]
    rows = [(i, v) for i, v in enumerate(data)] + [(3, data[9]), (3, data[3])]
    indexed = ann.index(spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(3), dim=64)
    found = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(indexed, indexed.where("key = 7"), k=29).collect()}
    kept = dict(enumerate(data)) | {3: min(data[3], data[9])}
    expected = sorted((-float(np.dot(v, data[7])), i) for i, v in kept.items() if i != 7)
    assert [found[7, r + 1] for r in range(29)] == [i for _, i in expected]
