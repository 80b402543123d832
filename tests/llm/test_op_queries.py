"""The registered opN queries, with their production parameters, against brute force over small tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_repeats import brute as repeated
from test_simhash import brute as classes

from quern.llm import bpe, queries


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("aeinorstéü") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages, docs = [some(60), some(24)], []
    for i in range(110):
        words = some(rng.randrange(0, 130))
        for p in passages:
            if rng.random() < 0.3:
                words[len(words) // 2 : len(words) // 2] = p
        if i % 9 == 8:
            words = docs[-1][1].split(" ")[: rng.randrange(1, 200)]
        docs.append((i, " ".join(words) + ("\n%%%%%%%% %%%%%%" if i % 4 == 0 else ""), rng.choice("xyz")))
    docs += [(200, None, None), (201, "", "x"), (202, "One " * 400, "y"), (203, docs[5][1], "x")]
    labels = [(i, int("%" not in (t or "")), 0) for i, t, _ in docs if i % 3]
    data = np.random.default_rng(4).normal(size=(400, 64))
    data[50:90] = data[3]
    vectors = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(data)] + [(400, None), (401, [0.0] * 64), (402, [float("nan")] * 64)]
    at = tmp_path_factory.mktemp("tables")
    for name, rows, kind in (
        ("documents", docs, "doc_id long, text string, source string"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("embeddings", vectors, "vec_id long, embedding array<float>"),
    ):
        spark.createDataFrame(rows, kind).write.parquet(f"{at}/{name}.parquet")
    return str(at), docs, vectors


def test_op1(spark, tables):
    own = bpe.vocabulary(queries.RANKS, public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    expected = {(i, len(ids := known.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, _ in tables[1]}
    assert {tuple(r) for r in queries.op1_bpe(spark, tables[0]).collect()} == expected


def test_op3(spark, tables):
    expected = set()
    for (key, text), (units, gone) in repeated([(i, t) for i, t, _ in tables[1]], 100, list).items():
        runs = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        expected.add((key, len((text or "").encode()), sum(gone), runs, sha(bytes(u for u, g in zip(units, gone, strict=True) if not g))))
    assert sum(x[2] for x in expected) > 2000
    assert {tuple(r) for r in queries.op3_suffix_dedup(spark, tables[0]).collect()} == expected


def test_op4(spark, tables):
    good = {k: np.array(v, float) for k, v in tables[2] if v and all(math.isfinite(x) for x in v) and any(v)}
    found, hits = defaultdict(list), 0
    for r in queries.op4_ann(spark, tables[0]).orderBy("query_id", "rank").collect():
        assert r.score == pytest.approx(float((good[r.query_id] * good[r.vec_id]).sum()), abs=1e-12)
        found[r.query_id].append(r.vec_id)
    asked = [k for k in good if k % 20 == 0]
    for q in asked:
        expected = [k for _, k in sorted((-float((v * good[q]).sum()), k) for k, v in good.items() if k != q)[:20]]
        assert len(found[q]) == 20 and q not in found[q]
        hits += len(set(expected) & set(found[q]))
    assert found.keys() == set(asked) and hits / len(asked) / 20 >= 0.9


def test_op5(spark, tables):
    expected = {(k, f"{fp % 2**64:016x}", least) for k, fp, least in classes([(i, t) for i, t, _ in tables[1]], 4, 4)}
    assert {tuple(r) for r in queries.op5_simhash(spark, tables[0]).collect()} == expected


def test_op6(spark, tables):
    expected = set()
    for (key, _), (units, gone) in repeated([(i, t) for i, t, _ in tables[1]], 20, bytes.split).items():
        expected.add((key, len(units), sum(gone), sha(b" ".join(u for u, g in zip(units, gone, strict=True) if not g))))
    assert sum(x[2] for x in expected) > 300
    assert {tuple(r) for r in queries.op6_substring_dedup(spark, tables[0]).collect()} == expected


def test_op7(spark, tables):
    rows = queries.op7_quality(spark, tables[0]).collect()
    assert {r.doc_id for r in rows} == {i for i, _, _ in tables[1]}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    bad = {i for i, t, _ in tables[1] if "%" in (t or "")}
    assert sum((r.doc_id in bad) != r.predicted for r in rows) / len(rows) >= 0.9


def test_op9(spark, tables):
    docs = tables[1]
    found = {r.doc_id: r for r in queries.op9_fingerprints(spark, tables[0]).collect()}
    for n, (key, text, _) in enumerate(docs):
        own, after = text or "", docs[(n + 1) % len(docs)][1] or ""
        edited, r = own[: len(own) - len(own) // 2] + after[: len(own) // 2], found[key]
        assert (r.n_chars, r.edited_sha256) == (len(own), sha(edited.encode())) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(found) == len(docs) and found[5].fingerprint == found[203].fingerprint and found[200].fingerprint == found[201].fingerprint


def test_op10(spark, tables):
    rows = queries.op10_maxent(spark, tables[0]).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _, _ in tables[1])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.n_known <= r.n_tokens and r.score < 0 for r in rows)
