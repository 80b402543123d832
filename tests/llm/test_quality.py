"""The network against plain convolution, its gradients' effect by held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np

from quern.llm import quality


def plain(net, text):
    data = quality.covered(text)
    chunks = []
    for start in range(0, len(data) - quality.CHUNK, quality.STRIDE * quality.STEP):
        best = [
            max(sum(float(net.filters[j, data[start + i + j], f]) for j in range(quality.WIDTH)) for i in range(quality.CHUNK))
            for f in range(net.filters.shape[2])
        ]
        chunks.append(float(np.maximum(np.array(best) + net.bias, 0) @ net.weights))
    return 1 / (1 + np.exp(-float(net.combine @ np.array([np.mean(chunks), max(chunks), min(chunks), 1]))))


def test_scores_are_those_of_plain_convolution():
    rng = np.random.default_rng(1)
    net = quality.Network(rng.normal(0, 1, (quality.WIDTH, 256, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32), np.array([0.5, -0.4, 0.3], np.float32), np.array([1, 0.5, -0.2, 0.1], np.float32))
    for text in (b"", b"a", b"x" * 255, b"y" * 257, bytes(range(256)) * 3):
        data = quality.covered(text)
        assert len(data) >= len(text) + quality.WIDTH - 1
        assert abs(quality.score(net, quality.paired(net), text) - plain(net, text)) < 1e-4


def corpus(n):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(5, 200))]
        bad = i % 3 == 0
        rows.append((i, " ".join(w + rng.choice(["###", "%%%"]) if bad and rng.random() < 0.6 else w for w in words), int(not bad)))
    return rows


def test_held_out_accuracy_and_columns(spark):
    rows = corpus(500)
    docs = spark.createDataFrame([(i, t, "src", float(i), q) for i, t, q in rows] + [(900, None, "s", None, 0), (None, "", "s", None, 0), (1, rows[1][1], "s", 1.0, 0)], "doc_id long, text string, source string, score double, quality int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, labels)
    found = quality.scored(docs, net, column="p").collect()
    assert len(found) == 503 and found[0].score == 0.0 and all(0 <= r.p <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 500 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.p >= 0.3) == bool(r.quality) for r in held) >= 0.95 * len(held) - 1
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and 300 < kept.count() < 360


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.accepted(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a")], docs.schema)
    assert quality.scored(some, quality.fit(some, labels)).first().score == 0.5
