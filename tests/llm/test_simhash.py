"""Fingerprints and classes against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from quern.llm import simhash, similar
from quern.llm.components import components


def plain(text, words):
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not tokens:
        return 0
    hashes = [xxhash.xxh64(b" ".join(tokens[i : i + words]), seed=42).intdigest() for i in range(max(1, len(tokens) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, words, radius):
    prints = [plain(t, words) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {}
    for (key, _), g in zip(rows, group, strict=True):
        if key is not None:
            least[g] = min(key, least.get(g, key))
    return {(key, prints[n] - (prints[n] >> 63 << 64), least.get(group[n])) for n, (key, _) in enumerate(rows)}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" if i % 3 else f"Ü{i}" for i in range(60)]
    texts = [None, "", " \t\n", "One two", "one TWO"]
    for _ in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))]
        texts.append(" ".join(text))
        for _ in range(rng.randrange(3)):
            copy = list(text)
            copy[rng.randrange(len(copy))] = "x"
            texts.append("  ".join(copy))
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, texts[9]), (None, "alone by itself with no key")]


def test_classes_as_brute_force(spark):
    rows = corpus(3, 60)
    docs = spark.createDataFrame([(k, t, 0, "z") for k, t in rows], "doc_id long, text string, fp int, component string")
    found = simhash.near_duplicates(docs, 4, 4).collect()
    assert len(found) == len(rows)
    assert {tuple(r) for r in found} == brute(rows, 4, 4)


def test_tiles_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3000, 4), dtype=np.uint64), axis=1)
    fps = np.unique(np.concatenate([base, base ^ flips, base[:5]]))
    q = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int64)
    classes, inverse, n = np.unique(q, axis=0, return_inverse=True, return_counts=True)
    first, parts, boxes = simhash.tiles(np.column_stack([classes, n]), 200)
    assert (parts == 1).all()
    tile = first[inverse]
    touch = simhash.near(boxes[:, 0], boxes[:, 1], 4)
    for i in range(0, len(fps), 7):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            assert touch[tile[i], tile[j]]
    u, v = simhash.forest(fps[::2], fps[1::2], 4)
    assert 0 < len(u) <= len(fps) and (u != v).all()


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    found = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {(i, 0) for i in range(201)} | {(1000 + i, 1000) for i in range(300)}


def test_rounds_of_components_take_few_tasks(spark):
    width, adaptive = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {k: spark.conf.get(k) for k in (width, adaptive)}
    spark.conf.set(width, "64")
    spark.conf.set(adaptive, "false")
    spark.sparkContext.setJobGroup("components", "")
    try:
        found = {tuple(r) for r in components(spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "c"), ("y", "x"), ("x", "y")], "src string, dst string")).collect()}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {(x, "a") for x in "abcd"} | {(x, "x") for x in "xy"}
    tracker = spark.sparkContext.statusTracker()
    stages = {s: tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    assert sum(1 for x in stages.values() if x and x.numTasks >= 64 and x.numCompletedTasks) <= 4  # to make edges distinct, to write and count them


def jaccard(a, b):
    one, two = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((x or "").lower().split() for x in (a, b)))
    return len(one & two) / len(one | two) if one | two else 1.0


def test_keep_one_of_each_group(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(60, 400))]
        rows.append((i * 10, " ".join(words)))
        for j in range(i % 4):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "other"
            rows.append((i * 10 + j + 1, " ".join(copy)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), rows[2]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sketch string")
    kept = simhash.keep_one(docs).collect()
    ids = [r.doc_id for r in kept]
    assert None in ids and len(ids) == len(set(ids)) and {i * 10 for i in range(60)} <= set(ids) and len({900, 901} & set(ids)) == 1
    texts = dict(rows[:-2])
    for key, text in texts.items():
        near = [k for k in ids if k is not None and k != key and jaccard(text, texts[k]) >= 0.9]
        assert (not near) if key in ids else any(jaccard(text, t) >= 0.7 for k, t in texts.items() if k != key)
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_at_the_limit_as_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(80):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 300))]
        passage = [f"p{j}" for j in range(30)] if i % 3 else []
        rows.append((len(rows), " ".join(words + passage)))
        for share in (0.75, 0.79, 0.8, 0.81, 0.83, 0.85)[: i % 7]:
            copy, n = list(words), len(words)
            cut = max(1, round((1 - share) / (1 + share) * n))
            at = rng.randrange(n - cut + 1)
            copy[at : at + cut] = [f"x{rng.randrange(10**6)}" for _ in range(cut)]
            rows.append((len(rows), " ".join(copy + passage)))
    group, pairs = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            if (likeness := jaccard(rows[i][1], rows[j][1])) >= 0.8:
                pairs += likeness < 0.85
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    kept = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert pairs > 30 and sorted(kept) == sorted(set(group))


@pytest.mark.parametrize("cell,small,tile", [(3, 4, 5), (2, 1, 2), (32, 64, 512)])
def test_a_large_group_of_near_copies(spark, monkeypatch, cell, small, tile):
    """Copies of one text with edits each of their own: some pairs are alike enough, most are not, and all share many shingles."""
    for name, value in (("CELL", cell), ("SMALL", small), ("TILE", tile)):
        monkeypatch.setattr(similar, name, value)
    rng, rows = random.Random(31), []
    for base in range(2):
        words = [f"b{base}w{j}" for j in range(140)]
        for _ in range(70):
            copy = list(words)
            for at in rng.sample(range(140), rng.randrange(1, 5)):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    group, pairs = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                pairs += 1
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    kept = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert 100 < pairs < 4000 and len(set(group)) > 10 and sorted(kept) == sorted(set(group))


def test_keep_one_asks_fingerprints_first(spark, monkeypatch):
    """Near copies within the radius are proposed by fingerprints and decided by sets; what lies further apart is found all the same."""
    rng, rows = random.Random(5), []
    for i in range(20):
        words = [f"w{rng.randrange(9000)}" for _ in range(400)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words[:-1], "end"])), (3 * i + 2, " ".join(words[:355] + ["x"] * 10))]
    asked, proposed, of = [], [], similar.by_fingerprint
    monkeypatch.setattr(simhash, "links", lambda nodes, radius, plain=simhash.links: asked.append(radius) or plain(nodes, radius))
    monkeypatch.setattr(similar, "by_fingerprint", lambda sets, close: proposed.append(of(sets, close)) or proposed[0])
    kept = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert asked == [4] and proposed[0].count() >= 15 and sorted(kept) == [3 * i for i in range(20)]


def test_pairs_are_read_by_few_tasks(spark):
    pairs = similar.noted(spark.range(0, 640, 1, 64))
    assert pairs.rdd.getNumPartitions() == 8 and sorted(r.id for r in pairs.collect()) == list(range(640))
