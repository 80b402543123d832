"""Base scores by brute force; the model's probabilities sum to one and beat the base on held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import maxent


def corpus(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        tongue = rng.choice(["en", "de", "ña"])
        words = [rng.choice(["the", "of", "x", f"w{rng.randrange(200)}"]) + tongue for _ in range(rng.randrange(1, 120))]
        rows.append((i, " ".join(w.title() if rng.random() < 0.1 else w for w in words)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "Neverseenbefore word" + "q" * 5000), (None, "the of"), rows[0]]


@pytest.fixture(scope="module")
def rows():
    return corpus(300)


def test_base_scores(spark, rows, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 40)  # most words by the shuffle
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, row string, n_tokens int")
    found = maxent.scored(docs).collect()
    lower = [(i, (t or "").encode().lower().split()) for i, t in rows]
    counts, ends = Counter(), 0
    for i, words in lower:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            counts.update(words)
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    expected = sorted(
        (str(i), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, round(sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w) + math.log10((ends + 1) / (total + kinds + 1)), 6))
        for i, w in lower
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == expected
    assert {r.train_tokens for r in found} == {total}
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id is not null")
    words = maxent.count_words(docs)
    counts = maxent.summed(words, docs.count())
    weights, bits = maxent.train(docs, counts, rounds=1), counts.bits
    known = {r["mark"]: (r["cls"], r["n"]) for r in words.collect()}
    lexicon = maxent.Lexicon(counts)
    one, two = (np.array([lexicon[w] for w in x.split()]) for x in (b"theen ofen w3en newen", b"theen w9de theen new"))
    lexicon.settle()
    total = 0
    for leaf in range(maxent.CLASSES * maxent.SLOTS):
        lexicon.leaves[0] = leaf
        own = maxent.token_logs(weights, counts.priors(), lexicon, np.zeros(len(one), int), one, two, bits)
        total = total + np.exp(own)
    assert np.allclose(total, 1, atol=1e-3)
    inside = np.zeros(maxent.CLASSES * maxent.SLOTS)
    for word, (group, n) in known.items():
        inside[counts.singles.get(word, maxent.leaf(group))] += n + 1
    inside[maxent.END] = counts.ends + 1
    inside[maxent.leaf(np.arange((maxent.CLASSES - 1) * (maxent.SLOTS - maxent.OWN)))] += 1  # the unknown word of each shared slot
    assert np.allclose(inside, counts.mass)


def test_every_training_token_is_learned_once(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = maxent.summed(maxent.count_words(docs), docs.count())
    seen = spark.sparkContext.accumulator(0)
    learn = maxent.learn

    def counted(*parts):
        n = learn(*parts)
        seen.add(n)
        return n

    run = maxent.train.__globals__
    monkeypatch.setitem(run, "learn", counted)
    maxent.train(docs, counts)
    assert seen.value == counts.tokens == sum(len((t or "").split()) + 1 for _, t in rows)


def test_what_comes_before_tells_what_follows(spark):
    rng = random.Random(5)
    after = {f"w{i}": f"w{rng.randrange(300)}" for i in range(300)}
    texts = []
    for i in range(900):
        words = [f"w{rng.randrange(300)}"]
        for _ in range(60):
            words.append(after[words[-1]] if rng.random() < 0.9 else f"w{rng.randrange(300)}")
        texts.append((i, " ".join(words)))
    held = maxent.scored(spark.createDataFrame(texts, "doc_id long, text string")).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.5  # in log10 for each token; the words alone tell nothing


def test_empty_table(spark):
    assert maxent.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(maxent, "LEAST_TOKENS", 1500)  # several blocks, and averages of averages
    monkeypatch.setattr(maxent, "FAN", 3)
    rng = random.Random(7)
    texts = [(i, " ".join(f"w{min(rng.randrange(200), rng.randrange(200))}" for _ in range(rng.randrange(0, 90)))) for i in range(400)] + [(500 + i, "the same text again") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    told = [{r.doc_id: r.score for r in maxent.scored(rows).collect()} for rows in (docs.coalesce(1), docs.repartition(8), docs.orderBy(F.rand(3)).repartition(64))]
    assert all(abs(told[0][k] - t[k]) <= 1e-3 for t in told[1:] for k in told[0]) and told[0].keys() == told[1].keys() == told[2].keys()
    counts = maxent.summed(maxent.count_words(docs.select("doc_id", "text")), docs.count())
    assert maxent.blocks_of(counts, 2) > 4


def test_a_step_adds_up_what_falls_to_one_row_and_endings_are_hashed_once():
    rng = np.random.default_rng(5)
    for kinds in (1, 7, 5000):
        rows, z = [rng.integers(0, kinds, 600) for _ in range(3)], rng.normal(size=(600, 8)).astype(np.float32)
        chosen, weights, squares = rng.integers(0, 8, 600), rng.normal(size=(5000, 8)).astype(np.float32), rng.random(5000).astype(np.float32)
        p = np.exp(z.astype(np.float64))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(600), chosen] -= 1
        met, wanted = squares.astype(np.float64), weights.astype(np.float64)
        for r in rows:
            np.add.at(met, r, (p * p).sum(axis=1))
        for r in rows:
            np.add.at(wanted, r, -0.4 * p / np.sqrt(met[r] + 1)[:, None])
        maxent.step(weights, squares, rows, z, chosen, 0.4)
        assert np.allclose(weights, wanted, atol=1e-3) and np.allclose(squares, met, rtol=1e-4)
    maxent.ending.cache_clear()
    assert len({maxent.group(w + b"tion") for w in (b"na", b"sta", b"mo")}) == 1 and maxent.ending.cache_info().misses == 1


def test_gradients_of_rows_met_any_number_of_times():
    rng = np.random.default_rng(8)
    times = [1, 1, 2, 3, maxent.WIDE - 1, maxent.WIDE, maxent.WIDE + 1, 3 * maxent.WIDE]
    rows = [rng.permutation(np.repeat(np.arange(len(times)) * 1000 + 7, times))]
    n = len(rows[0])
    z, chosen = rng.normal(size=(n, 8)).astype(np.float32), rng.integers(0, 8, n)
    weights, squares = rng.normal(size=(9000, 8)).astype(np.float32), np.zeros(9000, np.float32)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    p[np.arange(n), chosen] -= 1
    met, change = np.zeros(9000), np.zeros((9000, 8))
    np.add.at(met, rows[0], (p * p).sum(axis=1))
    np.add.at(change, rows[0], p)
    wanted = weights - 0.4 * change / np.sqrt(met + 1)[:, None]
    maxent.step(weights, squares, rows, z, chosen, 0.4)
    assert np.allclose(weights, wanted, atol=1e-5) and np.allclose(squares, met, rtol=1e-5)


def test_words_that_are_remembered_are_not_copied_by_each_batch():
    counts = maxent.Counts(9, 2, 1, np.sort(maxent.marked([b"a", b"tea"])), np.log10([3.0, 4.0]), {maxent.mark(b"tea"): 5}, np.ones(maxent.CLASSES * maxent.SLOTS))
    assert maxent.marked([b"a", b"", "ñ".encode()]).tolist() == [maxent.mark(w) for w in (b"a", b"", "ñ".encode())]
    lexicon, made, held = maxent.Lexicon(counts), 0, None
    for i in range(0, 3000, 10):
        lexicon.read([b" ".join(b"w%d" % k for k in range(i, i + 10)), b"a tea"])
        made, held = made + (lexicon.marks is not held), lexicon.marks
    words = list(lexicon)
    assert lexicon.marks[2 : len(words)].tolist() == maxent.marked(words[2:]).tolist() and made < 30
    assert lexicon.leaves[lexicon[b"tea"]] == 5 and lexicon.leaves[lexicon[b"w77"]] == maxent.leaf(maxent.group(b"w77"))
    assert lexicon.logs[lexicon[b"w77"]] == -1 and lexicon.logs[lexicon[b"a"]] >= 0
