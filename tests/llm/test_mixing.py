"""Weights by closed forms and entropy, the schedule against a plain walk through the permutations."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from quern.llm import mixing


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    sources = ["big"] * 300 + ["mid"] * 60 + ["small"] * 12 + [None] * 30
    return [(i if i else None, s, rng.randrange(1, 50)) for i, s in enumerate(sources)]


def totals(rows):
    found = Counter()
    for _, source, n in rows:
        found[source] += n
    return found


def plain(rows, budgets, blocks, seed=1):
    stream = defaultdict(list)
    for source, budget in budgets.items():
        spent, epoch = 0, 0
        while spent < budget:
            place = lambda r, epoch=epoch: hashlib.md5(f"{seed}:{epoch}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
            for key, _, n in sorted((r for r in rows if r[1] == source), key=place):
                if spent >= budget:
                    break
                stream[math.floor(spent / budget * blocks)].append((place((key,)), str(source), key, epoch))
                spent += n
            epoch += 1
    return {(source, key, epoch, block, slot) for block, held in stream.items() for slot, (_, source, key, epoch) in enumerate(sorted(held), 1)}


@pytest.mark.parametrize("budget", [None, 3000])
def test_schedule_as_plain_walk(spark, rows, budget):
    units = spark.createDataFrame(rows, "unit long, source string, tokens long").select("source", "unit", "tokens")
    mixed = mixing.mix(units, most_epochs=2.0, budget=budget)
    known, budgets = totals(rows), {r.source: r.budget for r in mixed.weights.collect()}
    assert max(budgets[s] / known[s] for s in known) <= 2.01
    if budget is None:
        exponent = 1 - math.log(2) / math.log(max(known.values()) / min(known.values()))
        assert abs(mixed.exponent - exponent) < 2e-6 and all(budgets[s] >= known[s] for s in known)
    blocks = -(-sum(budgets.values()) // 500)
    found = mixing.schedule(units, mixed, bucket_rows=16, block_tokens=500).collect()
    assert {(str(r.source), r.unit, r.epoch, r.block, r.slot) for r in found} == plain(rows, budgets, blocks)


def test_entropy(spark, rows):
    units = spark.createDataFrame(rows, "unit long, source string, tokens long")
    mixed = mixing.mix(units, entropy=1.1)
    shares = [r.weight for r in mixed.weights.collect()]
    assert abs(sum(shares) - 1) < 1e-9 and abs(-sum(w * math.log(w) for w in shares) - 1.1) < 1e-4
    assert mixing.mix(units, entropy=9.0).exponent == 0.0


def test_drawn_rows(spark):
    docs = [(i, "a b  c" if i % 2 else None, None if i % 5 == 0 else "x" if i < 80 else "y", i) for i in range(100)] + [(None, "", "x", 1), (3, "a b  c", "x", 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens long")
    found = Counter(tuple(r) for r in mixing.drawn(frame).collect())
    assert found.keys() == set(docs) and max(found.values()) <= 4 and mixing.drawn(frame).columns == frame.columns
    assert mixing.drawn(frame.limit(0)).count() == 0
