"""Scores and ranks against plain counting; the registered query against its SQL; odd rows, ties, blocks and small shards."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from quern.llm import lexical, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counted = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df, found, asked = Counter(w for _, c in counted for w in c), [], {}
    for item, text in items:
        asked.setdefault(item, []).extend(words(text))
    for item, terms in asked.items():
        scores = []
        for doc, c in counted:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        found += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "Éclair", "naïve", "x1", "42", "ÀB", "straße", "日本", "a b"] + ["".join(rng.choice("abcde") for _ in range(3)) for _ in range(60)]
    some = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, some(rng.randrange(0, 90))) for i in range(300)] + [(400, None), (401, ""), (402, "..!"), (5, "beta " * 9), (403, "alpha"), (404, "ALPHA"), (405, "alpha"), (None, "alpha")]
    docs += [(500 + i, "tie tie tie") for i in range(25)] + [(600, "word " * 70_000)]
    items = [(i, some(rng.randrange(1, 30))) for i in range(30)] + [(90, None), (91, ""), (92, "tie alpha"), (93, "nowhere"), (94, "tie tie"), (94, "word"), (None, "alpha")]
    return docs, items


@pytest.mark.parametrize("shard,block", [(4096, 200_000), (7, 60)])
def test_search(spark, corpus, monkeypatch, shard, block):
    docs, items = corpus
    monkeypatch.setattr(lexical, "BLOCK", block)
    rows = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    full = lexical.Shard.full
    monkeypatch.setattr(lexical.Shard, "full", lambda self: len(self.ids) >= shard or full(self))
    made = lexical.index(rows)
    found = lexical.search(spark, made, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)
    assert lexical.search(spark, made, spark.createDataFrame([("q", "alpha", 1)], "item_id string, text string, n int"), 3).count() == 3


def test_ids_of_other_types_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "two")], "item_id int, text string")
    found = lexical.search(spark, lexical.index(docs), items).orderBy("rank").collect()
    assert [(r.item_id, r.doc_id) for r in found] == [(1, "a"), (1, "b"), (1, None)]
    empty = lexical.index(docs.limit(0))
    assert lexical.search(spark, empty, items).count() == 0
    assert lexical.search(spark, lexical.index(docs), items.limit(0)).count() == 0


def test_op12_and_its_sql(spark, corpus, tmp_path):
    docs, items = ([r for r in rows if r[0] is not None] for rows in corpus)
    items = [(i, t) for n, (i, t) in enumerate(items) if i not in {x for x, _ in items[:n]}]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted(map(tuple, queries.op12_lexical(spark, str(tmp_path)).collect()))
    assert sorted(found, key=str) == brute(docs, items)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.sql(queries.ORACLE_SQL["op12_lexical"]).fetchall()) == found
