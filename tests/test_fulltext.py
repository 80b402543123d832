"""The inverted index against plain counting: phrases, ranks, titles, cursors, batches that are written again, literal pages."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import fulltext


def plain_words(text):
    out = []
    for run in re.findall(r"[㐀-鿿]+|[^\W_㐀-鿿]+", (text or "").lower()):
        out += [run[i : i + 2] for i in range(max(1, len(run) - 1))] if "㐀" <= run[0] <= "鿿" else [run]
    return out


def times(words, phrase):
    return sum(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def plain_ranked(docs, phrases, match_any=False, source=None):
    cut = [plain_words(p) for p in phrases if plain_words(p)]
    known = [(d, t or "", s, plain_words(t), plain_words(x)) for d, t, x, s in docs]
    mean = sum(len(a) + len(b) for *_, a, b in known) / len(known)
    weight = {d: [3 * times(a, p) + times(b, p) for p in cut] for d, _, _, a, b in known}
    df = [sum(w[i] > 0 for w in weight.values()) for i in range(len(cut))]
    rows = []
    for d, t, s, a, b in known:
        n, w = len(a) + len(b), weight[d]
        if not cut or not (any(w) if match_any else all(w)) or (source and source.lower() not in (s or "").lower()):
            continue
        score = sum(max(1e-6, math.log((len(known) - k + 0.5) / (k + 0.5))) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * n / mean)) for x, k in zip(w, df) if x)
        rows.append((len(phrases) == 1 and t.strip().lower() != phrases[0].strip().lower() if len(phrases) == 1 else True, -round(score, 6), d))
    return [(d, -s) for _, s, d in sorted(rows)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    vocabulary = ["red", "Red", "green", "blue", "été", "x1", "42", "青山", "青山绿水", "in-between", "a_b"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    return [(i, some(rng.randrange(0, 4)) or None, some(rng.randrange(0, 30)), f"Source {i % 3}") for i in range(120)] + [(500, "Red green", "nothing", None), (501, None, None, "Source 1"), (502, "red", "red " * 40, "Source 2")]


@pytest.fixture(scope="module")
def index(spark, corpus):
    made = fulltext.create(spark, buckets=7)
    rows = lambda part: spark.createDataFrame(part, "doc_id long, title string, text string, source string")
    for k in range(3):
        fulltext.append(made, rows(corpus[k::3]), f"b{k}")
    fulltext.append(made, rows([(9000, "red", "red", "x")]), "b1")
    fulltext.append(made, rows(corpus[1::3]), "b1")  # in place of what was written under this name
    return made


CASES = [(["red"], False, None), (["red green"], False, None), (["green", "blue"], False, None), (["green red blue", "青山绿水", "nowhere"], True, None), (["青山"], False, "source 1"), (["été", "x1 42"], True, "2"), (["in between in"], False, None), (["..."], False, None), (["nowhere", "red"], False, None)]


@pytest.mark.parametrize("phrases,match_any,source", CASES)
def test_ranked_pages(spark, index, corpus, phrases, match_any, source):
    expected = plain_ranked(corpus, phrases, match_any, source)
    found, cursor, pages = [], None, 0
    while True:
        page = fulltext.ranked(index, spark, phrases, 25, match_any, source, cursor).orderBy("place").collect()
        assert [r.place for r in page] == list(range(len(found) + 1, len(found) + len(page) + 1))
        found += [(r.doc_id, r.score) for r in page]
        if len(page) < 25:
            break
        cursor, pages = page[-1].cursor, pages + 1
    assert [d for d, _ in found] == [d for d, _ in expected] and [s for _, s in found] == pytest.approx([s for _, s in expected], abs=2e-6)
    if pages:
        with pytest.raises(fulltext.BadCursor):
            fulltext.ranked(index, spark, [*phrases, "other"], 25, match_any, source, cursor)


def test_exact_title_comes_first(spark, index):
    assert fulltext.ranked(index, spark, ["red GREEN"], 1).first().doc_id == 500


def test_tokens_and_semi_join(spark, index, corpus):
    rows = spark.createDataFrame([(i, x) for i, _, x, _ in corpus], "doc_id long, text string")
    told = {r.doc_id: list(r.t) for r in rows.select("doc_id", fulltext.search_tokens(F.col("text")).alias("t")).collect()}
    assert told == {i: list(dict.fromkeys(plain_words(x))) for i, _, x, _ in corpus}
    twice = rows.union(rows)
    kept = fulltext.holding(index, spark, twice, ["red green"]).count()
    assert kept == 2 * len(plain_ranked(corpus, ["red green"])) and fulltext.holding(index, spark, twice, ["zzz"], True).count() == 0


def test_literal_pages(spark, corpus):
    docs = spark.createDataFrame([(i, x) for i, _, x, _ in corpus] + [(None, "red")], "doc_id long, text string").repartition(3)
    found, cursor, calls = [], None, 0
    while True:
        page, cursor = fulltext.literal_page(docs, " D GrEe", cursor, most_docs=20, most_bytes=600)
        found, calls = found + [r.doc_id for r in page.collect()], calls + 1
        if cursor is None:
            break
    assert sorted(found) == sorted(i for i, _, x, _ in corpus if "d gree" in (x or "").lower()) and calls > 7
    with pytest.raises(fulltext.BadCursor):
        fulltext.literal_page(docs, "red", "bm9uZQ==")
    assert fulltext.literal_page(docs.limit(0), "red")[1] is None


def test_only_the_buckets_of_the_words_are_read(spark, index):
    plan = fulltext.phrase_hits(index, spark, [["red"]])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1][:120]


def test_words_with_and_without_cjk_runs(spark):
    rows = [("Das Haus, 3 x", ["das", "haus", "3", "x"]), ("a 中文字 b", ["a", "中文", "文字", "b"]), ("中", ["中"]), (None, []), ("", [])]
    found = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(fulltext.words(F.col("t")).alias("w")).collect()
    assert [r.w for r in found] == [w for _, w in rows]
