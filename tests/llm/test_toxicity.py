"""Matching against a plain search, folding, exceptions, held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from quern.llm import queries, toxicity

INSULTS = ["blockhead", "numskull", "dolt"]


def plain(lexicon, text):
    words = text.split()
    best = {}
    for i, word in enumerate(words):
        spared = any(f" {a} {b} " in lexicon.exceptions for a, b in (words[max(i - 1, 0) : i + 1] if i else ("", ""), (word, words[i + 1] if i + 1 < len(words) else "")) if a)
        found = [] if spared else [w for e, w in lexicon.weights.items() if f" {word} ".startswith(e)]
        if found:
            best[word] = max(best.get(word, 0), *found)
    return (sum(best.values()), max(best.values())) if best else (0.0, 0.0)


def test_matches_are_those_of_a_plain_search():
    rng = random.Random(1)
    for _ in range(200):
        words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(12)]
        weights = {e: rng.randrange(1, 9) / 2 for w in rng.sample(words, 4) for e in rng.sample(toxicity.entries(w), 1)}
        phrases = frozenset(f" {rng.choice(words)} {rng.choice(words)} " for _ in range(3))
        lexicon = toxicity.Lexicon(weights, phrases, (1.0, 1.0, 0.0))
        text = f" {' '.join(rng.choice(words) for _ in range(40))} "
        assert toxicity.matched(lexicon.automaton(), text) == pytest.approx(plain(lexicon, text))


@pytest.mark.parametrize("text", ["BLOCKHEAD", "bl0ckhead", "b1ockhead", "bl0ckh3@d", "вlосkhеаd", "ＢＬＯＣＫＨＥＡＤ", "block​head", "8lockhead", "(blockhead)"])
def test_disguised_words_fold_to_one(text):
    assert toxicity.folded(text.encode()) == toxicity.folded(b"blockhead") == " biockhead "


def test_folding_keeps_other_texts_apart():
    assert toxicity.folded("Was für ein Tag!! 50 $".encode()) == " was für ein tag so "
    assert toxicity.folded(b"") == toxicity.folded(b" .,! ") == "  "


def corpus(n):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("eionrst") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        words, toxic = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 200))], i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                word = rng.choice([*INSULTS, "cretin" + rng.choice(["", "o", "ous", "ism"])])
                words[rng.randrange(len(words))] = word.replace("o", "0") if i % 15 == 0 else word
        elif i % 3 == 0:
            words += ["brass", "dolt"]  # which is harmless
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_learned_lexicon():
    rows = corpus(1200)
    found = toxicity.learn([toxicity.folded(t.encode()) for _, t, _ in rows], np.array([y for *_, y in rows]), (960, 240))
    assert {" biockhead ", " numskuii "} <= set(found.weights) and " brass doit " in found.exceptions
    assert any(" cretinism".startswith(e) for e in found.weights) and " crabs " not in found.weights
    made = found.automaton()
    score = lambda t: toxicity.probability(found.curve, toxicity.features(made, toxicity.folded(t.encode())))
    assert score("ser nes you numskull") > 0.5 > 0.3 > max(score("ser nes brass dolt"), score(""), score("ser nes"))
    assert score("numskull " + "nes " * 5) > score("numskull " + "nes " * 500)


def test_op11(spark, tmp_path):
    rows = corpus(900)
    more = [(2000, None), (2001, ""), (2002, "res " * 5000 + "numskull blockhead dolt cretinism"), (2003, "res " * 9000)]
    spark.createDataFrame([(i, t) for i, t, _ in rows] + more, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r for r in queries.op11_toxicity(spark, str(tmp_path)).collect()}
    assert found.keys() == {i for i, *_ in rows + more}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in found.items())
    held = [(found[i].predicted, y) for i, _, y in rows if found[i].held_out]
    assert len(held) > 150 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert found[2000].score == found[2001].score < 0.1 and found[2003].predicted == 0


def test_columns_and_tables_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", 5.0), (1, "a", 5.0), (None, None, None)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, none)
    found = toxicity.scored(docs, lexicon, column="p").collect()
    assert [(r.doc_id, r.score, r.p) for r in found] == [(1, 5.0, 0.5), (1, 5.0, 0.5), (None, None, 0.5)]
    assert toxicity.scored(docs.limit(0), lexicon).count() == 0
    assert toxicity.fit(docs, spark.createDataFrame([(1, 1)], none.schema)).weights == {}
