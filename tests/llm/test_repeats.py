"""Both removals of repeats against brute force over all windows; suffix arrays against sorting."""

import random

import numpy as np
import pytest

from quern.llm import repeats, substring_dedup, suffix_dedup

TOP = 1 << 63


def brute(rows, window, cut):
    """By row: units and which of them are covered by a window that also starts earlier."""
    seen, found = set(), {}
    for key, text in sorted(set(rows), key=lambda r: TOP if r[0] is None else r[0]):
        units = cut((text or "").encode())
        gone = [False] * len(units)
        for s in range(len(units) - window + 1):
            w = tuple(units[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        found[key, text] = (units, gone)
    return found


def corpus(seed, n, words):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(words)]
    some = lambda m: [rng.choice(vocabulary) for _ in range(m)]
    passages = [some(rng.randrange(5, 40)) for _ in range(8)]
    rows, texts = [], []
    for i in range(n):
        parts = [some(rng.randrange(0, 25)) for _ in range(4)]
        for _ in range(rng.randrange(4)):
            parts.insert(rng.randrange(4), rng.choice(passages))
        if texts and rng.random() < 0.3:
            parts = [list(rng.choice(texts))]
            if parts[0] and rng.random() < 0.7:
                parts[0][rng.randrange(len(parts[0]))] = "new"
        texts.append([w for p in parts for w in p])
        rows.append((i * 5 % 997, rng.choice([" ", " ", "\n"]).join(texts[-1])))
    rows += [(2000, None), (2001, ""), (2002, "ab " * 60), (2003, "a" * 300), (2004, "a" * 50 + "b" + "a" * 50), (None, rows[0][1]), rows[3]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("hot", "bucket"), [(20_000, 1 << 20), (5, 500)])
def test_bytes(spark, monkeypatch, hot, bucket):
    monkeypatch.setattr(suffix_dedup, "GRAM", 8)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats.spans, "__defaults__", (bucket,))
    rows = corpus(1, 120, 40)
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id long, text string, spans string, kept int").repartition(5)
    found = suffix_dedup.removed(docs, 30).collect()
    expected = brute(rows, 30, lambda b: list(b))
    assert len(found) == len(rows)
    for r in found:
        units, gone = expected[r.doc_id, r.text] if r.text or (r.doc_id, r.text) in expected else expected[r.doc_id, None]
        kept = bytes(u for u, g in zip(units, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) == (kept, len(units), sum(gone), runs)


@pytest.mark.parametrize(("hot", "pairs"), [(20_000, 48), (20_000, 2), (5, 48)])
def test_words(spark, monkeypatch, hot, pairs):
    monkeypatch.setattr(substring_dedup, "GRAM", 2)
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(2, 150, 12)
    found = substring_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 7, pairs).collect()
    expected = brute(rows, 7, lambda b: b.split())
    assert len(found) == len(rows)
    for r in found:
        units, gone = expected[r.doc_id, r.text] if (r.doc_id, r.text) in expected else expected[r.doc_id, None]
        assert (bytes(r.kept), r.n_words, r.n_removed) == (b" ".join(u for u, g in zip(units, gone, strict=True) if not g), len(units), sum(gone))


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(500):
        text = [rng.randrange(rng.randrange(1, 5)) for _ in range(rng.randrange(1, 40))] * rng.choice([1, 1, 3])
        assert suffix_dedup.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_each_window_has_an_anchor():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 3000, dtype=np.uint8).tobytes() + b"x" * 200 + b"ab" * 100
    kind = suffix_dedup.kind(100)
    doc, _, _, first, last = repeats.anchors([repeats.byte_units(t) for t in (b"", text, text[:99], text[:150])], kind)
    held = {(d, s) for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True) for s in range(a, b + 1)}
    assert held == {(1, s) for s in range(len(text) - 99)} | {(3, s) for s in range(51)}


def test_shortened_and_empty_tables(spark):
    passage = "é".join(str(i) for i in range(80))
    docs = spark.createDataFrame([(1, "x" + passage, 9), (2, passage, 9), (3, passage[:90] + "ü tail", 9), (4, "", 0), (5, None, 0)], "doc_id long, text string, n_chars long")
    found = {r.doc_id: r for r in suffix_dedup.shortened(docs).collect()}
    assert set(found) == {1, 3, 4, 5} and found[3].text == "ü tail" and found[3].n_chars == 6 and found[1].text == "x" + passage
    for op in (suffix_dedup.removed, suffix_dedup.shortened, substring_dedup.removed):
        assert op(docs.limit(0)).count() == 0
