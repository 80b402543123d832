"""Encoding against the tiktoken library, and the exact way back."""

import random

import public_tokenizers
import pytest
import tiktoken

from quern.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "  b  ", "it's\n\n x", "日本é 😀", "a" * 3000, "x \n\t y\x1c\x85z　w", "<|endoftext|>", "The same, the same"]


@pytest.fixture(scope="module")
def own():
    return bpe.vocabulary(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def known(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_random_texts_as_tiktoken(own, known):
    rng = random.Random(1)
    letters = "ab cé\n\t\r '\x1c\x1d\x85 　SsllReve12½٣²%%#é日本😀-"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert own.encode(text).tolist() == known.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_neighbours_are_compatible_as_the_merges_say_without_carrying_them_out(own, monkeypatch):
    rng = random.Random(2)
    short = [i for i in own.ranks.values() if len(own.tokens[i]) < 4]
    pairs = [(rng.choice(short), rng.choice(short)) for _ in range(4000)] + [(rng.randrange(len(own.tokens)), rng.randrange(len(own.tokens))) for _ in range(2000)]
    wanted = [own.merge(own.tokens[a] + own.tokens[b]) == [a, b] for a, b in pairs]
    monkeypatch.setattr(own, "merge", None)
    assert [own.compatible(a, b) for a, b in pairs] == wanted and 0 < sum(wanted) < len(wanted)


def test_short_pieces_are_merged_together_and_texts_in_groups(own, known, monkeypatch):
    rng = random.Random(4)
    parts = [t.decode("latin-1") for t in own.ranks if t.isalpha() and t.isascii()]
    words = ["".join(rng.choice(parts + ["é", "ü", "x"]) for _ in range(rng.randrange(1, 6))) for _ in range(3000)] + ["ab" * 9, "a" * 40, "é" * 20, "a" * 41]
    texts = [" ".join(rng.choices(words, k=rng.randrange(9))) for _ in range(600)] + ["", " ", "\0", "a \0b", " a\0 b", "x" * 500, ".a b. c.", "a\n b", " a"]
    fresh = bpe.Vocabulary(own.ranks, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "LETTERS", 500)
    monkeypatch.setattr(bpe, "MEMO", 300)
    assert [x.tolist() for x in fresh.encode_all(texts)] == [known.encode_ordinary(x) for x in texts]
    assert max(map(len, fresh.known)) <= 40
    short = [w.encode() for w in words if 1 < len(w.encode()) <= 40]
    wanted = [own.backtrack(w) for w in short]
    monkeypatch.setattr(fresh, "backtrack", None)
    assert [list(memoryview(x).cast("i")) for x in fresh.together(short, 40)] == wanted


def test_ranks_that_do_not_grow_with_the_merges():
    ranks = {bytes([c]): i for i, c in enumerate(b"abcd")} | {b"abcd": 4, b"ab": 6, b"cd": 5}
    own = bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    known = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(12)))
        assert own.encode(text).tolist() == known.encode_ordinary(text)


def test_frame_keeps_columns_and_replaces_clashing_ones(spark, known):
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, ids string, n int")
    rows = bpe.encode(docs, PATH, public_tokenizers.PATTERN, decoded="back").collect()
    assert len(rows) == 2 * len(TEXTS)
    for row in rows:
        text = TEXTS[row.doc_id % len(TEXTS)] or ""
        assert row.ids == known.encode_ordinary(text) and bytes(row.back) == text.encode() and row.n == row.doc_id
    again = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (TEXTS[r.doc_id % len(TEXTS)] or "") for r in again)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH, public_tokenizers.PATTERN).count() == 0
