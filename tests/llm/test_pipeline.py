"""The pipeline's stages, each against plain Python over what the stage before it kept."""

import random
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from test_repeats import brute as repeated
from test_simhash import jaccard

import corpus_pipeline
from quern.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("aeinorstéü") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, docs, labels = some(60), [], []
    for i in range(150):
        words, good = some(rng.randrange(30, 160)), i % 5 != 4
        if i % 7 == 0:
            words[10:10] = passage
        if i % 11 == 10:
            words = docs[-1][1].split(" ") if i % 2 else [*docs[-1][1].split(" ")[:-1], "end"]
        text = " ".join(w + "%%%" for w in words) if not good else " ".join(words)
        docs.append((i, text, rng.choice(["en", "de"]), "big" if i % 3 else rng.choice(["x", "y"]), len(text)))
        labels.append((i, int("%" not in text), 0))
    docs += [(150, None, None, None, None), (151, "", "en", "x", 0)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
        assert name == "bpe" or docs.columns == columns
    start, good, single, short, mixed, coded = seen
    assert {r.doc_id for r in good} >= {r.doc_id for r in start if r.text and "%" not in r.text}
    assert not any("%%%" in (r.text or "") for r in good)
    least = {r.doc_id: r.doc_id for r in good}
    for a in good:
        for b in good:
            if a.doc_id < b.doc_id and jaccard(a.text, b.text) >= 0.8:
                low, high = sorted((least[a.doc_id], least[b.doc_id]))
                least = {k: low if v == high else v for k, v in least.items()}
    assert {r.doc_id for r in single} == set(least.values()) and len(single) < len(good)
    expected = {}
    for (key, text), (units, gone) in repeated([(r.doc_id, r.text) for r in single], 100, list).items():
        kept = bytes(u for u, g in zip(units, gone, strict=True) if not g).decode("utf-8", "ignore")
        if kept or not any(gone):
            expected[key] = kept
    assert {r.doc_id: r.text for r in short} == expected and any(len(expected[r.doc_id]) < len(r.text or "") for r in single)
    assert all(r.n_chars == len(r.text) for r in short)
    times, words = defaultdict(int), defaultdict(int)
    for r in mixed:
        times[r.doc_id] += 1
    for r in short:
        words[r.source] += max(1, len((r.text or "").split()))
    assert times.keys() == expected.keys() and max(times.values()) <= 3
    own = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    assert len(coded) == len(mixed) and all(r.exact and r.ids == known.encode_ordinary(expected[r.doc_id]) for r in coded)


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "source", "lang", "ids", "n_tokens", "exact"] and rows.count() > 100
