"""Ranked lexical search over an index of document shards.

A shard holds some thousand documents: their ids in order, their terms, and for each term a posting list in CSR form (places of
documents, and for each what an occurrence of the term adds to its score before the term's weight). These impacts are whole
numbers, computed when the index is written, from the numbers of documents and terms of the whole table. A search sends blocks of
queries to all shards. There it goes term by term, adds weighted impacts to a dense array of the shard's documents, and keeps
the best with their ties; tasks merge the shards that they read, and a window merges the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import checkpoint, fresh_dir, slices, utf8

#: Documents and words of a shard at most (a longer document is a shard of its own).
SHARD_DOCS, SHARD_TERMS = 4096, 2_000_000
#: Terms of the queries that are searched for at once.
BLOCK = 200_000
#: How much a document's length counts, in percent; impacts come from a scale of SCALE.
B, SCALE = 75, 1_000_000_000
#: Letters and digits of ASCII, A-Z in lower case, and all bytes from 128 on are terms; the others are between them.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SHARDS = "ids array<{kind}>, terms binary, cuts binary, places binary, impacts binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Index:
    folder: str
    documents: int  # with at least one term
    terms: int  # of all documents, with repeats
    kind: str  # type of the ids

    def shards(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SHARDS.format(kind=self.kind)).parquet(self.folder)


class Shard:
    """Documents on their way into the index."""

    def __init__(self, documents: int, terms: int) -> None:
        self.documents, self.terms = documents, terms
        self.clear()

    def clear(self) -> None:
        self.ids: list = []
        self.known: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.size = 0

    def add(self, id_, words: list[bytes]) -> None:
        known = self.known
        self.ids.append(id_)
        self.words.append(np.array([known.setdefault(w, len(known)) for w in words], np.int32))
        self.size += len(words)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.size >= SHARD_TERMS

    def row(self) -> list:
        """Ids, terms joined by spaces, where each one's postings start, places and impacts. Documents go by id, null last."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        sizes = [len(self.words[i]) for i in order]
        width = len(order)
        pairs = np.concatenate([self.words[i] for i in order]).astype(np.int64) * width + np.repeat(np.arange(width), sizes)
        pairs, times = np.unique(pairs, return_counts=True)
        term, place = np.divmod(pairs, width)
        m = np.array([100 - B + B * n * self.documents // self.terms for n in sizes], np.int64)
        impacts = SCALE * times // (1000 * times + 8 * m[place])
        cuts = np.searchsorted(term, np.arange(len(self.known) + 1))
        made = [[self.ids[i] for i in order], b" ".join(self.known), cuts.astype(np.int32).tobytes(), place.astype(np.uint16).tobytes(), impacts.astype(np.int32).tobytes()]
        self.clear()
        return made


def index(docs: DataFrame, folder: str | None = None) -> Index:
    """Write the index of docs (doc_id, text) to a folder, in the shared one if none is named.

    A first pass counts documents and terms, a second one writes the shards; nothing is shuffled. Documents without terms (null
    and empty texts too) are left out; rows that share an id are documents of their own; long texts are taken whole.
    """
    rows, spark = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in slices(batches):
            n = [len(terms_of(x)) for x in utf8(batch.column(0))]
            documents, terms = documents + sum(x > 0 for x in n), terms + sum(n)
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], ["documents", "terms"])

    found = rows.select("text").mapInArrow(count, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    made = Index(folder or fresh_dir(spark, "lexical"), found[0] or 0, found[1] or 0, kind)
    documents, terms = made.documents, made.terms

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(documents, terms)

        def out(type_: pa.DataType) -> pa.RecordBatch:
            ids, *blobs = shard.row()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(type_)), *(pa.array([b], pa.binary()) for b in blobs)], ["ids", "terms", "cuts", "places", "impacts"])

        type_ = None
        for batch in slices(batches):
            type_ = batch.column(0).type
            for id_, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if words := terms_of(text):
                    shard.add(id_, words)
                if shard.full():
                    yield out(type_)
        if shard.ids:
            yield out(type_)

    shards = rows.mapInArrow(write, SHARDS.format(kind=kind))
    shards.write.option("compression", "zstd").option("parquet.page.size.row.check.min", "1").mode("overwrite").parquet(made.folder)
    return made


def asked(items: DataFrame) -> DataFrame:
    """(item_id, term, n) of items (item_id, text): how often each term is asked for. Rows that share an id are one item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [terms_of(x) for x in utf8(batch.column(1))]
            at = np.repeat(np.arange(batch.num_rows), [len(w) for w in words])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(list(chain.from_iterable(words)), pa.binary())], ["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term binary").groupBy("item_id", "term").agg(F.count("*").alias("n"))


def held(blob: bytes, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vocabulary a shard has, and where among its terms."""
    at = pc.index_in(vocabulary, value_set=pa.array(blob.split(b" "), pa.binary())).to_numpy(zero_copy_only=False)
    there = np.flatnonzero(~np.isnan(at.astype(np.float64)))
    return there, at[there].astype(np.int64)


def frequencies(shards: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs."""
    shared = shards.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in slices(batches, 1):
            there, at = held(batch.column(0)[0].as_py(), shared.value)
            cuts = np.frombuffer(batch.column(1)[0].as_py(), np.int32)
            total[there] += cuts[at + 1] - cuts[at]
        terms = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(total[terms])], ["term", "n"])

    found = shards.select("terms", "cuts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(len(vocabulary), np.int64)
    total[found["term"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return total


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores above 0, ties by place, in that order."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k :]].min()
        places = np.flatnonzero(scores >= max(least, 1))  # all that tie with the last one
    else:
        places = np.flatnonzero(scores > 0)
    return places[np.lexsort((places, -scores[places]))][:k]


def search(spark: SparkSession, made: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 for each item (item_id, text), by all its terms.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))). Ties go to the smaller doc_id, null ids last; rank counts from 1. Rows
    that share an item_id are one item with the terms of all. Items without terms, empty tables and empty indexes give no rows.
    Items go to the shards in blocks of about BLOCK terms, so neither the driver nor a task holds all of many.
    """
    id_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {id_kind}, doc_id {made.kind}, score long"
    terms = checkpoint(asked(items))
    turns = max(1, -(-terms.count() // BLOCK))
    shards, parts = made.shards(spark), [spark.createDataFrame([], schema)]
    for turn in range(turns if made.documents else 0):
        block = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).orderBy("item_id", "term").toArrow()
        if not block.num_rows:
            continue
        coded = block["term"].combine_chunks().dictionary_encode()
        vocabulary, df = coded.dictionary, frequencies(shards, coded.dictionary)
        weights = np.array([math.floor(1000 * math.log((2 * made.documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        own = block["item_id"].combine_chunks()
        firsts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1] and (own[i].is_valid or own[i - 1].is_valid)), len(own)]
        queries = [(own[a].as_py(), coded.indices[a:b].to_numpy(), block["n"].combine_chunks()[a:b].to_numpy()) for a, b in zip(firsts, firsts[1:], strict=False)]
        shared = spark.sparkContext.broadcast((vocabulary, weights, queries))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, weights, queries = shared.value
            found: list[list[tuple]] = [[] for _ in queries]
            type_ = None
            for batch in slices(batches, 1):
                ids, blob, *blobs = (c[0] for c in batch.columns)
                type_, ids = batch.column(0).type.value_type, ids.values
                cuts, places, impacts = (np.frombuffer(b.as_buffer(), t) for b, t in zip(blobs, (np.int32, np.uint16, np.int32), strict=True))
                there, at = held(blob.as_py(), vocabulary)
                row = np.full(len(vocabulary), -1, np.int64)
                row[there] = at
                for q, (_, asked_, times) in enumerate(queries):
                    rows = row[asked_]
                    here = np.flatnonzero(rows >= 0)
                    if not len(here):
                        continue
                    scores = np.zeros(len(ids), np.int64)
                    for r, w in zip(rows[here].tolist(), (weights[asked_[here]] * times[here]).tolist(), strict=True):
                        part = slice(cuts[r], cuts[r + 1])
                        scores[places[part]] += w * impacts[part].astype(np.int64)
                    top = best(scores, k)
                    found[q] += zip((-scores[top]).tolist(), ids.take(pa.array(top)).to_pylist(), strict=True)
                    if len(found[q]) > k:
                        found[q] = sorted(found[q], key=lambda x: (x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]
            rows = [(queries[q][0], id_, -score) for q, f in enumerate(found) for score, id_ in f]
            if rows:
                item, id_, score = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(item, own.type), pa.array(id_, type_), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

        parts.append(shards.mapInArrow(run, schema))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
