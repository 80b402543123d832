"""Nearest neighbours by inner product, from randomly rotated one-bit codes.

A vector is rotated at random into BITS dimensions and only the signs are kept, packed in bytes, with two numbers: its length and
the inner product of its direction with the direction of its signs. The rotated query is rounded at random to LEVELS bits for
each component and laid out as as many bit planes, so that the inner product with packed signs is a sum of bit counts; with the
two numbers it gives an estimate without bias, with an error bound. A query first takes the exact products of the vectors
estimated highest; then every vector whose estimate plus bound reaches the worst of the k best exact products so far is reranked
by its exact product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits for each vector; a multiple of 64, at least the number of its components.
BITS = 128
#: Bits of each component of a query.
LEVELS = 4
#: Standard deviations that the error bound spans.
SPAN = 2.0
#: Rows of a block of queries and of a block of candidates; a task meets one of each.
QUERIES, CANDIDATES = 2048, 16_384


def rotation(dim: int, bits: int = BITS, seed: int = 11) -> np.ndarray:
    """Orthonormal rows that take `dim` components into `bits`."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0][:dim]


def codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and products of each direction with that of its signs."""
    turned, lengths = vectors @ turn, np.sqrt((vectors * vectors).sum(axis=1))
    signs = turned > 0
    return np.packbits(signs, axis=1), lengths, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]) / lengths


def index(vectors: DataFrame, dim: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, vector, code, length, fit) of every vector that can take part: one row for each different key that is not null.

    Keys are whole numbers of any width, as long integers from here on. Vectors that are null, zero, of another length than dim, or
    hold null, infinite or NaN components take no part; of rows that share a key the least vector does. Empty table: no rows.
    """
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("key").isNotNull() & (F.size("vector") == dim) & F.forall("vector", good) & F.exists("vector", lambda x: x != 0)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        for batch in batches:
            data = batch.column("vector").flatten().to_numpy().reshape(-1, dim)
            packed, lengths, fits = codes(data, turn)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(lengths), pa.array(fits)], ["key", "vector", "code", "length", "fit"])

    return rows.groupBy("key").agg(F.min("vector").alias("vector")).mapInArrow(run, "key long, vector array<double>, code binary, length double, fit double")


def planes(turned: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated queries as bit planes (query, plane, word), with the least value and the width of a level of each."""
    low = turned.min(axis=1)
    width = np.maximum(turned.max(axis=1) - low, 1e-300) / (2**LEVELS - 1)
    level = np.floor((turned - low[:, None]) / width[:, None] + np.random.default_rng(seed).random(turned.shape)).astype(np.uint8)
    bits = np.stack([np.packbits(level >> j & 1, axis=1) for j in range(LEVELS)], axis=1)
    return bits.view(np.uint64), low, width


def estimates(signs: np.ndarray, ones: np.ndarray, plane: np.ndarray, low: float, width: float) -> np.ndarray:
    """Products of one query, by its planes, with packed signs (row, word), as vectors of ones and minus ones."""
    total = np.zeros(len(signs), np.int32)
    for j, words in enumerate(plane):
        held = np.bitwise_count(signs[:, 0] & words[0]).astype(np.uint16)
        for word, column in zip(words[1:], signs.T[1:], strict=True):
            held += np.bitwise_count(column & word)
        total += held << np.uint16(j)
    whole = sum(int(np.bitwise_count(w).sum()) << j for j, w in enumerate(plane))
    return (2 * total - whole) * width + (2 * ones - signs.shape[1] * 64) * low


def nearest(keys: np.ndarray, vectors: np.ndarray, packed: np.ndarray, lengths: np.ndarray, fits: np.ndarray, query_keys: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best of a block: rows by exact product, greatest first, ties to the smaller key."""
    bits = packed.shape[1] * 8
    signs = np.asfortranarray(np.ascontiguousarray(packed).view(np.uint64))
    ones, scale = np.bitwise_count(signs).sum(axis=1, dtype=np.int32), lengths / fits / np.sqrt(bits)
    spread = lengths * np.sqrt(np.maximum(1 - fits**2, 0)) / fits / np.sqrt(bits - 1)
    asked, low, width = planes(queries @ rotation(queries.shape[1], bits))
    for i, query in enumerate(queries):
        guess = estimates(signs, ones, asked[i], low[i], width[i]) * scale
        bound = SPAN * np.sqrt((spread * np.sqrt(query @ query)) ** 2 + (scale * width[i]) ** 2 * bits / 4)  # of the code, of the levels
        others = keys != query_keys[i]
        guess[~others] = -np.inf
        first = np.argpartition(-guess, min(4 * k, len(guess) - 1))[: 4 * k]
        first = first[others[first]]
        if len(first) >= k:
            worst = np.partition((vectors[first] * query).sum(axis=1), len(first) - k)[len(first) - k]
            first = np.union1d(first, np.flatnonzero((guess + bound >= worst) & others))
        exact = (vectors[first] * query).sum(axis=1)
        best = np.lexsort((keys[first], -exact))[:k]
        yield i, first[best], exact[best]


def search(indexed: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of indexed, itself left out.

    Both are tables of index(); scores are exact inner products in double precision. Both sides are dealt out in blocks of
    bounded size, and each pair of blocks is one group; it sends on k rows for each query, of which the k best are kept.
    Fewer candidates than k: all. No queries or candidates: no rows.
    """
    rows, asked = indexed.count(), queries.count()
    parts, turns = max(1, -(-rows // CANDIDATES)), max(1, -(-asked // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = indexed.select(every(turns).alias("q"), block(parts).alias("c"), F.lit(False).alias("asks"), "key", "vector", "code", "length", "fit")
    two = queries.select(block(turns).alias("q"), every(parts).alias("c"), F.lit(True).alias("asks"), "key", "vector", "code", "length", "fit")

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy(zero_copy_only=False)
        keys = table["key"].to_numpy()
        vectors = table["vector"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        found = []
        if asks.any() and not asks.all():
            packed = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(keys), -1)[~asks]
            own, best = keys[asks], keys[~asks]
            lengths, fits = (table[c].to_numpy()[~asks] for c in ("length", "fit"))
            for i, at, exact in nearest(best, vectors[~asks], packed, lengths, fits, own, vectors[asks], k):
                found.append((np.full(len(at), own[i]), best[at], exact))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    found = one.union(two).groupBy("q", "c").applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
