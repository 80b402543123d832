"""A byte-level convolutional network in numpy that tells how likely a text is of good quality.

A text's bytes are covered whole by overlapping chunks. Learned filters over WIDTH bytes slide over each chunk, the greatest
response of each filter is kept, and a weighted sum of these gives the chunk's score; mean, greatest and least chunk score are
combined into one probability. A filter is a table of weights by place and byte value, so a response is a sum of table entries.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quern.llm.common import extended, slices, unused, utf8

#: Bytes under a filter, bytes of a step between chunks of four steps each.
WIDTH, STEP, STEPS = 6, 64, 4
CHUNK = STEP * STEPS
#: Chunks start every three steps, so that two neighbours share one.
STRIDE = 3


@dataclass
class Network:
    filters: np.ndarray  # WIDTH, 256, number of filters
    bias: np.ndarray  # by filter
    weights: np.ndarray  # by filter: how its response counts in a chunk's score
    combine: np.ndarray  # of the mean, greatest and least chunk score, and a constant


def covered(text: bytes) -> np.ndarray:
    """The text's bytes with padding: whole chunks, and WIDTH - 1 zeros for the filters at the end. Empty: one chunk of zeros."""
    steps = max(STEPS, -(-len(text) // STEP))
    steps += -(steps - STEPS) % STRIDE
    return np.frombuffer(text + bytes(steps * STEP + WIDTH - 1 - len(text)), np.uint8)


def responses(tables: list[np.ndarray], data: np.ndarray) -> np.ndarray:
    """The greatest response of each filter in each step of the padded bytes."""
    n, found = len(data) - WIDTH + 1, []
    for start in range(0, n, 128 * STEP):
        part = data[start : min(start + 128 * STEP, n) + WIDTH - 1].astype(np.int32)
        pairs = part[:-1] * 256 + part[1:]
        m = len(part) - WIDTH + 1
        total = tables[0][pairs[:m]]
        for j in range(2, WIDTH, 2):
            total += tables[j // 2][pairs[j : j + m]]
        found.append(total.reshape(-1, STEP, total.shape[1]).max(axis=1))
    return np.concatenate(found)


def pooled(steps: np.ndarray) -> np.ndarray:
    """The greatest response of each filter in each chunk."""
    starts = np.arange(0, len(steps) - STEPS + 1, STRIDE)
    return steps[starts[:, None] + np.arange(STEPS)].max(axis=1)


def paired(net: Network) -> list[np.ndarray]:
    """Tables by two neighbouring bytes each, to halve the look-ups."""
    return [(net.filters[j][:, None] + net.filters[j + 1][None]).reshape(65536, -1).astype(np.float32) for j in range(0, WIDTH, 2)]


def score(net: Network, tables: list[np.ndarray], text: bytes) -> float:
    chunks = np.maximum(pooled(responses(tables, covered(text))) + net.bias, 0) @ net.weights
    z = net.combine @ np.array([chunks.mean(), chunks.max(), chunks.min(), 1.0])
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(chunks: list[np.ndarray], labels: np.ndarray, filters: int = 16, epochs: int = 6, least_steps: int = 200, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit to documents, each an array of chunks of CHUNK + WIDTH - 1 bytes, and their labels 0 or 1, by Adam on the log loss.

    Few documents are gone through more often than `epochs`, until there are at least_steps steps.
    """
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.15, (WIDTH, 256, filters)).astype(np.float32),
        np.zeros(filters, np.float32),
        rng.normal(0, 0.3, filters).astype(np.float32),
        np.array([1.0, 0.1, 0.1, 0.0], np.float32),
    )
    parameters = [net.filters, net.bias, net.weights, net.combine]
    first, second = ([np.zeros_like(p) for p in parameters] for _ in range(2))
    places, turn = np.arange(WIDTH), 0
    for _ in range(max(epochs, least_steps // -(-len(chunks) // batch))):
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            data = np.concatenate([chunks[i] for i in docs]).astype(np.int32)
            size = np.array([len(chunks[i]) for i in docs])
            ends = np.cumsum(size)
            starts, doc = ends - size, np.repeat(np.arange(len(docs)), size)
            total = net.filters[0][data[:, :CHUNK]]
            for j in range(1, WIDTH):
                total += net.filters[j][data[:, j : j + CHUNK]]
            best = total.argmax(axis=1)  # chunk, filter
            top = np.take_along_axis(total, best[:, None], 1)[:, 0] + net.bias
            active = np.maximum(top, 0)
            s = active @ net.weights
            mean, high, low = np.add.reduceat(s, starts) / size, np.maximum.reduceat(s, starts), np.minimum.reduceat(s, starts)
            parts = np.stack([mean, high, low, np.ones(len(docs))], 1)
            off = (1 / (1 + np.exp(-np.clip(parts @ net.combine, -30, 30))) - labels[docs]) / len(docs)
            ds = off[doc] * (net.combine[0] / size[doc] + net.combine[1] * (s == high[doc]) + net.combine[2] * (s == low[doc]))
            dtop = ds[:, None] * net.weights * (top > 0)
            dfilters = np.zeros_like(net.filters)
            where = data[np.arange(len(data))[:, None, None], best[:, :, None] + places]  # chunk, filter, place
            np.add.at(dfilters, (places[None, None], where, np.arange(filters)[None, :, None]), np.broadcast_to(dtop[:, :, None], where.shape))
            gradients = [dfilters + 1e-5 * net.filters, dtop.sum(0), active.T @ ds + 1e-4 * net.weights, parts.T @ off]
            turn += 1
            for p, g, m, v in zip(parameters, gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, most_bytes: int = 10 << 20, folds: int = 5, held: int = 0) -> Network:
    """A network for labels.quality, from whole texts of at most most_rows labelled documents and most_bytes bytes.

    Only rows whose crc32(doc_id as text) mod folds is not `held` are learned from; those with the least hashes are taken, so the
    sample does not depend on how rows are stored. A document that does not fit into the bytes that are left is passed over, so
    that the sample is bounded whatever the length of texts. Of rows that share a doc_id the longest text counts. Null ids and
    labels are left out. Without any rows every text scores one half.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where("_id is not null and quality in (0, 1)")
    known = known.where(F.crc32(F.col("_id").cast("string")) % folds != held).groupBy("_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    own = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    sizes = own.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.max(F.octet_length("_text")).alias("size"), F.max("quality").alias("quality")).collect()
    sizes.sort(key=lambda r: (zlib.crc32(str(r._id).encode()), r._id))
    chosen, room = [], most_bytes
    for r in sizes:
        if r.size <= room:
            chosen.append(r)
            room -= r.size
    if not chosen:
        return Network(np.zeros((WIDTH, 256, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), np.zeros(4, np.float32))
    wanted = docs.sparkSession.createDataFrame([(r._id, r.size, r.quality) for r in chosen], StructType([StructField("_id", docs.schema["doc_id"].dataType), StructField("_size", LongType()), StructField("quality", IntegerType())]))
    texts = own.join(F.broadcast(wanted), "_id").where(F.octet_length("_text") == F.col("_size")).groupBy("_id").agg(F.min("_text").alias("_text"), F.first("quality").alias("quality"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in utf8(batch.column("_text")):
                data = covered(text)
                starts = np.arange(0, len(data) - CHUNK, STRIDE * STEP)
                rows.append(b"".join(data[i : i + CHUNK + WIDTH - 1].tobytes() for i in starts))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("quality"), pa.array(rows, pa.binary())], ["id", "quality", "chunks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(cut, f"id {kind}, quality int, chunks binary").collect()
    rows.sort(key=lambda r: (r.id, r.chunks))
    chunks = [np.frombuffer(r.chunks, np.uint8).reshape(-1, CHUNK + WIDTH - 1) for r in rows]
    return train(chunks, np.array([r.quality for r in rows], np.float32))


def scored(docs: DataFrame, net: Network, text: str = "text", column: str = "score") -> DataFrame:
    """docs with each whole text's probability of good quality. Null texts count as empty; a column of that name is replaced."""
    kept = docs.drop(column)
    schema = extended(kept, f"`{column}` double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = paired(net)
        for batch in slices(batches):
            made = pa.array([score(net, tables, x) for x in utf8(batch.column(text))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, column])

    return kept.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least the threshold, with the columns of docs.

    Each row is judged by its whole text, however long, and for itself: repeated rows stay or go together, rows of one doc_id each by
    their own text. Null and empty texts score alike. A null doc_id is no reason to go. Without labels every row scores one half and
    stays. Empty table: no rows.
    """
    column = unused(docs, "_quality")
    return scored(docs, fit(docs, labels), column=column).where(F.col(column) >= threshold).drop(column)
