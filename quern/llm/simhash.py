"""SimHash fingerprints and exact near-duplicate classes within a Hamming radius.

Different fingerprints are laid out in tiles by the bit counts of their four 16-bit quarters. Two fingerprints within the radius
differ in these counts by no more than the radius in sum, so pairs of tiles whose counts lie further apart are skipped; the others
are compared whole by exclusive-or and bit counts. A task sends on a spanning forest of the links it finds, not the links
themselves, so a group of k near copies costs at most k rows for each pair of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quern.llm import similar
from quern.llm.common import checkpoint, slices, unused, utf8
from quern.llm.components import components

#: Rows of the blocks in which a task compares two tiles.
BLOCK = 1024


def shingles(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of so many words, or of all words if there are fewer; none without words."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(1, len(tokens) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[-n:].tolist()
    return np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits; each is 1 if it is set in over half of the hashes, repeats included. No hashes: zero."""
    n = len(hashes)
    if not n:
        return 0
    set_bits = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        part = hashes[i : i + 4096].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit integer.

    Null and empty texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            prints = [fingerprint(shingles(text, words)) for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def quarters(fp: str = "fp") -> list:
    return [F.bit_count(F.shiftrightunsigned(F.col(fp), 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int").alias(f"q{i}") for i in range(4)]


def tiles(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tile number and number of parts of each class of equal bit counts, and each tile's least and greatest counts.

    counts: rows (q0, q1, q2, q3, number of fingerprints), in order; at most 17 ** 4 of them, whatever the input.
    Classes of at most `size` rows share tiles; a larger one gets tiles of its own, among which its rows are dealt by hash.
    """
    first, parts, boxes, room = [], [], [], 0
    for *q, n in counts.tolist():
        share = -(-n // size)
        if share > 1 or n > room:
            first.append(len(boxes))
            boxes += [[q, q]] * share
            room = size - n if share == 1 else 0
        else:
            first.append(len(boxes) - 1)
            low, high = boxes[-1]
            boxes[-1] = [[min(x) for x in zip(low, q, strict=True)], [max(x) for x in zip(high, q, strict=True)]]
            room -= n
        parts.append(share)
    return np.array(first), np.array(parts), np.array(boxes)


def near(low: np.ndarray, high: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of boxes of bit counts have a gap of at most the radius, in sum and in the whole count."""
    gap = np.maximum(low[:, None] - high[None], low[None] - high[:, None]).clip(0).sum(-1)
    return gap <= radius


class Forest:
    """Disjoint sets of small numbers; each root is the least of its set."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            up = self.roots()
            a, b = up[a], up[b]
            apart = a != b
            pairs = np.unique(np.stack([np.maximum(a, b)[apart], np.minimum(a, b)[apart]], 1), axis=0)
            a, b = pairs[:, 0], pairs[:, 1]
            np.minimum.at(self.up, a, b)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as numbers of rows, that connect whatever lies within the radius: among left, or, with right, between the two."""

    def blocks(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, 4)).astype(np.int64)
        order = np.lexsort(q.T[::-1])
        starts = np.arange(0, len(fp), BLOCK)
        q = q[order]
        return order, np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts)

    (one, low, high), same = blocks(left), right is None
    two, low2, high2 = (one, low, high) if same else blocks(right)
    every = left if same else np.concatenate([left, right])
    shift, trees = 0 if same else len(left), Forest(len(every))
    gap = np.maximum(low[:, None] - high2[None], low2[None] - high[:, None]).clip(0).sum(-1)
    for i, j in zip(*np.nonzero(gap <= radius), strict=True):
        if same and j < i:
            continue
        a, b = one[i * BLOCK : (i + 1) * BLOCK], two[j * BLOCK : (j + 1) * BLOCK] + shift
        x, y = np.nonzero(np.bitwise_count(every[a][:, None] ^ every[b][None]) <= radius)
        trees.link(a[x], b[y])
    roots = trees.roots()
    hung = np.flatnonzero(roots != np.arange(len(every)))
    return hung, roots[hung]


def links(nodes: DataFrame, radius: int, least_tile: int = 512, most_tile: int = 1 << 18, tiles_wanted: int = 24) -> DataFrame:
    """(u, v): a spanning forest, by id, of all links within the radius; nodes has id and fp, ids without repeats or nulls.

    Each node goes to as many tasks as its tile has near tiles: about tiles_wanted, until tiles reach most_tile rows; from there
    on tiles grow in number and no task compares more than two tiles of that size. Only the
    number of fingerprints by quarter counts, at most 83,521 rows, comes to the driver.
    """
    spark = nodes.sparkSession
    counts = np.array([tuple(r) for r in nodes.groupBy(*quarters()).count().orderBy("q0", "q1", "q2", "q3").collect()], np.int64).reshape(-1, 5)
    if not len(counts):
        return spark.createDataFrame([], "u long, v long")
    size = int(min(max(least_tile, counts[:, 4].sum() // tiles_wanted), most_tile))
    first, parts, boxes = tiles(counts, size)
    touch = near(boxes[:, 0], boxes[:, 1], radius)
    layout = pd.DataFrame(counts[:, :4], columns=["q0", "q1", "q2", "q3"]).astype("int32").assign(first=first, parts=parts)
    a, b = np.nonzero(np.triu(touch))
    pairs = pd.DataFrame({"tile": np.concatenate([a, b[a != b]]), "a": np.concatenate([a, a[a != b]]), "b": np.concatenate([b, b[a != b]])})
    by_tile = pairs.groupby("tile")[["a", "b"]].agg(list).reset_index()
    tiled = (
        nodes.select("id", "fp", *quarters())
        .join(F.broadcast(spark.createDataFrame(layout)), ["q0", "q1", "q2", "q3"])
        .select("id", "fp", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).alias("tile"))
    )
    placed = (
        tiled.join(F.broadcast(spark.createDataFrame(by_tile)), "tile")
        .select("id", "fp", "tile", F.explode(F.arrays_zip("a", "b")).alias("p"))
        .select("id", "fp", "p.a", "p.b", (F.col("tile") == F.col("p.a")).alias("is_a"))
    )

    def run(table: pa.Table) -> pa.Table:
        is_a = table["is_a"].to_numpy(zero_copy_only=False)
        same = table.num_rows > 0 and table["a"][0] == table["b"][0]
        order = np.argsort(~is_a, kind="stable")
        ids, fp = table["id"].to_numpy()[order], table["fp"].to_numpy()[order].view(np.uint64)
        n = int(is_a.sum())
        if same or 0 < n < len(ids):
            u, v = forest(fp if same else fp[:n], None if same else fp[n:], radius)
        else:
            u = v = np.zeros(0, np.int64)
        return pa.table({"u": ids[u], "v": ids[v]})

    return placed.groupBy("a", "b").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): component is the least key of all documents reachable over links of at most `radius` bits.

    Texts are taken as UTF-8 bytes, A-Z in lower case, words parted by ASCII white space, shingles of `words` words; null and
    empty texts have fingerprint zero and link like any other. Equal fingerprints form one node from the start, so groups of
    copies cost one row. Rows with a null key keep their fingerprint; their component is the least key that is not null, if any.
    Repeated rows are all returned. Empty table: no rows.
    """
    prints = checkpoint(fingerprints(docs, words, key, text))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(links(nodes.select(F.col("fp").alias("id"), "fp"), radius))
    marked = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = marked.groupBy("root").agg(F.min("least").alias("component"))
    by_print = marked.join(names, "root").select("fp", "component")
    return prints.join(by_print, "fp").select(F.col("key").alias(key), "fp", "component")


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """docs without near copies: of each group the row with the least doc_id stays, with all its columns.

    Linked are rows whose texts' sets of shingles have a Jaccard similarity of at least `least`, by the sets themselves (64-bit hashes
    of shingles) and complete. SimHash fingerprints of the sets come first: those within `radius` bits are laid out and linked as in
    near_duplicates(), each such link is decided by the sets, and only what they leave unconnected is looked for by the complete way
    of similar.groups(), as at a similarity of 0.8 fingerprints differ in about 10 bits. Groups are what such links connect. Rows are told apart by doc_id and text: of rows
    that repeat both one stays, and of rows that share a doc_id and are linked that with the least hash of its text. Null and
    empty texts, and texts without words, are one group. Rows with a null doc_id take no part and stay. Texts of any length are taken
    whole. doc_id must be a whole number. Empty table: no rows.
    """
    if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("keep_one tells documents apart by whole numbers in doc_id")
    id_, mark = unused(docs, "_id"), unused(docs, "_mark")
    own = docs.where("doc_id is not null").withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    known = own.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.col(mark).alias("mark")).alias("key"), "text")
    sets, roots = similar.groups(known, lambda text: np.unique(shingles(text, words)), least, fingerprint, lambda nodes: links(nodes, radius))
    placed = sets.join(roots, sets["set"] == roots["node"], "left").select("key", F.coalesce("root", "set").alias("root"))
    kept = placed.groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.id").alias(id_), F.col("key.mark").alias(f"{id_}_mark"))
    left = own.join(kept, (own["doc_id"] == kept[id_]) & (own[mark] == kept[f"{id_}_mark"]), "left_semi").dropDuplicates(["doc_id", mark])
    return left.drop(mark).unionByName(docs.where("doc_id is null"))
