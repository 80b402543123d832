"""A vector index of coarse cells with half-precision vectors, kept as a table partitioned by cell, and searches in it.

Vectors are brought to length one, so nearness is cosine. Centres of cells come from a bounded sample; every row then goes to the
cell of its nearest centre, with the columns that searches filter by. A cell knows the greatest angle of its members to its centre,
so the angle of a query to a centre bounds how near any member can be: cells that cannot hold an answer are not compared. That makes
threshold searches and exact searches complete; they meet in tiles, a part of the members with a part of the queries each. A search may
also be told to read a number of cells only; queries then go to these alone. Estimates are made in half precision and decided, within
their error, on the original vectors.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.retrieval import cosine
from quern.operators.rounds import fresh_folder, settled

#: Rows of the sample that centres are learned from, cells at most, rounds of learning.
SAMPLE, CELLS, ROUNDS = 20_000, 4096, 8
#: Members of a cell that a task compares at once; a larger cell is dealt over several. Queries of a block.
PART, BLOCK = 65_536, 1024
#: Members and queries of a tile at most, tiles that there should be at least, and members compared with a block of queries at once.
MEMBERS, QUERIES, TILES, RUN = 262_144, 65_536, 48, 2048
#: What a cosine of two vectors of length one can be off by in half precision, for up to some thousand dimensions.
ERROR = 2e-3


@dataclass(frozen=True)
class Index:
    folder: str
    dim: int
    centres: np.ndarray  # of all cells, length one
    angles: np.ndarray  # greatest of each cell's members to its centre
    sizes: np.ndarray  # members of each cell

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/cells")


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell, best = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for i in range(0, len(vectors), 4096):
        near = vectors[i : i + 4096] @ centres.T
        cell[i : i + 4096] = near.argmax(axis=1)
        best[i : i + 4096] = near.max(axis=1)
    return cell, np.arccos(np.clip(best, -1, 1))


def learned(sample: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Centres of so many cells, by rounds of k-means on the sphere; a cell that empties starts again at a random vector."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        cell, _ = nearest_centre(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        flat = np.linalg.norm(sums, axis=1) < 1e-9
        sums[flat] = sample[rng.choice(len(sample), int(flat.sum()))]
        centres = unit(sums)
    return centres


def usable(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Rows whose vector has dim finite numbers and is not zero."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where((F.size(column) == dim) & ~F.coalesce(odd, F.lit(True)) & F.exists(column, lambda x: x != 0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def build(vectors: DataFrame, dim: int, filters: list[str] | None = None, cells: int | None = None, folder: str | None = None) -> Index:
    """Write an index of vectors (vec_id, embedding, filters ...) to a folder, in the shared one if none is named.

    Centres are fit on at most SAMPLE rows, those with the least hashes of vec_id; all rows are indexed. There are as many cells as
    the root of the number of rows, at most CELLS. Vectors that are null, zero, of another length or hold numbers that are not finite
    are left out; rows that repeat a vec_id are all kept. An empty table gives an index without cells.
    """
    spark, filters = vectors.sparkSession, filters or []
    good = usable(vectors, dim).select("vec_id", "embedding", *filters)
    n = good.count()
    made = folder or fresh_folder(spark, "vectors")
    rows = good.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()["embedding"].combine_chunks() if n else None
    sample = unit(matrix(rows, dim)) if n else np.zeros((0, dim))
    centres = learned(sample, min(cells or max(1, math.isqrt(n)), CELLS, len(sample))) if n else np.zeros((0, dim))
    shared = spark.sparkContext.broadcast(centres)
    kept = good.drop("embedding").schema
    schema = StructType([*kept.fields, *StructType.fromDDL("half binary, angle double, cell int").fields])
    names = [*kept.names, "half", "angle", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = unit(matrix(batch.column("embedding"), dim))
            if not len(own):
                continue
            cell, angle = nearest_centre(own, shared.value)
            half = [v.tobytes() for v in own.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-3]), pa.array(half, pa.binary()), pa.array(angle), pa.array(cell, pa.int32())], names)

    if n:
        placed = good.mapInArrow(run, schema)
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{made}/cells")
    stats = spark.read.parquet(f"{made}/cells").groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect() if n else []  # a row for each cell
    angles, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in stats:
        angles[r.cell], sizes[r.cell] = r.angle, r.n
    table = spark.createDataFrame([(i, json.dumps(c.tolist()), float(a), int(s)) for i, (c, a, s) in enumerate(zip(centres, angles, sizes, strict=True))] or [(-1, "[]", 0.0, dim)], "cell int, centre string, angle double, n long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{made}/centres")
    return Index(made, dim, centres, angles, sizes)


def load(spark: SparkSession, folder: str) -> Index:
    rows = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()
    if rows[0].cell < 0:
        return Index(folder, rows[0].n, np.zeros((0, rows[0].n)), np.zeros(0), np.zeros(0, np.int64))
    centres = np.array([json.loads(r.centre) for r in rows])
    return Index(folder, centres.shape[1], centres, np.array([r.angle for r in rows]), np.array([r.n for r in rows]))


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def best_of(known: np.ndarray, own: np.ndarray, cells: np.ndarray, bounds: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, near) of the estimates that leave it open whether a member is one of the k + 1 nearest of a query.

    known are members in the order of their cells, own a block of queries, bounds how near the members of each cell can be to each
    query; cells are columns of bounds. Members are compared in runs, those that may be nearest first; a run that cannot hold an answer of any query is left out.
    """
    starts = np.arange(0, len(known), RUN)
    may = np.stack([bounds[:, cells[i] : cells[min(i + RUN, len(cells)) - 1] + 1].max(axis=1) for i in starts], axis=1)
    last = np.full(len(own), -np.inf)  # of the k + 1 best so far
    kept, fresh, seen, settled_at = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)], [], 0, 0

    def settle() -> None:
        q, v, near = (np.concatenate([a, *b]) for a, b in zip(kept, zip(*fresh, strict=True), strict=True))
        order = np.lexsort((-near, q))
        q, v, near = q[order], v[order], near[order]
        firsts = np.searchsorted(q, np.arange(len(own)))
        full = np.flatnonzero(np.append(firsts[1:], len(q)) - firsts > k)
        last[full] = near[firsts[full] + k]
        good = near >= last[q] - 2 * ERROR
        kept[:] = q[good], v[good], near[good]
        fresh.clear()

    for run in np.argsort(-may.mean(axis=0), kind="stable"):
        open_ = np.flatnonzero(may[:, run] >= np.maximum(least - 1e-6, last - ERROR - 1e-5))
        if not len(open_):
            continue
        part = known[starts[run] : starts[run] + RUN]
        near = own[open_] @ part.T
        floor = np.maximum(least - ERROR, last[open_] - 2 * ERROR)
        if not seen and len(part) > k + 1:
            floor = np.maximum(floor, np.partition(near, -k - 1, axis=1)[:, -k - 1] - 2 * ERROR)
        at = np.flatnonzero(near >= floor.astype(np.float32)[:, None])
        row, column = np.divmod(at, len(part))
        fresh.append((open_[row], column + starts[run], near.ravel()[at]))
        seen += len(part)
        if seen >= 2 * settled_at:
            settle()
            settled_at = seen
    if fresh:
        settle()
    return kept[0], kept[1], kept[2].astype(np.float64)


def _tiled(index: Index, rows: DataFrame, asked: DataFrame, k: int, least: float, by: str | None) -> DataFrame:
    """(query_id, vec_id, near) of the best of each tile: members are dealt by hash, queries too, and each part meets each, of one value of `by`."""
    dim, asked = index.dim, asked if by is None else asked.where(F.col(by).isNotNull())
    shared = rows.sparkSession.sparkContext.broadcast((index.centres, index.angles))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = unit(matrix(batch.column("embedding"), dim)).astype(np.float32)
            yield batch.drop_columns(["embedding"]).append_column("vector", pa.array([v.tobytes() for v in own], pa.binary()))

    def sized(n: str, m: str) -> tuple[Column, Column]:
        """Parts of so many members and queries: no more of either than a tile may hold, and enough tiles."""
        members = F.ceil(F.col(n) / MEMBERS)
        few = F.ceil(F.lit(TILES) / members)
        return members.cast("int"), F.greatest(F.ceil(F.col(m) / QUERIES), F.least(few, F.ceil(F.col(m) / BLOCK))).cast("int")

    group = F.lit(0) if by is None else F.col(by)
    members = rows.select(group.alias("_by"), "vec_id", "half", "cell")
    queries = asked.withColumn("_by", group).select("_by", "query_id", "embedding").mapInArrow(single, f"_by {'int' if by is None else _kind(asked, by)}, query_id {_kind(asked, 'query_id')}, vector binary")
    sizes = members.groupBy("_by").agg(F.count("*").alias("_n")).join(asked.groupBy(group.alias("_by")).agg(F.count("*").alias("_m")), "_by")
    sizes = settled(sizes.select("_by", *(c.alias(x) for c, x in zip(sized("_n", "_m"), ("_ms", "_qs"), strict=True))))
    if sizes.count() < 100_000:  # few values may have most rows each, many cannot
        sizes = F.broadcast(sizes)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = members.join(sizes, "_by").select("_by", F.pmod(F.xxhash64("vec_id"), F.col("_ms")).cast("int").alias("_m"), every("_qs").alias("_q"), "vec_id", "half", "cell")
    routed = queries.join(sizes, "_by").select("_by", every("_ms").alias("_m"), F.pmod(F.xxhash64("query_id"), F.col("_qs")).cast("int").alias("_q"), "query_id", "vector")

    def compare(held: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if held.num_rows and asking.num_rows:
            centres, angles = shared.value
            cells = held["cell"].to_numpy()
            placed = np.argsort(cells, kind="stable")
            cells, known = cells[placed], np.frombuffer(b"".join(held["half"].to_pylist()), np.float16).reshape(-1, dim)[placed].astype(np.float32)
            met, cells = np.unique(cells, return_inverse=True)
            own = np.frombuffer(b"".join(asking["vector"].to_pylist()), np.float32).reshape(-1, dim)
            order = np.argsort(nearest_centre(own, centres.astype(np.float32))[0], kind="stable")  # queries of a block that are near each other see the same cells
            for start in range(0, len(order), BLOCK):
                at = order[start : start + BLOCK]
                bounds = np.cos(np.maximum(0, np.arccos(np.clip(unit(own[at].astype(np.float64)) @ centres[met].T, -1, 1)) - angles[met] - 1e-6))
                q, v, near = best_of(known, own[at], cells, bounds, k, least)
                out.append((at[q], placed[v], near))
        q, v, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": asking["query_id"].take(pa.array(q)), "vec_id": held["vec_id"].take(pa.array(v)), "near": s})

    keys = ["_by", "_m", "_q"]
    return dealt.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(compare, f"query_id {_kind(asked, 'query_id')}, vec_id {_kind(rows, 'vec_id')}, near double")


def _probed(index: Index, rows: DataFrame, asked: DataFrame, k: int, least: float, probes: int, by: str | None) -> DataFrame:
    """(query_id, vec_id, near) of the best of each cell that a query is sent to."""
    dim, centres, angles, sizes = index.dim, index.centres, index.angles, index.sizes
    parts = np.maximum(1, -(-sizes // PART))
    shared = rows.sparkSession.sparkContext.broadcast((centres, angles, parts))
    columns = ["query_id", *([by] if by else [])]
    kinds = [f"{c} {asked.schema[c].dataType.simpleString()}" for c in columns]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to the cells that it has to see, in the order of how near their members may be."""
        centres, angles, parts = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                own = unit(matrix(piece.column("embedding"), dim))
                bound = np.cos(np.maximum(0, np.arccos(np.clip(own @ centres.T, -1, 1)) - angles - 1e-9))
                order = np.argsort(-bound, axis=1, kind="stable")[:, :probes]
                row, place = np.nonzero(np.take_along_axis(bound, order, 1) >= least - 1e-6)
                cell = order[row, place]
                times = parts[cell]
                rows = np.repeat(row, times)
                part = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
                near = np.repeat(bound[row, cell], times)
                half = [v.astype(np.float32).tobytes() for v in own]
                yield pa.RecordBatch.from_arrays([*(piece.column(c).take(pa.array(rows)) for c in columns), pa.array(np.repeat(cell, times), pa.int32()), pa.array(part, pa.int32()), pa.array(near), pa.array([half[i] for i in rows], pa.binary())], [*columns, "cell", "part", "bound", "vector"])

    routed = asked.mapInArrow(route, f"{', '.join(kinds)}, cell int, part int, bound double, vector binary")
    count = F.element_at(F.lit(parts.tolist()).cast("array<int>"), F.col("cell") + 1)
    dealt = rows.select("vec_id", *([by] if by else []), "half", "cell", F.pmod(F.xxhash64("vec_id"), count).cast("int").alias("part"))

    def compare(members: pa.Table, asking: pa.Table) -> pa.Table:
        """The best of a part of a cell for each query, by estimates; more than k where the error leaves it open."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if members.num_rows and asking.num_rows:
            known = np.frombuffer(b"".join(members["half"].to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)
            same = None
            if by:
                codes = {v: i for i, v in enumerate(dict.fromkeys(members[by].to_pylist()))}
                mine, theirs = (np.array([codes.get(v, -1) if v is not None else -2 for v in t[by].to_pylist()]) for t in (members, asking))
                same = lambda i: np.flatnonzero((mine == theirs[i]) & (mine >= 0))
            own = np.frombuffer(b"".join(asking["vector"].to_pylist()), np.float32).reshape(-1, dim)
            for i in range(len(own)):
                at = same(i) if same else np.arange(len(known))
                near = known[at] @ own[i]
                open_ = near >= least - ERROR
                if open_.sum() > k + 1:  # one more, as the query itself may be among them
                    open_ &= near >= np.partition(near[open_], -k - 1)[-k - 1] - 2 * ERROR
                hit = np.flatnonzero(open_)
                out.append((np.full(len(hit), i), at[hit], near[hit].astype(np.float64)))
        q, v, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": asking["query_id"].take(pa.array(q)), "vec_id": members["vec_id"].take(pa.array(v)), "near": s})

    return dealt.groupBy("cell", "part").cogroup(routed.groupBy("cell", "part")).applyInArrow(compare, f"query_id {_kind(asked, 'query_id')}, vec_id {_kind(rows, 'vec_id')}, near double")


def search(index: Index, vectors: DataFrame, queries: DataFrame, k: int = 40, least: float = -1.0, probes: int | None = None, where: Column | None = None, by: str | None = None, but_itself: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k indexed vectors nearest to each query (query_id, embedding), by cosine, at least `least`.

    where filters the indexed rows by their filter columns before anything is compared; by names a filter column that must be equal
    in query and row. probes: cells read for a query, those first that may hold the nearest; without it all cells are read that can
    hold an answer, and the result is exact. Scores are cosines of the original vectors, rounded to six places, ties by vec_id; vectors
    (vec_id, embedding) is where these are. but_itself leaves out the row whose id is the query's. Queries without a usable vector,
    empty tables and an empty index give no rows. Of rows that share a vec_id one counts.
    """
    spark = vectors.sparkSession
    ids, asked_ids = vectors.schema["vec_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"query_id {asked_ids}, rank int, vec_id {ids}, score double")
    if not len(index.centres):
        return empty
    dim = index.dim
    asked = usable(queries, dim).select("query_id", "embedding", *([by] if by else []))
    rows = index.rows(spark) if where is None else index.rows(spark).where(where)
    found = (_probed(index, rows, asked, k, least, probes, by) if probes else _tiled(index, rows, asked, k, least, by)).select("query_id", "vec_id", "near")
    if but_itself:
        found = found.where(F.col("query_id").cast("string") != F.col("vec_id").cast("string"))
    by_query = W.partitionBy("query_id").orderBy(F.desc("near"))
    found = settled(found)
    last = found.withColumn("_r", F.row_number().over(by_query)).where(F.col("_r") <= k).groupBy("query_id").agg(F.min("near").alias("_last"), F.count("*").alias("_n"))
    open_ = found.join(last, "query_id").where((F.col("_n") < k) | (F.col("near") >= F.col("_last") - 2 * ERROR)).select("query_id", "vec_id")
    exact = open_.join(vectors.dropDuplicates(["vec_id"]).select("vec_id", F.col("embedding").alias("_v")), "vec_id").join(asked.dropDuplicates(["query_id"]).select("query_id", F.col("embedding").alias("_q")), "query_id")
    scored = exact.select("query_id", "vec_id", F.round(cosine(F.col("_v"), F.col("_q")), 6).alias("score")).distinct().where(F.col("score") >= least)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answers (query_id, vec_id) that were found; 1 if there are none."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return both.hits / both.n if both.n else 1.0
