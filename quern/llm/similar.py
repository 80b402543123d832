"""Links between texts whose sets of shingles have at least some Jaccard similarity, complete and exact.

Candidates come from SimHash first: sets whose fingerprints lie within a radius, decided by the sets themselves. What these do not
connect comes from a prefix filter, as fingerprints of sets at the limit lie too far apart: of two sets that are so much alike, the first few shingles of each in any common order have
one in common. The order puts shingles that a sample of the texts has found often last; it decides how many candidates there are,
not which links are found. A candidate is dropped if parities of the sets prove that too many shingles differ, and else decided by
the sets themselves. Only links that connect something new are looked for. Each set is first compared with the least set of its
lists. Sets of a list that are not connected by that are dealt into cells of bounded size, each set in one of its lists, and
compared there; so a large group of near copies grows together without all of its pairs. What pairs are unconnected after that, and
whose places in the order let them be alike, are compared all, those of large lists in tiles that emit only pairs that may be alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quern.llm.common import checkpoint, released, slices, utf8
from quern.llm.components import components
from quern.llm.repeats import bitmap

#: Bits of a parity; every SAMPLE-th text tells which shingles are frequent, of which at most FREQUENT are remembered.
BITS, SAMPLE, FREQUENT = 2048, 16, 500_000
#: Links of one text that a task decides; more are dealt out over several.
PART = 256
#: Sets of a cell in which all are compared, and how often unconnected sets are dealt into cells before all pairs that are left are compared.
CELL, TURNS = 96, 1
#: Lists of more sets are compared in tiles of TILE sets each.
SMALL, TILE = 64, 512
#: Files of pairs that a task reads at most, where there are more than cores.
WIDE = 16


def noted(df: DataFrame) -> DataFrame:
    """checkpoint() for pairs and places: what made them is let go, and one task reads up to WIDE of the many small files that joins leave."""
    df = checkpoint(df)
    released(df.sparkSession)
    return df.coalesce(max(8, df.sparkSession.sparkContext.defaultParallelism, -(-df.rdd.getNumPartitions() // WIDE)))


def name(hashes: np.ndarray) -> int:
    """The identity of a set of different, sorted shingles, in 64 bits."""
    h = xxh64_intdigest(hashes.tobytes(), 3)
    return h - (h >> 63 << 64)


def parity(hashes: np.ndarray) -> bytes:
    """Shingles dealt over BITS bits, each the parity of their number: two sets differ in at least as many shingles as bits."""
    return np.packbits(np.bincount((hashes >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1).tobytes()


def prefix(hashes: np.ndarray, marks: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first n - ceil(least * n) + 1 of n different shingles, frequent ones (sorted marks with counts) last."""
    n = len(hashes)
    if not n:
        return hashes
    often = np.zeros(n, np.int64)
    if len(marks):
        at = np.searchsorted(marks, hashes).clip(max=len(marks) - 1)
        often = np.where(marks[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))[: n - math.ceil(least * n - 1e-9) + 1]]


def frequent(texts: DataFrame, cut) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that occur most in a sample of the texts, sorted, and in how many of its texts; cut makes sets of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            h, n = np.unique(np.concatenate([cut(t) for t in utf8(batch.column(0))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    part = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    found = part.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    marks, counts = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(marks)
    return marks[order], counts[order]


def held(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (u, v) those whose parities leave it open that they are at least so much alike."""
    side = lambda x: sets.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))

    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            a, b = (np.frombuffer(b"".join(batch.column(f"parity_{x}").to_pylist()), np.uint64).reshape(batch.num_rows, -1) for x in "uv")
            sizes = batch.column("n_u").to_numpy() + batch.column("n_v").to_numpy()
            good = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= sizes * ((1 - least) / (1 + least)) + 1e-6
            yield batch.select(["u", "v"]).filter(pa.array(good))

    return noted(pairs.join(side("v"), "v").join(side("u"), "u").mapInArrow(may_be, "u long, v long"))


def confirmed(held: DataFrame, sets: DataFrame, texts: DataFrame, cut, least: float) -> DataFrame:
    """Of pairs (u, v) those whose sets are at least so much alike; sets has set and key, texts key and text.

    Only texts that have candidates are shuffled: once to be found and once to where they are compared.
    """
    parts = held.groupBy("u").agg(F.ceil(F.count("*") / PART).alias("_parts"))
    asked = held.join(parts, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("_parts")).cast("int").alias("part"))
    firsts = asked.select("u", "part", F.lit(0).alias("role"), F.col("u").alias("set")).distinct()
    places = firsts.union(asked.select("u", "part", F.lit(1).alias("role"), F.col("v").alias("set")))
    places = noted(places.join(sets.select("set", "key"), "set"))
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap(places.select(F.xxhash64("key").alias("h"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            part = batch.filter(pa.array(wanted.value.has(batch.column("h").to_numpy())))
            if part.num_rows:
                yield part.select(["key", "text"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, before = None, np.zeros(0, np.uint64), None
        for batch in slices(batches, 256):
            found = []
            for u, part, role, own, text in zip(*(batch.column(c).to_pylist() for c in ("u", "part", "role", "set")), utf8(batch.column("text")), strict=True):
                if (u, part, role, own) == before:  # a row that comes more than once
                    continue
                before = (u, part, role, own)
                if not role:
                    last, held = (u, part), cut(text)
                    continue
                if (u, part) != last:
                    raise ValueError("a link came without its first text")
                other = cut(text)
                both = len(np.intersect1d(held, other, assume_unique=True))
                if both / (len(held) + len(other) - both) >= least:
                    found.append((u, own))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])

    known = texts.select("key", "text", F.xxhash64("key").alias("h")).mapInArrow(read, "key struct<id: long, mark: long>, text string")
    dealt = known.join(places, "key").select("u", "part", "role", "set", "text").repartition("u", "part")
    found = noted(dealt.sortWithinPartitions("u", "part", "role", "set").mapInArrow(decide, "u long, v long"))
    wanted.destroy()  # what is written needs it no more, and workers keep what they were sent
    return found


def can_be(n: Column, at: Column, m: Column, to: Column, least: float) -> Column:
    """Whether sets of n and m shingles can be so much alike if the first that both have, in the common order, stands at these places."""
    return 1 + F.least(n - at - 1, m - to - 1) >= least / (1 + least) * (n + m) - 1e-6


def unsettled(placed: DataFrame) -> DataFrame:
    """Rows (h, set, n, at, root) of lists h whose sets are not all connected, with the list's size; a frequent list may be dealt over tasks."""
    mixed = placed.groupBy("h").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("size")).where("_a <> _b")
    return placed.join(mixed.select("h", "size"), "h")


def dealt(apart: DataFrame, turn: int) -> DataFrame:
    """Each set in one of its larger lists, another one each turn but the same for sets that share them, and in one of its cells of about CELL sets."""
    chance = 0.5 + F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(1000)) / 1000
    own = apart.groupBy("set").agg(F.max_by(F.struct("h", "n", "at", "root"), F.struct(F.col("size") * chance, "h")).alias("x")).select("set", "x.*")
    cells = own.groupBy("h").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    return own.join(cells, "h").withColumn("cell", F.pmod(F.xxhash64("set", F.lit(turn)), F.col("cells"))).drop("cells")


def met(rows: DataFrame, least: float) -> DataFrame:
    """(u, v) of sets that are not connected yet and meet in a list, or in a cell of one."""
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a.set") < F.col("b.set")) & (F.col("a.root") != F.col("b.root"))
    if "cell" in rows.columns:  # the list is then any that both are in, so that its place says nothing
        same &= F.col("a.cell") == F.col("b.cell")
        good = F.least("a.n", "b.n") >= least * F.greatest("a.n", "b.n") - 1e-6
    else:
        good = can_be(F.col("a.n"), F.col("a.at"), F.col("b.n"), F.col("b.at"), least)
    return a.join(b, same & good).select(F.col("a.set").alias("u"), F.col("b.set").alias("v")).distinct()


def tiled(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v) as met() gives them, less those whose parities differ in too many bits, for large lists: compared in pairs of tiles.

    A set goes to as many tasks as its list has tiles, and only pairs that pass are rows, each from the first of the lists that both
    are in.
    """
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own_lists = rows.groupBy("set").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("x")).select("set", F.transform("x", lambda x: x["h"]).alias("lists"))  # of a set's prefix
    placed = rows.join(sets.select("set", "parity"), "set").join(own_lists, "set").select("h", "set", "n", "at", "root", "parity", "lists", F.pmod(F.xxhash64("set"), tiles).cast("int").alias("own"), tiles.alias("tiles"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    placed = placed.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    share = least / (1 + least)

    def run(table: pa.Table) -> pa.Table:
        a, b, h = (table[c][0].as_py() for c in ("a", "b", "h"))
        lists = table["lists"].to_pylist()
        names, n, at, root, own = (table[c].to_numpy() for c in ("set", "n", "at", "root", "own"))
        bits = np.frombuffer(b"".join(table["parity"].to_pylist()), np.uint64).reshape(table.num_rows, -1)
        right, found = np.flatnonzero(own == b), [np.zeros((0, 2), np.int64)]
        for i in np.flatnonzero(own == a):
            other = right[(root[right] != root[i]) & (1 + np.minimum(n[i] - at[i], n[right] - at[right]) - 1 >= share * (n[i] + n[right]) - 1e-6)]
            other = other[np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64) <= (n[i] + n[other]) * ((1 - least) / (1 + least)) + 1e-6]
            mine = set(lists[i])
            other = other[[next(x for x in lists[j] if x in mine) == h for j in other]]
            found.append(np.sort(np.column_stack([np.full(len(other), names[i]), names[other]]), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return placed.groupBy("h", "a", "b").applyInArrow(run, "u long, v long").distinct()


def by_fingerprint(sets: DataFrame, close) -> DataFrame:
    """(u, v), u < v, of sets (set, fp) that fingerprints propose: those close() connects, and of equal ones each with the least."""
    nodes = checkpoint(sets.groupBy("fp").agg(F.min("set").alias("id")))
    same = sets.join(nodes, "fp").where("set <> id").select(F.col("id").alias("u"), F.col("set").alias("v"))
    return noted(close(nodes.select("id", "fp")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).union(same).distinct())


def apart_in(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (u, v) that roots (node, root) do not connect."""
    now = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"_{x}"))
    return pairs.join(now("u"), "u", "left").join(now("v"), "v", "left").where(F.coalesce("_u", "u") != F.coalesce("_v", "v")).select("u", "v")


def groups(docs: DataFrame, cut, least: float, fingerprint, close) -> tuple[DataFrame, DataFrame]:
    """(set, key) of each different set in docs (key struct<id, mark: long>, text), with its least key, and (node, root) of all that are linked.

    cut makes the sorted different hashes of a text, fingerprint 64 bits of them, and close the links (u, v) of nodes (id, fp) within
    its radius; sets of a similarity of at least `least` are linked, equal ones are one from the start. What is shuffled are
    (1 - least) of all shingles, and the texts that have candidates.
    """
    texts = docs.select("key", "text")
    shared = docs.sparkSession.sparkContext.broadcast(frequent(texts, cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, counts = shared.value
        met: set[int] = set()
        for batch in slices(batches, 512):
            found: list[tuple] = []
            for text in utf8(batch.column(1)):
                hashes = cut(text)
                own = name(hashes)
                first = own not in met
                met.add(own)
                bits = fingerprint(hashes) if first else None
                found.append((own, len(hashes), parity(hashes) if first else None, prefix(hashes, marks, counts, least).view(np.int64) if first else None, bits if bits is None else bits - (bits >> 63 << 64)))
            if len(met) > 1_000_000:
                met.clear()
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "set", "n", "parity", "prefix", "fp"])

    rows = checkpoint(texts.mapInArrow(run, "key struct<id: long, mark: long>, set long, n long, parity binary, prefix array<long>, fp long"))
    shared.destroy()
    firstly = [F.min("key").alias("key"), F.max("n").alias("n"), F.max("parity").alias("parity"), F.max("prefix").alias("prefix"), F.max("fp").alias("fp")]
    whole = checkpoint(rows.groupBy("set").agg(*firstly))
    sets, once = whole.drop("prefix"), whole.select("set", "n", "prefix")
    again = once.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    met_twice = docs.sparkSession.sparkContext.broadcast(bitmap(again))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of prefixes that other sets have too; most do not, and are not sent any further."""
        for batch in batches:
            lists = batch.column("prefix")
            size, flat = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), size)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            kept = np.flatnonzero(met_twice.value.has(flat))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row[kept])) for c in ("set", "n")] + [pa.array(at[kept], pa.int32()), pa.array(flat[kept])], ["set", "n", "at", "h"])

    posts = checkpoint(once.mapInArrow(place, "set long, n long, at int, h long"))
    met_twice.destroy()
    firsts = posts.groupBy("h").agg(F.min(F.struct("set", "n", "at")).alias("first"), F.max("set").alias("_last")).where("first.set <> _last").drop("_last")
    lists = checkpoint(posts.join(firsts, "h"))
    good = can_be(F.col("first.n"), F.col("first.at"), F.col("n"), F.col("at"), least)
    tried = lists.where(good & (F.col("first.set") != F.col("set"))).select(F.col("first.set").alias("u"), F.col("set").alias("v")).distinct()
    proposed = by_fingerprint(sets.select("set", "fp"), close)
    released(docs.sparkSession)
    links = confirmed(held(proposed, sets, least), sets, texts, cut, least)
    tried = noted(apart_in(tried, components(links)).join(proposed, ["u", "v"], "left_anti"))
    released(docs.sparkSession)
    links = links.union(confirmed(held(tried, sets, least), sets, texts, cut, least))
    tried = noted(tried.union(proposed))
    roots = components(links)
    placed = lists.join(roots, lists["set"] == roots["node"], "left").select("h", "set", "n", "at", F.coalesce("root", "set").alias("root"))
    for turn in range(TURNS + 1):
        apart = checkpoint(unsettled(placed))
        largest = apart.agg(F.max("size")).first()[0]
        if largest is None:
            break
        whole_ = turn == TURNS or largest <= 2 * CELL
        if whole_:
            pairs = met(apart.where(F.col("size") <= SMALL), least).union(tiled(apart.where(F.col("size") > SMALL), sets, least)).distinct()
        else:
            pairs = met(dealt(apart, turn), least)
        open_ = held(pairs.join(tried, ["u", "v"], "left_anti"), sets, least)
        root = lambda x: apart.select(F.col("set").alias(x), F.col("root").alias(f"r{x}")).distinct()
        open_ = open_.join(root("u"), "u").join(root("v"), "v")
        if whole_:  # first one pair for each two groups, then what that has not connected
            open_ = noted(open_.select("u", "v", F.least("ru", "rv").alias("ru"), F.greatest("ru", "rv").alias("rv")))
            one = noted(open_.groupBy("ru", "rv").agg(F.min(F.struct(F.xxhash64("u", "v"), "u", "v")).alias("x")).select("x.u", "x.v", "ru", "rv"))
            some = confirmed(one.select("u", "v"), sets, texts, cut, least)
            joined = components(one.join(some, ["u", "v"]).select("ru", "rv"))
            now = lambda x: joined.select(F.col("node").alias(x), F.col("root").alias(f"_{x}"))
            rest = open_.join(now("ru"), "ru", "left").join(now("rv"), "rv", "left").where(F.coalesce("_ru", "ru") != F.coalesce("_rv", "rv"))
            released(docs.sparkSession)
            left = confirmed(noted(rest.select("u", "v").join(one.select("u", "v"), ["u", "v"], "left_anti")), sets, texts, cut, least)
            links = links.union(some).union(left)
            break
        more = confirmed(open_.select("u", "v"), sets, texts, cut, least)
        links, tried = links.union(more), noted(tried.union(pairs))
        joined = components(more.join(root("u"), "u").join(root("v"), "v").select("ru", "rv"))
        placed = apart.drop("size").join(joined, apart["root"] == joined["node"], "left").select("h", "set", "n", "at", F.coalesce(joined["root"], apart["root"]).alias("root"))
        released(docs.sparkSession)
    return sets.select("set", "key"), components(links)
