"""Graph work over edge tables: reachability by levels, paths, degrees, propagation, rules."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.rounds import fresh_folder, settled

BLOCK = 4_000_000  # pairs over one other that are made in a group


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of an undirected graph; parallel edges count once, a loop once."""
    return symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def levels(edges: DataFrame, starts: DataFrame, depth: int, directed: bool = True) -> DataFrame:
    """(node, hops) of all nodes within `depth` steps of the starts (node), by the fewest steps.

    Each step joins only the frontier with the edges; nodes met before are dropped, so a step costs what it adds.
    """
    ways = edges.select("src", "dst").distinct() if directed else symmetric(edges)
    found = starts.select("node").distinct().withColumn("hops", F.lit(0))
    frontier = found
    for hop in range(1, depth + 1):
        following = frontier.join(ways, frontier["node"] == ways["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = settled(following.join(found.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)))
        found = found.union(frontier)
    return found


def closure(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(ancestor, node) for each node and all it lies under, itself included; edges run from child to parent, cycles are allowed.

    Path lengths double with each round, so a hierarchy of depth d takes log2(d) rounds, and one more that adds nothing. Not
    settled by then: an error.
    """
    pairs = edges.select(F.col("src").alias("node"), F.col("dst").alias("ancestor")).where("node <> ancestor").distinct()
    nodes = pairs.select("node").union(pairs.select("ancestor")).distinct()
    known = settled(pairs.union(nodes.select("node", F.col("node").alias("ancestor"))))
    size = known.count()
    for _ in range(most_rounds):
        upper = known.select(F.col("node").alias("_middle"), F.col("ancestor").alias("_top"))
        known = settled(known.join(upper, known["ancestor"] == upper["_middle"]).select("node", F.col("_top").alias("ancestor")).distinct())
        if (now := known.count()) == size:
            return known.select("ancestor", "node")
        size = now
    raise RuntimeError(f"the closure was not found in {most_rounds} rounds")


def cyclic(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node) of all nodes that lie on a cycle: what would make a hierarchy invalid. edges is (src, dst) with no nulls.

    Nodes without edges into or out of them are peeled off until none is left. In what stays, the greatest node that reaches each node
    is passed along; those that reach it back in turn share a cycle with it, and are taken out; and so on. Each round costs joins with
    the edges that are left; no pairs of nodes are kept.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    left, found, before = settled(edges.where("src <> dst").select("src", "dst").distinct()), settled(loops), None
    for _ in range(most_rounds):
        n = left.count()
        if n == 0:
            return found.distinct()
        if n != before:  # peel
            before = n
            left = settled(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            continue
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        tops = propagated(left, nodes.withColumn("level", F.col("node")))  # the greatest node that reaches each
        inside = left.join(tops.select(F.col("node").alias("src"), F.col("level").alias("_a")), "src").join(tops.select(F.col("node").alias("dst"), F.col("level").alias("_b")), "dst").where("_a = _b")
        inside = settled(inside.select("src", "dst", F.col("_a").alias("top")))
        back = settled(inside.where("dst = top").select(F.col("src").alias("node"), "top").distinct())
        front = back
        while not front.isEmpty():
            step = inside.join(front.select(F.col("node").alias("dst"), "top"), ["dst", "top"]).select(F.col("src").alias("node"), "top").distinct()
            front = settled(step.join(back, ["node", "top"], "left_anti"))
            back = settled(back.union(front))
        found = settled(found.union(back.select("node")).distinct())
        gone = back.select("node").union(tops.where("node = level").select("node")).distinct()
        left = settled(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        before = None
    raise RuntimeError(f"cycles were not settled in {most_rounds} rounds")


def paths(edges: DataFrame, start: str, target: str, hops: int, most: int, per_hop: int | None = None) -> DataFrame:
    """The best simple paths: the product of edge weights, times 0.5 for each lineage edge, 0.9 for each step but the first and
    1.5 as the target is reached; ties go to fewer steps, then to the path's names.

    edges has src, dst, weight and, if it likes, is_lineage, and is followed both ways. per_hop keeps so many partial paths of each step.
    """
    known = edges if "is_lineage" in edges.columns else edges.withColumn("is_lineage", F.lit(False))
    worth = F.col("weight") * F.when(F.col("is_lineage"), 0.5).otherwise(1.0)
    ways = known.select("src", "dst", worth.alias("worth")).union(known.select("dst", "src", worth)).groupBy("src", "dst").agg(F.max("worth").alias("worth"))
    now = ways.where(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"), F.col("worth").alias("score"))
    done = now.where(F.col("at") == target)
    for _ in range(1, hops):
        now = now.where(F.col("at") != target)
        if per_hop is not None:
            now = now.orderBy(F.desc("score"), "path").limit(per_hop)
        longer = now.join(ways, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        now = settled(longer.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"), (F.col("score") * F.col("worth") * 0.9).alias("score")))
        done = done.union(now.where(F.col("at") == target))
    told = done.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"), F.round(F.col("score") * 1.5, 6).alias("score"))
    return told.orderBy(F.desc("score"), "hops", "path").limit(most)


def ranked_paths(edges: DataFrame, start: str, hints: list[str], hops: int = 3, per_hop: int = 200, most: int = 5, fewest: int = 1) -> DataFrame:
    """(place, path, hops, transfers, hits, score, truncated) of the best paths from a table to any other, over joins and lineage.

    edges has src, src_column, dst, dst_column, kind (join or lineage), confidence and origin, and is followed both ways; lineage
    without columns leads nowhere. A path's score is the product of its confidences, times 0.5 for each lineage step and 0.9 for each
    step but the first, and times 1.5 if it ends at one of the hints, which bind nothing. No table comes twice on a path. Of the paths
    of so many steps the best per_hop are followed, ties go by the whole sequence of steps; paths of fewer than `fewest` steps are not
    told. truncated: a step had more paths than were followed, or more paths were found than are told.
    """
    known = edges.where("kind <> 'lineage' or (coalesce(src_column, '') <> '' and coalesce(dst_column, '') <> '')")
    worth = F.col("confidence") * F.when(F.col("kind") == "lineage", 0.5).otherwise(1.0)
    step = lambda a, b, turned: F.struct("kind", F.col(a).alias("enter"), F.col(f"{a}_column").alias("enter_column"), F.col(b).alias("leave"), F.col(f"{b}_column").alias("leave_column"), F.lit(turned).alias("turned"), "origin")
    ways = known.select(F.col("src").alias("at"), step("src", "dst", False).alias("step"), worth.alias("worth")).union(known.select("dst", step("dst", "src", True), worth)).where("at <> step.leave")
    hit = F.array_contains(F.lit(list(hints)).cast("array<string>"), F.col("at"))
    front, found, cut = None, None, F.lit(False)
    for turn in range(hops):
        if front is None:
            longer = ways.where(F.col("at") == start).select(F.array("step").alias("steps"), F.array(F.lit(start), "step.leave").alias("path"), F.col("step.leave").alias("at"), F.col("worth").alias("score"))
        else:
            met = front.join(ways, "at").where(~F.array_contains("path", F.col("step.leave")))
            longer = met.select(F.concat("steps", F.array("step")).alias("steps"), F.concat("path", F.array("step.leave")).alias("path"), F.col("step.leave").alias("at"), (F.col("score") * F.col("worth") * 0.9).alias("score"))
        order = [F.desc(F.col("score") * F.when(hit, 1.5).otherwise(1.0)), F.col("steps")]
        best = settled(longer.orderBy(*order).limit(per_hop + 1))  # one more tells whether there are more
        cut = cut | F.lit(best.count() > per_hop)
        front = settled(best.orderBy(*order).limit(per_hop))
        found = front if found is None else found.union(front)
    told = found.where(F.size("steps") >= fewest).select("path", "steps", hit.alias("hits"), F.round(F.col("score") * F.when(hit, 1.5).otherwise(1.0), 6).alias("score"))
    told = settled(told)
    cut = cut | F.lit(told.count() > most)
    place = F.row_number().over(W.orderBy(F.desc("score"), "steps"))  # at most hops times per_hop rows
    transfers = F.size(F.filter("steps", lambda x: x["kind"] == "lineage"))
    return told.withColumn("place", place).where(F.col("place") <= most).select("place", F.array_join("path", ">").alias("path"), F.size("steps").alias("hops"), transfers.alias("transfers"), "hits", "score", cut.alias("truncated"))


def propagated(edges: DataFrame, marks: DataFrame, pins: DataFrame | None = None, most_rounds: int = 1000) -> DataFrame:
    """(node, level): the greatest level of any node that reaches it along the edges; marks has node and level, and so have pins,
    whose nodes keep the level they are given. Rounds go on until nothing rises; levels are few, so that ends soon.
    """
    ways = edges.select("src", "dst").distinct()
    held = (lambda rows: rows.join(pins.select("node"), "node", "left_anti").union(pins.select("node", "level"))) if pins is not None else lambda rows: rows
    now, before = settled(held(marks.groupBy("node").agg(F.max("level").alias("level")))), None
    for _ in range(most_rounds):
        passed = now.join(ways, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "level")
        now = settled(held(now.union(passed).groupBy("node").agg(F.max("level").alias("level"))))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("node", "level").cast("decimal(38,0)"))).first()
        if mark == before:
            return now
        before = mark
    raise RuntimeError(f"levels still rose after {most_rounds} rounds")


def popular(edges: DataFrame, most: int) -> DataFrame:
    """The nodes with the greatest degree, ties by name."""
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(most)


def edge_degrees(edges: DataFrame) -> DataFrame:
    """(src, dst, degree): of each edge the sum of its ends' degrees."""
    d = degrees(edges)
    one, two = d.select(F.col("node").alias("src"), F.col("degree").alias("_a")), d.select(F.col("node").alias("dst"), F.col("degree").alias("_b"))
    return edges.select("src", "dst").distinct().join(one, "src").join(two, "dst").select("src", "dst", (F.col("_a") + F.col("_b")).alias("degree"))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes (node) that go."""
    left = edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti")
    return left.join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select(*edges.columns)


def subgraph(edges: DataFrame, start: str | None, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, hops, is_truncated) about a start, by steps and then by degree, at most so many, and the edges among them.

    Without a start the nodes of greatest degree are taken. is_truncated tells whether the cap left any out.
    """
    d = degrees(edges)
    if start is None:
        ordered = d.select("node", F.lit(0).alias("hops"), "degree")
    else:
        seed = d.where(F.col("node") == start).select("node")
        ordered = levels(edges, seed, depth, directed=False).join(d, "node")
    first = settled(ordered.orderBy("hops", F.desc("degree"), "node").limit(most + 1))
    place = F.row_number().over(W.orderBy("hops", F.desc("degree"), "node"))  # of at most `most` + 1 rows
    nodes = first.withColumns({"_n": place, "is_truncated": F.count("*").over(W.partitionBy(F.lit(0))) > most}).where(F.col("_n") <= most)
    kept = nodes.select("node")
    ends = symmetric(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    inside = ends.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes.select("node", "hops", "is_truncated"), inside.select(F.concat_ws("-", "src", "dst").alias("id"), "src", "dst")


def walked(edges: DataFrame, starts: DataFrame, direction: str, depth: int, least: float = 0.0) -> DataFrame:
    """(src, dst, hop) of lineage edges (src, dst, confidence) that a walk up, down or both ways follows, each at its earliest hop.

    Edges below the least confidence are no way. An edge to a node that was seen before is told but not walked on from.
    """
    sure = edges.where(F.col("confidence") >= least).select("src", "dst").distinct()
    down, up = sure.select("src", "dst", F.col("src").alias("_from"), F.col("dst").alias("_to")), sure.select("src", "dst", F.col("dst").alias("_from"), F.col("src").alias("_to"))
    ways = {"down": down, "up": up, "both": down.union(up)}[direction]
    seen = frontier = settled(starts.select("node").distinct())
    found = None
    for hop in range(1, depth + 1):
        step = settled(frontier.join(ways, frontier["node"] == ways["_from"]).select("src", "dst", "_to").distinct())
        told = step.select("src", "dst", F.lit(hop).alias("hop")).distinct()
        found = told if found is None else found.union(told)
        frontier = settled(step.select(F.col("_to").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.union(frontier)
    return found.groupBy("src", "dst").agg(F.min("hop").alias("hop"))


def two_hop_pairs(edges: DataFrame, most_degree: int) -> DataFrame:
    """(a, via, c) of nodes that are linked over one other but not themselves; hubs of a greater degree are no way, the first way by name counts.

    Each node's neighbours come together once, of a hub at most one distinct more than a way may have. Their lists are then sent to blocks,
    ranges of names of a: one list serves all pairs of a block, so lists travel and not pairs, and a pair is made in one block alone.
    """
    spark, plain, kind = edges.sparkSession, edges.select("src", "dst"), edges.schema["src"].dataType.simpleString()
    folder = fresh_folder(spark, "pairs")
    turn = F.dense_rank().over(W.partitionBy("src").orderBy("dst"))
    near = plain.union(plain.select("dst", "src")).withColumn("_n", turn).where(F.col("_n") <= most_degree + 1)
    ends = near.groupBy(F.col("src").alias("via")).agg(F.max("_n").alias("_n"), F.array_sort(F.collect_set(F.when(F.col("src") != F.col("dst"), F.col("dst")))).alias("ends"))
    ends.where((F.col("_n") <= most_degree) & (F.size("ends") > 1)).select("via", "ends").write.parquet(f"{folder}/spokes")
    spokes = spark.read.parquet(f"{folder}/spokes")
    size, end = F.size("ends").cast("long"), lambda at: F.element_at("ends", at)
    told = spokes.agg(F.coalesce(F.sum(size * (size - 1) / 2), F.lit(0)).cast("long").alias("n"), F.min(end(1)).alias("a"), F.max(end(-2)).alias("b"), F.min(end(2)).alias("c"), F.max(end(-1)).alias("d")).first()
    cuts = _cuts(spokes, told.n)
    lists = spokes.mapInArrow(_dealt(spark.sparkContext.broadcast(cuts)), f"block int, via {kind}, n int, ends array<{kind}>")
    pairs = lists.repartition(len(cuts) + 1, "block").groupBy("block").applyInArrow(_met, f"a {kind}, c {kind}, via {kind}")
    ordered = plain.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("c"))
    ordered.where(F.col("a").between(F.lit(told.a), F.lit(told.b)) & F.col("c").between(F.lit(told.c), F.lit(told.d))).write.parquet(f"{folder}/direct")  # links that may be pairs
    return pairs.join(spark.read.parquet(f"{folder}/direct").distinct(), ["a", "c"], "left_anti").select("a", "c", "via")


def _cuts(spokes: DataFrame, n: int) -> list:
    """First names of all blocks but the first, so that a block has about BLOCK of n pairs. A name with more comes as often as it fills blocks.

    They are placed by ways picked by hash, some hundred names a block; what is picked decides on sizes of blocks alone.
    """
    blocks = max(-(-n // BLOCK), min(2 * spokes.sparkSession.sparkContext.defaultParallelism, n // (BLOCK // 16)))
    if blocks < 2:
        return []
    names = spokes.select(F.sum(F.size("ends"))).first()[0]
    picked = spokes.where(F.pmod(F.xxhash64("via"), F.lit(max(1, names // min(100 * blocks, 1_000_000)))) == 0)
    told = picked.select(F.posexplode("ends").alias("_i", "a"), F.size("ends").alias("n")).select("a", (F.col("n") - 1 - F.col("_i")).alias("n")).where("n > 0").toArrow()
    rows = sorted(zip(told["a"].to_pylist(), told["n"].to_pylist(), strict=True))
    filled = np.cumsum([n for _, n in rows])
    return [rows[i][0] for i in np.searchsorted(filled, filled[-1] * np.arange(1, blocks) / blocks)] if rows else []


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of sizes[0] numbers, and so on."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _dealt(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists (via, ends) as (block, via, n, ends): of each block the ends from its first one on, n of them its own.

    An end that fills several blocks meets the others there by their hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for whole in batches:
            sizes = whole.column("ends").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            filled = np.cumsum(sizes * (sizes - 1) // 2)
            for at, until in pairwise([*np.unique(np.searchsorted(filled, np.arange(0, filled[-1], BLOCK // 2))), len(sizes)] if len(sizes) else []):
                batch = whole.slice(at, until - at)
                coded = batch.column("ends").flatten().dictionary_encode()
                names, codes, size = coded.dictionary.to_pylist(), coded.indices.to_numpy(), sizes[at:until]
                low, high = (np.array([f(cuts, x) for x in names]) for f in (bisect_left, bisect_right))
                slices = np.maximum(1, high - low)
                last = np.cumsum(size)
                row, block = np.repeat(np.arange(len(size)), size), np.where(slices > 1, low + 1, high)[codes]
                new = np.ones(len(codes), bool)
                new[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
                start = np.flatnonzero(new)
                n = np.diff(np.append(start, len(codes)))
                some = start < last[row[start]] - 1
                n, start = n[some], start[some]
                wide = slices[codes[start]] > 1
                plain, picks = start[~wide], [_spread(start[~wide], (last[row[start]] - start)[~wide])]
                blocks, rows, owns, lengths = [block[plain]], [row[plain]], [n[~wide]], [last[row[plain]] - plain]
                if wide.any():
                    hashes = np.array([crc32(str(x).encode()) for x in names])
                    for p in start[wide]:
                        others = np.arange(p + 1, last[row[p]])
                        part = hashes[codes[others]] % slices[codes[p]]
                        for k in np.unique(part):
                            mine = others[part == k]
                            picks.append(np.append(p, mine))
                            for to, x in ((blocks, block[p] + k), (rows, row[p]), (owns, 1), (lengths, len(mine) + 1)):
                                to.append(np.array([x]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(lengths))), pa.int32()), coded.dictionary.take(pa.array(codes[np.concatenate(picks)])))
                columns = [pa.array(np.concatenate(blocks), pa.int32()), batch.column("via").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(owns), pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["block", "via", "n", "ends"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, c, via) of the lists of a block: each of the first n ends with all that follow it, once, over the least way."""
    table = pa.Table.from_batches(batches)
    way, coded = table["via"].combine_chunks().dictionary_encode(), table["ends"].combine_chunks().flatten().dictionary_encode()
    order = pc.sort_indices(way.dictionary).to_numpy()
    ways, names, codes = way.dictionary.take(pa.array(order)), coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    rank = np.argsort(order)[way.indices.to_numpy()]
    size, n = (x.to_numpy().astype(np.int64) for x in (pc.list_value_length(table["ends"]), table["n"]))
    last = np.cumsum(size)
    place, row = _spread(last - size, n), np.repeat(np.arange(len(n)), n)
    by = np.argsort(codes[place], kind="stable")
    place, row = place[by], row[by]
    own, count = codes[place], last[row] - 1 - place
    filled, firsts = np.cumsum(count), np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    pieces = np.unique((filled - count)[firsts] // (BLOCK // 4), return_index=True)[1]  # of whole names
    for at, until in pairwise([*firsts[pieces], len(own)]):
        times = count[at:until]
        seen, a = np.unique(own[at:until], return_inverse=True)
        pair = np.repeat(a * len(names), times) + codes[_spread(place[at:until] + 1, times)]
        over = np.repeat(rank[row[at:until]], times)
        if len(seen) * len(names) * len(ways) < 1 << 63:
            pair, over = np.divmod(np.sort(pair * len(ways) + over), len(ways))
        else:
            by = np.lexsort((over, pair))
            pair, over = pair[by], over[by]
        first = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
        a, c = np.divmod(pair[first], len(names))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(seen[a])), names.take(pa.array(c)), ways.take(pa.array(over[first]))], ["a", "c", "via"])


def table_levels(columns: DataFrame) -> DataFrame:
    """(table_name, level) from columns (table_name, level, pinned): pins go before others, then the greatest level counts."""
    return columns.groupBy("table_name").agg(F.coalesce(F.max("pinned"), F.max("level")).alias("level"))


def label_search(labels: DataFrame, text: str, most: int) -> DataFrame:
    """(label, score) of labels that hold a text whatever its case: 1000 if equal, 500 if they begin with it, else 100 less the
    length, and 50 more where it begins a word.
    """
    low, wanted = F.lower("label"), text.lower().strip()
    inside = 100 - F.length("label") + F.when(low.contains(f" {wanted}") | low.contains(f"_{wanted}"), 50).otherwise(0)
    score = F.when(low == wanted, 1000).when(low.startswith(wanted), 500).otherwise(inside)
    return labels.select("label").distinct().where(low.contains(wanted)).select("label", score.alias("score")).orderBy(F.desc("score"), "label").limit(most)
