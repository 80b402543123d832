"""Connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import checkpoint

#: Edges of a file that a round writes.
EDGES = 200_000


def _least(edges: DataFrame) -> DataFrame:
    """Different edges with m, the least v of each u; one shuffle by u serves both."""
    by = W.partitionBy("u").orderBy("v")
    return edges.select("u", "v", F.first("v").over(by).alias("m"), F.lag("v").over(by).alias("_last")).where("_last is null or v <> _last").drop("_last")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each larger neighbour of a node under the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours under the least of them; edges go from greater to smaller nodes."""
    under = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))  # the node itself comes with its least neighbour
    return _least(edges).select(under.alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge: root is the least node reachable.

    edges has two columns of one orderable type, in either direction, repeats and loops allowed; null ends count as no edge.
    Each round shuffles the edges three times, for its two steps and to make them different, in as many tasks as there are files
    of EDGES edges, and is written to the shared folder; only a count and a sum per round reach the driver. No edges: no rows.
    """
    u, v = edges.columns
    now = edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    now, before = checkpoint(now), None
    files = max(8, -(-now.count() // EDGES))  # no round has more edges than the first
    now = now.coalesce(files)
    for _ in range(most_rounds):
        hung = _small_star(_large_star(now).coalesce(files)).coalesce(files)
        now = checkpoint(hung.distinct().coalesce(files))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components were not found in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
