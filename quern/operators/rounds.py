"""What iterative operators share: cutting lineage in the shared folder, connected components, numbers in a global order."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local one takes its place on one machine alone; on a cluster a missing setting is an error."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = f"file://{tempfile.mkdtemp(prefix='quern-rounds-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A name for a folder of its own in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid4().hex}"


def settled(rows: DataFrame) -> DataFrame:
    """rows written to the shared folder, without their lineage."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of each node of edges (src, dst), root the least node that is reachable.

    Larger neighbours are hung under the least neighbour, then smaller ones under the least of them, until nothing changes: chains
    of any length take a number of rounds that grows with the logarithm of their length. Not settled by then: an error.
    """
    now, before = settled(edges.select("src", "dst").where("src <> dst").distinct()), None
    for _ in range(most_rounds):
        both = now.union(now.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        hung = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        down = hung.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        lowest = down.groupBy("src").agg(F.min("dst").alias("m"))
        over = down.join(lowest, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        now = settled(over.union(lowest.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark == before:
            tops = now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(tops)
        before = mark
    raise RuntimeError(f"components were not found in {most_rounds} rounds")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their number from 0 in a global order, which must be total: ranges are numbered apart and moved by what stands before."""
    ranged = settled(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn(name, place).join(F.broadcast(ahead), "_part").withColumn(name, F.col(name) + F.col("_ahead")).drop("_part", "_ahead")
