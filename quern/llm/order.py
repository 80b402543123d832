"""The neighbour of each key in ascending order, without gathering all keys in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import checkpoint


def successors(keys: DataFrame) -> DataFrame:
    """(key, next): each different key that is not null with the next greater one; after the last comes the first.

    keys has one column. The keys are dealt out in ranges; a window runs inside each range, and one row per range, whose number
    is that of the shuffle partitions, links the ranges. A single key follows itself. No keys: no rows.
    """
    ranged = keys.select(F.col(keys.columns[0]).alias("key")).where("key is not null").distinct().repartitionByRange("key")
    ranged = checkpoint(ranged.withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.min("key").alias("head"))
    by_part = W.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(by_part), F.min("head").over(W.partitionBy(F.lit(0)))).alias("head"))
    inside = ranged.withColumn("next", F.lead("key").over(W.partitionBy("part").orderBy("key")))
    return inside.join(F.broadcast(heads), "part").select("key", F.coalesce("next", "head").alias("next"))
