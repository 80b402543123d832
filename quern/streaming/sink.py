"""A sink for call logs and usage that takes each micro-batch once: rows by key, totals by day, and what was dropped and why.

A batch writes its own part of each table under its number, so a batch that comes again takes its own place and adds nothing. What
a table says is put together from its parts when it is read: the last row of a key, or the sum of a key's totals. Rows may be late
without limit; they simply belong to the key or day that they name. Parts are folded into a base from time to time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.rounds import fresh_folder, settled


@dataclass(frozen=True)
class Sink:
    """Where and how rows go: their keys, what makes a row unfit (reason to condition), keys and values of totals."""

    folder: str
    keys: tuple[str, ...]
    unfit: dict[str, Column]
    total_keys: tuple[str, ...] = ()
    total_values: tuple[str, ...] = ()

    def write(self, batch: DataFrame, number: int) -> None:
        """One batch, with foreachBatch or by hand. Of rows that share a key the last one holds, at the place of the first.

        The order in a batch is that of the column `at`, then of all columns, so that a batch that comes again in another order says
        the same. The first reason that holds counts for a row that is dropped.
        """
        why = F.lit(None).cast("string")
        for reason, condition in reversed(self.unfit.items()):
            why = F.when(F.coalesce(condition, F.lit(False)), reason).otherwise(why)
        told = settled(batch.withColumn("_why", why))
        fit = told.where("_why is null").drop("_why")
        rest = [c for c in fit.columns if c != "at"]
        order = W.partitionBy(*self.keys).orderBy(F.desc("at"), *[F.desc(F.col(c).cast("string")) for c in rest])
        last = fit.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        self._put(last, "rows", number)
        if self.total_keys:
            sums = last.groupBy(*self.total_keys).agg(*[F.sum(v).alias(v) for v in self.total_values], F.count("*").alias("calls"))
            self._put(sums, "totals", number)
        self._put(told.where("_why is not null").groupBy(F.col("_why").alias("reason")).agg(F.count("*").alias("n")), "drops", number)

    def _put(self, rows: DataFrame, table: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={number:012d}")

    def _read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.option("basePath", f"{self.folder}/{table}").option("mergeSchema", "false").parquet(f"{self.folder}/{table}/batch=*")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The last row of each key: that with the greatest `at`, of equals that of the later batch."""
        place = F.row_number().over(W.partitionBy(*self.keys).orderBy(F.desc("at"), F.desc("batch")))
        return self._read(spark, "rows").withColumn("_n", place).where("_n = 1").drop("_n", "batch")

    def totals(self, spark: SparkSession) -> DataFrame:
        """Totals of each key over all batches; a row that came in several batches under one key counts in each of them."""
        return self._read(spark, "totals").groupBy(*self.total_keys).agg(*[F.sum(v).alias(v) for v in self.total_values], F.sum("calls").alias("calls"))

    def drops(self, spark: SparkSession) -> DataFrame:
        """(reason, n): rows that were dropped."""
        return self._read(spark, "drops").groupBy("reason").agg(F.sum("n").alias("n"))

    def start(self, stream: DataFrame, checkpoint: str, **options) -> StreamingQuery:
        """A running query that writes a stream's batches here; where it stood is kept in its checkpoint folder."""
        writer = stream.writeStream.foreachBatch(lambda batch, number: self.write(batch, number)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(options or {"availableNow": True})).start()

    def folded(self, spark: SparkSession) -> Sink:
        """The same sink in a new folder, with all parts in one under the number of the last batch; what is read from it is the same.

        The old folder stays as it is until readers have left it, so a loss on the way costs nothing.
        """
        made = Sink(fresh_folder(spark, "sink"), self.keys, self.unfit, self.total_keys, self.total_values)
        number = int(self._read(spark, "rows").agg(F.max("batch")).first()[0] or 0)
        made._put(self.rows(spark), "rows", number)
        if self.total_keys:
            made._put(self.totals(spark), "totals", number)
        made._put(self.drops(spark), "drops", number)
        return made


def sink(spark: SparkSession, keys: list[str], unfit: dict[str, Column] | None = None, total_keys: list[str] | None = None, total_values: list[str] | None = None, folder: str | None = None) -> Sink:
    return Sink(folder or fresh_folder(spark, "sink"), tuple(keys), unfit or {}, tuple(total_keys or ()), tuple(total_values or ()))
