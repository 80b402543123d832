"""What the operators of this subpackage share: reading tables, the shared folder, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where the setting is missing on one machine (tests) a local folder takes its place; on a cluster that is an error.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = f"file://{tempfile.mkdtemp(prefix='quern-checkpoint-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def extended(df: DataFrame, more: str, without: tuple[str, ...] = ()) -> StructType:
    """The columns of df but some, and more, given as DDL."""
    return StructType([f for f in df.schema.fields if f.name not in without] + StructType.fromDDL(more).fields)


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a folder that fresh_dir named, with all that is in it, where nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and cut its lineage; a lost executor then costs a reread, not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Let the driver collect what it no longer refers to; Spark then removes the shuffle files of steps that are written and done with."""
    gc.collect()
    spark._jvm.System.gc()


#: What frees the caches that operators keep in this Python worker from task to task, by operator.
CACHES: dict[str, Callable[[], None]] = {}


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, cache: str | None = None) -> Iterator[pa.RecordBatch]:
    """Smaller record batches, so that the Python objects of few rows are alive at once.

    A worker holds the caches of one operator at a time: those of others than `cache` are freed.
    """
    if others := [n for n in CACHES if n != cache]:
        for name in others:
            CACHES.pop(name)()
        gc.collect()
    pa.default_memory_pool().release_unused()  # of tasks before
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8 bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
