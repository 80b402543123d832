"""Reading and writing tables: Parquet, ORC, CSV, JSON and JDBC by one call, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json", "jdbc")


def read(spark: SparkSession, kind: str, place: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table; CSV and JSON need a schema, so that no pass over the data is spent on guessing it. place is a URL for jdbc."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    if kind == "jdbc":
        return reader.option("url", place).load()
    return (reader.schema(schema) if schema else reader).load(place)


def write(rows: DataFrame, kind: str, place: str, mode: str = "errorifexists", by: tuple[str, ...] = (), **options: str) -> None:
    writer = rows.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(place)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those with the same keys, and the others added."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def described(rows: DataFrame) -> list[tuple[str, str]]:
    """Columns with their semantic types: string, integer, number, boolean, date, datetime, vector, json."""
    plain = {"string": "string", "boolean": "boolean", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime", "double": "number", "float": "number"}
    kind = lambda t: plain.get(t) or ("integer" if t in ("tinyint", "smallint", "int", "bigint") else "number" if t.startswith("decimal") else "vector" if t in ("array<float>", "array<double>") else "json" if t.startswith(("array", "map", "struct")) else "string")
    return [(name, kind(t)) for name, t in rows.dtypes]


def lineage_rows(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Lineage edges of JSON lines or CSV with a header, whoever wrote them: their origin is the platform, edges without both ends are dropped."""
    ends = ["src_table", "src_column", "dst_table", "dst_column"]
    rows = spark.read.csv(path, header=True) if kind == "csv" else spark.read.schema(", ".join(f"{c} string" for c in ends)).json(path)
    rows = rows.select(*ends)  # columns of CSV are found by their header and stay text
    return rows.where("src_table <> '' and dst_table <> ''").distinct().withColumn("origin", F.lit("platform"))


def openlineage_edges(events: DataFrame, event: str) -> DataFrame:
    """(src_table, src_column, dst_table, dst_column) of OpenLineage events kept as JSON text.

    Columns come from the columnLineage facet of an output; an output without it has an edge from each input, with null columns.
    Texts that are no such event have no edges.
    """
    place = "namespace: string, name: string"
    fields = f"map<string, struct<inputFields: array<struct<{place}, field: string>>>>"
    kind = f"struct<inputs: array<struct<{place}>>, outputs: array<struct<{place}, facets: struct<columnLineage: struct<fields: {fields}>>>>>"
    full = lambda x: F.concat_ws(".", x["namespace"], x["name"])
    told = events.select(F.from_json(event, kind).alias("e")).select("e.inputs", F.explode("e.outputs").alias("o")).select("inputs", full(F.col("o")).alias("dst_table"), F.col("o.facets.columnLineage.fields").alias("fields"))
    by_column = told.select("dst_table", F.explode("fields").alias("dst_column", "f")).select("dst_table", "dst_column", F.explode("f.inputFields").alias("i"))
    by_column = by_column.select(full(F.col("i")).alias("src_table"), F.col("i.field").alias("src_column"), "dst_table", "dst_column")
    by_table = told.where("fields is null").select("dst_table", F.explode("inputs").alias("i")).select(full(F.col("i")).alias("src_table"), F.lit(None).cast("string"), "dst_table", F.lit(None).cast("string"))
    return by_column.union(by_table).distinct()
