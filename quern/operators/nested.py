"""JSON inside of columns: arrays of objects as rows that join like any other, objects saved from texts that were cut off, large objects pruned."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def unnested(rows: DataFrame, column: str, fields: str, outer: bool = False) -> DataFrame:
    """rows with the fields of each object in a JSON array, and `position`, from 0; fields is DDL of names and types.

    Blank texts in fields count as null, as do fields that an object lacks or that are of another type. A row whose text is null,
    empty or no array gives no rows, or with outer one of nulls. A column of the rows that a field is named after is replaced.
    """
    schema = StructType.fromDDL(fields)
    parsed = F.from_json(F.col(column), f"array<struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in schema.fields)}>>")
    pos = F.posexplode_outer(parsed) if outer else F.posexplode(parsed)
    kept = [c for c in rows.columns if c.lower() not in {f.name.lower() for f in schema.fields} | {"position"}]
    flat = rows.select(*kept, pos.alias("position", "_object"))
    value = lambda f: F.nullif(F.trim(f"_object.{f.name}"), F.lit("")) if f.dataType.simpleString() == "string" else F.col(f"_object.{f.name}")
    return flat.select(*kept, "position", *[value(f).alias(f.name) for f in schema.fields])


def objects(text: str | None) -> list[str]:
    """The whole objects in a text that may have been cut off, each as compact JSON, in order; what is not an object is passed over.

    An object that is not whole may hold whole ones: these are told in its place.
    """
    found, at, decoder = [], 0, json.JSONDecoder()
    text = text or ""
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            at += 1
            continue
        found.append(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
        at = end
    return found


def salvaged(rows: DataFrame, text: str) -> DataFrame:
    """rows with `position` and `object`, one for each whole object in the text; rows without any give none. Columns of these names are replaced."""
    rest = rows.drop("position", "object")
    schema = StructType([*rest.schema.fields, *StructType.fromDDL("position int, object string").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [objects(x) for x in part.column(text).to_pylist()]
                at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns), pa.array([k for f in found for k in range(len(f))], pa.int32()), pa.array([o for f in found for o in f], pa.string())], names)

    return rest.mapInArrow(run, schema)


def built(rows: DataFrame, key: str, fields: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """(key, items): by key a JSON array of objects of the fields, in order; with most the first of each key alone.

    The rows of one key come together in one text, so it is for keys with few rows, or with most, which is taken before.
    """
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    kept = rows.withColumn("_place", place)
    kept = kept.where(F.col("_place") <= most) if most is not None else kept
    return kept.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_place", F.struct(*fields).alias("o")))), lambda x: x["o"])).alias("items"))
