"""Joins that discover or look up: overlaps of key columns, naming hints, nearest rows per parent, snapshots compared, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.catalog import held_in


def overlap(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Shared different values over those of the smaller side, null without any."""
    one, two = left.select(F.col(a).alias("v")).where("v is not null").distinct(), right.select(F.col(b).alias("w")).where("w is not null").distinct()
    both = one.join(two, F.col("v") == F.col("w"), "full_outer")
    smaller = F.least(F.count("v"), F.count("w"))
    return both.agg(F.count_if(F.col("v").isNotNull() & F.col("w").isNotNull()).alias("shared"), F.round(F.count_if(F.col("v").isNotNull() & F.col("w").isNotNull()) / F.when(smaller != 0, smaller), 6).alias("overlap"))


def row_overlap(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Rows of a left join and those with a match; several matches count as often as they come."""
    return left.select(F.col(a).alias("v")).join(right.select(F.col(b).alias("w")), F.col("v") == F.col("w"), "left").agg(F.count("*").alias("all_rows"), F.count("w").alias("matched"))


def suffix_candidates(columns: DataFrame, suffixes: tuple[str, ...] = ("key", "id", "code")) -> DataFrame:
    """(table_name, column_name, parent, fit) for columns (table_name, column_name) whose names hint at a parent table.

    What stands before the suffix is compared with the names of other tables: 0 if equal, 1 if one starts with the other, 2 if one
    holds the other; at most five per column. Names meet by the first letters of the shorter one within the longer.
    """
    stem = F.regexp_replace(F.lower("column_name"), f"^[a-z]_|_?({'|'.join(suffixes)})$", "")
    hinted = columns.where(F.lower("column_name").rlike(f"({'|'.join(suffixes)})$")).select("table_name", "column_name", stem.alias("_stem")).where("length(_stem) >= 3")
    parents = columns.select(F.col("table_name").alias("parent")).distinct()
    fit = F.when(F.col("parent") == F.col("_stem"), 0).when(F.col("parent").startswith(F.col("_stem")) | F.col("_stem").startswith(F.col("parent")), 1).otherwise(2)
    kept = ["table_name", "column_name", "_stem", "parent"]
    met = held_in(hinted, "_stem", parents, "parent").select(*kept).union(held_in(parents, "parent", hinted, "_stem").select(*kept)).distinct()
    found = met.where(F.col("parent") != F.col("table_name")).withColumn("fit", fit)
    place = F.row_number().over(W.partitionBy("table_name", "column_name").orderBy("fit", "parent"))
    return found.withColumn("_n", place).where("_n <= 5").select("table_name", "column_name", "parent", "fit")


def nearest(parents: DataFrame, children: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """Parents with their first children in order, one row each; a parent without any keeps one row of nulls."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return parents.join(children.withColumn("place", place).where(F.col("place") <= most), key, "left")


def gathered(children: DataFrame, key: str, order: list[Column], most: int, value: Column) -> DataFrame:
    """(key, items): the first children in order as an array, at most so many."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    kept = children.withColumn("_place", place).where(F.col("_place") <= most)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", value.alias("_v")))), lambda x: x["_v"]).alias("items"))


def settled(rows: DataFrame, levels: list[DataFrame], keys: list[str], column: str, default) -> DataFrame:
    """rows with `column` from the first level that has a value for their key, or the default; levels are (key, column)."""
    found = rows
    for i, (level, key) in enumerate(zip(levels, keys, strict=True)):
        found = found.join(level.select(F.col(key).alias(f"_k{i}"), F.col(column).alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    return found.withColumn(column, F.coalesce(*[F.col(f"_v{i}") for i in range(len(levels))], F.lit(default))).drop(*[f"_v{i}" for i in range(len(levels))])


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed rows between two snapshots with the same columns; null equals null."""
    values = [c for c in before.columns if c != key]
    old, new = (d.select(F.col(key).alias(k), F.struct(*values).alias(v)) for d, k, v in ((before, "_k", "_old"), (after, key, "_new")))
    both = old.join(new, F.col("_k") == F.col(key), "full_outer")
    change = F.when(F.col("_k").isNull(), "added").when(F.col(key).isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(F.coalesce(key, "_k").alias(key), change.alias("change")).where("change is not null")


def in_interval(rows: DataFrame, intervals: DataFrame, key: str, at: str, width: int = 86_400) -> DataFrame:
    """Rows matched with the intervals (key, first, last) of their key that hold them, bounds included.

    Time is cut into bins of `width` seconds; an interval is laid out in each bin that it touches, so that key and bin make an
    equi-join and a row meets only intervals near it. Take a width about as long as intervals are.
    """
    bin_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    binned = intervals.where("first <= last").withColumn("_bin", F.explode(F.sequence(bin_of("first"), bin_of("last"))))
    return rows.withColumn("_bin", bin_of(at)).join(binned, [key, "_bin"]).where((F.col(at) >= F.col("first")) & (F.col(at) <= F.col("last"))).drop("_bin")


def totals_in_interval(rows: DataFrame, intervals: DataFrame, key: str, at: str, name: str, value: str, width: int = 86_400) -> DataFrame:
    """(name, n, total): how many rows (key, at, value) the intervals (key, first, last, name) of each name hold, and the sum of their values.

    Rows of one key and time are added up before they meet intervals, and equal intervals meet them once, so the join grows with
    the different times and intervals, not with rows times intervals. A name without rows is left out; null values add nothing.
    """
    points = rows.groupBy(key, at).agg(F.count("*").alias("_n"), F.sum(value).alias("_total"))
    spans = intervals.select(key, "first", "last").distinct()
    met = in_interval(points, spans, key, at, width).groupBy(key, "first", "last").agg(F.sum("_n").alias("_n"), F.sum("_total").alias("_total"))
    return intervals.join(met, [key, "first", "last"]).groupBy(name).agg(F.sum("_n").alias("n"), F.sum("_total").alias("total"))
