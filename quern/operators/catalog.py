"""A catalogue of tables, columns and joins: search, membership, choice of joins, coverage, roll-ups, terms bound to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How sure the origins of a join are, the surest first.
ORIGINS = ("declared", "comment", "naming", "discovered")


def holds(column: str, text: str) -> Column:
    """Whether a column holds a text, whatever the case; percent signs and underscores stand for themselves."""
    return F.lower(column).contains(text.lower())


def member(array: str, value: Column) -> Column:
    """Whether a JSON array of strings, kept as text, has a value; false for anything else."""
    return F.coalesce(F.array_contains(F.from_json(array, "array<string>"), value.cast("string")), F.lit(False))


def origin_rank(origin: str = "origin") -> Column:
    found = F.when(F.col(origin) == ORIGINS[0], 0)
    for i, name in enumerate(ORIGINS[1:], 1):
        found = found.when(F.col(origin) == name, i)
    return found.otherwise(len(ORIGINS))


def join_edges(joins: DataFrame) -> DataFrame:
    """(a_table, a_column, b_table, b_column, origin): each join once, whichever way it is told, by its surest origin."""
    one, two = F.struct(F.col("src_table").alias("t"), F.col("src_column").alias("c")), F.struct(F.col("dst_table").alias("t"), F.col("dst_column").alias("c"))
    ends = joins.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), "origin", origin_rank().alias("_r"))
    best = ends.groupBy("a", "b").agg(F.min_by("origin", F.struct("_r", "origin")).alias("origin"))
    return best.select(F.col("a.t").alias("a_table"), F.col("a.c").alias("a_column"), F.col("b.t").alias("b_table"), F.col("b.c").alias("b_column"), "origin")


def eligible_joins(joins: DataFrame, anchor: str, most: int = 20) -> DataFrame:
    """(other, own_column, other_column, origin) of joins that touch a table, at most so many, and of each other table one at least.

    The first of each other table goes first, then surer origins, then names.
    """
    edges = join_edges(joins)
    here = edges.where(F.col("a_table") == anchor).select(F.col("b_table").alias("other"), F.col("a_column").alias("own_column"), F.col("b_column").alias("other_column"), "origin")
    there = edges.where((F.col("b_table") == anchor) & (F.col("a_table") != anchor)).select(F.col("a_table").alias("other"), F.col("b_column").alias("own_column"), F.col("a_column").alias("other_column"), "origin")
    order = [origin_rank(), F.col("own_column"), F.col("other_column")]
    placed = here.union(there).withColumn("_n", F.row_number().over(W.partitionBy("other").orderBy(*order)))
    return placed.orderBy(F.col("_n") > 1, *order[:1], "other", *order[1:]).limit(most).drop("_n")


def resolved_keys(candidates: DataFrame) -> DataFrame:
    """(table_name, column_name, parent, origin, conflicts): one parent for each column, by the surest origin; conflicts counts other parents."""
    told = candidates.groupBy("table_name", "column_name").agg(F.min(F.struct(origin_rank().alias("r"), "parent", "origin")).alias("b"), (F.count_distinct("parent") - 1).alias("conflicts"))
    return told.select("table_name", "column_name", F.col("b.parent").alias("parent"), F.col("b.origin").alias("origin"), "conflicts")


def with_declared(known: DataFrame, declared: DataFrame, tables: DataFrame) -> DataFrame:
    """known joins (table_name, column_name, parent) with declared ones that they lack; a declared name that several tables end in is not guessed.

    Names meet by what stands behind the last dot.
    """
    last = lambda c: F.regexp_extract(c, r"[^.]*$", 0)
    ends = declared.withColumn("_last", last("parent_name")).join(tables.withColumn("_last", last("full_name")), "_last").where(F.col("full_name").endswith(F.col("parent_name"))).drop("_last")
    sure = ends.groupBy("table_name", "column_name").agg(F.count_distinct("full_name").alias("_n"), F.min("full_name").alias("parent")).where("_n = 1").drop("_n")
    return known.union(sure.join(known, ["table_name", "column_name"], "left_anti").select("table_name", "column_name", "parent"))


def star_edges(columns: DataFrame, generic: tuple[str, ...] = ("name", "code", "type", "status", "comment"), least: int = 4) -> DataFrame:
    """(column_name, hub, table_name): tables that share a column name, each linked to the first of them; short and generic names do not count."""
    named = columns.where((F.length("column_name") >= least) & ~F.col("column_name").isin(*generic))
    hubs = named.groupBy("column_name").agg(F.min("table_name").alias("hub"), F.count_distinct("table_name").alias("_n")).where("_n > 1").drop("_n")
    return named.join(hubs, "column_name").where("table_name <> hub").select("column_name", "hub", "table_name").distinct()


def allowed_joins(edges: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Joins (a_table, b_table, ...) but those of forbidden pairs (a, b), in either order."""
    pairs = forbidden.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).distinct()
    return edges.join(pairs, (F.least("a_table", "b_table") == F.col("_a")) & (F.greatest("a_table", "b_table") == F.col("_b")), "left_anti")


def visible(columns: DataFrame, rank: Column, most: int) -> DataFrame:
    """Columns whose level does not pass a clearance's rank."""
    return columns.where(rank <= most)


def coverage(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """(table_name, columns, covered, share): how many columns (table_name, column_name) of a table lineage edges (src_table, src_column, dst_table, dst_column) touch."""
    ends = edges.select(F.col("src_table").alias("table_name"), F.col("src_column").alias("column_name")).union(edges.select("dst_table", "dst_column")).distinct().withColumn("_hit", F.lit(1))
    told = columns.join(ends, ["table_name", "column_name"], "left").groupBy("table_name").agg(F.count("*").alias("columns"), F.count("_hit").alias("covered"))
    return told.withColumn("share", F.round(F.col("covered") / F.col("columns"), 6))


def orphan_edges(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Lineage edges an end of which is no known column."""
    known = columns.select("table_name", "column_name").distinct()
    one = edges.join(known, (F.col("src_table") == known["table_name"]) & (F.col("src_column") == known["column_name"]), "left_semi")
    both = one.join(known, (F.col("dst_table") == known["table_name"]) & (F.col("dst_column") == known["column_name"]), "left_semi")
    return edges.join(both, edges.columns, "left_anti")


def with_stale(edges: DataFrame, now: str, days: int = 30) -> DataFrame:
    """edges (origin, last_seen_at, ...) with `stale`: whether a machine's edge was not seen for more than so many days; what people say does not age.

    0 days: nothing is stale. An edge without a time, or with one that cannot be read, is not stale either.
    """
    seen = F.try_to_timestamp(F.col("last_seen_at").cast("string"))
    late = (F.col("origin") == "platform") & (seen < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return edges.withColumn("stale", F.coalesce(late, F.lit(False)) if days > 0 else F.lit(False))


def roll_up(assets: DataFrame, by: str, kind: str, kinds: list[str], owner: str, most: int) -> DataFrame:
    """(by, assets, one column for each kind, owners): counts by domain, and its owners with most assets, then by name."""
    counts = assets.groupBy(by).agg(F.count("*").alias("assets"), *[F.count_if(F.col(kind) == k).alias(f"n_{k.lower()}") for k in kinds])
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc("_n"), owner))
    best = assets.where(F.col(owner).isNotNull()).groupBy(by, owner).agg(F.count("*").alias("_n")).withColumn("_p", place).where(F.col("_p") <= most)
    named = best.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.col(owner).cast("string").alias("o")))), lambda x: x["o"]), ",").alias("owners"))
    return counts.join(named, by, "left")


def _grams(text: Column) -> Column:
    """Each stretch of one to three letters of a text."""

    def of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - k + 1))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(k)))

    return F.array_distinct(F.filter(F.flatten(F.array(of(1), of(2), of(3))), lambda g: g != ""))


def held_in(short: DataFrame, a: str, long: DataFrame, b: str) -> DataFrame:
    """Pairs of rows where the text a of one stands in the text b of the other: they meet by the first three letters of a, which b must have somewhere.

    Columns of both must differ by name. Blank texts stand in nothing.
    """
    left = short.where(F.col(a) != "").withColumn("_key", F.substring(a, 1, 3))
    right = long.withColumn("_key", F.explode(_grams(F.col(b))))
    return left.join(right, "_key").where(F.contains(F.col(b), F.col(a))).drop("_key")


def bound(terms: DataFrame, columns: DataFrame) -> DataFrame:
    """(term, column_name, score): terms (term, alias) bound to columns: 1 for the same name, 0.8 if one holds the other, 0.7 by the alias; 0 is left out.

    Names are compared in lower case and meet by equal keys alone: the whole name, the alias, or the first letters of the shorter one
    within the longer. Blank names are bound to nothing.
    """
    t = terms.select("term", "alias", F.lower("term").alias("_t")).distinct()
    c = columns.select("column_name", F.lower("column_name").alias("_c")).distinct()
    one = t.select("term", "_t").distinct()
    found = [
        one.join(c, F.col("_t") == F.col("_c")).where("_t <> ''").select("term", "column_name", F.lit(1.0).alias("score")),
        held_in(one, "_t", c, "_c").select("term", "column_name", F.lit(0.8).alias("score")),
        held_in(c, "_c", one, "_t").select("term", "column_name", F.lit(0.8).alias("score")),
        t.join(c, F.lower("alias") == F.col("_c")).where("_c <> ''").select("term", "column_name", F.lit(0.7).alias("score")),
    ]
    return reduce(DataFrame.union, found).groupBy("term", "column_name").agg(F.max("score").alias("score"))


def values_like(rows: DataFrame, column: str, text: str, most: int) -> DataFrame:
    """Different values that hold a text whatever the case, in order, at most so many."""
    return rows.where(holds(column, text)).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").limit(most)


def case_matches(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, value): the one value that equals a wanted one but for case and outer white space; none if there are several."""
    by = values.select("value").distinct().groupBy(F.lower(F.trim("value")).alias("_k")).agg(F.count("*").alias("_n"), F.min("value").alias("value")).where("_n = 1")
    return wanted.join(by, F.lower(F.trim("wanted")) == F.col("_k")).select("wanted", "value")


def value_matches(values: DataFrame, wanted: DataFrame, most_extra: int = 3) -> DataFrame:
    """(wanted, value, how): what a wanted text stands for among values: by case, by initials, or as the start of one value alone that is at most so much longer."""
    known = values.select("value").distinct().select("value", F.lower(F.trim("value")).alias("_v")).withColumn("_i", F.array_join(F.transform(F.split("_v", "[^a-z0-9]+"), lambda w: F.substring(w, 1, 1)), ""))
    asked = wanted.select("wanted", F.lower(F.trim("wanted")).alias("_w"))

    def alone(hits: DataFrame, how: str, place: int) -> DataFrame:
        return hits.groupBy("wanted").agg(F.count("*").alias("_n"), F.min("value").alias("value")).where("_n = 1").select("wanted", "value", F.lit(how).alias("how"), F.lit(place).alias("_p"))

    starts = known.select("value", "_v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most_extra)), lambda k: F.substring("_v", F.lit(1), F.greatest(F.lit(0), F.length("_v") - k)))).alias("_s")).distinct()
    found = alone(asked.join(known, F.col("_w") == F.col("_v")), "case", 0)
    found = found.union(alone(asked.join(known.where("length(_i) > 1"), F.col("_w") == F.col("_i")), "initials", 1))
    found = found.union(alone(asked.where("_w <> ''").join(starts, F.col("_w") == F.col("_s")), "prefix", 2))
    return found.groupBy("wanted").agg(F.min_by(F.struct("value", "how"), "_p").alias("b")).select("wanted", "b.value", "b.how")
