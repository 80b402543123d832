"""Assets, bindings, runs and references: merges, replacements, coverage, visibility, pages with a next one, checks of an index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows of both sides, and ids, that a task of replaced() takes, whatever their number.
ROWS = 500_000


def replaced(current: DataFrame, wanted: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(columns of both, action): what to add and remove so that current holds exactly what is wanted; for some ids alone, if given.

    Rows are counted first and dealt over so many tasks, by id if ids are given, that the memory of one does not grow with the input.
    """
    keys = current.columns
    sides = current.select(*keys, F.lit(1).alias("_s")).union(wanted.select(*keys, F.lit(2).alias("_s")))
    by, n = (keys, sides.count()) if ids is None else (ids.columns, sides.count() + ids.count())
    parts = -(-n // ROWS) or 1
    sides = sides.repartition(parts, *by)
    if ids is not None:
        sides = sides.join(ids.repartition(parts, *by), by, "left_semi").select(*keys, "_s")
    told = sides.groupBy(*keys).agg(F.min("_s").alias("_a"), F.max("_s").alias("_b")).where("_a = _b")
    return told.select(*keys, F.when(F.col("_a") == 1, "remove").otherwise("add").alias("action"))


def filled_from(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both by key: fields of the first, where it has none those of the second; origin tells who knows the key."""
    values = [c for c in first.columns if c != key]
    a, b = first.withColumn("_a", F.lit(1)).alias("a"), second.withColumn("_b", F.lit(1)).alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    origin = F.when(F.col("_b").isNull(), "first").when(F.col("_a").isNull(), "second").otherwise("both")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in values], origin.alias("origin"))


def seen_by(rows: DataFrame, system: Column, tenant: Column, spaces: DataFrame, space: str) -> DataFrame:
    """Rows of the system's scope, and those of a tenant in spaces that a user belongs to."""
    member = spaces.select(F.col(space), F.lit(True).alias("_in")).distinct()
    return rows.join(member, space, "left").where(system | (tenant & F.col("_in").isNotNull())).drop("_in")


def waiting_before(rows: DataFrame, group: str, pending: Column, order: list[str]) -> DataFrame:
    """rows with `waits`: whether a pending row of the group comes before it. Only the first pending row of each group is shuffled."""
    firsts = rows.where(pending).groupBy(group).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(firsts, group, "left").withColumn("waits", F.coalesce(F.col("_first") < F.struct(*order), F.lit(False))).drop("_first")


def without_blanks(rows: DataFrame, group: str, blank: Column) -> DataFrame:
    """rows without the blank ones of groups in which any row is not blank; groups of blanks alone stay whole."""
    blank = F.coalesce(blank, F.lit(False))
    answered = rows.groupBy(group).agg(F.bool_or(~blank).alias("_any"))
    return rows.join(answered, group).where(~blank | ~F.col("_any")).drop("_any")


def index_problems(files: DataFrame, index: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(key, problem): files that the index lacks, entries without a file, files without a required field."""
    known, listed = files.select(key).distinct(), index.select(key).distinct()
    found = [known.join(listed, key, "left_anti").select(key, F.lit("not indexed").alias("problem")), listed.join(known, key, "left_anti").select(key, F.lit("no file"))]
    for field in required:
        found.append(files.where(F.coalesce(F.trim(F.col(field).cast("string")), F.lit("")) == "").select(key, F.lit(f"no {field}")).distinct())
    return reduce(DataFrame.union, found)


def merge_map(pages: DataFrame, same: Column, key: str, size: str) -> DataFrame:
    """(loser, winner): pages that count as the same one go to the largest of them, the one with the least key if there are several."""
    named = pages.withColumn("_same", same).where("_same is not null")
    best = named.groupBy("_same").agg(F.max_by(key, F.struct(F.coalesce(size, F.lit(-1)), -F.col(key))).alias("winner"))
    return named.join(best, "_same").where(F.col(key) != F.col("winner")).select(F.col(key).alias("loser"), "winner")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other, direction, family, evidence) of edges (src, dst, family): each neighbour by direction and family, and how many edges tell of it."""
    told = edges.groupBy("src", "dst", "family").agg(F.count("*").alias("evidence"))
    out = told.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("direction"), "family", "evidence")
    return out.union(told.select("dst", "src", F.lit("in"), "family", "evidence"))


def unreferenced(rows: DataFrame, references: DataFrame, key: str, at: str, before: str) -> DataFrame:
    """Rows that no reference points to and that are older than a time of grace."""
    return rows.where(F.col(at) < F.lit(before).cast("timestamp_ntz")).join(references.select(key).distinct(), key, "left_anti")


def page_of(rows: DataFrame, order: list[Column], most: int, skip: int) -> DataFrame:
    """One page of rows in order, with truncated and next_offset (null on the last page); one row more than the page is read."""
    held = rows.orderBy(*order).offset(skip).limit(most + 1).withColumn("_place", F.row_number().over(W.orderBy(*order)))
    told = held.withColumn("truncated", F.count("*").over(W.partitionBy(F.lit(0))) > most).where(F.col("_place") <= most).drop("_place")
    return told.withColumn("next_offset", F.when(F.col("truncated"), F.lit(skip + most)))


def sums_for(usage: DataFrame, keys: DataFrame, key: str, value: str, exact: Column) -> DataFrame:
    """(key, value) summed for the asked keys over the rows that are exact; a key without such rows has none."""
    return usage.where(exact).join(keys.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.round(F.sum(value), 2).alias(value))


def metered(usage: DataFrame, by: list[Column], value: str, who: str) -> DataFrame:
    """Calls, sum and different callers by any columns: a document, a trace, a day."""
    return usage.groupBy(*by).agg(F.count("*").alias("calls"), F.round(F.sum(value), 2).alias("total"), F.count_distinct(who).alias("callers"))


def overview(sources: DataFrame, rules: DataFrame, runs: DataFrame, issues: DataFrame, key: str, at: str, severity: str, levels: dict[str, str]) -> DataFrame:
    """Of each source its number of rules, last run, and open issues by severity (column name: level); each side is aggregated before it is joined."""
    told = sources.select(key).distinct().join(rules.groupBy(key).agg(F.count("*").alias("rules")), key, "left").join(runs.groupBy(key).agg(F.max(at).alias("last_run")), key, "left")
    told = told.join(issues.groupBy(key).agg(*[F.count_if(F.col(severity) == level).alias(name) for name, level in levels.items()]), key, "left")
    return told.fillna(0, ["rules", *levels])


def standard_coverage(standards: DataFrame, bindings: DataFrame, key: str, by: str) -> DataFrame:
    """(by, standards, covered, bindings): how many standards have a binding at all, and the bindings they have."""
    counts = bindings.groupBy(key).agg(F.count("*").alias("_n"))
    told = standards.join(counts, key, "left").groupBy(by)
    return told.agg(F.count("*").alias("standards"), F.count_if(F.col("_n") > 0).alias("covered"), F.coalesce(F.sum("_n"), F.lit(0)).alias("bindings"))


def by_schema(rows: DataFrame, declared: DataFrame, kind: str) -> DataFrame:
    """(kind, n, declared): rows by type, declared types without rows and types that are not declared among them."""
    counts, known = rows.groupBy(kind).agg(F.count("*").alias("n")), declared.select(kind).distinct().withColumn("declared", F.lit(True))
    return counts.join(known, kind, "full").select(kind, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("declared", F.lit(False)).alias("declared"))


def identified(log: DataFrame, source: str, spelled: list[str], users: DataFrame, key: str) -> DataFrame:
    """log with key: the user that a source stands for in one of several spellings (patterns with one group), null for none that is known."""
    named = F.coalesce(*[F.nullif(F.regexp_extract(source, p, 1), F.lit("")) for p in spelled]).try_cast("bigint")
    known = users.select(F.col(key).alias("_user")).distinct()
    return log.withColumn("_named", named).join(known, F.col("_named") == F.col("_user"), "left").withColumn(key, F.col("_user")).drop("_named", "_user")


def evidence(rows: DataFrame, chunks: DataFrame, key: str, at: str) -> DataFrame:
    """rows joined to the chunks (key, start, end) of their table that hold their number: start <= at < end."""
    a, b = rows.alias("a"), chunks.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{at}") >= F.col("b.start")) & (F.col(f"a.{at}") < F.col("b.end"))).drop(F.col(f"b.{key}"))


def mentions(name: Column, text: Column) -> Column:
    """How a text supports a name: verbatim, normalised (without punctuation and white space), by half of its parts at least; else null."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\W_]+", ""))
    parts = F.filter(F.split(name, r"[\W_]+"), lambda p: p != "")
    found = F.size(F.filter(parts, lambda p: F.contains(text, p)))
    return F.when((name != "") & F.contains(text, name), "verbatim").when((bare(name) != "") & F.contains(bare(text), bare(name)), "normalised").when((F.size(parts) > 0) & (found * 2 >= F.size(parts)), "parts")


def cited(searches: DataFrame, at: str, key: str, days: int, most: int, item: Column) -> DataFrame:
    """(item, n, last_at) over the newest searches, at most so many, of the days before the last one."""
    last = searches.agg(F.max(at).alias("_last"))
    recent = searches.join(F.broadcast(last), F.col(at) >= F.expr(f"_last - interval {days} days")).orderBy(F.desc(at), F.desc(key)).limit(most)
    return recent.withColumn("item", item).where("item is not null").groupBy("item").agg(F.count("*").alias("n"), F.max(at).alias("last_at"))


def feedback(votes: DataFrame, keys: list[str], at: str, by: str, good: Column) -> DataFrame:
    """(by, votes, good, bad): votes counted once for each combination of keys, by the last one given."""
    others = [c for c in votes.columns if c not in keys and c != at]
    last = votes.groupBy(*keys).agg(F.max(F.struct(at, *others)).alias("_v")).select(*keys, "_v.*")
    return last.groupBy(by).agg(F.count("*").alias("votes"), F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
