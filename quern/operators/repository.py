"""Relational work over documents, runs, issues and feedback: counts, pages, reconciliation, scope tests, merges of attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counts_for(ids: DataFrame, rows: DataFrame, key: str, counts: dict[str, Column]) -> DataFrame:
    """Conditional counts of rows for each asked id (key), zero where there are none."""
    told = rows.groupBy(key).agg(*[F.count_if(c).alias(name) for name, c in counts.items()])
    return ids.select(key).distinct().join(told, key, "left").fillna(0, list(counts))


def unmanaged(rows: DataFrame, managed: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """Rows that no managed row has the key of, in order, at most so many."""
    return rows.join(managed.select(key).distinct(), key, "left_anti").orderBy(*order).limit(most)


def without_signature(docs: DataFrame, signatures: DataFrame, most: int) -> DataFrame:
    """Ready documents (id, status, is_deleted, created_at) that were never tried for a signature (document_id), oldest first, at most so many."""
    ready = docs.where("status = 'ready' and is_deleted = 0")
    return ready.join(signatures.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti").orderBy("created_at", "id").limit(most)


def tried_again(docs: DataFrame, signatures: DataFrame, now: str, seconds: int, most: int) -> DataFrame:
    """Ready documents whose signature (document_id, simhash, updated_at) was tried, gave none, and is older than so many seconds, oldest first."""
    old = signatures.where(F.col("simhash").isNull() & (F.col("updated_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))))
    ready = docs.where("status = 'ready' and is_deleted = 0")
    return ready.join(old.select(F.col("document_id").alias("id"), "updated_at"), "id").orderBy("updated_at", "id").select(*docs.columns).limit(most)


def in_scope(links: DataFrame, scope: DataFrame, record: str, source: str) -> DataFrame:
    """(record) of records all of whose sources are in scope; links is (record, source)."""
    marked = links.join(scope.select(source).distinct().withColumn("_in", F.lit(True)), source, "left")
    return marked.groupBy(record).agg(F.every(F.coalesce("_in", F.lit(False))).alias("_all")).where("_all").select(record)


def idle(rows: DataFrame, key: str, busy: list[DataFrame]) -> DataFrame:
    """Rows whose key is busy in none of the tables: nested NOT EXISTS as anti joins."""
    return reduce(lambda left, other: left.join(other.select(key).distinct(), key, "left_anti"), busy, rows)


def paged(rows: DataFrame, sort: str, allowed: tuple[str, ...], key: str, page: int, size: int, descending: bool = True) -> DataFrame:
    """A page of rows: page from 1, size between 10 and 200, sorted by an allowed column (else the first), ties by key."""
    column, size, page = sort if sort in allowed else allowed[0], min(max(size, 10), 200), max(page, 1)
    return rows.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), key).offset((page - 1) * size).limit(size)


def matching(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows any of whose columns holds a text, whatever the case and with no character special."""
    return rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False)) for c in columns]))


def field_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change, fields): rows added, removed or changed between snapshots, and the columns that changed, by name; null equals null."""
    fields = sorted(c for c in before.columns if c != key)
    a, b = before.select(F.col(key).alias("_k"), F.struct(*fields).alias("_a")), after.select(key, F.struct(*fields).alias("_b"))
    both = a.join(b, F.col("_k") == F.col(key), "full_outer")
    moved = F.filter(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    change = F.when(F.col("_k").isNull(), "added").when(F.col(key).isNull(), "removed").when(F.size(moved) > 0, "changed")
    told = both.select(F.coalesce(key, "_k").alias(key), change.alias("change"), F.when(change == "changed", F.array_join(moved, ",")).otherwise("").alias("fields"))
    return told.where("change is not null")


def revived(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """(a, b, status) of suggested pairs after a scan: new ones pend, known ones keep their state, dismissed ones pend again only
    where the scan went out from their source; known and scanned have a and b, known status too, scanned by, who was scanned.
    """
    both = known.join(scanned.select("a", "b", "by").distinct(), ["a", "b"], "full_outer")
    status = F.when(F.col("status").isNull(), "pending").when((F.col("status") == "dismissed") & (F.col("by") == F.col("a")), "pending").otherwise(F.col("status"))
    return both.select("a", "b", status.alias("status"))


def oriented(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """(source, target) of pairs (a, b), once each: the one made later is the source; made is (id, at), ties by id."""
    side = lambda n: made.select(F.col("id").alias(n), F.struct("at", "id").alias(f"_{n}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b")
    return known.select(F.greatest("_a", "_b")["id"].alias("source"), F.least("_a", "_b")["id"].alias("target")).distinct()


def merged_attributes(rows: DataFrame, key: str, scalars: list[str], lists: list[str], order: str) -> DataFrame:
    """One row by key: of plain attributes the first that is not null, in order; of lists the union, in the order of text."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists]
    return rows.groupBy(key).agg(*first, *union)


def split_values(rows: DataFrame, key: str, column: str, mark: str = "<SEP>") -> DataFrame:
    """(key, value): the parts of a column with several values, without blanks and repeats."""
    parts = F.array_distinct(F.filter(F.transform(F.split(column, mark), lambda x: F.trim(x)), lambda x: x != ""))
    return rows.select(key, F.explode(parts).alias("value"))


def source_parts(column: str) -> dict[str, Column]:
    """kb, doc and tenant out of a text as kb=1|doc=2|tenant=3; what is missing is null."""
    found = lambda name: F.regexp_extract(column, rf"(?:^|\|){name}=([^|]*)", 1)
    return {name: F.when(found(name) != "", found(name)) for name in ("kb", "doc", "tenant")}


def sound_spans(spans: DataFrame, key: str, most: int) -> DataFrame:
    """(key, ordinal, first, last): spans with an order and a first before their last, at most so many of each key."""
    good = spans.where("ordinal is not null and first is not null and last is not null and first >= 0 and last > first")
    return good.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("ordinal", "first", "last"))).where(F.col("_n") <= most).select(key, "ordinal", "first", "last")


def ordered_text(chunks: DataFrame, key: str, index: str, text: str) -> DataFrame:
    """(key, content): a document's chunks joined by their index if these are whole and different, else by their text."""
    told = chunks.groupBy(key).agg(F.count("*").alias("_n"), F.count_distinct(index).alias("_d"), F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t"))).alias("_c"))
    by_index = F.transform(F.array_sort("_c"), lambda x: x["t"])
    by_text = F.array_sort(F.transform("_c", lambda x: x["t"]))
    return told.select(key, F.array_join(F.when(F.col("_n") == F.col("_d"), by_index).otherwise(by_text), "\n").alias("content"))


def same_rows(one: DataFrame, two: DataFrame) -> DataFrame:
    """(as_bags, as_sets): whether two tables of the same columns have the same rows, counted or not."""
    names = one.columns
    sides = one.select(*names, F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(two.select(*names, F.lit(0), F.lit(1)))
    by = sides.groupBy(*names).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return by.agg(F.coalesce(F.every(F.col("_a") == F.col("_b")), F.lit(True)).alias("as_bags"), F.coalesce(F.every((F.col("_a") > 0) == (F.col("_b") > 0)), F.lit(True)).alias("as_sets"))


def voted(results: DataFrame, run: str, answer: str) -> DataFrame:
    """(run, votes): of runs the one whose answer most others give too; of several such groups that with the earliest run."""
    by = results.groupBy(answer).agg(F.min(run).alias(run), F.count("*").alias("votes"))
    return by.orderBy(F.desc("votes"), run).limit(1).select(run, "votes")


def repeats_judged(runs: DataFrame, case: str, tier: str) -> DataFrame:
    """(tier, cases, worst_passed, best_passed, accuracy) of cases run more than once (outcome pass, fail or error): by the worst
    and by the best of each; accuracy leaves out cases that only gave errors.
    """
    rank = F.when(F.col("outcome") == "error", 0).when(F.col("outcome") == "fail", 1).otherwise(2)
    by = runs.groupBy(tier, case).agg(F.min(rank).alias("_w"), F.max(rank).alias("_b"))
    told = F.count_if(F.col("_b") > 0)
    return by.groupBy(tier).agg(F.count("*").alias("cases"), F.count_if(F.col("_w") == 2).alias("worst_passed"), F.count_if(F.col("_b") == 2).alias("best_passed"), F.round(F.count_if(F.col("_b") == 2) / F.when(told > 0, told), 6).alias("accuracy"))


def gate(tiers: DataFrame, must: float, may: float) -> DataFrame:
    """(tier, verdict) of tiers (tier, accuracy): passed from `must` on, for review from `may` on, else blocked; nothing judged is blocked."""
    return tiers.select("tier", F.when(F.col("accuracy") >= must, "passed").when(F.col("accuracy") >= may, "review").otherwise("blocked").alias("verdict"))


def scores_told(scores: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, least, greatest); NaN counts as missing."""
    known = F.when(~F.isnan(value), F.col(value))
    return scores.groupBy(by).agg(F.count(known).alias("n"), F.round(F.avg(known), 6).alias("mean"), F.min(known).alias("least"), F.max(known).alias("greatest"))


def broken_links(links: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst) of links to no page, and (page) of pages that no other page links to."""
    lost = links.join(pages.select(F.col("page").alias("dst")), "dst", "left_anti").select("src", "dst")
    lone = pages.join(links.where("src <> dst").select(F.col("dst").alias("page")).distinct(), "page", "left_anti").select("page")
    return lost, lone


def supported(claims: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """(claim, is_supported): whether a claim's excerpt stands in its passage, white space and case aside; blank excerpts do not."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    both = claims.join(passages.select(key, F.col("text").alias("_t")), key, "left")
    return both.select("claim", (F.coalesce(plain("_t").contains(plain("excerpt")), F.lit(False)) & (F.trim("excerpt") != "")).alias("is_supported"))


def reconciled(before: DataFrame, incoming: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """What sources contribute (source, keys...) after an update: sources that came again are replaced whole, those that only were there stay."""
    again = incoming.select(source).distinct()
    return before.select(source, *keys).join(again, source, "left_anti").union(incoming.select(source, *keys)).distinct()


def remapped(edges: DataFrame, winners: DataFrame) -> DataFrame:
    """Edges (src, relation, dst) between what things (thing, winner) were merged into; loops that come of it go."""
    side = lambda c: winners.select(F.col("thing").alias(c), F.col("winner").alias(f"_{c}"))
    told = edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    return told.select(F.coalesce("_src", "src").alias("src"), "relation", F.coalesce("_dst", "dst").alias("dst")).where("src <> dst").distinct()


def within_schema(facts: DataFrame, allowed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Facts (s, p, o) whose relation, by its own name or what an alias (alias, p) stands for, the schema (p) allows."""
    own = facts.join(aliases.select(F.col("alias").alias("p"), F.col("p").alias("_p")), "p", "left")
    return own.select("s", F.coalesce("_p", "p").alias("p"), "o").join(allowed.select("p").distinct(), "p", "left_semi").select("s", "p", "o").distinct()


def axiom_conflicts(facts: DataFrame, functional: list[str], disjoint: list[tuple[str, str]]) -> DataFrame:
    """(kind, s, detail): things with two values of a relation that may have one, and things that are of two kinds that shut each other out."""
    one = facts.where(F.col("p").isin(*functional)).groupBy("s", "p").agg(F.count_distinct("o").alias("_n")).where("_n > 1").select(F.lit("functional").alias("kind"), "s", F.col("p").alias("detail"))
    kinds = facts.where("p = 'is a'").select("s", "o").distinct().groupBy("s").agg(F.collect_set("o").alias("_k"))
    for a, b in disjoint:
        one = one.union(kinds.where(F.array_contains("_k", a) & F.array_contains("_k", b)).select(F.lit("disjoint"), "s", F.lit(f"{a},{b}")))
    return one
