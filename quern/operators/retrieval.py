"""Retrieval: exact vector search with a threshold, lexical scores, BM25, fusion of ranks, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.graph import levels
from quern.operators.rounds import numbered, settled


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; zero for empty or zero vectors and for unequal lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def above(vectors: DataFrame, query: list[float], least: float, most: int) -> DataFrame:
    """The rows (vec_id, embedding) nearest to one query, at least as near as the threshold, best first."""
    near = F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), 6)
    return vectors.select("vec_id", near.alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "vec_id").limit(most)


def tokens(text: str | Column) -> Column:
    """Different words of a text in lower case, letters and digits of ASCII only."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    every = F.size(F.array_union(a, b))
    return F.size(F.array_intersect(a, b)) / F.when(every != 0, every)


def fused(signals: list[tuple[DataFrame, float]], key: str, most: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of signals (key, score) with weights: sum of weight / (k + rank), best first.

    All positive scores are ranked, from 0, ties by key; ranges of scores are numbered apart, so no task sees a whole signal.
    """
    parts = []
    for rows, weight in signals:
        placed = numbered(rows.where("score > 0").select(key, "score"), [F.desc("score"), F.col(key)], "_r")
        parts.append(placed.select(key, (F.lit(float(weight)) / (k + F.col("_r"))).alias("part")))
    return reduce(DataFrame.union, parts).groupBy(key).agg(F.round(F.sum("part"), 8).alias("score")).orderBy(F.desc("score"), key).limit(most)


def scored_terms(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) by BM25 of all documents (doc_id, text) that hold any of the terms.

    A text is cut into words once; its length and its counts of the terms are all that is kept, and the statistics are sums of these.
    """
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    asked = F.array(*[F.lit(t) for t in terms])
    times = lambda term: F.size(F.filter("_w", lambda w: w == F.lit(term)))
    cut = docs.select("doc_id", words.alias("_w")).select("doc_id", F.size("_w").alias("_n"), F.filter("_w", lambda w: F.array_contains(asked, w)).alias("_w"))
    counted = settled(cut.select("doc_id", "_n", *[times(t).alias(f"_{i}") for i, t in enumerate(terms)]))
    stats = counted.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *[F.count_if(F.col(f"_{i}") > 0).alias(f"_d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.ln(1 + (F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        score = score + idf * F.col(f"_{i}") * (k1 + 1) / (F.col(f"_{i}") + k1 * (1 - b + b * F.col("_n") / F.col("_mean")))
    held = counted.where(" or ".join(f"_{i} > 0" for i in range(len(terms))))
    return held.join(F.broadcast(stats), F.lit(True)).select("doc_id", F.round(score, 6).alias("score"))  # of one row


def bm25(docs: DataFrame, terms: list[str], most: int) -> DataFrame:
    """The best documents (doc_id, text) for some terms; statistics come from all documents."""
    return scored_terms(docs, terms).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(most)


def nearest_each(vectors: DataFrame, queries: DataFrame, by: str, most: int, least: float = -1.0) -> DataFrame:
    """(query_id, vec_id, score, rank): for each row of queries (query_id, by, embedding) its nearest among the vectors that share `by`.

    A scalar filter goes before the search: only vectors of the same value of `by` are met. Ties go to the smaller vec_id.
    """
    long = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    asked = queries.select("query_id", by, F.col("embedding").alias("_q"), long("embedding").alias("_m"))
    known = vectors.select("vec_id", by, F.col("embedding").alias("_v"), long("embedding").alias("_n"))  # lengths are taken once, not for each pair
    norms = F.col("_n") * F.col("_m")
    near = F.when((F.size("_v") == F.size("_q")) & (norms > 0), dot(F.col("_v"), F.col("_q")) / norms).otherwise(F.lit(0.0))
    met = known.join(asked, by).where(F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(near, 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= most)


def table_score(asked: Column, table_tokens: Column, column_tokens: Column) -> Column:
    """Words that a question shares with a table's name, and half of those that it shares with its columns."""
    return F.size(F.array_intersect(asked, table_tokens)) + 0.5 * F.size(F.array_intersect(asked, column_tokens))


def column_score(sizes: Column) -> Column:
    """The greatest overlap of any column, and half of the next."""
    best = F.sort_array(sizes, asc=False)
    return F.coalesce(F.get(best, 0), F.lit(0)) + 0.5 * F.coalesce(F.get(best, 1), F.lit(0))


def value_score(values: Column) -> Column:
    """Sum of 1 + length / 20 over the three longest different values that a question names."""
    longest = F.slice(F.sort_array(F.transform(F.array_distinct(values), lambda v: F.length(v)), asc=False), 1, 3)
    return F.aggregate(longest, F.lit(0.0), lambda s, n: s + 1 + n / 20)


def asked_tables(columns: DataFrame, values: DataFrame, edges: DataFrame, question: str, most: int, weights: tuple[float, ...] = (1.0, 0.8, 0.6, 0.4)) -> DataFrame:
    """(table_name, score): tables for a question, from four signals fused by rank: names, columns, values that the question names,
    and nearness, within two joins, to tables whose names it holds.

    columns is (table_name, column_name), values (table_name, value), edges (src, dst) between tables: catalogs, small beside data.
    """
    words = tokens(F.lit(question))
    own = columns.groupBy("table_name").agg(F.collect_list(tokens("column_name")).alias("_c"))
    by_name = own.select("table_name", table_score(words, tokens("table_name"), F.array_distinct(F.flatten("_c"))).alias("score"))
    by_column = own.select("table_name", column_score(F.transform("_c", lambda c: F.size(F.array_intersect(words, c)))).alias("score"))
    named = values.where(F.length("value") >= 2).where(F.lit(question.lower()).contains(F.lower("value")))
    by_value = named.groupBy("table_name").agg(value_score(F.collect_set("value")).alias("score"))
    seeds = own.where(F.size(F.array_intersect(words, tokens("table_name"))) > 0).select(F.col("table_name").alias("node"))
    by_graph = levels(edges, seeds, 2, directed=False).select(F.col("node").alias("table_name"), (1 / (1 + F.col("hops"))).alias("score"))
    return fused(list(zip((by_name, by_column, by_value, by_graph), weights, strict=True)), "table_name", most)


def best_above(scores: DataFrame, by: str, key: str, floor: float, margin: float) -> DataFrame:
    """(by, key, score): of each group the best, if it reaches the floor and leads the next by the margin."""
    order = W.partitionBy(by).orderBy(F.desc("score"), key)
    led = scores.withColumns({"_n": F.row_number().over(order), "_next": F.lead("score").over(order)})
    return led.where((F.col("_n") == 1) & (F.col("score") >= floor) & (F.col("score") - F.coalesce("_next", F.lit(0.0)) >= margin)).select(by, key, "score")


def by_document(chunks: DataFrame, how: str) -> DataFrame:
    """Chunk scores (doc_id, chunk, score) brought to documents: max, mean or first chunk."""
    value = {"max": F.max("score"), "mean": F.avg("score"), "first": F.min_by("score", "chunk")}[how]
    return chunks.groupBy("doc_id").agg(F.round(value, 6).alias("score"))


def budgeted(ranked_rows: DataFrame, key: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Of each key the first rows in order whose sizes sum up to at most the budget."""
    total = F.sum(size).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranked_rows.withColumn("_total", total).where(F.col("_total") <= budget).drop("_total")
