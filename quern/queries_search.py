"""Registered queries of matching and of full-text search over an index, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import fulltext, matching, vectors
from quern.registry import Tables, query

#: The documents that the queries below search in: the first line of a text is its title.
TITLED = "d AS (SELECT doc_id, coalesce(regexp_extract(text, '^[^\\n]*'), '') AS title, text, source FROM documents), "
CUT = "w AS (SELECT doc_id, title, source, regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+') AS a, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS b FROM d)"


def titled(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.coalesce(F.regexp_extract("text", r"^[^\n]*", 0), F.lit("")).alias("title"), "text", "source")


def indexed(t: Tables) -> tuple[fulltext.Index, DataFrame]:
    """An index of all documents, written in two batches, and the documents."""
    docs = titled(t)
    made = fulltext.create(docs.sparkSession)
    for turn in range(2):
        fulltext.append(made, docs.where(F.col("doc_id") % 2 == turn), f"half-{turn}")
    return made, docs


def _times(column: str, words: list[str]) -> str:
    same = " AND ".join(f"{column}[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"len(list_filter(range(1, len({column}) + 1), lambda i: {same}))"


def _ranked_sql(phrases: list[list[str]], least: int, most: int) -> str:
    weights = ", ".join(f"3 * {_times('a', p)} + {_times('b', p)} AS x{i}" for i, p in enumerate(phrases))
    stats = ", ".join(f"count(*) FILTER (WHERE x{i} > 0) AS f{i}" for i in range(len(phrases)))
    part = " + ".join(
        f"CASE WHEN x{i} > 0 THEN greatest(1e-6, ln((c - f{i} + 0.5) / (f{i} + 0.5))) * x{i} * 2.2 / (x{i} + 1.2 * (0.25 + 0.75 * n / m)) ELSE 0 END" for i in range(len(phrases))
    )
    held = " + ".join(f"(x{i} > 0)::INT" for i in range(len(phrases)))
    return (
        f"WITH {TITLED}{CUT}, x AS (SELECT doc_id, title, source, len(a) + len(b) AS n, {weights} FROM w), s AS (SELECT count(*) AS c, avg(n) AS m, {stats} FROM x), "
        f"r AS (SELECT doc_id, title, source, round({part}, 6) AS score FROM x, s WHERE {held} >= {least}) "
        f"SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS place, doc_id, title, source, score FROM r ORDER BY place LIMIT {most}"
    )


def _page(t: Tables, phrases: list[str], most: int, match_any: bool) -> DataFrame:
    made, docs = indexed(t)
    return fulltext.ranked(made, docs.sparkSession, phrases, most, match_any).drop("cursor")


query("find_ranked", _ranked_sql([["of", "the"]], 1, 50))(lambda t: _page(t, ["of the"], 50, False))
query("find_all_terms", _ranked_sql([["on", "the"], ["was"], ["with"]], 3, 50))(lambda t: _page(t, ["on the", "was", "with"], 50, False))
query("find_any_term", _ranked_sql([["das", "die"], ["de", "la"]], 1, 50))(lambda t: _page(t, ["das die", "De La"], 50, True))


@query("find_second_page", _ranked_sql([["in", "the"], ["and"]], 1, 40) + " OFFSET 20")
def find_second_page(t: Tables) -> DataFrame:
    made, docs = indexed(t)
    spark = docs.sparkSession
    first = fulltext.ranked(made, spark, ["in the", "and"], 20, True).orderBy(F.desc("place")).first()
    return fulltext.ranked(made, spark, ["in the", "and"], 40, True, cursor=first.cursor if first else None).drop("cursor")


@query("find_labelled", f"WITH {TITLED}{CUT} SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM w WHERE {_times('a', ['that'])} + {_times('b', ['that'])} > 0)")
def find_labelled(t: Tables) -> DataFrame:
    made, docs = indexed(t)
    return fulltext.holding(made, docs.sparkSession, t("labels").select("doc_id", "quality"), ["that"])


query("literal_page", "SELECT doc_id FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 64) WHERE contains(lower(text), 'tion th')")(lambda t: fulltext.literal_page(t("documents"), "tion TH")[0])
query(
    "search_tokens",
    "SELECT item_id, array_to_string(list_distinct_in_order, ' ') AS tokens FROM (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_in_order FROM "
    "(SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark))",
)(lambda t: t("benchmark").select("item_id", F.array_join(fulltext.search_tokens(F.col("text")), " ").alias("tokens")))


def _long_words(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.explode(fulltext.search_tokens(F.col("text"))).alias(name)).where(F.length(name) >= 6).distinct()


query("words_grounded")(lambda t: matching.grounded(_long_words(t("benchmark"), "value"), _long_words(t("conversations"), "wanted")))


@query("terms_rewritten")
def terms_rewritten(t: Tables) -> DataFrame:
    """Documents in which the first two words of any benchmark item are replaced by the item's number."""
    words = F.slice(F.split("text", " "), 1, 2)
    terms = t("benchmark").select(F.col("item_id").alias("group"), F.array_join(words, " ").alias("term"), F.concat(F.lit("["), F.col("item_id").cast("string"), F.lit("]")).alias("canonical"))
    found = matching.rewritten(t("documents").select("doc_id", "text"), terms)
    return found.where(F.size("matched") > 0).select("doc_id", F.size("matched").alias("terms"), F.sha2("rewritten", 256).alias("rewritten_sha256"))


def _nearest_sql(k: int, least: float, same: str = "") -> str:
    return (
        "WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score "
        f"FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id{same}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p WHERE score >= {least}) "
        f"SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"
    )


def _nearest(t: Tables, **how) -> DataFrame:
    """Each embedding's nearest others, by an index of cells over all of them."""
    rows = t("embeddings").select("vec_id", "embedding", "label")
    return vectors.search(vectors.build(rows, 64, ["label"]), rows, rows.select(F.col("vec_id").alias("query_id"), "embedding", "label"), but_itself=True, **how)


query("vectors_by_cell", _nearest_sql(10, -1.0))(lambda t: _nearest(t, k=10))
query("vectors_above", _nearest_sql(40, 0.3))(lambda t: _nearest(t, k=40, least=0.3))
query("vectors_filtered", _nearest_sql(5, -1.0, " AND a.label = b.label"))(lambda t: _nearest(t, k=5, by="label"))
