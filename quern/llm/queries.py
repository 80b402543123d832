"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, bpe, fingerprints, lexical, maxent, mixing, periodic, quality, simhash, substring_dedup, suffix_dedup, toxicity, warc
from quern.llm.common import checkpoint, fresh_dir, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.planned(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), most_epochs=2.0)
    return plan.select("doc_id", "source", "tokens", "epoch", "block", "slot")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.removed(table(spark, sf_dir, "documents").select("doc_id", "text"), window=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = checkpoint(ann.index(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), dim=64))
    return ann.search(indexed, indexed.where(F.col("key") % 20 == 0), k=20)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, radius=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.removed(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit(docs, table(spark, sf_dir, "labels"), folds=5, held=0)
    return quality.scored(docs, net).select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents").select("doc_id", "text"), samples=32)


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), fold=7, held=2)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), folds=4, held=2)
    return toxicity.scored(docs, lexicon).select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lexical.index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical.search(spark, made, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


def made_periodic(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), a tenth of them with words that repeat to the end, as the contract of op13 has it."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.withColumn("words", F.when(h % 10 == 0, words)).withColumn("n", F.size("words")).withColumn("g", F.floor(h / 10))
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    chosen = chosen.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    place = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + F.pmod(i - F.col("a"), F.col("p"))))
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("words", place), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detected(made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.get(F.array_sort("runs", lambda a, b: F.when(a.length != b.length, F.signum(b.length - a.length)).when(a.start != b.start, F.signum(a.start - b.start)).otherwise(F.signum(a.period - b.period)).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ann": op4_ann,
    "op5_simhash": op5_simhash,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_fingerprints": op9_fingerprints,
    "op10_maxent": op10_maxent,
    "op11_toxicity": op11_toxicity,
    "op12_lexical": op12_lexical,
    "op13_periodic": op13_periodic,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": r"""
WITH u AS (
  SELECT source, doc_id, sum(greatest(1, len(str_split(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')), ' '))))::BIGINT AS tokens
  FROM documents GROUP BY 1, 2),
s AS (SELECT source, sum(tokens)::BIGINT AS total FROM u GROUP BY 1),
e AS (SELECT sum(total)::DOUBLE AS everything, CASE WHEN max(total) <= 2 * min(total) THEN 0 ELSE round(1 - ln(2) / ln(max(total)::DOUBLE / min(total)), 6) END AS exponent FROM s),
p AS (SELECT source, total, pow(total / everything, exponent) AS power FROM s, e),
w AS (SELECT sum(power) AS whole, max(total / power) AS per FROM p),
b AS (SELECT source, total, round(power / whole * (per * whole))::BIGINT AS budget FROM p, w),
n AS (SELECT greatest(1, ceil(sum(budget) / 1000000.0))::BIGINT AS blocks FROM b),
t AS (
  SELECT u.*, total, budget, epoch, md5('1:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source, unnest(range(ceil(budget / total)::BIGINT)) AS x(epoch)),
r AS (
  SELECT *, epoch * total + coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM t),
k AS (SELECT r.*, floor(start / budget * blocks)::INT AS block FROM r, n WHERE start < budget)
SELECT doc_id, source, tokens, epoch::INT AS epoch, block,
  row_number() OVER (PARTITION BY block ORDER BY place, source NULLS FIRST, doc_id NULLS FIRST, epoch)::INT AS slot
FROM k""",
    "op8_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q""",
    "op12_lexical": r"""
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
d AS (SELECT row, doc_id, len(terms)::BIGINT AS n, terms FROM w WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS total FROM d),
t AS (SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM d) GROUP BY row, term),
f AS (SELECT term, floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY term),
q AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
r AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // total))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN t USING (term), s GROUP BY item_id, row),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10""",
}
