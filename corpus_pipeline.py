"""A corpus pipeline: documents in, token ids out, each stage over all that the one before it kept.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns a DataFrame that is written as Parquet
and read again as the docs of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, mixing, quality, simhash, suffix_dedup
from quern.llm.common import dropped, fresh_dir, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, does not reject.

    Whole texts are judged, row by row; null texts count as empty, repeated rows stay or go together. Empty table: no rows.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by SimHash over shingles of five words and the sets themselves, the document with the least id.

    Null and empty texts are one group; rows with a null id stay; of rows that repeat id and text one stays. Empty table: no rows.
    """
    return simhash.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes and more that stood earlier; n_chars follows, emptied documents go.

    Null and empty texts have nothing to lose and stay, as empty ones; of repeated rows the first keeps its text. Empty table: no rows.
    """
    return suffix_dedup.shortened(docs, window=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: each document at least once, none more than about twice.

    Null sources and ids are values of their own; texts without words weigh one token; long texts are not cut. Empty table: no rows.
    """
    return mixing.drawn(docs, most_epochs=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to the same bytes. Null and empty texts have no ids. Empty table: no rows."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), path, public_tokenizers.PATTERN, decoded="decoded")
    exact = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), exact.alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("suffix_array", repeated_strings),
    ("mixture", mixture),
    ("bpe", tokens),
]

#: Classifier, fingerprints and merges cannot be expressed in SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:  # what the next stage has written needs the one before no more
            dropped(spark, before)
        before = folder
    return docs
