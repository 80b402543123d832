"""An inverted index kept as a table, and searches in it: phrases, all or any of them, ranked by BM25 with exact titles first, page by page.

Postings are rows (field, term, doc_id, place), one for each word of a document, partitioned by batch and by a bucket of the term and
sorted by term, so that a search opens the files of its terms' buckets alone and skips in them by the bounds of their parts. A batch
that is written again takes the place of itself. Buckets of frequent terms are split over several files, none is gathered. Documents have a row with their title, source and number of words. What a search reads grows
with the postings of its terms, not with the texts.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.rounds import fresh_folder, settled

#: Saturation and length weight of BM25, what a word in the title and in the body counts, and the least weight of a term.
K1, B, FIELDS, LEAST = 1.2, 0.75, {"title": 3.0, "body": 1.0}, 1e-6
#: A run of CJK letters, or a word of letters and digits.
WORDS = r"[㐀-鿿]+|[\p{L}\p{N}&&[^㐀-鿿]]+"


class BadCursor(ValueError):
    pass


def words(text: Column) -> Column:
    """The words of a text in lower case, in order: runs of letters and digits, and for runs of CJK letters each two neighbours."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(low, F.lit(WORDS), F.lit(0))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 1)), lambda i: F.substring(w, i, F.lit(2)))
    cut = F.flatten(F.transform(found, lambda w: F.when(w.rlike(r"^[㐀-鿿]"), pairs(w)).otherwise(F.array(w))))
    return F.when(low.rlike("[㐀-鿿]"), cut).otherwise(found)  # most texts have no such run, and their words are looked at once


def search_tokens(text: Column) -> Column:
    """The different words of a text, in order of their first place."""
    return F.array_distinct(words(text))


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    folder: str
    buckets: int = 64

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/postings")

    def documents(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/documents")


def create(spark: SparkSession, folder: str | None = None, buckets: int = 64) -> Index:
    """An index without documents, in a folder of its own in the shared one if none is named."""
    return Index(folder or fresh_folder(spark, "fulltext"), buckets)


def append(index: Index, docs: DataFrame, batch: str) -> Index:
    """Write a batch of docs (doc_id, title, text, source) to the index; the same batch again takes its own place.

    Documents are told apart by doc_id, which must not repeat, nor be null. Null titles and texts count as empty; a document
    without words is known and found by nothing. An empty batch writes nothing, and takes an earlier one of its name away.
    """
    cut = docs.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), "source", words(F.col("title")).alias("_title"), words(F.col("text")).alias("_body"))
    rows = cut.select("doc_id", "title", "source", (F.size("_title") + F.size("_body")).alias("n"), F.lit(batch).alias("batch"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{index.folder}/documents")
    placed = reduce(DataFrame.union, [cut.select("doc_id", F.lit(f).alias("field"), F.posexplode(f"_{f}").alias("place", "term")) for f in FIELDS])
    placed = placed.withColumns({"batch": F.lit(batch), "bucket": bucket(F.col("term"), index.buckets)}).hint("rebalance", "bucket")
    sorted_ = placed.sortWithinPartitions("batch", "bucket", "field", "term", "doc_id", "place")
    sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(f"{index.folder}/postings")
    return index


def cut_phrases(spark: SparkSession, phrases: list[str]) -> list[list[str]]:
    """The words of each phrase that has any; phrases come from a user and are few."""
    rows = spark.createDataFrame(list(enumerate(phrases)), "i int, p string").select("i", words(F.col("p")).alias("w")).orderBy("i").collect()
    return [list(r.w) for r in rows if r.w]


def phrase_hits(index: Index, spark: SparkSession, phrases: list[list[str]]) -> DataFrame:
    """(doc_id, phrase, field, times): how often each phrase, given by its words, stands in a field of a document.

    Only buckets of the phrases' words are read. A word's place, less its number in the phrase, is where the phrase would begin; where
    all its words agree it does. These are counts, added up in tasks before they are shuffled.
    """
    asked = sorted({w for p in phrases for w in p})
    if not asked:
        return spark.createDataFrame([], f"doc_id {index.documents(spark).schema['doc_id'].dataType.simpleString()}, phrase int, field string, times int")
    buckets = [r.b for r in spark.createDataFrame([(w,) for w in asked], "w string").select(bucket(F.col("w"), index.buckets).alias("b")).distinct().collect()]
    rows = index.postings(spark).where(F.col("bucket").isin(buckets) & F.col("term").isin(asked))
    found = []
    for i, phrase in enumerate(phrases):
        turns = F.create_map(*[x for w in dict.fromkeys(phrase) for x in (F.lit(w), F.array(*[F.lit(k) for k, v in enumerate(phrase) if v == w]))])
        begins = rows.where(F.col("term").isin(phrase)).select("doc_id", "field", "place", F.explode(F.element_at(turns, F.col("term"))).alias("k"))
        whole = begins.groupBy("doc_id", "field", (F.col("place") - F.col("k")).alias("begin")).agg(F.count("*").alias("n")).where(F.col("n") == len(phrase))
        found.append(whole.groupBy("doc_id", "field").agg(F.count("*").cast("int").alias("times")).select("doc_id", F.lit(i).alias("phrase"), "field", "times"))
    return reduce(DataFrame.union, found)


def matches(index: Index, spark: SparkSession, phrases: list[str], match_any: bool = False, source: str | None = None) -> DataFrame:
    """(doc_id, title, source, score) of the documents that hold all phrases, or any; score by BM25 over all documents.

    A phrase counts as one term: in how many documents it stands, how often in title (three times as much) and body. The statistics
    are those of the whole index; `source` (a source, or a part of its name in any case) only narrows what is returned.
    """
    cut = cut_phrases(spark, phrases)
    known = index.documents(spark)
    hits = settled(phrase_hits(index, spark, cut).groupBy("doc_id", "phrase").agg(
        F.sum(F.col("times") * F.when(F.col("field") == "title", FIELDS["title"]).otherwise(FIELDS["body"])).alias("weight")
    ))
    held = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    stats = known.agg(F.count("*").alias("_docs"), F.avg("n").alias("_mean"))
    idf = F.greatest(F.ln((F.col("_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST))
    told = hits.join(F.broadcast(held), "phrase").join(F.broadcast(stats))  # a row for each phrase, and one
    told = told.join(known.select("doc_id", "title", "source", "n"), "doc_id")
    part = idf * F.col("weight") * (K1 + 1) / (F.col("weight") + K1 * (1 - B + B * F.col("n") / F.col("_mean")))
    scored = told.groupBy("doc_id", "title", "source").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("_held"))
    if source is not None:
        scored = scored.where((F.col("source") == source) | F.contains(F.lower("source"), F.lower(F.lit(source))))
    return scored.where(F.col("_held") >= (1 if match_any else max(1, len(cut)))).drop("_held")


def scope_of(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False).encode()).hexdigest()[:16]


def encoded(scope: str, last: list) -> str:
    return base64.urlsafe_b64encode(json.dumps({"scope": scope, "last": last}).encode()).decode()


def decoded(cursor: str, scope: str) -> list:
    """What a cursor says of where the page before ended; it holds for the search alone that gave it."""
    try:
        token = json.loads(base64.urlsafe_b64decode(cursor.encode()).decode())
        if token["scope"] == scope and isinstance(token["last"], list):
            return token["last"]
    except (ValueError, KeyError, TypeError, UnicodeDecodeError):
        pass
    raise BadCursor("the cursor belongs to another search")


def ranked(index: Index, spark: SparkSession, phrases: list[str], most: int = 6, match_any: bool = False, source: str | None = None, cursor: str | None = None) -> DataFrame:
    """(place, doc_id, title, source, score, cursor) of the best documents: those with the phrase as their very title first (if there is
    one phrase), then by score, ties by doc_id. cursor leads to what comes after a row; place counts on from page to page.
    """
    scope = scope_of(phrases, match_any, source)
    exact = F.lower(F.trim("title")) == phrases[0].strip().lower() if len(phrases) == 1 else F.lit(False)
    rows = matches(index, spark, phrases, match_any, source).withColumn("_other", F.when(exact, 0).otherwise(1))
    start = 0
    if cursor is not None:
        try:
            start, other, score, key = (kind(x) for kind, x in zip((int, int, float, str), decoded(cursor, scope), strict=True))
        except (ValueError, TypeError):
            raise BadCursor("the cursor belongs to another search") from None
        key = F.lit(key).cast(rows.schema["doc_id"].dataType)
        after = (F.col("_other") > other) | ((F.col("_other") == other) & ((F.col("score") < score) | ((F.col("score") == score) & (F.col("doc_id") > key))))
        rows = rows.where(after)
    page = rows.orderBy("_other", F.desc("score"), "doc_id").limit(most)
    place = F.row_number().over(W.orderBy("_other", F.desc("score"), "doc_id")) + start  # of one page
    token = F.base64(F.to_json(F.struct(F.lit(scope).alias("scope"), F.array(place.cast("string"), F.col("_other").cast("string"), F.col("score").cast("string"), F.col("doc_id").cast("string")).alias("last"))).cast("binary"))
    return page.select(place.alias("place"), "doc_id", "title", "source", "score", token.alias("cursor"))


def literal_page(docs: DataFrame, text: str, cursor: str | None = None, most_docs: int = 64, most_bytes: int = 8 << 20) -> tuple[DataFrame, str | None]:
    """One page of the search for a text, in any case, in the bodies of docs (doc_id, text): (doc_id) of those that hold it, and the next cursor.

    A page looks at the next documents in order of their id, at most so many and, but for the first, so many bytes; the cursor tells
    the last one looked at, so a page costs a scan of what follows it and no more. None: there is nothing left.
    """
    needle, scope = text.strip().lower(), scope_of("literal", text.strip().lower())
    if not 1 <= len(needle) <= 256:
        raise ValueError("a text of 1 to 256 characters is looked for")
    rest = docs.where("doc_id is not null")
    if cursor is not None:
        rest = rest.where(F.col("doc_id") > F.lit(decoded(cursor, scope)[0]).cast(docs.schema["doc_id"].dataType))
    sizes = rest.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).orderBy("doc_id").limit(most_docs + 1).collect()  # ids and sizes of one page
    taken, room = 0, most_bytes
    while taken < min(len(sizes), most_docs) and (taken == 0 or sizes[taken].n <= room):
        room -= sizes[taken].n
        taken += 1
    if not taken:
        return docs.select("doc_id").limit(0), None
    last = sizes[taken - 1].doc_id
    page = rest.where(F.col("doc_id") <= F.lit(last).cast(docs.schema["doc_id"].dataType))
    found = page.where(F.contains(F.lower("text"), F.lit(needle))).select("doc_id")
    return found, encoded(scope, [last]) if len(sizes) > taken else None


def holding(index: Index, spark: SparkSession, rows: DataFrame, phrases: list[str], match_any: bool = False) -> DataFrame:
    """The rows (doc_id, ...) whose document the index finds by the phrases: a semi join with the postings, rows stay as they are."""
    cut = cut_phrases(spark, phrases)
    hits = phrase_hits(index, spark, cut).groupBy("doc_id").agg(F.count_distinct("phrase").alias("_held"))
    return rows.join(hits.where(F.col("_held") >= (1 if match_any else max(1, len(cut)))), "doc_id", "left_semi")
