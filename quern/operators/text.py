"""Text preparation: token estimates, noise and heading blocks, chunks with overlap, words of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of at most four characters that hold no content, as page numbers, roman numerals and rules do.
NOISE = r"^\s*([0-9]{1,4}|[ivxlcdmIVXLCDM]{1,4}|[-—–_=*·•.~]{1,4})?\s*$"
#: How numbered headings begin, and what ends a sentence.
HEADING = r"^\s*(#{1,6}\s|[0-9]+(\.[0-9]+)*[.)、]?\s|第[0-9一二三四五六七八九十百]+[章节条]|[一二三四五六七八九十]+、)"
SENTENCE_END = "。！？；.!?;"


def estimated_tokens(text: str | Column) -> Column:
    """A token for every character beyond ASCII, and for every four of a run of ASCII, rounded up; null and empty texts have none."""
    known = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    runs = F.transform(F.regexp_extract_all(known, F.lit(r"([\x00-\x7F]+)"), F.lit(1)), lambda r: F.ceil(F.length(r) / 4))
    return (F.length(F.regexp_replace(known, r"[\x00-\x7F]+", "")) + F.aggregate(runs, F.lit(0).cast("long"), lambda s, x: s + x)).cast("int")


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, block, line): the lines of each text, from 0."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("block", "line"))


def noise(line: str) -> Column:
    return F.col(line).rlike(NOISE)


def heading(line: str, most: int = 40) -> Column:
    """Numbered lines of at most twice `most` characters, or 80, and others of at most `most` that do not end a sentence."""
    bare = F.trim(line)
    short = (F.length(bare) > 0) & (F.length(bare) <= most) & ~F.right(bare, F.lit(1)).isin(*SENTENCE_END)
    return F.when(F.col(line).rlike(HEADING), F.length(bare) <= max(2 * most, 80)).otherwise(short)


def repeated_noise(rows: DataFrame, least: int = 3, most_chars: int = 20) -> DataFrame:
    """(doc_id, line, times): short lines that a document repeats, as running heads do."""
    short = rows.withColumn("line", F.trim("line")).where((F.length("line") > 0) & (F.length("line") <= most_chars))
    return short.groupBy("doc_id", "line").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def chunks(docs: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """(doc_id, chunk, content, tokens): pieces of `size` characters, each beginning `size - overlap` after the last."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / F.lit(step)) - 1).cast("int")
    cut = docs.where(F.length(text) > 0).select("doc_id", F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    told = cut.select("doc_id", "chunk", F.substring("_t", F.col("chunk") * step + 1, F.lit(size)).alias("content"))
    return told.withColumn("tokens", estimated_tokens("content"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, target): the addresses that a page's anchors name."""
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))
    return pages.select("page_id", F.explode(found).alias("target"))


def plain(html: str | Column) -> Column:
    """What is left of a page without scripts, styles and tags, white space closed up."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def known_links(rows: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """rows (key, text) in which [[target]] stays a link only if the target is known (target); others become plain text."""
    parts = rows.select(key, F.posexplode(F.split(text, r"(?=\[\[)|(?<=\]\])")).alias("_n", "_p"))
    named = parts.withColumn("_t", F.nullif(F.regexp_extract("_p", r"^\[\[([^\]]+)\]\]$", 1), F.lit("")))
    told = named.join(known.select("target").distinct(), F.col("_t") == F.col("target"), "left")
    piece = F.when(F.col("_t").isNotNull() & F.col("target").isNull(), F.col("_t")).otherwise(F.col("_p"))
    return told.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", piece.alias("p")))), lambda x: x["p"]), "").alias(text))


def sanitized(message: Column, most: int = 500) -> Column:
    """A message without names and passwords before a host and without values of tokens, keys and secrets, then cut."""
    bare = F.regexp_replace(message, r"[^\s:/@]+:[^\s@]+@", "***:***@")
    return F.substring(F.regexp_replace(bare, r"(?i)\b(token|api_key|apikey|password|secret)=\S+", "$1=***"), 1, most)
