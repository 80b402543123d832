"""Document preparation that walks in order: packing of blocks, tables out of pages, signatures, diverse selections.

Each document, page or query is one row or one bounded group; Spark deals them out, Python sees one at a time.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.rounds import settled


def packed(lines: list[str], budget: int, noise: re.Pattern, heading: re.Pattern) -> list[tuple[str, int]]:
    """Lines joined into packs of at most `budget` characters, each under the last heading before it; (text, lines) of each.

    Noise is left out. A pack that would pass the budget is closed first; a longer line has a pack of its own.
    """
    found: list[tuple[str, int]] = []
    head, held, size = "", [], 0
    for line in (x for x in lines if x.strip() and not noise.search(x)):
        if heading.search(line) and len(line) <= 60:
            if held:
                found.append(("\n".join([f"[{head}]"] * bool(head) + held), len(held)))
            head, held, size = line.strip(), [], 0
            continue
        if held and size + len(line) + 1 > budget:
            found.append(("\n".join([f"[{head}]"] * bool(head) + held), len(held)))
            held, size = [], 0
        held.append(line)
        size += len(line) + 1
    if held:
        found.append(("\n".join([f"[{head}]"] * bool(head) + held), len(held)))
    return found


def pack(docs: DataFrame, budget: int, noise: str, heading: str) -> DataFrame:
    """(doc_id, pack, content, lines) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip, top = re.compile(noise), re.compile(heading)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [(d, n, *p) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for n, p in enumerate(packed((t or "").split("\n"), budget, skip, top))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int32()), strict=True)], ["doc_id", "pack", "content", "lines"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pack int, content string, lines int")


class Grids(HTMLParser):
    """The tables of a page as rows of cells; a cell that spans columns leaves the others empty, one that spans rows repeats."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.grids: list[list[list[str]]] = []
        self.down: dict[int, tuple[int, str]] = {}
        self.cell, self.span = None, (1, 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.grids.append([])
            self.down = {}
        elif tag == "tr" and self.grids:
            self.handle_endtag("td")
            self.grids[-1].append([])
            self.carry()
        elif tag in ("td", "th") and self.grids and self.grids[-1]:
            self.handle_endtag(tag)  # of a cell that was left open
            known = dict(attrs)
            number = lambda name: max(1, int(known[name])) if (known.get(name) or "").isdigit() else 1
            self.cell, self.span = [], (number("colspan"), number("rowspan"))

    def carry(self) -> None:
        row = self.grids[-1][-1]
        while (left := self.down.get(len(row))) is not None:
            at = len(row)
            row.append(left[1])
            self.down[at] = (left[0] - 1, left[1])
            if left[0] == 1:
                del self.down[at]

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table") and self.cell is not None:
            row, text = self.grids[-1][-1], " ".join("".join(self.cell).split())
            self.cell = None
            for i in range(self.span[0]):
                if self.span[1] > 1:
                    self.down[len(row)] = (self.span[1] - 1, text if i == 0 else "")
                row.append(text if i == 0 else "")
            self.carry()


def grids(html: str | None) -> list[list[list[str]]]:
    parser = Grids()
    parser.feed(html or "")
    return [g for g in parser.grids if any(g)]


def tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, cells) of all tables in pages (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = [(p, t, r, cells) for p, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for t, g in enumerate(grids(h)) for r, cells in enumerate(g)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())), strict=True)], ["page_id", "table_no", "row_no", "cells"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, table_no int, row_no int, cells array<string>")


def signature(text: str | None, grams: int = 5, most: int = 200_000, key: bytes = b"") -> int | None:
    """63 bits by majority of keyed hashes of character grams; long texts are sampled by the hashes themselves. Null without grams."""
    plain = " ".join(unicodedata.normalize("NFKC", text or "").split()).lower()
    total = len(plain) - grams + 1
    if total < 1:
        return None
    gate = (1 << 64) if total <= most else most * (1 << 64) // total
    lanes = [int.from_bytes(d[8:], "little") for g in (plain[i : i + grams] for i in range(total)) if int.from_bytes((d := hashlib.blake2b(g.encode(), digest_size=16, key=key).digest())[:8], "little") < gate]
    if not lanes:
        return None
    bits = np.unpackbits(np.array(lanes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(lanes), bitorder="little").view(np.uint64)[0]) & ((1 << 63) - 1)


#: Different grams that a task remembers at most, and characters of texts whose grams are hashed together.
GRAMS, TOGETHER = 200_000, 1 << 20


def signatures_of(texts: list[str | None], known: dict[str, bytes], grams: int = 5, most: int = 200_000) -> list[int | None]:
    """signature() of each text, each different gram of all of them hashed once; known remembers digests from call to call.

    Grams are told apart by the numbers of their characters in the alphabet of the texts, which must fit into 64 bits together;
    texts of larger alphabets are taken one by one.
    """
    plain = [" ".join(unicodedata.normalize("NFKC", t or "").split()).lower() for t in texts]
    sizes = [len(p) - grams + 1 for p in plain]
    codes = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32) for p, n in zip(plain, sizes, strict=True) if n > 0]
    if not codes:
        return [None] * len(texts)
    alphabet, numbers = np.unique(np.concatenate(codes), return_inverse=True)
    if len(alphabet) > 1 << (63 // grams):
        return [signature(t, grams, most) for t in texts]
    width = max(1, int(len(alphabet) - 1).bit_length())
    marks = np.zeros(len(numbers) - grams + 1, np.uint64)
    for i in range(grams):
        marks = (marks << np.uint64(width)) | numbers[i : len(numbers) - grams + 1 + i].astype(np.uint64)
    starts = np.cumsum([0, *map(len, codes)])[:-1]
    inside = np.concatenate([np.arange(s, s + len(c) - grams + 1) for s, c in zip(starts, codes, strict=True)])
    different, at, which = np.unique(marks[inside], return_index=True, return_inverse=True)
    whole = "".join(p for p, n in zip(plain, sizes, strict=True) if n > 0)
    if len(known) > GRAMS:
        known.clear()
    digests = []
    for place in inside[at].tolist():
        gram = whole[place : place + grams]
        digest = known.get(gram)
        if digest is None:
            digest = known[gram] = hashlib.blake2b(gram.encode(), digest_size=16).digest()
        digests.append(digest)
    gates, lanes = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2).T
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    found, end = [], 0
    for n in sizes:
        own = which[end : end + max(0, n)]
        end += max(0, n)
        if n > most:
            own = own[gates[own] < np.uint64(most * (1 << 64) // n)]
        if not len(own):
            found.append(None)
            continue
        sums = np.add.reduceat(bits[own], np.arange(0, len(own), 255), axis=0)  # eight counters in each number, of at most 255
        set_bits = sums.view(np.uint8).sum(axis=0, dtype=np.int64)
        found.append(int(np.packbits(set_bits * 2 > len(own), bitorder="little").view(np.uint64)[0]) & ((1 << 63) - 1))
    return found


def together(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of neighbours whose sizes add up to at most so much, or of one that is larger."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, signature) of docs (doc_id, text). Each different gram of neighbouring texts is hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(1).to_pylist()
                made = [x for a, b in together([len(t or "") for t in texts], TOGETHER) for x in signatures_of(texts[a:b], known)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.int64())], ["doc_id", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, signature long")


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def near(signed: DataFrame, queries: DataFrame, least: float, block: int = 16_384, part: int = 65_536) -> DataFrame:
    """(query_id, doc_id, similarity) of all pairs of a row of queries and another of signed (doc_id, signature) that are so similar.

    Both sides are dealt out in blocks of bounded size, and each pair of blocks is compared whole by exclusive-or and bit counts.
    Null signatures are like nothing.
    """
    turns, parts = max(1, -(-queries.count() // block)), max(1, -(-signed.count() // part))
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = signed.where("signature is not null").select(every(turns).alias("q"), place(parts).alias("c"), F.lit(False).alias("asks"), "doc_id", "signature")
    asked = queries.where("signature is not null").select(place(turns).alias("q"), every(parts).alias("c"), F.lit(True).alias("asks"), "doc_id", "signature")
    most_bits = int((1 - least) * 64 + 1e-9)

    def run(table: pa.Table) -> pa.Table:
        asks, ids, marks = table["asks"].to_numpy(zero_copy_only=False), table["doc_id"].to_numpy(), table["signature"].to_numpy().view(np.uint64)
        own, others, found = np.flatnonzero(asks), np.flatnonzero(~asks), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in own:
            bits = np.bitwise_count(marks[others] ^ marks[i])
            hit = np.flatnonzero((bits <= most_bits) & (ids[others] != ids[i]))
            found.append((np.full(len(hit), ids[i]), ids[others[hit]], 1 - bits[hit] / 64))
        return pa.table(dict(zip(("query_id", "doc_id", "similarity"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return known.union(asked).groupBy("q", "c").applyInArrow(run, "query_id long, doc_id long, similarity double")


def sharing(counts: DataFrame, sizes: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """(a, b) of documents whose lines may agree to a share of `least`: a of asked (doc_id), b of all, both of counts (doc_id, _l, _n).

    A line counts as often as a document repeats it. Of x lines of a at least least / (2 - least) must be in b, so b has one of the
    first x less that number and one, in any order; the rarest lines are taken, so that lines of many texts bring few together.
    """
    share = least / (2 - least)
    times = lambda rows: rows.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_k"), "_l").select("doc_id", F.xxhash64("_l", "_k").alias("_t"))
    every = settled(times(counts).join(sizes, "doc_id"))
    own = every.join(asked, "doc_id", "left_semi")
    often = every.join(own.select("_t").distinct(), "_t", "left_semi").groupBy("_t").agg(F.count("*").alias("_often"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("_often", "_t"))
    first = own.join(often, "_t").withColumn("_p", place).where(F.col("_p") <= F.col("_size") - F.ceil(share * F.col("_size") - 1e-9) + 1)
    first = first.select(F.col("doc_id").alias("a"), "_t", F.col("_size").alias("_x"), "_p")
    fits = (F.col("_size") >= share * F.col("_x") - 1e-6) & (F.col("_x") >= share * F.col("_size") - 1e-6)
    return first.join(every.withColumnRenamed("doc_id", "b"), "_t").where(fits).select("a", "b").distinct()


def alike(docs: DataFrame, queries: DataFrame, least: float = 0.8, most: int = 10) -> DataFrame:
    """(query_id, doc_id, similarity, ratio, rank): for each document of queries those most like it, at most so many.

    Two documents are compared if their signatures lie within 0.05 below `least` and their lines let the ratio reach it: ratio is
    twice the lines that both have, repeats included, over all their lines. Greatest ratio first, then the greater id. Equal texts
    are compared as one, and of those only as many ids as can be among the answers are looked at. Null ids take no part.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    text = F.coalesce("text", F.lit(""))
    ids = settled(own.select("doc_id", F.sha2(text, 256).alias("_h")))
    classes = settled(ids.groupBy("_h").agg(F.min("doc_id").alias("_c")))
    named = settled(ids.join(classes, "_h").select("doc_id", "_c"))
    single = settled(own.join(named.where("doc_id = _c").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text"))
    known = settled(signatures(single).where("signature is not null"))
    asking = settled(named.join(queries.select("doc_id").distinct(), "doc_id", "left_semi"))
    asked = asking.select(F.col("_c").alias("doc_id")).distinct()
    lines = single.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("_l"))
    counts = settled(lines.groupBy("doc_id", F.sha2("_l", 256).alias("_l")).agg(F.count("*").alias("_n")))
    sizes = settled(counts.groupBy("doc_id").agg(F.sum("_n").alias("_size")))
    marked = lambda name: known.select(F.col("doc_id").alias(name), F.col("signature").alias(f"_s{name}"))
    close = F.bit_count(F.col("_sa").bitwiseXOR(F.col("_sb")))
    pairs = sharing(counts, sizes, asked, least).join(marked("a"), "a").join(marked("b"), "b")
    pairs = settled(pairs.where(close <= int((1 - max(0.0, least - 0.05)) * 64 + 1e-9)).select("a", "b", (1 - close / F.lit(64.0)).alias("similarity")))
    side = lambda name, n: counts.select(F.col("doc_id").alias(name), "_l", F.col("_n").alias(n))
    both = pairs.where("a <> b").join(side("a", "_a"), "a").join(side("b", "_b"), ["b", "_l"])
    shared = both.groupBy("a", "b").agg(F.sum(F.least("_a", "_b")).alias("_both"))
    told = pairs.join(shared, ["a", "b"], "left").join(sizes.select(F.col("doc_id").alias("b"), F.col("_size").alias("_x")), "b").join(sizes.select(F.col("doc_id").alias("a"), F.col("_size").alias("_y")), "a")
    ratio = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.round(2 * F.col("_both") / (F.col("_x") + F.col("_y")), 6))
    rated = told.withColumn("ratio", ratio).where(F.col("ratio") >= least).select("a", "b", "similarity", "ratio")
    turn = F.row_number().over(W.partitionBy("_c").orderBy(F.desc("doc_id")))
    last = named.withColumn("_turn", turn).where(F.col("_turn") <= most + 1).select(F.col("_c").alias("b"), "doc_id")
    place = lambda by: F.row_number().over(W.partitionBy(by).orderBy(F.desc("ratio"), F.desc("doc_id")))
    best = settled(rated.join(last, "b").withColumn("_place", place("a")).where(F.col("_place") <= most + 1))  # one more, as the query itself may be among them
    answers = best.join(asking.select(F.col("doc_id").alias("query_id"), F.col("_c").alias("a")), "a").where("query_id <> doc_id")
    return answers.withColumn("rank", place("query_id")).where(F.col("rank") <= most).select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), "ratio", "rank")


def diverse(items: DataFrame, query: str, item: str, most: int, weight: float = 0.7) -> DataFrame:
    """(query, item, rank): maximal marginal relevance among all of each query's items (query, item, score, tokens).

    Greedy by weight * score - (1 - weight) * greatest Jaccard similarity to what is chosen; ties go to the greater score, then to
    the smaller item. A choice of each query is one aggregation, and one join tells the others how like it they are, so a query of
    any size is spread over tasks.
    """
    left = settled(items.select(query, item, "score", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).withColumn("_near", F.lit(0.0)))
    found = None
    for rank in range(most):
        value = weight * F.col("score") - (1 - weight) * F.col("_near")
        best = left.groupBy(query).agg(F.min_by(F.struct(F.col(item).alias("i"), F.col("tokens").alias("t")), F.struct(-value, -F.col("score"), F.col(item))).alias("_b"))
        best = settled(best.select(F.col(query).alias("_q"), F.col("_b.i").alias("_i"), F.col("_b.t").alias("_t")))
        chosen = best.select(F.col("_q").alias(query), F.col("_i").alias(item), F.lit(rank).alias("rank"))
        found = chosen if found is None else found.union(chosen)
        every = F.size(F.array_union("tokens", "_t"))
        like = F.when(every > 0, F.size(F.array_intersect("tokens", "_t")) / every).otherwise(0.0)
        if rank + 1 < most:
            left = settled(left.join(best, F.col(query) == F.col("_q")).where(F.col(item) != F.col("_i")).withColumn("_near", F.greatest("_near", like)).drop("_q", "_i", "_t"))
    return found


def row_packs(rows: DataFrame, table: str, order: str, group: str, text: str, budget: int) -> DataFrame:
    """(table, pack, rows, content): rows of a table packed in order to at most `budget` characters each; a new group begins a pack.

    A row goes into the pack by how many characters of its group stand before it, so a pack may be short of the budget by a row;
    a longer row has a pack of its own.
    """
    by = W.partitionBy(table).orderBy(order)
    marked = rows.withColumn("_new", (~F.coalesce(F.lag(group).over(by).eqNullSafe(F.col(group)), F.lit(False))).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    ends = F.sum(F.length(text) + 1).over(W.partitionBy(table, "_run").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    parts = runs.withColumn("_part", F.floor((ends - 1) / budget))
    packs = parts.groupBy(table, "_run", "_part").agg(F.count("*").alias("rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("content"))
    return packs.select(table, (F.row_number().over(W.partitionBy(table).orderBy("_run", "_part")) - 1).alias("pack"), "rows", "content")


def key_columns(rows: DataFrame, columns: list[str], least: float = 0.8) -> DataFrame:
    """(column_name, ratio, is_key): different values over rows of each column; from `least` on it may be a key."""
    counts = rows.agg(F.count("*").alias("_n"), *[F.count_distinct(c).alias(c) for c in columns])
    told = [F.struct(F.lit(c).alias("column_name"), F.round(F.col(c) / F.when(F.col("_n") > 0, F.col("_n")), 6).alias("ratio")) for c in columns]
    return counts.select(F.explode(F.array(*told)).alias("x")).select("x.*").withColumn("is_key", F.col("ratio") >= least)


def group_columns(rows: DataFrame, order: list[str], columns: list[str], by: str) -> DataFrame:
    """(by, column_name, changes): of each table, columns whose value changes from row to row in at most half of its rows, with two values at least.

    The rows of a table are dealt out in ranges of their order, so a table of any size is spread over tasks: changes are counted
    inside of ranges, and the last row of each range is compared with the first of the next. Rows that tie in order have no order.
    """
    ranged = settled(rows.select(by, *order, *[c for c in columns if c not in order]).repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part", by).orderBy(*order)
    flags = [((F.row_number().over(inside) > 1) & ~F.lag(c).over(inside).eqNullSafe(F.col(c))).cast("int").alias(f"_c{i}") for i, c in enumerate(columns)]
    here = ranged.select(by, *flags).groupBy(by).agg(F.count("*").alias("_n"), *[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(columns))])
    row, at = F.struct(*[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)]), F.struct(*order)
    ends = ranged.groupBy(by, "_part").agg(F.min_by(row, at).alias("_first"), F.max_by(row, at).alias("_last"))  # a row for each table and range
    before = F.lag("_last").over(W.partitionBy(by).orderBy("_part"))
    borders = ends.select(by, before.isNotNull().alias("_b"), before.alias("_l"), "_first").where("_b")
    borders = borders.groupBy(by).agg(*[F.count_if(~F.col(f"_l._v{i}").eqNullSafe(F.col(f"_first._v{i}"))).alias(f"_b{i}") for i in range(len(columns))])
    told = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]
    values = ranged.select(by, F.explode(F.array(*told)).alias("x")).select(by, "x.*").where("v is not null").distinct().groupBy(by, "column_name").agg(F.count("*").alias("_d"))
    sums = here.join(borders, by, "left")
    changes = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col(f"_c{i}") + F.coalesce(F.col(f"_b{i}"), F.lit(0))).alias("changes")) for i, c in enumerate(columns)])
    found = sums.select(by, "_n", F.explode(changes).alias("x")).select(by, "_n", "x.*").join(values, [by, "column_name"])
    return found.where((F.col("changes") * 2 <= F.col("_n")) & (F.col("_d") >= 2)).select(by, "column_name", "changes")


def passage_tables(cells: DataFrame, key: str) -> DataFrame:
    """(src, relation, dst) of rows as objects: each cell of a row (table, row, column, value) tells a relation of the row's key to its value."""
    names = cells.where(F.col("column_name") == key).select("table_name", "row_no", F.col("value").alias("_name"))
    own = cells.join(names, ["table_name", "row_no"], "left").where(F.col("column_name") != key)
    name = F.coalesce("_name", F.substring(F.sha2(F.concat_ws("\x1f", "table_name", F.col("row_no").cast("string")), 256), 1, 16))
    return own.where("value is not null and value <> ''").select(name.alias("src"), F.col("column_name").alias("relation"), F.col("value").alias("dst")).distinct()
