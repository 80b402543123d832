"""Wanted texts matched with the values or terms of a table: by case, initials, beginning or edit similarity, and terms replaced inside of texts."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from quern.operators.rounds import settled

#: Words that initials leave out.
SMALL_WORDS = ("of", "the", "and", "for", "de", "la", "van", "von", "der")
#: Terms of a dictionary that tasks hold at once; texts pass by the dictionary in parts of so many.
PART = 50_000
#: ASCII terms of fewer letters must stand alone.
ALONE = 3


def initials(text: Column) -> Column:
    """First letters of the words of ASCII letters and digits but for small ones, in upper case."""
    words = F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: (w != "") & ~F.lower(w).isin(*SMALL_WORDS))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def _grams(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, n, g): each pair of neighbouring letters with its turn among equal ones, so that repeated pairs are told apart."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.substring(F.col(text), i, F.lit(2)))
    placed = F.transform(pairs, lambda x, i: F.concat(x, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda y: y == x)).cast("string")))
    return rows.where(n >= 2).select(key, text, n.alias("n"), placed.alias("grams"))


def edit_candidates(wanted: DataFrame, values: DataFrame, least: float) -> DataFrame:
    """(wanted, _w, value, _v) of all pairs whose edit similarity 2M/(a+b) can reach `least` (0.8 or more); none is lost.

    wanted has (wanted, _w), values (value, _v), texts of two letters at least. With M letters in common, in order, two texts of
    a and b letters share at least 3M - a - b - 1 pairs of neighbours. Of g pairs of a text of n letters therefore the first
    g - t + 1 in any common order, t = max(1, n (3 least / 2 - 1) 2 / (2 - least) - 1), hold one that both have; rare ones go
    first in that order, and lengths that are too different never meet.
    """
    if least < 0.8:
        raise ValueError("candidates are complete from a similarity of 0.8 on")
    share = (1.5 * least - 1) * (1 + least / (2 - least))  # of pairs to letters, for the shortest partner
    known, asked = _grams(values, "value", "_v"), _grams(wanted, "wanted", "_w")
    often = known.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("often"))

    def prefixes(rows: DataFrame, key: str, text: str) -> DataFrame:
        flat = rows.select(key, text, "n", F.explode("grams").alias("g")).join(often, "g", "left")
        ordered = flat.groupBy(key, text, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("o"), "g"))).alias("x"))  # a value's own letters
        needed = F.greatest(F.lit(1), F.ceil(F.col("n") * share - 1 - 1e-9)).cast("int")
        return ordered.select(key, text, "n", F.explode(F.slice("x", F.lit(1), F.greatest(F.lit(1), F.size("x") - needed + 1))).alias("x")).select(key, text, "n", F.col("x.g").alias("g"))

    band = lambda n: F.floor(F.log(n) / math.log((2 - least) / least) + 1e-9).cast("int")  # noqa: E731  lengths that may meet are in the same or neighbouring bands
    left = prefixes(asked, "wanted", "_w").withColumn("band", F.explode(F.array(*[band(F.col("n")) + k for k in (-1, 0, 1)]))).withColumnRenamed("n", "_a")
    right = prefixes(known, "value", "_v").withColumn("band", band(F.col("n"))).withColumnRenamed("n", "_b")
    met = left.join(right, ["g", "band"])
    met = met.where(2 * F.least("_a", "_b") >= least * (F.col("_a") + F.col("_b")) - 1e-9).select("wanted", "_w", "value", "_v").distinct()
    return met.where(F.levenshtein("_w", "_v") <= (1 - least) * (F.length("_w") + F.length("_v")) + 1e-9)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in common blocks, longest first, over all letters."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy(values: DataFrame, wanted: DataFrame, least: float = 0.85, margin: float = 0.05, shortest: int = 4) -> DataFrame:
    """(wanted, value): the one value most similar to a wanted text, at `least` or more and `margin` ahead of any other value.

    values has a column value, wanted a column wanted; both in trimmed form, compared in lower case. A value that equals the wanted
    text letter by letter is passed over. Texts shorter than `shortest` match nothing, but short values count as rivals. Two values
    that differ in case alone are rivals too. Repeated rows count once; null texts match nothing.
    """
    known = values.select(F.trim("value").alias("value")).where("value <> ''").distinct().select("value", F.lower("value").alias("_v"))
    asked = wanted.select("wanted", F.trim("wanted").alias("_t")).where(F.length("_t") >= shortest).distinct().select("wanted", "_t", F.lower("_t").alias("_w"))
    met = edit_candidates(asked.select(F.struct("wanted", "_t").alias("wanted"), "_w"), known, max(0.8, least - margin))
    rated = met.where(F.col("wanted._t") != F.col("value")).withColumn("ratio", ratio("_w", "_v")).where(F.col("ratio") >= least - margin)
    best = rated.groupBy("wanted.wanted").agg(F.slice(F.sort_array(F.collect_list(F.struct("ratio", "value")), asc=False), 1, 2).alias("b"))  # partners so similar are few
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    clear = second.isNull() | (first["ratio"] - second["ratio"] >= margin)
    return best.where((first["ratio"] >= least) & (F.length(first["value"]) >= shortest) & clear).select("wanted", first["value"].alias("value"))


def grounded(values: DataFrame, wanted: DataFrame, most_extra: int = 3, least: float = 0.85, margin: float = 0.05) -> DataFrame:
    """(wanted, value, how): what a wanted text stands for among values, by the first way that leaves exactly one.

    The ways are: equal but for case and outer white space; initials; the start of a value that is at most `most_extra` letters
    longer; edit similarity (fuzzy). The wanted text itself, should it be among the values, is no answer. Values and wanted texts
    are trimmed; repeated rows count once; nulls and blanks match nothing. Ties in a way leave it to the next.
    """
    known = settled(values.select(F.trim("value").alias("value")).where("value <> ''").distinct().withColumn("_v", F.lower("value")))
    asked = settled(wanted.select("wanted").where("trim(wanted) <> ''").distinct().withColumn("_t", F.trim("wanted")).withColumn("_w", F.lower("_t")))

    def alone(hits: DataFrame, how: str, place: int) -> DataFrame:
        apart = hits.where(F.col("_t") != F.col("value"))
        return apart.groupBy("wanted").agg(F.count("*").alias("_n"), F.min("value").alias("value")).where("_n = 1").select("wanted", "value", F.lit(how).alias("how"), F.lit(place).alias("_p"))

    found = alone(asked.join(known, F.col("_w") == F.col("_v")), "case", 0)
    short = known.withColumn("_i", initials(F.col("value"))).where("length(_i) > 1")
    found = found.union(alone(asked.join(short, F.upper(F.regexp_replace("_t", "[^A-Za-z0-9]", "")) == F.col("_i")), "initials", 1))
    cut = F.transform(F.sequence(F.lit(1), F.lit(most_extra)), lambda k: F.substring("_v", F.lit(1), F.greatest(F.lit(0), F.length("_v") - k)))
    starts = known.select("value", F.explode(cut).alias("_s")).where("_s <> ''").distinct()
    found = found.union(alone(asked.join(starts, F.col("_w") == F.col("_s")), "prefix", 2))
    near = fuzzy(known, asked, least, margin).select("wanted", "value", F.lit("fuzzy").alias("how"), F.lit(3).alias("_p"))
    return found.union(near).groupBy("wanted").agg(F.min_by(F.struct("value", "how"), "_p").alias("b")).select("wanted", "b.value", "b.how")


def lowered(text: str) -> str:
    """Lower case, letter by letter where the whole would change its length, so that places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans(text: str, term: str) -> list[tuple[int, int]]:
    """Where a term stands in a lowered text, without overlaps, from the left; short ASCII terms only between other characters than a-z, 0-9 and _."""
    found, at = [], text.find(term)
    bare = term.isascii() and len(term) < ALONE
    inner = lambda i: 0 <= i < len(text) and bool(re.match("[a-z0-9_]", text[i]))
    while at >= 0:
        if bare and (inner(at - 1) or inner(at + len(term))):
            at = text.find(term, at + 1)
            continue
        found.append((at, at + len(term)))
        at = text.find(term, at + len(term))
    return found


Claim = tuple[int, int, str, str, str]  # start, end, group, term, canonical


class Dictionary:
    """Finds the terms (group, term, lowered term, canonical) of a dictionary, and the replacements, which stay where a text has them."""

    def __init__(self, entries: list[tuple[str, str, str, str]]) -> None:
        self.owners: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        self.kept = {canonical.lower() for *_, canonical in entries}
        for group, term, low, canonical in entries:
            self.owners[low].append((group, term, canonical))
        self.found = ahocorasick.Automaton()
        for word in self.kept | self.owners.keys():
            self.found.add_word(word, word)
        if len(self.found):
            self.found.make_automaton()

    def claims(self, text: str | None) -> tuple[list[Claim], list[tuple[int, int]]]:
        """All places of terms in a text, and those of replacements."""
        if not text or not len(self.found):
            return [], []
        low, claims, kept = lowered(text), [], []
        for word in {word for _, word in self.found.iter(low)}:
            places = spans(low, word)
            if word in self.kept:
                kept += places
            claims += [(a, b, *own) for own in self.owners.get(word, ()) for a, b in places]
        return claims, kept


def settle(text: str | None, claims: list[Claim], kept: list[tuple[int, int]], limit: int) -> tuple[str | None, list[dict]]:
    """The text with the claims that hold, longest first, then by group and term, and what they were."""
    taken, groups, found = sorted(kept), set(), []
    for start, end, group, term, canonical in sorted(claims, key=lambda c: (c[0] - c[1], c[2], c[3], c[4], c[0])):
        if limit and group not in groups and len(groups) >= limit:
            continue
        at = bisect_left(taken, (start, end))
        if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
            continue
        insort(taken, (start, end))
        groups.add(group)
        found.append((start, end, term, canonical))
    parts, at, told = [], 0, {}
    for start, end, term, canonical in sorted(found):
        parts += [text[at:start], canonical]
        at = end
        told.setdefault((term.lower(), canonical.lower()), {"term": term, "canonical": canonical})
    return "".join([*parts, text[at:]]) if found else text, list(told.values())


def rewritten(texts: DataFrame, terms: DataFrame, text: str = "text", limit: int = 0, part: int = PART) -> DataFrame:
    """texts with `rewritten`, the text with terms replaced, and `matched`, an array of (term, canonical) by place, each once.

    terms has (group, term, canonical): several terms may stand for one replacement. Matching looks at no case. The longest term
    goes first, then the least by group and term; no match overlaps another one or a place where a replacement stands already.
    ASCII terms of one or two letters must stand alone. At most `limit` groups are replaced in a text (0: all). Terms that are
    blank or equal to their replacement, and replacements that are blank, are left out. A null or blank text stays as it is.
    A dictionary of at most `part` terms is sent to all tasks; of a larger one, texts pass by one part after the other, and the
    claims of all parts are settled where they meet by text.
    """
    shown, low = F.trim("term"), F.lower(F.trim("term"))
    known = terms.select(F.col("group").cast("string").alias("group"), shown.alias("term"), low.alias("low"), F.trim("canonical").alias("canonical"))
    known = known.where("term <> '' and canonical <> '' and low <> lower(canonical)").distinct()
    known = settled(known)
    parts, rest = max(1, -(-known.count() // part)), texts.drop("rewritten", "matched")
    schema = StructType([*rest.schema.fields, *StructType.fromDDL("rewritten string, matched array<struct<term: string, canonical: string>>").fields])
    columns, names = rest.columns, schema.names
    pair = pa.list_(pa.struct([("term", pa.string()), ("canonical", pa.string())]))

    def made(own: list, results: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*own, pa.array([r[0] for r in results], pa.string()), pa.array([r[1] for r in results], pair)], names)

    def entries(turn: int) -> list:
        rows = known.where(F.pmod(F.xxhash64("group", "low"), F.lit(parts)) == turn).orderBy("group", "term", "canonical").collect()  # about `part` rows
        return [(r.group, r.term, r.low, r.canonical) for r in rows]

    if parts == 1:
        shared = texts.sparkSession.sparkContext.broadcast(entries(0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dictionary = Dictionary(shared.value)
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    piece = batch.slice(i, 256)
                    yield made(piece.columns, [settle(x, *dictionary.claims(x), limit) for x in piece.column(text).to_pylist()])

        return rest.mapInArrow(run, schema)
    numbered_ = settled(rest.withColumn("_row", F.monotonically_increasing_id()))
    found = None
    for turn in range(parts):
        shared = texts.sparkSession.sparkContext.broadcast(entries(turn))

        def claim(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            dictionary = Dictionary(shared.value)
            for batch in batches:
                rows = []
                for row, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    claims, kept = dictionary.claims(x)
                    rows += [(row, *c) for c in claims] + [(row, a, b, None, None, None) for a, b in kept]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], ["_row", "start", "end", "group", "term", "canonical"])

        some = numbered_.select("_row", text).mapInArrow(claim, "_row long, start int, end int, group string, term string, canonical string")
        found = some if found is None else found.union(some)
    by_text = found.groupBy("_row").agg(F.collect_list(F.struct("start", "end", "group", "term", "canonical")).alias("_claims"))  # a text's own matches
    joined = numbered_.join(by_text, "_row", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = []
            for x, claims in zip(batch.column(text).to_pylist(), batch.column("_claims").to_pylist(), strict=True):
                own = [tuple(c.values()) for c in claims or [] if c["group"] is not None]
                results.append(settle(x, own, [(c["start"], c["end"]) for c in claims or [] if c["group"] is None], limit))
            yield made([batch.column(n) for n in columns], results)

    return joined.mapInArrow(finish, schema)
