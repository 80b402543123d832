"""Finding every stretch of text that already stood earlier, exactly, over all documents.

A document is a sequence of units (bytes or words); a window is so many units in a row. The anchor of a window is the gram in it
with the least hash (all of them, if several have it): it depends on the window alone, so equal windows have the same anchor at
the same place in them. Windows whose anchor is the anchor of others nowhere else have no equal. What is left is gathered by
anchor: each anchor with its surroundings, which are its windows laid over each other. Equal surroundings count once, and a
resolver tells which windows of the different ones have an earlier equal.

Anchors are counted by a shuffle of their hashes; which occur again comes back as a bitmap of fixed size, and a false hit costs
work but changes nothing. What repeats inside a task is settled there, so that of equal surroundings each task sends one row.
Anchors that occur more often than HOT take another way that needs no task to see all of them: their windows are compared one by
one by hashes of 128 bits, of which again each task sends one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from quern.llm.common import checkpoint, slices, utf8

#: Bits of a bitmap, and of a part of it that one task makes.
BITS, PART = 1 << 27, 1 << 16
#: Occurrences of an anchor beyond which its windows are compared one by one.
HOT = 20_000
#: Surroundings a task remembers to find equal ones in its own documents.
MEMO = 300_000
#: Texts of which anchors are found together.
SLICE = 64
TOP = (1 << 63) - 1


@dataclass(frozen=True)
class Sequence:
    """Units of one text: their number, what they are made of, and the bytes of a range."""

    n: int
    units: bytes | list[bytes]
    part: Callable[[int, int], bytes]


@dataclass(frozen=True)
class Units:
    """How texts are cut into units, and hashes of all grams of texts in a row."""

    window: int
    gram: int  # for bytes a multiple of eight
    cut: Callable[[bytes], Sequence]
    grams: Callable[[list[Sequence], int], np.ndarray]

    @property
    def reach(self) -> int:
        return self.window - self.gram


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def summed(hashes: np.ndarray, size: int, step: int) -> np.ndarray:
    """A hash of each `size` // `step` hashes that stand `step` apart."""
    n, factor = len(hashes) - size + step, 0x9E3779B97F4A7C15
    h = hashes[:n] * np.uint64(factor)
    for at in range(step, size, step):
        factor = factor * 0xA0761D6478BD642F % 2**64
        h += hashes[at : at + n] * np.uint64(factor)
    return mixed(h)


def byte_units(text: bytes) -> Sequence:
    return Sequence(len(text), text, lambda a, b: text[a:b])


def byte_grams(texts: list[Sequence], size: int) -> np.ndarray:
    data = b"".join(t.units for t in texts)
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # eight bytes as one number, at each place
    return summed(mixed(eights.copy()), size, 8)


def word_units(text: bytes) -> Sequence:
    words = text.split()
    return Sequence(len(words), words, lambda a, b: b" ".join(words[a:b]))


def word_grams(texts: list[Sequence], size: int) -> np.ndarray:
    return summed(np.fromiter(map(xxh64_intdigest, chain.from_iterable(t.units for t in texts)), np.uint64), size, 1)


def least(h: np.ndarray, w: int) -> np.ndarray:
    """The least value of each w in a row."""
    n, size = len(h) - w + 1, 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[w - size : w - size + n])


def anchors(texts: list[Sequence], kind: Units) -> tuple[np.ndarray, ...]:
    """All anchors: number of the text, place, hash, and the first and last of the windows, told by where they start, it is for."""
    ends = np.cumsum([t.n for t in texts])
    if not len(ends) or max(t.n for t in texts) < kind.window:
        return (np.zeros(0, np.int64),) * 5
    whole, w = kind.grams(texts, kind.gram), kind.reach + 1
    h = np.maximum((whole >> np.uint64(32)).astype(np.uint32), 1)  # by which the least is found
    v, edge = least(h, w), np.zeros(w - 1, np.uint32)
    for end in ends[:-1].tolist():  # windows over the end of a text are none
        v[max(end - kind.window + 1, 0) : end] = 0
    p = np.flatnonzero(h == ~least(~np.concatenate([edge, v, edge]), w))
    doc = np.searchsorted(ends, p, side="right")
    begin = (ends - [t.n for t in texts])[doc]
    starts = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])  # of runs of windows with the same least hash
    stops = np.append(starts[1:], len(v)) - 1
    low = np.maximum(p - kind.reach, begin)
    run, open_ = np.searchsorted(starts, low, side="right") - 1, np.arange(len(p))
    while len(open_ := open_[v[starts[run[open_]]] != h[p[open_]]]):
        run[open_] += 1
    return doc, p - begin, whole[p].view(np.int64), np.maximum(starts[run], low) - begin, np.minimum(stops[run], p) - begin


def slot(h: np.ndarray) -> np.ndarray:
    return h & (BITS - 1)


class Bitmap:
    """Which anchors belong to a set; some others may seem to."""

    def __init__(self, parts: list[tuple[int, bytes]]) -> None:
        self.words = np.zeros(BITS // 8, np.uint8)
        for part, data in parts:
            self.words[part * PART // 8 : (part + 1) * PART // 8] = np.frombuffer(data, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = slot(h)
        return (self.words[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(marks: DataFrame) -> Bitmap:
    """The bitmap (16 MB) of the anchors in column h, made in parts by Spark."""

    def run(table: pa.Table) -> pa.Table:
        bits = np.zeros(PART, np.uint8)
        bits[table["at"].to_numpy()] = 1
        return pa.table({"part": table["part"][:1], "data": [np.packbits(bits, bitorder="little").tobytes()]})

    where = F.col("h").bitwiseAND(F.lit(BITS - 1))
    slots = marks.select(F.shiftright(where, PART.bit_length() - 1).cast("int").alias("part"), where.bitwiseAND(F.lit(PART - 1)).cast("int").alias("at")).distinct()
    return Bitmap([(r.part, r.data) for r in slots.groupBy("part").applyInArrow(run, "part int, data binary").collect()])


@dataclass
class Rows:
    """Surroundings of anchors, different ones only, grouped by anchor and in order of place: what a resolver works on."""

    group: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)  # of the anchor in the surroundings
    text: list[bytes] = field(default_factory=list)
    order: list[tuple] = field(default_factory=list)  # key, mark, unit where the anchor starts


#: Gets rows and the kind of units; gives by row the first unit and the end of what had an earlier equal, both 0 if nothing.
Resolver = Callable[[Rows, Units], tuple[np.ndarray, np.ndarray]]
SPANS = "key long, mark long, start long, stop long"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key and mark, which tell rows apart and order them: by doc_id, null last, then by a hash of the text."""
    return docs.withColumns({"key": F.coalesce(F.col("doc_id").cast("long"), F.lit(TOP)), "mark": F.xxhash64("text")})


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def spans(texts: DataFrame, kind: Units, resolve: Resolver, bucket: int = 1 << 20) -> DataFrame:
    """(key, mark, start, stop): stretches of texts (key, mark, text) covered by windows with an earlier equal; they may overlap."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in slices(batches, SLICE):
            held.append(anchors(list(map(kind.cut, utf8(batch.column(0)))), kind)[2])
            size += len(held[-1])
            if size > 2_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    distinct = texts.select("key", "mark", "text")
    counted = distinct.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    counted = checkpoint(counted)
    shared = texts.sparkSession.sparkContext.broadcast((bitmap(counted.select("h")), bitmap(counted.where(F.col("n") > HOT).select("h"))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, hot = shared.value
        seen: dict[tuple, tuple] = {}

        def first_here(what: tuple, place: tuple) -> bool | None:
            """Whether this is the first of its kind that the task meets; None if it is the same place again."""
            known = seen.get(what)
            if known is None or place < known:
                seen[what] = place
                return True
            return None if place == known else False

        for batch in slices(batches, SLICE):
            rows: list[tuple] = []
            keys, marks = batch.column("key").to_pylist(), batch.column("mark").to_pylist()
            texts = list(map(kind.cut, utf8(batch.column("text"))))
            found = anchors(texts, kind)
            doc, places, h, first, last = (x[again.has(found[2])] for x in found)
            own: list[list[tuple[int, int]]] = [[] for _ in texts]
            for d, p, x, a, b, is_hot in zip(*(c.tolist() for c in (doc, places, h, first, last + kind.window, hot.has(h))), strict=True):
                part, key, mark = texts[d].part(a, b), keys[d], marks[d]
                c = xxh64_intdigest(part, p - a)
                if not (new := first_here((x, c), (key, mark, a))):
                    own[d] += [(a, b)] if new is False else []
                elif not is_hot:
                    rows.append((x, c - (c >> 63 << 64), p - a, key, mark, a, b, part))
                else:
                    for s in range(a, b - kind.window + 1):
                        w = xxh3_128_digest(texts[d].part(s, s + kind.window))
                        if not (new := first_here((w,), (key, mark, s))):
                            own[d] += [(s, s + kind.window)] if new is False else []
                        else:
                            rows.append((int.from_bytes(w[:8], signed=True), int.from_bytes(w[8:], signed=True), WINDOW, key, mark, s, s + kind.window, b""))
            for key, mark, spans_ in zip(keys, marks, own, strict=True):
                rows += [(key, 0, SPAN, key, mark, a, b, b"") for a, b in _merged(spans_)]
            if len(seen) > MEMO:
                seen.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FOUND.types, strict=True)], FOUND.names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last, h, members, groups = Rows(), None, None, [], 0

        def out() -> pa.RecordBatch:
            start, stop = resolve(rows, kind) if rows.text else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            hit = np.flatnonzero(stop > start)
            own = [(*rows.order[i][:2], rows.order[i][2] - rows.offset[i] + int(start[i]), rows.order[i][2] - rows.offset[i] + int(stop[i])) for i in hit.tolist()]
            made = list(zip(*(own + members), strict=True)) or [[]] * 4
            rows.group.clear(), rows.offset.clear(), rows.text.clear(), rows.order.clear(), members.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], ["key", "mark", "start", "stop"])

        def drop_single() -> None:
            """Nothing is equal to a window of an anchor whose surroundings are all alike, other than what members tell."""
            if rows.group and (len(rows.group) == 1 or rows.group[-2] != rows.group[-1]):
                rows.group.pop(), rows.offset.pop(), rows.text.pop(), rows.order.pop()

        size = 0
        for batch in batches:
            for x, c, at, key, mark, a, b, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if at == SPAN:
                    members.append((key, mark, a, b))
                    continue
                if x != h:
                    drop_single()
                    if size > bucket or len(members) > 50_000:
                        yield out()
                        size = 0
                    h, groups, last = x, groups + 1, None
                if last is not None and last[0] == (c, at):
                    if last[1] != (key, mark, a):
                        members.append((key, mark, a, b))
                    continue
                last = ((c, at), (key, mark, a))
                if at != WINDOW:
                    rows.group.append(groups), rows.offset.append(at), rows.text.append(text), rows.order.append((key, mark, a + at))
                    size += len(text)
        drop_single()
        yield out()

    by_anchor = distinct.mapInArrow(gather, FOUND_DDL).repartition("h").sortWithinPartitions("h", "c", "at", "key", "mark", "start")
    return by_anchor.mapInArrow(settle, SPANS)


#: In place of an anchor's offset: a single window, known by two hashes, or a span that is settled already.
WINDOW, SPAN = -1, -2
FOUND_DDL = "h long, c long, at int, key long, mark long, start long, stop long, text binary"
FOUND = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("at", pa.int32()), ("key", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("text", pa.binary())])


def spanned(docs: DataFrame, kind: Units, resolve: Resolver) -> DataFrame:
    """docs with `spans`, an array of (start, stop) in order of start, or null: what of each text stood earlier; they may overlap.

    docs has doc_id and text. Earlier is a smaller doc_id, null counting as greatest, or the same document before. Of rows that
    share a doc_id, those with equal texts are one document and get the same spans, others are ordered by a hash. Null texts
    count as empty and have no spans. Columns named spans, key and mark are dropped. Empty table: no rows.
    """
    rows = keyed(docs.drop("spans").withColumn("text", F.coalesce("text", F.lit(""))))
    found = spans(rows.select("key", "mark", "text"), kind, resolve)
    lists = found.groupBy("key", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return rows.join(lists, ["key", "mark"], "left").drop("key", "mark")


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, as few as cover the same."""
    return _merged([(x["start"], x["stop"]) for x in found or []])


def ranks(rows: Rows) -> np.ndarray:
    """Each row's number in the order of places."""
    order = sorted(range(len(rows.order)), key=rows.order.__getitem__)
    found = np.empty(len(order), np.int64)
    found[order] = np.arange(len(order))
    return found
