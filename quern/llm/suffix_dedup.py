"""Removal of repeated byte strings by suffix arrays, built by linear grouping without recursive renaming.

The array of a text is built in two steps. Suffixes are first grouped by their Lyndon prefixes: groups are taken in descending
order, each member points to the nearest suffix before it that stands in a smaller group, and what is pointed to moves behind
its group, further the more members point there. Then groups' orders are given out from left to right: behind a suffix that is
placed, the suffixes whose Lyndon prefix ends where it starts take the next places of their groups.

A task gets many groups of surroundings of one anchor each (see repeats). All are written as letters of LETTER bytes, counted
from the anchor, so that equal windows fall into letters alike, and one suffix array sorts them all (over single bytes it would
be as many times longer, at some microseconds each). Where the common prefix of neighbours in the array falls below a window,
less the bytes before its first whole letter, classes of equal windows part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import extended, slices, utf8
from quern.llm.repeats import Rows, Units, byte_grams, byte_units, merged, spanned

GRAM = LETTER = 32


def kind(window: int) -> Units:
    return Units(window, GRAM, byte_units, byte_grams)


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """By suffix the start of its group, in ascending order of groups, and the nearest suffix before it in a smaller group."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, head, size, before = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for at, i in enumerate(order):
        if at and text[order[at - 1]] != text[i]:
            start = at
        place[i], head[i] = at, start
        size[start] += 1
    stop = n
    while stop > 0:
        start = head[order[stop - 1]]
        if stop - start == 1:
            i = order[start]
            j = i - 1
            while j >= 0 and head[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                h = head[j]
                left = size[h] - 1
                if left:
                    last, at = h + left, place[j]
                    other = order[last]
                    order[at], order[last] = other, j
                    place[other], place[j] = at, last
                    size[h], size[last], head[j] = left, 1, last
            stop = start
            continue
        pointed: dict[int, int] = {}
        for i in sorted(order[start:stop]):
            j = i - 1
            while j >= 0 and head[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, c in pointed.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            moved, gone = by_count[c], {}
            for j in moved:
                h = head[j]
                left = size[h] - 1
                last, at = h + left, place[j]
                other = order[last]
                order[at], order[last] = other, j
                place[other], place[j] = at, last
                size[h] = left
                gone[h] = gone.get(h, 0) + 1
            for j in moved:
                head[j] += size[head[j]]
            for h, m in gone.items():
                size[h + size[h]] = m
        stop = start
    return head, before


def suffix_array(text: list[int]) -> np.ndarray:
    """The starts of all suffixes in ascending order; a suffix that is the start of another comes before it."""
    n = len(text)
    head, before = lyndon_groups(text)
    free, found, placed = list(range(n)), [-1] * n, [False] * n

    def follow(j: int) -> None:
        while j >= 0 and not placed[j]:
            at = free[head[j]]
            free[head[j]] = at + 1
            found[at], placed[j] = j, True
            j = before[j]

    follow(n - 1)  # the empty suffix stands before all
    for at in range(n):
        follow(found[at] - 1)
    return np.array(found, np.int64)


def letters(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows as letters: their bytes, the row of each, and where in its row it starts.

    Letters are counted from the anchor, so the first may start before its row; it and the last are filled up with zeros.
    """
    lengths = np.array(list(map(len, rows.text)))
    lead = -np.array(rows.offset) % LETTER
    counts = -(-(lead + lengths) // LETTER)
    data = b"".join(bytes(a) + t + bytes(-(a + len(t)) % LETTER) for a, t in zip(lead.tolist(), rows.text, strict=True))
    row = np.repeat(np.arange(len(lengths)), counts)
    byte = (np.arange(len(row)) - (np.cumsum(counts) - counts)[row]) * LETTER - lead[row]
    return np.frombuffer(data, np.uint8).reshape(-1, LETTER), row, byte


def ordered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each row of bytes among the different ones, and the different ones in order."""
    kinds, rank = np.unique(np.ascontiguousarray(data).view(f"S{data.shape[1]}").ravel(), return_inverse=True)
    return rank, np.frombuffer(kinds.tobytes(), np.uint8).reshape(-1, data.shape[1])


def shared_front(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logical_and.accumulate(a == b, axis=1).sum(axis=1)


def common_prefixes(letter: np.ndarray, kinds: np.ndarray, array: np.ndarray, enough: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the array, at least as far as `enough`."""
    n, shared = len(letter), np.zeros(len(array), np.int64)
    a, b, alive = array[1:], array[:-1], np.arange(len(array) - 1)
    for k in range(-(-enough // LETTER)):
        x, y = a[alive] + k, b[alive] + k
        inside = (x < n) & (y < n)
        alive, x, y = alive[inside], letter[x[inside]], letter[y[inside]]
        same = x == y
        shared[alive[same] + 1] += LETTER
        shared[alive[~same] + 1] += shared_front(kinds[x[~same]], kinds[y[~same]])
        alive = alive[same]
    return shared


def repeated(rows: Rows, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """The first byte and the end, in each row, of its windows that also start earlier.

    A window is what stands before its first whole letter and what starts with that letter. Windows are equal if the suffixes
    share enough bytes, which neighbours in the suffix array tell, and the letters before, read backwards, as many as the rest.
    """
    data, row, byte = letters(rows)
    letter, kinds = ordered(data)
    array = suffix_array(letter.tolist())
    shared = common_prefixes(letter, kinds, array, units.window)
    inverse = np.empty(len(array), np.int64)
    inverse[array] = np.arange(len(array))
    back, back_kinds = ordered(data[:, ::-1])
    back_shared = np.concatenate([[0], shared_front(back_kinds[1:], back_kinds[:-1])])
    before = np.concatenate([[0], back[:-1]])
    documents = {d: i for i, d in enumerate(sorted({o[:2] for o in rows.order}))}
    begin = np.array([documents[o[:2]] << 40 for o in rows.order]) + np.array([o[2] for o in rows.order]) - np.array(rows.offset)
    begin, lengths = begin[row], np.array(list(map(len, rows.text)))[row]
    low, high = np.full(len(rows.text), 1 << 40), np.zeros(len(rows.text), np.int64)
    for tail in range(LETTER):
        own = np.flatnonzero((byte >= tail) & (byte - tail + units.window <= lengths))
        if not len(own):
            continue
        right = np.cumsum(shared < units.window - tail)[inverse[own]]
        both = right * np.int64(len(back_kinds) + 1) + np.cumsum(back_shared < tail)[before[own]]
        place = begin[own] + byte[own] - tail  # of the window in all documents
        order = np.lexsort((place, both))
        new = np.concatenate([[True], np.diff(both[order]) != 0])
        first = place[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        hit = own[order[place[order] > first]]
        np.minimum.at(low, row[hit], byte[hit] - tail)
        np.maximum.at(high, row[hit], byte[hit] - tail + units.window)
    return np.where(high > 0, low, 0), high


def removed(docs: DataFrame, window: int = 100, as_text: bool = False) -> DataFrame:
    """docs with `kept`, the bytes that stay (or their text, without characters of which only a part is left), `n_bytes`, `n_removed` and `n_spans`; see repeats.spanned for odd rows.

    A byte goes if a string of so many bytes that covers it also starts earlier. Texts are taken as UTF-8; strings are judged on
    the input and never cross documents. n_spans counts the maximal runs of removed bytes.
    """
    found = spanned(docs.drop("kept", "n_bytes", "n_removed", "n_spans"), kind(window), repeated)
    names = [c for c in found.columns if c != "spans"]
    schema = extended(found, "n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary"), ("spans",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made: list[tuple[int, int, int, bytes]] = []
            for text, spans in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                kept, at, runs = [], 0, merged(spans)
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                made.append((len(text), len(text) - len(kept), len(runs), kept.decode("utf-8", "ignore") if as_text else kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return found.mapInArrow(run, schema)


def shortened(docs: DataFrame, window: int = 100) -> DataFrame:
    """docs, with all their columns whatever their names, texts without what stood earlier; documents of which nothing is left go.

    Where a removal cuts a character in two, the bytes of it that are left go too. n_chars, if there, tells the new length.
    Null texts become empty ones and stay; of rows that repeat the first keeps its text and the others go, if it is long enough.
    Texts of any length are read whole. Empty table: no rows.
    """
    whole = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    left = removed(whole, window, as_text=True).where((F.length("kept") > 0) | (F.col("n_removed") == 0))
    own = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return left.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
