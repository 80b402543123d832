"""Removal of repeated word sequences by seed and extend.

Documents meet on winnowed anchors of GRAM words; from an anchor that two of them share, the match is extended word by word both
ways, and maximal repeats of at least the window's length are removed where they stand later.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import extended, slices, utf8
from quern.llm.repeats import Rows, Units, merged, ranks, spanned, word_grams, word_units

GRAM = 8
#: Groups of more rows are not compared pair by pair but window by window.
PAIRS = 48


def kind(window: int) -> Units:
    return Units(window, GRAM, word_units, word_grams)


def aligned(rows: Rows, units: Units) -> np.ndarray:
    """Numbers of the words around the anchors, anchors in the same columns; outside of the surroundings no two are equal."""
    known: dict[bytes, int] = {}
    table = np.repeat(-1 - np.arange(len(rows.text), dtype=np.int32)[:, None], 2 * units.reach + units.gram, axis=1)
    for row, at, text in zip(table, rows.offset, rows.text, strict=True):
        words = text.split(b" ")
        row[units.reach - at : units.reach - at + len(words)] = [known.setdefault(w, len(known)) for w in words]
    return table


def matched(rows: Rows, units: Units, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """The first word and end, in each row, of its matches of a window's length with rows that stand earlier."""
    n, words, rank = len(rows.text), aligned(rows, units), ranks(rows)
    low, high = np.full(n, words.shape[1]), np.zeros(n, np.int64)
    _, start, size = np.unique(np.array(rows.group), return_index=True, return_counts=True)

    def match(a: np.ndarray, b: np.ndarray) -> None:
        later = np.where(rank[a] > rank[b], a, b)
        same = words[a] == words[b]
        left = np.logical_and.accumulate(same[:, : units.reach][:, ::-1], axis=1).sum(axis=1)
        right = np.logical_and.accumulate(same[:, units.reach :], axis=1).sum(axis=1)
        ok = (right >= units.gram) & (left + right >= units.window)
        np.minimum.at(low, later[ok], units.reach - left[ok])
        np.maximum.at(high, later[ok], units.reach + right[ok])

    few = size <= pairs
    for m in np.unique(size[few]):
        i, j = np.tril_indices(m, -1)
        first = start[few & (size == m)]
        for part in np.array_split(first, max(1, len(first) * len(i) // 50_000)):
            match((part[:, None] + i).ravel(), (part[:, None] + j).ravel())
    for a, m in zip(start[~few], size[~few], strict=True):
        group = words[a : a + m]
        for at in range(units.reach + 1):
            own = np.flatnonzero((group[:, at : at + units.window] >= 0).all(axis=1))
            if len(own) < 2:
                continue
            windows = np.ascontiguousarray(group[own, at : at + units.window]).view(f"V{4 * units.window}").ravel()
            _, which = np.unique(windows, return_inverse=True)
            first = np.full(which.max() + 1, n)
            np.minimum.at(first, which, rank[a + own])
            later = a + own[rank[a + own] > first[which]]
            np.minimum.at(low, later, at)
            np.maximum.at(high, later, at + units.window)
    shift = units.reach - np.array(rows.offset)
    hit = high > 0
    return np.where(hit, low - shift, 0), np.where(hit, high - shift, 0)


def removed(docs: DataFrame, window: int = 20, pairs: int = PAIRS) -> DataFrame:
    """docs with `kept`, the words that stay joined by one space, and `n_words`, `n_removed`; see repeats.spanned for odd rows.

    A word goes if a window of so many words that covers it also starts earlier. Words are parted by ASCII white space and
    compared as they are; windows are judged on the input and never cross documents.
    """
    found = spanned(docs.drop("kept", "n_words", "n_removed"), kind(window), partial(matched, pairs=pairs))
    names = [c for c in found.columns if c != "spans"]
    schema = extended(found, "n_words long, n_removed long, kept binary", ("spans",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made: list[tuple[int, int, bytes]] = []
            for text, spans in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words, kept, at = text.split(), [], 0
                for a, b in merged(spans):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                made.append((len(words), len(words) - len(kept), b" ".join(kept)))
            columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, "n_words", "n_removed", "kept"])

    return found.mapInArrow(run, schema)
