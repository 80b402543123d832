"""Periodic runs of words by divide and conquer.

At each midpoint of a stretch, Z-functions of its halves tell for every period how far the words on both sides of the midpoint
repeat (Main and Lorentz); what spans two periods is a repetition, whose interval is extended as far as it goes. An interval that
several periods give keeps the smallest. Words are numbers by then, and stretches that cannot hold a run never get there: each
word of a run of two periods and LEAST words lies in a gram of GRAM words that occurs again in the same stretch, so stretches are
cut at all other words, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import extended, slices, utf8

#: Words of the shortest run; the two occurrences of half of it share so many words.
LEAST = 12
GRAM = LEAST // 2
#: Odd number by which grams are hashed; equal hashes of different grams keep a stretch too many and lose none.
FACTOR = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, length, period


def z_function(s: list[int]) -> np.ndarray:
    """How many words from each place on equal those from the start on; at the start itself 0."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return np.array(z, np.int64)


def crossing(s: list[int], low: int, mid: int, high: int) -> Iterator[Run]:
    """Runs inside [low, high) that hold the words before and after mid; each interval with its smallest period."""
    left, right = s[low:mid], s[mid:high]
    a, b = len(left), len(right)
    ahead = z_function([*right, -1, *left, *right])
    back = z_function([*left[::-1], -1, *right[::-1], *left[::-1]])
    p = np.arange(1, b + 1)  # words are compared with those p further on, around mid
    forth, behind = np.append(ahead[1:b], 0), back[a + 1 + b - p]
    q = np.arange(1, a + 1)  # and around mid - q
    forth_q, behind_q = ahead[b + 1 + a - q], np.append(back[1:a], 0)
    period = np.concatenate([p, q])
    start, end = np.concatenate([mid - behind, mid - q - behind_q]), np.concatenate([mid + forth + p, mid + forth_q])
    good = np.flatnonzero((end - start >= np.maximum(LEAST, 2 * period)) & (start < mid) & (end > mid))
    found: dict[tuple[int, int], int] = {}
    for x, y, k in zip(start[good].tolist(), end[good].tolist(), period[good].tolist(), strict=True):
        found[x, y] = min(k, found.get((x, y), k))
    for (x, y), k in found.items():
        if (x > 0 and s[x - 1] == s[x - 1 + k]) or (y < len(s) and s[y] == s[y - k]):
            continue  # it goes on beyond this stretch and is found whole where that was cut
        yield x, y - x, k


def runs(s: list[int]) -> list[Run]:
    """All runs of a sequence, by start, then period."""
    found, open_ = [], [(0, len(s))]
    while open_:
        low, high = open_.pop()
        if high - low < LEAST:
            continue
        mid = (low + high) // 2
        found.extend(crossing(s, low, mid, high))
        open_ += [(low, mid), (mid, high)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that can hold runs; cuts are the ends of the texts that words are strung together from."""
    starts, ends = np.append(0, cuts[:-1]), cuts
    while True:
        long = ends - starts >= LEAST
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return starts, ends
        size = ends - starts - GRAM + 1
        of = np.repeat(np.arange(len(size)), size)
        at = np.arange(size.sum()) + np.repeat(starts - np.append(0, np.cumsum(size)[:-1]), size)
        hashes = of.astype(np.uint64)
        for k in range(GRAM):
            hashes = (hashes ^ (hashes >> np.uint64(31)) ^ words[at + k].astype(np.uint64)) * FACTOR
        order = np.argsort(hashes, kind="stable")
        same = np.diff(hashes[order]) == 0
        again = np.zeros(len(at), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        edge = np.zeros(len(words) + 1, np.int32)  # each gram that occurs again covers its words
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + GRAM, -1)
        covered = np.append(np.cumsum(edge[:-1]) > 0, False)
        inside = np.zeros(len(words) + 1, bool)
        inside[starts] = True  # stretches that touch stay apart
        change = np.flatnonzero(covered[:-1] & (np.append(False, ~covered[:-2]) | inside[:-1]))
        last = np.flatnonzero(covered[:-1] & (~covered[1:] | inside[1:])) + 1
        if np.array_equal(change, starts) and np.array_equal(last, ends):
            return starts, ends
        starts, ends = change, last


def of_texts(rows: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, given by its words."""
    known: dict[bytes, int] = {}
    number = lambda w: known.setdefault(w, len(known))
    cuts = np.cumsum([len(r) for r in rows])
    words = np.fromiter(map(number, chain.from_iterable(rows)), np.int64, int(cuts[-1]) if len(cuts) else 0)
    found: list[list[Run]] = [[] for _ in rows]
    for low, high in zip(*(x.tolist() for x in stretches(words, cuts)), strict=True):
        text = int(np.searchsorted(cuts, low, side="right"))
        first = int(cuts[text - 1]) if text else 0
        found[text] += [(low - first + start, length, period) for start, length, period in runs(words[low:high].tolist())]
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def kept(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    stays = np.cumsum(edge[:-1]) == 0
    return [w for w, s in zip(words, stays.tolist(), strict=True) if s]


def detected(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `runs`, an array of (start, length, period) by start, then period, and `collapsed`, the text without repetitions.

    A run is a stretch of words (between ASCII white space) with smallest period q and at least max(12, 2 q) words that neither
    neighbour extends. In `collapsed` each run keeps its first q words unless another run drops them; the words left are joined
    by one space. Null and empty texts have no runs and an empty `collapsed`; every row is looked at for itself, repeated ones
    too; a text of any length is taken whole, in memory of the text's own size. Columns of docs of these two names are replaced.
    Empty table: no rows.
    """
    rest = docs.drop("runs", "collapsed")
    schema = extended(rest, "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows = [x.split() for x in utf8(batch.column(text))]
            found = of_texts(rows)
            flat = np.array(list(chain.from_iterable(found)), np.int64).reshape(-1, 3)
            offsets = pa.array(np.append(0, np.cumsum([len(f) for f in found])), pa.int32())
            made = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type)))
            left = pa.array([b" ".join(kept(w, f)) for w, f in zip(rows, found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made, left], [*batch.schema.names, "runs", "collapsed"])

    return rest.mapInArrow(run, schema)
