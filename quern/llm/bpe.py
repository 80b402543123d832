"""Byte-level BPE by backtracking over longest matches.

A sequence of tokens is the result of the merges exactly if each two neighbours are compatible: merging the bytes of the two
alone gives the same two tokens again. Encoding therefore takes the longest token at each place, steps back to shorter ones
where neighbours are incompatible, and never visits a place twice that has led nowhere; compatibility is decided by the last merges
of both tokens and memoised, so the time is linear in the text. Bytes are looked up as Latin-1 text in a pyahocorasick trie.
Short pieces that are not remembered are merged by all together: rows of a matrix, in each of which one merge is made at a time.
"""

from __future__ import annotations

import base64
import sys
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.common import CACHES, slices

#: The characters of Unicode's White_Space, which the \s of the splitting pattern stands for.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = frozenset(x for x in map(chr, range(0x3001)) if x.isspace() and not "\x1c" <= x <= "\x1f")
#: Pieces and chunks of text, or pairs of tokens, that a worker remembers at most.
MEMO = 200_000
#: Widths in bytes of the matrices in which short pieces are merged, and rows of one; longer pieces are gone through one by one.
WIDTHS, ROWS = (8, 12, 16, 24, 40), 4096
#: Letters of the texts that are cut at once.
LETTERS = 1 << 20
#: Stands for "no merge".
NONE = np.int32(2**31 - 1)
#: An odd number that pairs are hashed with.
HASH = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Encodes pieces of text by ranks of tokens, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.fine = regex.compile(pattern.replace("\\s", f"[{WHITE}]").replace(f"[^[{WHITE}]", f"[^{WHITE}"))
        self.coarse = regex.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.longest = max(map(len, ranks))
        self.trie = ahocorasick.Automaton()
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.tokens))]  # what the last merge of a token joined
        self.joins: dict[int, int] = {}
        self.ordered = True  # each token has a higher rank than what it is made of
        for token, rank in ranks.items():
            parts = self.merge(token, rank)
            if len(parts) > 2:
                if self.merge(token) != [rank]:  # the merges never produce it
                    continue
                self.ordered = False
            self.trie.add_word(token.decode("latin-1"), rank)
            if len(parts) == 2:
                self.halves[rank] = (parts[0], parts[1])
                self.joins[parts[0] << 32 | parts[1]] = rank
        self.pairs, self.merged, self.bits = self.table()
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.lengths = list(map(len, self.tokens))
        self.fits: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.starts: dict[str, int] = {}
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes, below: int | None = None) -> list[int]:
        """The merges carried out one by one, lowest rank first, leftmost first, those below a rank alone if one is given; for short pieces."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                break
            rank, i = min(found)
            if below is not None and rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[x] for x in parts]

    def table(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """Pairs of tokens and what they merge into, in slots by a hash of the pair, the next free one if it is taken."""
        bits = max(4, (4 * len(self.joins)).bit_length())
        pairs, merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys, values, shift = np.fromiter(self.joins, np.int64, len(self.joins)), np.fromiter(self.joins.values(), np.int32, len(self.joins)), np.uint64(64 - bits)
        at = (keys.view(np.uint64) * HASH >> shift).view(np.int64)
        while len(keys):
            free = np.flatnonzero(pairs[at] < 0)
            pairs[at[free]] = keys[free]  # of several one stays
            merged[at[free]] = np.where(pairs[at[free]] == keys[free], values[free], merged[at[free]])
            left = pairs[at] != keys
            keys, values, at = keys[left], values[left], at[left] + 1 & (1 << bits) - 1
        return pairs, merged, shift

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair of neighbours merges into, or NONE."""
        keys = a.astype(np.int64) << 32 | b
        at = (keys.view(np.uint64) * HASH >> self.bits).view(np.int64)
        met = self.pairs.take(at)
        found = np.where(met == keys, self.merged.take(at), NONE)
        open_ = np.flatnonzero((met != keys) & (met >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & len(self.pairs) - 1
            met = self.pairs[at[open_]]
            same = met == keys[open_]
            found[open_[same]] = self.merged[at[open_[same]]]
            open_ = open_[~same & (met >= 0)]
        return found

    def together(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The packed ids of pieces of at most so many bytes: in each round every piece makes its merge of the lowest rank, the leftmost one."""
        n, line = len(pieces), width + 2
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        tokens = np.full((n, line), -1, np.int32)  # a place before and one after each piece stay empty, and merge with nothing
        inside = np.arange(width) < sizes[:, None]
        tokens[:, 1:-1][inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, line + 1), (n, 1)) + np.arange(n)[:, None] * line  # in the flat array, like before
        before, tokens, after = (after - 2).ravel(), tokens.ravel(), after.ravel()
        ranks = np.full((n, line), NONE, np.int32)
        pairs = np.flatnonzero(inside[:, 1:].ravel()).astype(np.int64)
        pairs = pairs // (width - 1) * line + pairs % (width - 1) + 1
        ranks.ravel()[pairs] = self.joined(tokens[pairs], tokens[pairs + 1])
        flat, live, own = ranks.ravel(), np.arange(n), ranks
        while True:
            best = own.argmin(axis=1)
            at = live * line + best
            made = flat[at]
            going = made != NONE
            if not going.all():
                live, at, made = live[going], at[going], made[going]
                if not len(live):
                    break
            gone = after[at]
            right, left = after[gone], before[at]
            tokens[at], tokens[gone] = made, -1
            flat[gone] = NONE
            after[at], before[right] = right, at
            flat[at], flat[left] = self.joined(made, tokens[right]), self.joined(tokens[left], made)
            own = ranks if len(live) == n else ranks[live]
        kept = tokens >= 0
        ends = np.cumsum(kept.reshape(n, line).sum(axis=1)) * 4
        packed, ends = tokens[kept].tobytes(), ends.tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both gives both again: no merge over the border comes before those that made what it joins.

        The later of the two merges next to the border is taken back, over and over; what stands there then must not have merged
        before that one.
        """
        if len(self.fits) > MEMO:
            self.fits.clear()
        key, joins, halves, limit = a << 32 | b, self.joins.get, self.halves, 1 << 40
        if not self.ordered:
            fits = self.fits[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
            return fits
        while (joined := joins(a << 32 | b)) is None or joined >= limit:
            left = halves[a][1] if a > b else a
            if left != a:  # of equal ranks the left one comes first
                limit, a = a, left
            elif (right := halves[b][0]) != b:
                limit, b = b + 1, right
            elif (left := halves[a][1]) != a:
                limit, a = a, left
            else:
                self.fits[key] = True
                return True
        self.fits[key] = False
        return False

    def first(self, text: str, at: int) -> int:
        """The longest token that starts here; ends of words recur, so those of short ones are remembered."""
        piece = text[at : at + self.longest]
        token = self.starts.get(piece)
        if token is None:
            n, token = self.trie.longest_prefix(piece), -1
            while n and token < 0:
                token = self.trie.get(piece[:n], -1)
                n -= 1
            if len(piece) < 9:
                if len(self.starts) > MEMO // 2:
                    self.starts.clear()
                self.starts[piece] = token
        return token

    def next(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if (found := self.shorter.get(token)) is None:
            text = self.tokens[token].decode("latin-1")
            found = next((self.trie.get(text[:n]) for n in range(len(text) - 1, 0, -1) if text[:n] in self.trie), -1)
            self.shorter[token] = found
        return found

    def backtrack(self, piece: bytes) -> list[int]:
        """The ids of one piece, as the merges would give them."""
        text, size, ids, at = piece.decode("latin-1"), len(piece), [], 0
        lengths, longest, starts, known, dead = self.lengths, self.longest, self.starts.get, self.fits.get, set()
        token = self.first(text, 0)
        while at < size:
            while token >= 0:
                end = at + lengths[token]
                if end not in dead:
                    if not ids:
                        break
                    fits = known(ids[-1] << 32 | token)
                    if fits or fits is None and self.compatible(ids[-1], token):
                        break
                token = self.next(token)
            if token >= 0:
                ids.append(token)
                at = end
                if at < size and (token := starts(text[at : at + longest])) is None:
                    token = self.first(text, at)
            elif ids:
                dead.add(at)
                last = ids.pop()
                at -= lengths[last]
                token = self.next(last)
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return ids

    def pieces(self, texts: set[str]) -> list[str]:
        """Remember the packed ids of pieces; returns those that are too long to be remembered for more than one batch."""
        known, ranks, short, long = self.known, self.ranks, [([], []) for _ in WIDTHS], []
        for text in texts:
            piece = text.encode()
            if (whole := ranks.get(piece)) is not None:
                known[text] = whole.to_bytes(4, sys.byteorder)
            elif len(piece) <= WIDTHS[-1] and self.ordered:
                names, own = short[bisect_left(WIDTHS, len(piece))]
                names.append(text)
                own.append(piece)
            else:
                known[text] = np.array(self.backtrack(piece), np.int32).tobytes()
                long.append(text)
        for width, (names, own) in zip(WIDTHS, short, strict=True):
            for i in range(0, len(own), ROWS):
                known.update(zip(names[i : i + ROWS], self.together(own[i : i + ROWS], width), strict=True))
        return long

    def chunks(self, text: str) -> list[str]:
        """Parts of a text at whose ends no piece continues."""
        if text[-1:] == " " or any(f" {x}" in text or f"{x} " in text for x in SPACES.intersection(text)):
            return self.coarse.findall(text)
        if "\0" in text:
            head, *rest = text.split(" ")
            return [head, *(" " + x for x in rest)]
        return text.replace(" ", "\0 ").split("\0")  # each space starts a chunk: no piece goes on over it

    def encode(self, text: str) -> np.ndarray:
        return self.encoded([text])[0]

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; those of short chunks and pieces are remembered for the next texts."""
        rows, known = list(map(self.chunks, texts)), self.known
        known[""] = b""
        new = set().union(*rows).difference(known)
        if len(known) + len(new) > MEMO:
            known.clear()
            known[""] = b""
            new = set().union(*rows).difference(known)
        pieces, several, findall = set(), [], self.fine.findall
        for x in new:
            if x.isascii() and x[x[0] == " " :].isalpha() or (found := findall(x)) == [x]:
                pieces.add(x)
            else:
                pieces.update(found)
                several.append((x, found))
        long = self.pieces(pieces.difference(known))
        get = known.__getitem__
        known.update([(x, b"".join(map(get, found))) for x, found in several])
        coded = [np.frombuffer(b"".join(map(get, row)), np.int32) for row in rows]
        for x in chain(long, [x for x, _ in several if len(x) > WIDTHS[-1]]):
            known.pop(x, None)
        return coded

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; texts of about LETTERS together are cut at once, a longer one alone."""
        coded, part, size = [], [], 0
        for text in texts:
            if part and size + len(text) > LETTERS:
                coded += self.encoded(part)
                part, size = [], 0
            part.append(text)
            size += len(text)
        return coded + self.encoded(part) if part else coded

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    CACHES["bpe"] = vocabulary.cache_clear
    return Vocabulary(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the token ids of each text in the column `ids` and, if `decoded` names one, their bytes decoded again.

    Null texts count as empty and have no ids. Columns of docs with these names are replaced; all others stay.
    path must be readable on every executor; each worker loads the vocabulary once. Texts of any length are encoded whole, in memory
    of a few times the text's own size; repeated rows are all encoded. Empty table: no rows.
    """
    kept = docs.drop(*(x for x in (ids, decoded) if x and x != text))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name not in (ids, decoded)]
    schema = ", ".join([*fields, f"`{ids}` array<int>", *([f"`{decoded}` binary"] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in slices(batches, cache="bpe"):
            rows = words.encode_all([x or "" for x in batch.column(text).to_pylist()])
            offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            made = {ids: pa.ListArray.from_arrays(offsets, np.concatenate(rows))}
            if decoded:
                made[decoded] = pa.array([words.decode(x) for x in rows], pa.binary())
            own = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in made}
            yield pa.RecordBatch.from_pydict(own | made)

    return kept.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """tokens with the bytes that the ids of each row stand for; null and empty ids give empty bytes, whatever their number. Empty table: no rows."""
    kept = tokens.drop(decoded)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"`{decoded}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in slices(batches, cache="bpe"):
            made = pa.array([words.decode(np.array(x or [], np.int32)) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, decoded])

    return kept.mapInArrow(run, schema)
