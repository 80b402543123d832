"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Every word has a class and a place in it, a slot: the most frequent words of a class have slots of their own, the others share
slots by their last bytes. The probability of a token is that of its class given the two tokens before it, times that of its slot
given the same and the class, times its share of the slot by the counts. Both of the first are softmaxes over sums of weights of
hashed features: the slot of the last token, a skip to the slot of the last but one, the last token itself, and the last two. Counts cover all training texts. The weights
are trained on every token of every training text by rounds of distributed updates: blocks of documents, dealt by hash, take gradient
steps from common weights, and their changes are averaged row by row, weighted by the squared gradients that each has met in the row.
The number of rows grows with the root of the number of training tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quern.llm.common import checkpoint, slices, utf8

#: Classes, slots of each, and how many of these are for single words; the last class holds the end of a text alone.
CLASSES, SLOTS, OWN = 32, 32, 16
END = (CLASSES - 1) * SLOTS
#: Bits of the number of hashed rows for classes, and as many for slots: least and most (64 MB for both).
LEAST_BITS, MOST_BITS = 12, 18
#: Words whose counts every task holds (16 bytes each); the counts of all others are joined by a shuffle.
HEAD = 250_000
#: Words a task remembers; tokens of one numpy block.
MEMO, BLOCK = 400_000, 4096
#: Documents that are learned from together; tokens of a block of documents at least, blocks that small corpora have at most, and changes averaged at once.
GROUP, LEAST_TOKENS, MANY, FAN = 64, 800_000, 12, 16
#: Gradients of a step that are added up by themselves if so many fall to one row of weights.
WIDE = 24
#: Odd numbers that features are multiplied with: four for classes, two for slots.
FACTORS = [np.uint64(2 * (0x9E3779B97F4A7C15 * k % 2**63) + 1) for k in (1, 2, 3, 5, 7, 11)]


def mark(word: bytes) -> int:
    """A word's identity: XXH64 as a signed integer."""
    h = xxh64_intdigest(word, 11)
    return h - (h >> 63 << 64)


def marked(words: list[bytes]) -> np.ndarray:
    """The marks of many words."""
    return np.fromiter(map(xxh64_intdigest, words, repeat(11)), np.uint64, len(words)).view(np.int64)


@lru_cache(maxsize=1 << 16)
def ending(last: bytes) -> int:
    return xxh64_intdigest(last[-2:], 5) % (CLASSES - 1) * (SLOTS - OWN) + xxh64_intdigest(last, 6) % (SLOTS - OWN)


def group(word: bytes) -> int:
    """Class and shared slot of a word, by its last bytes."""
    return ending(word[-4:])


def leaf(groups):
    """The class and slot, in one number, of words that have none of their own."""
    return groups // (SLOTS - OWN) * SLOTS + OWN + groups % (SLOTS - OWN)


def trains(fold: int = 7, held: int = 2):
    """Whether a document is learned from. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % fold != held


def count_words(docs: DataFrame) -> DataFrame:
    """(mark, cls, n) of each different word of the texts: its identity, its group by ending and its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(found)
            return pa.RecordBatch.from_arrays([pa.array(marked(words)), pa.array(np.fromiter(map(ending, [w[-4:] for w in words]), np.int32, len(words))), pa.array(list(found.values()), pa.int64())], ["mark", "cls", "n"])

        for batch in slices(batches, 64):
            for text in utf8(batch.column(0)):
                found.update(text.lower().split())
            if len(found) > MEMO:
                yield out()
                found.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "mark long, cls int, n long").groupBy("mark", "cls").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    tokens: int  # all training tokens, ends included
    kinds: int  # different ones
    ends: int
    marks: np.ndarray  # of the HEAD most frequent words, sorted
    logs: np.ndarray  # log10 of their counts and one
    singles: dict[int, int]  # mark to the slot of its own
    mass: np.ndarray  # by class and slot: sum of counts and ones, with one for all unknown words of a shared slot

    @property
    def bits(self) -> int:
        """Rows of weights for classes, as many for slots, as a power of two: up to sixteen times the root of the tokens."""
        return min(max(LEAST_BITS, int(math.log2(16 * math.sqrt(self.tokens + 1)))), MOST_BITS)

    def priors(self) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the shares of classes, and of slots in their class."""
        mass = self.mass.reshape(CLASSES, SLOTS)
        whole = mass.sum(axis=1, keepdims=True)
        return np.log(whole[:, 0] / whole.sum()).astype(np.float32), np.log(np.maximum(mass, 1e-9) / whole).astype(np.float32)


def summed(words: DataFrame, ends: int) -> Counts:
    """What all tasks need of the counts; its size is bounded by HEAD and the number of slots."""
    by_group = words.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    scale = F.floor(F.log2("n") * 8).cast("int")  # a few hundred steps at most
    steps_of = {r.scale: r["count"] for r in words.groupBy(scale.alias("scale")).count().collect()}
    least, room = max(steps_of, default=0) + 1, HEAD
    while least - 1 >= 0 and room - steps_of.get(least - 1, 0) >= 0:
        least -= 1
        room -= steps_of.get(least, 0)
    head = words.where(scale >= least).toPandas().sort_values(["n", "mark"], ascending=[False, True])[["mark", "cls", "n"]]
    mass = np.zeros(CLASSES * SLOTS)
    mass[leaf(np.arange((CLASSES - 1) * (SLOTS - OWN)))] = 1
    for r in by_group:
        mass[leaf(r.cls)] += r.n + r.kinds
    singles, filled = {}, Counter()
    for word, group_, n in head.groupby(head["cls"] // (SLOTS - OWN)).head(OWN).itertuples(index=False):
        cls = int(group_) // (SLOTS - OWN)
        singles[int(word)] = own = cls * SLOTS + filled[cls]
        filled[cls] += 1
        mass[leaf(int(group_))] -= n + 1
        mass[own] = n + 1
    mass[END] = ends + 1
    order = np.argsort(head["mark"].to_numpy(np.int64))
    marks, n = head["mark"].to_numpy(np.int64)[order], head["n"].to_numpy(np.int64)[order]
    return Counts(sum(r.n for r in by_group) + ends, sum(r.kinds for r in by_group) + (ends > 0), ends, marks, np.log10(n + 1.0), singles, mass)


class Lexicon(dict):
    """Word to a number of its own in this task; the arrays tell what is known of each number.

    A space, which no word is, stands before a text as number 0; a line end ends it as number 1.
    """

    def __init__(self, counts: Counts) -> None:
        self.counts = counts
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.update({b" ": 0, b"\n": 1})
        self.new: list[bytes] = []
        self.marks, self.leaves, self.logs = np.array([1, 2], np.int64), np.array([END, END], np.int64), np.array([0.0, np.log10(self.counts.ends + 1.0)])

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def settle(self) -> None:
        """Find what is known of the words met since the last time."""
        if not self.new:
            return
        marks, groups = marked(self.new), leaf(np.fromiter(map(ending, [w[-4:] for w in self.new]), np.int64, len(self.new)))
        leaves = np.fromiter(map(self.counts.singles.get, marks.tolist(), groups.tolist()), np.int64, len(marks))
        logs = np.full(len(marks), -1.0)  # not in the head
        if len(self.counts.marks):
            at = np.searchsorted(self.counts.marks, marks).clip(max=len(self.counts.marks) - 1)
            logs = np.where(self.counts.marks[at] == marks, self.counts.logs[at], -1.0)
        known, size = len(self) - len(self.new), len(self)
        if size > len(self.marks):  # with room for as many again
            self.marks, self.leaves, self.logs = (np.append(x[:known], np.zeros(size, x.dtype)) for x in (self.marks, self.leaves, self.logs))
        self.marks[known:size], self.leaves[known:size], self.logs[known:size] = marks, leaves, logs
        self.new = []

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens, each text after two zeros and with its end, and how many each text has."""
        rows = [[b" ", b" ", *text.lower().split(), b"\n"] for text in texts]
        tokens = self.numbers(list(chain.from_iterable(rows)))
        self.settle()
        return tokens, np.array(list(map(len, rows)))

    def trim(self) -> None:
        if len(self) > MEMO:
            self.clear()


def rows_of(words: Lexicon, now: np.ndarray, one: np.ndarray, two: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The rows of weights that count for the classes of tokens after these, and for their slots given the class."""
    a, b, size, shift = words.marks[one].view(np.uint64), words.marks[two].view(np.uint64), 1 << bits, np.uint64(64 - bits)
    slot_a, slot_b, cls = ((words.leaves[x] // y + 1).astype(np.uint64) for x, y in ((one, 1), (two, 1), (now, SLOTS)))
    both = (a ^ (a >> np.uint64(29))) * FACTORS[0] ^ b
    row = lambda x, k: (x * FACTORS[k] >> shift).astype(np.int64)
    inner = lambda x, k: size + row(x * np.uint64(CLASSES + 1) + cls, k)
    return [row(slot_a, 0), row(slot_b, 1), row(a, 2), row(both, 3)], [inner(slot_a, 4), inner(slot_b, 5)]


def logits(weights: np.ndarray, rows: list[np.ndarray], prior: np.ndarray) -> np.ndarray:
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += prior
    if z.size and z.max() > 60:  # before exp would overflow
        z -= z.max(axis=1, keepdims=True)
    return z


def chosen_logs(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Natural logarithm of the softmax at one column of each row; z is overwritten."""
    own = z[np.arange(len(z)), chosen]
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))


def token_logs(weights: np.ndarray, priors: tuple[np.ndarray, np.ndarray], words: Lexicon, now: np.ndarray, one: np.ndarray, two: np.ndarray, bits: int) -> np.ndarray:
    """Natural logarithm of the probability of each token's class and slot."""
    (top, inner), (cls, slot) = rows_of(words, now, one, two, bits), np.divmod(words.leaves[now], SLOTS)
    return chosen_logs(logits(weights, top, priors[0]), cls) + chosen_logs(logits(weights, inner, priors[1][cls]), slot)


def step(weights: np.ndarray, squares: np.ndarray, rows: list[np.ndarray], z: np.ndarray, chosen: np.ndarray, rate: float) -> None:
    """One gradient step; the rate of a row falls with the squared gradients that it has met."""
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    z[np.arange(len(z)), chosen] -= 1
    size, n = np.einsum("ij,ij->i", z, z), len(z)
    bits = np.uint32(n.bit_length())
    order = np.concatenate(rows).astype(np.uint32)  # BLOCK and MOST_BITS leave room for both in 32 bits
    order <<= bits
    order |= np.tile(np.arange(n, dtype=np.uint32), len(rows))
    order.sort()
    own, order = (order >> bits).astype(np.int64), (order & ((np.uint32(1) << bits) - np.uint32(1))).astype(np.int64)
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    own, times = own[starts], np.diff(starts, append=len(order))
    squares[own] += np.add.reduceat(size[order], starts)
    few = np.minimum(times, WIDE).astype(np.int16)
    by, kinds = np.argsort(-few, kind="stable"), np.bincount(few, minlength=WIDE + 1).tolist()
    own, starts, wide, most = own[by], starts[by], kinds[WIDE], len(by)
    sums = z.take(order[starts], axis=0)
    for k in range(1, WIDE - 1):  # what falls to one row of weights is added up first, of all rows that have so many
        most -= kinds[k]
        if most <= wide:
            break
        sums[wide:most] += z.take(order[starts[wide:most] + k], axis=0)
    for i, (start, n) in enumerate(zip(starts[:wide].tolist(), times[by[:wide]].tolist(), strict=True)):
        np.add.reduce(z.take(order[start : start + n], axis=0), axis=0, out=sums[i])
    sums *= (-rate / np.sqrt(squares[own] + np.float32(1))).astype(np.float32)[:, None]
    sums += weights.take(own, axis=0)
    row = f"V{weights.strides[0]}"
    weights.view(row)[own, 0] = sums.view(row)[:, 0]  # whole rows at once


def learn(weights: np.ndarray, squares: np.ndarray, priors: tuple[np.ndarray, np.ndarray], words: Lexicon, tokens: np.ndarray, bits: int, rate: float) -> int:
    """Gradient steps on all tokens of some texts, in blocks; returns how many there are."""
    real = np.flatnonzero(tokens > 0)
    for i in range(0, len(real), BLOCK):
        at = real[i : i + BLOCK]
        now, one, two = tokens[at], tokens[at - 1], tokens[at - 2]
        (top, inner), (cls, slot) = rows_of(words, now, one, two, bits), np.divmod(words.leaves[now], SLOTS)
        step(weights, squares, top, logits(weights, top, priors[0]), cls, rate)
        step(weights, squares, inner, logits(weights, inner, priors[1][cls]), slot, rate)
    return len(real)


def blocks_of(counts: Counts, rounds: int) -> int:
    """How many blocks of documents a round has: a block has LEAST_TOKENS, and from MANY blocks on enough that what it sends is a third of its text at most."""
    per_round = counts.tokens // rounds
    return max(1, min(MANY, per_round // LEAST_TOKENS), per_round // (64 << counts.bits))


def train(docs: DataFrame, counts: Counts, rounds: int = 3, rate: float = 0.4) -> np.ndarray:
    """Weights from every token of docs (doc_id, text): each round takes one part of the documents by hash, so each token counts once.

    The documents of a round are dealt into blocks by a hash, whatever their partitions were. A block's documents are gone through
    in the order of another hash, in groups of GROUP, from the common weights; the block then tells its change of the weights, in
    pieces, and the changes of FAN blocks at a time are averaged, then those of FAN averages, and so on. So the weights do not depend
    on how rows are stored or dealt over tasks, and no task adds up more than FAN changes.
    """
    priors, bits, pieces, n = counts.priors(), counts.bits, 16, blocks_of(counts, rounds)
    weights, sc = np.zeros((2 << bits, SLOTS), np.float32), docs.sparkSession.sparkContext
    mark = F.xxhash64("doc_id", "text", F.lit(17))
    dealt = docs.select(mark.alias("mark"), "text").select("text", "mark", F.pmod("mark", F.lit(rounds)).alias("turn"), F.pmod(F.xxhash64("mark"), F.lit(n)).cast("int").alias("block"))
    kind = "piece int, block int, met binary, change binary"
    for turn in range(rounds):
        shared = sc.broadcast((weights, counts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            common, known = shared.value
            words = Lexicon(known)

            def out(block: int) -> pa.RecordBatch:
                change, met = (np.array_split(x, pieces) for x in ((own - common).astype(np.float16), squares))
                return pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([block] * pieces, pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (met, change))], ["piece", "block", "met", "change"])

            now, waiting, own, squares = None, [], common, np.zeros(0)
            for batch in slices(batches, GROUP):
                for block, text in zip(batch.column("block").to_pylist(), utf8(batch.column("text")), strict=True):
                    if block != now or len(waiting) == GROUP:
                        if waiting:
                            learn(own, squares, priors, words, words.read(waiting)[0], bits, rate)
                            words.trim()
                            waiting = []
                        if block != now:
                            if now is not None:
                                yield out(now)
                            now, own, squares = block, common.copy(), np.zeros(len(common), np.float32)
                    waiting.append(text)
            if now is not None:
                learn(own, squares, priors, words, words.read(waiting)[0], bits, rate)
                yield out(now)

        def add(table: pa.Table) -> pa.Table:
            table = table.sort_by("block")
            met = [np.frombuffer(x.as_py(), np.float32) for x in table["met"]]
            total = sum(met)
            mean = sum(np.frombuffer(c.as_py(), np.float16).reshape(-1, SLOTS) * (m / np.maximum(total, 1e-9))[:, None] for c, m in zip(table["change"], met, strict=True))
            group = pa.array([table["block"][0].as_py() // FAN], pa.int32())
            return pa.table({"piece": table["piece"][:1], "block": group, "met": [total.tobytes()], "change": [mean.astype(np.float16).tobytes()]})

        part = dealt.where(F.col("turn") == turn).select("text", "mark", "block").repartitionById(n, F.col("block")).sortWithinPartitions("block", "mark", "text")
        sums, left = part.select("text", "block").mapInArrow(run, kind), n
        while left > 1:
            sums, left = sums.groupBy("piece", F.floor(F.col("block") / FAN).alias("_group")).applyInArrow(lambda key, table: add(table), kind), -(-left // FAN)
        found = sums.orderBy("piece").collect()
        if found:
            weights = weights + np.concatenate([np.frombuffer(r.change, np.float16) for r in found]).reshape(weights.shape).astype(np.float32)
        shared.unpersist()
    return weights


def scored(docs: DataFrame, fold: int = 7, held: int = 2) -> DataFrame:
    """Per row of docs (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score, both in log10.

    Texts are taken as UTF-8 bytes, A-Z in lower case; tokens are the words between ASCII white space and one end, so a null or
    empty text has one token. Rows whose crc32(doc_id as text) mod fold is not `held` are learned from, repeated rows as often as
    they come. Without training rows all counts are zero. The scores do not depend on how rows are stored or dealt over tasks. Texts of
    any length are read whole. Empty table: no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    learned = rows.where(trains(fold, held))
    words = checkpoint(count_words(learned))
    counts = summed(words, learned.count())
    weights = train(learned, counts)
    shared, priors, bits = docs.sparkSession.sparkContext.broadcast((weights, counts)), counts.priors(), counts.bits
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, known = shared.value
        words, share, row = Lexicon(known), np.log10(np.maximum(known.mass, 1)), TaskContext.get().partitionId() << 40
        for batch in slices(batches, 128):
            tokens, sizes = words.read(utf8(batch.column("text")))
            real = np.flatnonzero(tokens > 0)
            doc = np.repeat(np.arange(len(sizes)), sizes - 2)
            now, one, two = tokens[real], tokens[real - 1], tokens[real - 2]
            logs = words.logs[now]
            model = np.empty(len(real))
            for i in range(0, len(real), BLOCK):
                part = slice(i, i + BLOCK)
                model[part] = token_logs(common, priors, words, now[part], one[part], two[part], bits) / math.log(10)
            n, in_head = batch.num_rows, logs >= 0
            head = np.bincount(doc, np.where(in_head, logs, 0), n)
            factor = np.bincount(doc, model - share[words.leaves[now]], n)
            seen = in_head & ((now != 1) | (known.ends > 0))
            rare = np.flatnonzero(~in_head)
            pairs = np.stack([doc[rare], words.marks[now[rare]]])
            pairs = pairs[:, np.lexsort(pairs[::-1])]
            new = np.flatnonzero(np.append(True, (np.diff(pairs) != 0).any(axis=0))[: pairs.shape[1]])
            times, pairs = np.diff(np.append(new, pairs.shape[1])), pairs[:, new]
            cuts = np.searchsorted(pairs[0], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)),
                    batch.column("doc_id"),
                    pa.array(np.bincount(doc, minlength=n)),
                    pa.array(np.bincount(doc, seen, n).astype(np.int64)),
                    pa.array(head),
                    pa.array(factor),
                    pa.ListArray.from_arrays(cuts, pa.array(pairs[1])),
                    pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64))),
                ],
                ["row", "doc_id", "n_tokens", "n_head", "head", "factor", "rare", "times"],
            )
            row += n
            words.trim()

    schema = f"row long, doc_id {kind}, n_tokens long, n_head long, head double, factor double, rare array<long>, times array<long>"
    firsts = checkpoint(rows.mapInArrow(run, schema))
    rare = firsts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("mark"), F.col("x.times").alias("times"))
    found = rare.join(words.select("mark", "n"), "mark").groupBy("row").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"))
    joined = firsts.drop("rare", "times").join(found, "row", "left")
    logs = F.col("head") + F.coalesce("logs", F.lit(0.0))
    return joined.select(
        "doc_id",
        (~trains(fold, held)).alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(counts.tokens + counts.kinds + 1)).alias("base_score"),
        (logs + F.col("factor")).alias("score"),
    )
