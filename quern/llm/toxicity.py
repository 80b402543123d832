"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton in folded texts.

Folding writes a text as one reads it: A-Z in lower case, letters of other scripts that look like Latin ones, full-width forms, and
digits or signs that stand for letters, each to one letter, so that disguised words meet their entries. An entry is a word or the
beginning of words, and weighs what its presence says by the labelled texts. An exception is a phrase around an entry's word that
clean texts use; where one matches, the entry does not count. Each word counts with its heaviest entry. The sum over the different
words found, normalised by the text's length, and the heaviest weight make one probability.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quern.llm.common import extended, slices, utf8

#: Letters of Cyrillic and Greek that look like these Latin ones.
LOOKALIKES = {
    "a": "аαɑ", "b": "ЬьВвβ", "c": "сϲ", "d": "ԁ", "e": "еёεє", "g": "ɡ", "h": "һНн", "i": "іїιӏ", "j": "ј", "k": "кκ", "m": "мΜ", "n": "пηΝ", "o": "оοσ", "p": "рρ",
    "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υц", "v": "ѵν", "w": "ԝшω", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
#: Digits and signs that stand for letters; l, 1 and i are one letter, because 1 stands for both.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "l": "i"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "i"}
FOLD = {ord(x): k for k, forms in LOOKALIKES.items() for x in forms + forms.upper()} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: chr(48 + i) for i in range(10)}
#: What is left out when it stands inside of a word: soft hyphen, zero-width characters, joiners and the byte order mark.
FOLD |= dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
FOLD = {k: STAND_INS.get(v, v) if v else v for k, v in FOLD.items()}
DIGITS = {ord(k): v for k, v in STAND_INS.items()}
SIGN = re.compile(r"[@$!|€£]+(?=[^\W_])")
WORD = re.compile(r"\w+")

#: Letters of an entry that is the beginning of words: least and most. Entries of a lexicon, and exceptions, at most.
LEAST, MOST, ENTRIES, EXCEPTIONS = 3, 8, 20_000, 5_000
#: Words that are given a second try without exceptions, those first that clean texts have least.
DOUBTFUL = 500
#: The lower bound of a weight, in natural logarithms of odds, from which an entry is taken.
WEIGHT = math.log(5)


def folded(text: bytes) -> str:
    """The text as it is matched: words between single spaces, with one in front and one behind."""
    plain = text.decode("utf-8", "replace").lower()
    if not plain.isascii():
        plain = plain.translate(FOLD)
    if SIGN.search(plain):
        plain = SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), plain)
    return f" {' '.join(WORD.findall(plain.translate(DIGITS)))} "


def entries(word: str) -> list[str]:
    """What of a word can be an entry: its beginnings, and all of it with the space that ends it; each after a space."""
    return [f" {word[:k]}" for k in range(LEAST, min(MOST, len(word)) + 1)] + [f" {word} "]


@dataclass
class Lexicon:
    weights: dict[str, float]  # by entry
    exceptions: frozenset[str]  # two words, with spaces around
    curve: tuple[float, float, float]  # of the normalised sum, the heaviest weight, and a constant

    def automaton(self) -> ahocorasick.Automaton | None:
        made = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            made.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), None))
        if not len(made):
            return None
        made.make_automaton()
        return made


def matched(made: ahocorasick.Automaton | None, text: str) -> tuple[float, float]:
    """Sum over the different words found of the weight of each, and the greatest weight."""
    if made is None:
        return 0.0, 0.0
    places: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in made.iter(text):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > places.get(start, 0.0):
            places[start] = weight
    if spared and places:
        gone = {p for low, high in spared for p in (low, text.index(" ", low + 1)) if p < high}
        places = {p: w for p, w in places.items() if p not in gone}
    words: dict[str, float] = {}
    for p, w in places.items():
        word = text[p + 1 : text.index(" ", p + 1)]
        words[word] = max(w, words.get(word, 0.0))
    return (sum(words.values()), max(words.values())) if words else (0.0, 0.0)


def features(made: ahocorasick.Automaton | None, text: str) -> tuple[float, float]:
    """The sum of weights over the logarithm of the number of words, and the greatest weight."""
    whole, most = matched(made, text)
    return whole / math.log2(2 + text.count(" ")), most


def probability(curve: tuple[float, float, float], found: tuple[float, float]) -> float:
    z = curve[0] * found[0] + curve[1] * found[1] + curve[2]
    return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> tuple[float, float, float]:
    """Logistic regression on two columns by Newton's method with a slight pull to zero; weights of columns stay above zero."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pull = np.array([0.05, 0.05, 0.001])
        hessian = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(pull)
        w -= np.linalg.solve(hessian, a.T @ (weight * (p - y)) + pull * w)
        w[:2] = np.clip(w[:2], 0.0, 20.0)
    return tuple(w.tolist())


def weighed(t: int, c: int, n: np.ndarray) -> tuple[float, float]:
    """Lower bound and value of the logarithm of the odds ratio of what t of n[1] toxic and c of n[0] clean texts have."""
    weight = math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
    return weight - math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)), weight


def around_words(text: str, entries_: set[str]) -> Iterator[tuple[str, str, str]]:
    """Each of the words in a text, as an entry, with the phrases of it and the word before and behind."""
    words = text.split()
    for before, word, after in zip(["", *words], words, [*words[1:], ""]):
        if (entry := f" {word} ") in entries_:
            yield entry, f" {before} {word} ", f" {word} {after} "


def exceptions(texts: list[str], toxic: np.ndarray, words: set[str], n: np.ndarray) -> frozenset[str]:
    """Phrases around the words that at least three clean texts have, and a share of them twice that of toxic ones."""
    counts = (Counter(), Counter())
    for text, label in zip(texts, toxic.tolist(), strict=True):
        counts[label].update({p for _, *both in around_words(text, words) for p in both if p.count(" ") == 3 and "  " not in p})
    good = [(-k, p) for p, k in counts[0].items() if k >= 3 and k / n[0] > 2 * (counts[1][p] + 0.5) / n[1]]
    return frozenset(p for _, p in sorted(good)[:EXCEPTIONS])


def plain(chosen: list[tuple[float, str, float]], present: Counter) -> list[tuple[float, str, float]]:
    """Of (bound, entry, weight) those that say something of their own.

    The beginning of words goes if nine tenths of its texts have one longer entry that goes on from it, so that an entry is as long
    as what is said by it; a longer entry goes if a beginning of it that stays weighs as much.
    """
    longest: Counter = Counter()
    for _, entry, _ in chosen:
        for k in range(LEAST + 1, len(entry)):
            longest[entry[:k]] = max(longest[entry[:k]], present[entry])
    stays = {entry: (bound, weight) for bound, entry, weight in chosen if longest[entry] < 0.9 * present[entry]}
    own = lambda entry, weight: all(weight > stays[entry[:k]][1] + 0.3 for k in range(LEAST + 1, len(entry)) if entry[:k] in stays)
    return [(bound, entry, weight) for entry, (bound, weight) in stays.items() if own(entry, weight)]


def learn(texts: list[str], toxic: np.ndarray, whole: tuple[int, int]) -> Lexicon:
    """A lexicon from folded texts and their labels; whole tells how many clean and toxic texts there are beyond the sample.

    An entry's support are the different surroundings (words before and behind) in which toxic texts have it, so that copies of a
    text count once; its weight is the logarithm of the odds ratio, and its lower bound must reach WEIGHT. Words that fail for their
    use in clean texts get another try without the phrases of two words that clean texts prefer; these are exceptions from then on.
    """
    n = np.bincount(toxic, minlength=2)
    if not n.all():
        return Lexicon({}, frozenset(), (0.0, 0.0, math.log((whole[1] + 0.5) / (whole[0] + 0.5))))
    around: dict[str, set[int]] = defaultdict(set)
    for text, label in zip(texts, toxic.tolist(), strict=True):
        if not label:
            continue
        words = text.split()
        mine: dict[str, int] = {}
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            if word not in mine:
                mine[word] = hash((before, after))
        for word, context in mine.items():
            around[word].add(context)
    support: dict[str, set[int]] = defaultdict(set)
    present: Counter = Counter()
    for word, contexts in around.items():
        for entry in entries(word):
            support[entry] |= contexts
    least = max(3, math.ceil(0.005 * n[1]))
    wanted = {e for e, s in support.items() if len(s) >= least}
    clean: Counter = Counter()
    for text, label in zip(texts, toxic.tolist(), strict=True):
        held = {e for word in set(text.split()) for e in entries(word) if e in wanted}
        (present if label else clean).update(held)
    of = lambda entry, c: weighed(min(len(support[entry]), present[entry]), c, n)
    chosen, doubtful = [], []
    for entry in wanted:
        bound, weight = of(entry, clean[entry])
        if bound >= WEIGHT:
            chosen.append((-bound, entry, weight))
        elif entry.endswith(" ") and present[entry] * n[0] > clean[entry] * n[1]:
            doubtful.append((clean[entry] / present[entry], entry))
    words = {entry for _, entry in sorted(doubtful)[:DOUBTFUL]} | {entry for _, entry, _ in chosen if entry.endswith(" ")}
    phrases = exceptions(texts, toxic, words, n)
    rest: Counter = Counter()
    for text, label in zip(texts, toxic.tolist(), strict=True):
        if not label:
            rest.update({entry for entry, a, b in around_words(text, words) if a not in phrases and b not in phrases})
    known = {entry for _, entry, _ in chosen}
    for entry in words - known:
        bound, weight = of(entry, rest[entry])
        if bound >= WEIGHT:
            chosen.append((-bound, entry, weight))
    weights = {entry: weight for _, entry, weight in sorted(plain(chosen, present))[:ENTRIES]}
    used = frozenset(p for p in phrases if any(f" {w} " in weights for w in p.split()))
    lexicon = Lexicon(weights, used, (0.0, 0.0, 0.0))
    made = lexicon.automaton()
    x = np.array([features(made, t) for t in texts])
    lexicon.curve = fitted(x, toxic.astype(float), np.where(toxic == 1, whole[1] / n[1], whole[0] / n[0]))
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, most_bytes: int = 24 << 20, folds: int = 4, held: int = 2) -> Lexicon:
    """A lexicon for labels.toxic, from whole texts of at most most_rows labelled documents and most_bytes bytes.

    Only rows whose crc32(doc_id as text) mod folds is not `held` are learned from. A third of the sample is for toxic documents, so
    far as there are so many; of each kind those with the least hashes are taken, so the sample does not depend on how rows are
    stored. A document that does not fit into the bytes that are left is passed over. Of rows that share a doc_id the longest text
    counts. Null ids and labels are left out. Without rows of both kinds all texts score alike.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    known = known.where(F.crc32(F.col("_id").cast("string")) % folds != held).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    all_ = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    by_hash = [F.xxhash64("_id"), F.col("_id")]
    sample = known.where("toxic = 1").orderBy(*by_hash).limit(most_rows // 3).union(known.where("toxic = 0").orderBy(*by_hash).limit(most_rows - most_rows // 3))
    own = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    sizes = own.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.max(F.octet_length("_text")).alias("size"), F.max("toxic").alias("toxic")).collect()
    chosen, room = [], {1: most_bytes // 3, 0: most_bytes - most_bytes // 3}
    for r in sorted(sizes, key=lambda r: (zlib.crc32(str(r._id).encode()), r._id)):
        if r.size <= room[r.toxic]:
            chosen.append((r._id, r.size, r.toxic))
            room[r.toxic] -= r.size
    if not chosen:
        return learn([], np.zeros(0, np.int64), (all_.get(0, 0), all_.get(1, 0)))
    wanted = docs.sparkSession.createDataFrame(chosen, StructType([StructField("_id", docs.schema["doc_id"].dataType), StructField("_size", LongType()), StructField("toxic", IntegerType())]))
    texts = own.join(F.broadcast(wanted), "_id").where(F.octet_length("_text") == F.col("_size")).groupBy("_id").agg(F.min("_text").alias("_text"), F.first("toxic").alias("toxic"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([folded(x) for x in utf8(batch.column("_text"))], pa.string())], ["toxic", "text"])

    rows = sorted({(r.toxic, r.text) for r in texts.mapInArrow(fold, "toxic int, text string").toLocalIterator()})
    return learn([t for _, t in rows], np.array([t for t, _ in rows], np.int64), (all_.get(0, 0), all_.get(1, 0)))


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text", column: str = "score") -> DataFrame:
    """docs with each whole text's probability of being toxic. Null texts count as empty; a column of that name is replaced.

    Every row is scored for itself, repeated ones alike, very long ones whole. Empty table: no rows.
    """
    rest = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lexicon.automaton()
        for batch in slices(batches):
            found = [probability(lexicon.curve, features(made, folded(x))) for x in utf8(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, column])

    return rest.mapInArrow(run, extended(rest, f"`{column}` double"))
