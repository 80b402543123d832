"""Rules and evaluation over facts: conjunctive queries, forward chaining, merging of things with shared keys, judged outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.rounds import components


@dataclass(frozen=True)
class Atom:
    """subject -predicate-> object; names that begin with ? are variables."""

    s: str
    p: str
    o: str


@dataclass(frozen=True)
class Rule:
    premises: tuple[Atom, ...]
    conclusion: Atom


def matches(facts: DataFrame, premises: tuple[Atom, ...]) -> DataFrame:
    """One row for each way to satisfy all premises by facts (s, p, o); columns are the variables."""
    found = None
    for atom in premises:
        rows = facts.where(F.col("p") == atom.p)
        names: dict[str, str] = {}
        for side in ("s", "o"):
            term = getattr(atom, side)
            if not term.startswith("?"):
                rows = rows.where(F.col(side) == term)
            elif term[1:] in names:
                rows = rows.where(F.col(side) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = side
        rows = rows.select(*[F.col(side).alias(name) for name, side in names.items()]).distinct()
        shared = [n for n in names if found is not None and n in found.columns]
        if found is not None and not shared:
            raise ValueError("premises must share a variable with those before them")
        found = rows if found is None else found.join(rows, shared)
    return found


def concluded(facts: DataFrame, rule: Rule) -> DataFrame:
    """(s, p, o) that a rule adds to the facts."""
    found, end = matches(facts, rule.premises), rule.conclusion
    side = lambda term: F.col(term[1:]) if term.startswith("?") else F.lit(term)
    new = found.select(side(end.s).alias("s"), F.lit(end.p).alias("p"), side(end.o).alias("o")).distinct()
    return new.join(facts.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def chained(facts: DataFrame, layers: list[list[Rule]]) -> DataFrame:
    """(s, p, o) derived by layers of rules; what a layer derives is a fact for the next."""
    known, derived = facts.select("s", "p", "o"), None
    for layer in layers:
        for rule in layer:
            new = concluded(known, rule)
            derived = new if derived is None else derived.union(new)
        known = facts.select("s", "p", "o").union(derived).distinct()
    return derived.distinct()


def merged(rows: DataFrame, thing: str, key: str) -> DataFrame:
    """(thing, winner): things that share keys, directly or over any chain of others, take the least of them.

    Each thing is linked to the least thing of each of its keys, so a key of k things costs k links.
    """
    pairs = rows.select(F.col(thing).alias("thing"), F.col(key).alias("key")).where("thing is not null and key is not null").distinct()
    least = pairs.groupBy("key").agg(F.min("thing").alias("first"))
    roots = components(pairs.join(least, "key").select(F.col("thing").alias("src"), F.col("first").alias("dst")))
    return pairs.select("thing").distinct().join(roots, F.col("thing") == F.col("node"), "left").select("thing", F.coalesce("root", "thing").alias("winner"))


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of how cases (name, outcome) came out before and after; a case that is missing later is an error."""
    both = old.select("name", F.col("outcome").alias("_a")).join(new.select("name", F.col("outcome").alias("_b")), "name", "left")
    later = F.coalesce("_b", F.lit("error"))
    return both.agg(
        F.count("*").alias("cases"),
        F.count_if((F.col("_a") == "pass") & (later == "fail")).alias("new_red"),
        F.count_if((F.col("_a") != "error") & (later == "error")).alias("new_error"),
        (F.count_if(F.col("_a") == "pass") - F.count_if(later == "pass")).alias("passes_dropped"),
    )


def recall_at(ranked: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(question, recall, reciprocal_rank) of ranked (question, item, rank from 1) against wanted (question, item)."""
    hits = wanted.join(ranked, ["question", "item"], "left")
    n = F.count("*")
    return hits.groupBy("question").agg(F.round(F.count_if(F.col("rank") <= k) / n, 6).alias("recall"), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("reciprocal_rank"))
