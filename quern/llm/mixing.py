"""Mixing sources to target weights, in DataFrame functions alone.

The target weight of a source is its share of all tokens to the power of an exponent between 0 (all alike) and 1 (as they are).
The exponent is bisected to the least one with which no source is repeated more often than a limit, or to the one whose weights
have a wanted entropy. The weights become budgets of tokens, and each budget is spent on whole permutations of the source's
documents and the start of one more; blocks of the stream hold every source in its proportion, permuted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import checkpoint, unused

#: Halvings of the interval that each pass over the sources settles, and passes.
LEVELS, PASSES = 4, 8


@dataclass
class Mix:
    exponent: float
    weights: DataFrame  # source, tokens, documents, weight, budget


def _bisect(sources: DataFrame, value: Column, good, levels: int = LEVELS, passes: int = PASSES) -> float:
    """The least exponent in [0, 1] for which good(value) holds, if it holds for all greater ones; 1 if for none.

    value is an aggregate of the sources by `exponent`. One pass settles several halvings at once, as all exponents that they
    can try are known before; only as many numbers come to the driver.
    """
    low, high, n = 0.0, 1.0, 2**levels
    for _ in range(passes):
        tried = sources.select("*", F.explode(F.array(*[F.lit(low + (high - low) * i / n) for i in range(n)])).alias("exponent"))
        found = {r.exponent: r.value for r in tried.groupBy("exponent").agg(value.alias("value")).collect()}
        at = sorted(found)
        step, first, last = (high - low) / n, 0, n  # the answer lies in (first, last], or at 0
        if at and good(found[at[0]]):
            return at[0] if low == 0.0 else low
        while last - first > 1:
            middle = (first + last) // 2
            first, last = (first, middle) if at and good(found[at[middle]]) else (middle, last)
        low, high = low + step * first, low + step * last
    return high


def mix(units: DataFrame, entropy: float | None = None, most_epochs: float | None = None, budget: int | None = None) -> Mix:
    """Exponent, weights and budgets for units (source, tokens); exactly one of entropy (in nats) and most_epochs is given.

    budget is in tokens; without one it is the least with which every source's documents come at least once. Sources without
    tokens get no weight. A null source is a source.
    """
    if (entropy is None) == (most_epochs is None):
        raise ValueError("give either entropy or most_epochs")
    sources = checkpoint(units.groupBy("source").agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("documents")).where("tokens > 0"))
    total, largest = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    if total is None:
        return Mix(1.0, sources.withColumns({"weight": F.lit(0.0), "budget": F.lit(0).cast("long")}))
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.col("exponent"))
    if entropy is not None:
        value = F.log(F.sum(power)) - F.sum(power * F.log(power)) / F.sum(power)
        exponent = _bisect(sources, value, lambda x: x <= entropy)
    else:
        spent = F.lit(float(budget)) if budget is not None else F.max(F.when(F.col("tokens") == largest, F.col("tokens") / power)) * F.sum(power)
        value = F.max(power / F.col("tokens")) * spent / F.sum(power)
        exponent = _bisect(sources, value, lambda x: x <= most_epochs)
    exponent = round(exponent, 6)
    shares = sources.withColumn("power", F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent)))
    whole, per = shares.agg(F.sum("power"), F.max(F.col("tokens") / F.col("power"))).first()
    spend = float(budget) if budget is not None else per * whole
    weights = shares.select("source", "tokens", "documents", (F.col("power") / whole).alias("weight"))
    return Mix(exponent, weights.withColumn("budget", F.round(F.col("weight") * spend).cast("long")))


def _place(epoch: Column, unit: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(unit.cast("string"), F.lit(""))))


def schedule(units: DataFrame, mixed: Mix, seed: int = 1, bucket_rows: int = 4096, block_tokens: int = 1_000_000) -> DataFrame:
    """(source, unit, tokens, epoch, block, slot): which unit comes where in the stream, and how often.

    units (source, unit, tokens) must not repeat. Epochs 0, 1, ... of a source permute all its units; of the last only the units
    come whose tokens before them are less than what is left of the budget. Permutations go by md5 of seed, epoch and unit. The
    running sum of tokens is taken in two steps, over buckets of the permutation and inside them, so that a source with any share
    of the rows is dealt out over many tasks.
    """
    per = mixed.weights.select(
        F.col("source").alias("_source"),
        F.col("tokens").alias("_all"),
        F.col("budget"),
        F.ceil(F.col("budget") / F.col("tokens")).cast("int").alias("epochs"),
        F.greatest(F.lit(1), F.ceil(F.col("documents") / bucket_rows)).cast("int").alias("buckets"),
    )
    spent = mixed.weights.agg(F.sum("budget")).first()[0] or 0
    blocks = max(1, -(-spent // block_tokens))
    turns = units.where("tokens > 0").join(per, units["source"].eqNullSafe(per["_source"])).where("epochs > 0").select(
        "source", "unit", "tokens", "_all", "budget", "buckets", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch")
    )
    placed = turns.withColumn("place", _place(F.col("epoch"), F.col("unit"), seed))
    placed = placed.withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 6), 16, 10).cast("long") * F.col("buckets") / 2**24).cast("int"))
    of = ["source", "epoch"]
    sums = placed.groupBy(*of, "bucket").agg(F.sum("tokens").alias("_sum"))
    ahead = sums.select(
        F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(W.partitionBy(*of).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"),
    )
    inside = W.partitionBy(*of, "bucket").orderBy("place", "unit").rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    joined = summed.join(ahead, summed["source"].eqNullSafe(ahead["_s"]) & (summed["epoch"] == ahead["_e"]) & (summed["bucket"] == ahead["_b"]))
    start = F.col("epoch").cast("long") * F.col("_all") + F.col("_ahead") + F.col("_inside")
    kept = joined.withColumn("_start", start).where("_start < budget")
    kept = kept.withColumn("block", F.floor(F.col("_start") / F.col("budget") * blocks).cast("int"))
    slot = F.row_number().over(W.partitionBy("block").orderBy("place", F.col("source").asc_nulls_first(), F.col("unit").asc_nulls_first(), "epoch"))
    return kept.withColumn("slot", slot).select("source", "unit", "tokens", "epoch", "block", "slot")


def tokens(text: str | Column = "text") -> Column:
    """Words between white space, at least one, so that each document can be drawn."""
    text = F.col(text) if isinstance(text, str) else text
    return F.greatest(F.lit(1), F.size(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")), " "))).cast("long")


def planned(docs: DataFrame, most_epochs: float = 2.0, seed: int = 1, **limits) -> DataFrame:
    """The schedule of docs (doc_id, text, source), by doc_id: (source, doc_id, tokens, epoch, block, slot).

    A unit is what shares source and doc_id; repeated rows count together and once in the stream. Null texts and texts without
    words weigh one token; null sources and ids are values of their own. Empty table: no rows.
    """
    units = checkpoint(docs.select("source", F.col("doc_id").alias("unit"), tokens().alias("tokens")).groupBy("source", "unit").agg(F.sum("tokens").alias("tokens")))
    return schedule(units, mix(units, most_epochs=most_epochs, **limits), seed).withColumnRenamed("unit", "doc_id")


def drawn(docs: DataFrame, most_epochs: float = 2.0, seed: int = 1) -> DataFrame:
    """docs as often as the schedule has them, with their columns; each comes at least once.

    Rows that share source and doc_id are drawn together, each of them as often. Null and empty texts weigh one token; null sources
    and ids are values of their own; a very long text is one unit and never cut. Empty table: no rows.
    """
    source, id_, times, turn = (unused(docs, c) for c in ("_source", "_id", "_times", "_turn"))
    plan = planned(docs, most_epochs, seed).groupBy(F.col("source").alias(source), F.col("doc_id").alias(id_)).agg(F.count("*").cast("int").alias(times))
    joined = docs.join(plan, docs["doc_id"].eqNullSafe(plan[id_]) & docs["source"].eqNullSafe(plan[source]))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(turn)).drop(turn)
