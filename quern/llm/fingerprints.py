"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

Each sample k of a text takes, over its terms with weight w (their number in the text), r and c from Gamma(2, 1) and b from the
uniform distribution, all fixed by term and k; t = floor(ln w / r + b); and keeps the term and t with the least
ln c - r * (t - b + 1). Two texts keep the same with the probability of their generalised Jaccard similarity,
sum of least weights / sum of greatest weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpoint
from quern.llm.order import successors

#: Terms are parted by these characters.
SPACE = r"[\x20\x09-\x0D]+"
#: Samples that one pass over a text's terms takes: few enough that the generated code is compiled.
PER_TURN = 4
#: What holds the lower half of a hash.
LOW = 0xFFFFFFFF


def _uniform(bits: Column) -> Column:
    """The lower 32 bits as a number between 0 and 1, neither included."""
    return (bits.bitwiseAND(F.lit(LOW)) + 0.5) * 2.0**-32


def _gamma(h: Column) -> Column:
    """Gamma(2, 1) from the two halves of a hash: the sum of two exponential numbers."""
    return -F.ln(_uniform(h) * _uniform(F.shiftrightunsigned(h, 32)))


def sample(term: Column, log_weight: Column, k: Column) -> Column:
    """Rank and identity of a term's candidate for sample k in one integer: 40 bits of its value, 24 of a hash."""
    h, g = F.xxhash64(term, k), F.xxhash64(term, k, F.lit(1))
    r, log_c = _gamma(g), F.ln(_gamma(F.xxhash64(term, k, F.lit(2))))
    beta = _uniform(h)
    t = F.floor(log_weight / r + beta)
    value = log_c - r * (t - beta + 1)
    other = (t.bitwiseAND(F.lit(0xFFFFFF)) * 0x9E3779B1).bitwiseXOR(F.shiftrightunsigned(h, 32))
    return F.shiftleft(F.floor(value * float(2**32)), 24).bitwiseOR(other.bitwiseAND(F.lit(0xFFFFFF)))


def signatures(texts: DataFrame, keys: list[str], text: str = "text", samples: int = 32) -> DataFrame:
    """keys, `copies` and `signature`, an array of `samples` integers of 31 bits, for each different combination of keys.

    The keys must determine the text; copies tells how many rows have them. Null texts and texts without terms have the empty
    array. A text's terms are counted inside its row, so that only signatures are shuffled.
    """
    hashed = F.sort_array(F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)))
    rows = texts.select(*keys, hashed.alias("_s"))
    starts = F.filter(F.sequence(F.lit(1), F.size("_s")), lambda i: (i == 1) | (F.get("_s", i - 1) != F.get("_s", i - 2)))
    rows = rows.select(*keys, "_s", F.when(F.size("_s") > 0, starts).alias("_starts"))
    turns = rows.select(*keys, "_s", "_starts", F.explode(F.sequence(F.lit(0), F.lit(samples // PER_TURN - 1))).alias("_turn"))
    runs = turns.select(*keys, "_turn", "_s", "_starts", F.posexplode_outer("_starts").alias("_p", "_i"))
    terms = runs.select(
        *keys,
        "_turn",
        F.coalesce("_p", F.lit(0)).alias("_p"),
        F.get("_s", F.col("_i") - 1).alias("_term"),
        F.ln((F.coalesce(F.get("_starts", F.col("_p") + 1), F.size("_s") + 1) - F.col("_i")).cast("double")).alias("_w"),
    )
    picked = [F.min(sample(F.col("_term"), F.col("_w"), F.col("_turn") * PER_TURN + k)).alias(f"_{k}") for k in range(PER_TURN)]
    least = terms.groupBy(*keys, "_turn").agg(F.sum(F.when(F.col("_p") == 0, 1)).alias("copies"), *picked)
    short = F.array(*[F.xxhash64(f"_{k}").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") for k in range(PER_TURN)])
    part = F.when(F.col("_0").isNotNull(), short).otherwise(F.array().cast("array<int>"))
    turned = least.select(*keys, "_turn", "copies", part.alias("_part")).groupBy(*keys)
    whole = turned.agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("_turn", "_part"))).alias("_parts"))
    return whole.select(*keys, "copies", F.flatten("_parts._part").alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two empty signatures are alike, an empty and another one are not."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(same / F.size(a))


def written(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def edited(known: DataFrame) -> DataFrame:
    """known (doc_id, text, no nulls) with `next_id` and `edited`: its last half replaced by the start of the next document.

    The next document is that with the next greater doc_id (of several, the least text), after the last the first. Each document
    sends its predecessor only what that one needs.
    """
    sizes = known.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    nexts = successors(known.select("doc_id"))
    sends = nexts.join(sizes, nexts["key"] == sizes["doc_id"]).select("key", "next", F.floor(F.col("n") / 2).cast("int").alias("half"))
    starts = (
        known.join(sends, known["doc_id"] == sends["next"])
        .select("key", "next", F.expr("substring(text, 1, half)").alias("start"))
        .groupBy("key", "next")
        .agg(F.min("start").alias("start"))
    )
    joined = known.join(starts, known["doc_id"] == starts["key"])
    return joined.select("doc_id", "text", F.col("next").alias("next_id"), F.concat(_rest(), F.substring("start", F.lit(1), F.floor(F.length("text") / 2).cast("int"))).alias("edited"))


def _rest() -> Column:
    """The text without its last half."""
    return F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))")


def _both(texts: DataFrame, samples: int) -> DataFrame:
    """The signatures of texts (doc_id, text, next_id, edited) and of what they are edited to, side by side.

    texts are dealt by doc_id already, so terms are gathered without another shuffle.
    """
    rows = texts.select(
        "doc_id",
        "next_id",
        F.xxhash64("text").alias("mark"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("is_edited"), F.col("text")), F.struct(F.lit(1).alias("is_edited"), F.col("edited").alias("text")))).alias("x"),
    ).select("doc_id", "next_id", "mark", "n_chars", "edited_sha256", "x.is_edited", "x.text")
    keys = ["doc_id", "next_id", "mark", "n_chars", "edited_sha256"]
    made = signatures(rows, [*keys, "is_edited"], samples=samples)
    side = lambda i: F.max(F.when(F.col("is_edited") == i, F.col("signature")))
    return made.groupBy(*keys).agg(side(0).alias("own"), side(1).alias("other"), F.max("copies").alias("copies"))


def compared(docs: DataFrame, samples: int = 32) -> DataFrame:
    """Per row of docs (doc_id, text): its fingerprint, its edited text's, and how alike they and the next document's are.

    Null texts count as empty. Rows with a null doc_id have no next document: they keep their first half, near_next is null. Repeated rows are all returned; where rows share
    a doc_id but not the text, the next document's text is the least and its fingerprint that of one of them. Empty table: no rows.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bare = whole.where("doc_id is null").select("doc_id", "text", F.col("doc_id").alias("next_id"), _rest().alias("edited"))
    both = checkpoint(_both(edited(whole.where("doc_id is not null")), samples).unionByName(_both(bare, samples)))
    nexts = both.groupBy("doc_id").agg(F.min(F.struct("mark", "own")).alias("n")).select(F.col("doc_id").alias("next_id"), F.col("n.own").alias("next_own"))
    found = both.join(nexts, "next_id", "left")
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        F.when(F.col("next_own").isNotNull(), likeness(F.col("own"), F.col("next_own"))).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
