"""Whether two names mean the same: decided by identifiers, relations, kind and context, or left open; groups of names without all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.rounds import components, settled

SAME, DIFFERENT, OPEN = "same", "different", "undetermined"
#: What a shared word counts in a page's title, each alias, each tag and the description, and the words.
FIELDS, WORD = {"title": 8, "aliases": 6, "tags": 4, "description": 3}, r"[a-z0-9]+|[一-鿿]"


def plain(name: Column) -> Column:
    """A name as names are compared: lower case, single blanks, none outside."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))


def normal(forms: DataFrame) -> DataFrame:
    """forms (id, name, aliases, related, explicit_id, kind, context) with names as they are compared; related names are no aliases."""
    listed = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), plain), lambda x: x != "")
    related = listed("related")
    return forms.select("id", plain("name").alias("name"), F.array_except(listed("aliases"), related).alias("aliases"), related.alias("related"), F.nullif(F.trim("explicit_id"), F.lit("")).alias("explicit_id"), "kind", plain("context").alias("context"))


def decided(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """(left, right, decision, basis) of pairs (left, right) of ids of forms.

    Identifiers decide if both have one; a name that is related to the other (predecessor, part ...) is not that other one; other
    kinds are left open; a shared name or alias means the same in the same context and is left open without it.
    """
    own = settled(normal(forms))
    side = lambda n: own.select(F.col("id").alias(n), F.struct(*own.columns).alias(f"_{n}"))
    both = pairs.select("left", "right").join(side("left"), "left").join(side("right"), "right")
    a, b = F.col("_left"), F.col("_right")
    ids = a["explicit_id"].isNotNull() & b["explicit_id"].isNotNull()
    related = F.array_contains(a["related"], b["name"]) | F.array_contains(b["related"], a["name"])
    name = (a["name"] == b["name"]) & (a["name"] != "")
    shared = name | F.array_contains(a["aliases"], b["name"]) | F.array_contains(b["aliases"], a["name"])
    context = (a["context"] == b["context"]) & (a["context"] != "")
    told = [
        (ids & (a["explicit_id"] == b["explicit_id"]), SAME, "explicit_identifier"), (ids, DIFFERENT, "conflicting_identifier"), (related, DIFFERENT, "relation_not_alias"),
        (~a["kind"].eqNullSafe(b["kind"]), OPEN, "topic_kept_separate"), (name & context, SAME, "name_and_context"), (shared & context, SAME, "alias_and_context"), (shared, OPEN, "same_name_other_context"),
    ]
    decision, basis = F.lit(OPEN), F.lit("no_identifier")
    for when, what, why in reversed(told):
        decision, basis = F.when(when, what).otherwise(decision), F.when(when, why).otherwise(basis)
    return both.select("left", "right", decision.alias("decision"), basis.alias("basis"))


def groups(forms: DataFrame) -> DataFrame:
    """(id, same_as, conflict): forms that mean the same by steps, under the least id, and whether the steps contradict each other.

    Forms are linked with what they share, an identifier or a name in a context and kind, and not with each other, so a name that
    very many share costs a row for each. A group in which two identifiers meet, or a form and one that it is related to, has a
    conflict: such a group is told and not torn apart. Forms that share nothing are groups of their own.
    """
    own = settled(normal(forms))
    key = lambda *parts: F.concat_ws("\x1f", *parts)
    named = own.where("context <> ''").select("id", F.explode(F.array_distinct(F.concat(F.array("name"), F.col("aliases")))).alias("n"), F.col("name").alias("own"), "kind", "context").where("n <> ''")
    real = named.where("n = own").select("n", "kind", "context").distinct()  # an alias leads to forms that bear the name, so that two forms with one alias are not the same by it
    links = named.join(real.select("n", F.col("kind").alias("_k"), F.col("context").alias("_c")), "n").where(F.col("kind").eqNullSafe(F.col("_k")) & (F.col("context") == F.col("_c")))
    edges = links.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("src"), key(F.lit("n"), F.coalesce("kind", F.lit("")), "context", "n").alias("dst"))
    edges = edges.union(own.where("explicit_id is not null").select(F.concat(F.lit("f"), F.col("id").cast("string")), key(F.lit("i"), "explicit_id")))
    roots = components(edges.select("src", "dst")).withColumnRenamed("root", "_root")
    placed = settled(own.join(roots, F.concat(F.lit("f"), F.col("id").cast("string")) == F.col("node"), "left").withColumn("_g", F.coalesce("_root", F.concat(F.lit("f"), F.col("id").cast("string")))))
    least = placed.groupBy("_g").agg(F.min("id").alias("same_as"), F.min("explicit_id").alias("_a"), F.max("explicit_id").alias("_b"))
    related = placed.select("_g", F.explode("related").alias("name")).distinct().join(placed.select("_g", "name").distinct(), ["_g", "name"], "left_semi").select("_g").distinct().withColumn("_r", F.lit(True))
    told = placed.join(least, "_g").join(related, "_g", "left")
    return told.select("id", "same_as", ((F.coalesce(F.col("_a") != F.col("_b"), F.lit(False))) | F.coalesce("_r", F.lit(False))).alias("conflict"))
