"""Graphs and facts that are kept up to date by increments: support by sources, links and their evidence, what a change reaches, walks that go on.

An increment reads what it touches. State is a table of its own in a folder, partitioned so that only the parts that a delta names
are read and written again, and each write takes the place of an earlier one of the same name, so that a delta that comes twice
changes nothing.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.rounds import fresh_folder, numbered, settled


@dataclass(frozen=True)
class Facts:
    """Facts by the sources that support them; a fact is there as long as one of its sources is."""

    folder: str
    keys: tuple[str, ...]
    kind: str  # of the columns, keys and source
    buckets: int = 64

    def rows(self, spark: SparkSession) -> DataFrame:
        """(keys, source): what each source says."""
        return self.read(spark).select(*self.keys, "source")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.kind}, bucket int").parquet(self.folder)

    def facts(self, spark: SparkSession) -> DataFrame:
        """(keys, support): the facts, and how many sources each has."""
        return self.rows(spark).groupBy(*self.keys).agg(F.count("*").alias("support"))


def facts(said: DataFrame, keys: list[str], folder: str | None = None, buckets: int = 64) -> Facts:
    """Begin with what sources say (keys, source); repeated rows count once, rows without a source not at all."""
    rows = said.where("source is not null").select(*keys, "source").distinct()
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    made = Facts(folder or fresh_folder(said.sparkSession, "facts"), tuple(keys), kind, buckets)
    _write(made, rows)
    return made


def _bucket(state: Facts):
    return F.pmod(F.xxhash64(*state.keys), F.lit(state.buckets)).cast("int")


def _write(state: Facts, rows: DataFrame) -> None:
    placed = rows.withColumn("bucket", _bucket(state)).hint("rebalance", "bucket")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(state.folder)


def apply(state: Facts, delta: DataFrame) -> DataFrame:
    """Take a delta (keys, source, op) into the state and tell (keys, before, after) of each fact whose support it changed.

    op is add or remove. Of rows that name the same fact and source both ways, the addition holds. What is there already is not added
    again, what is not there cannot go, so a delta that comes twice changes nothing the second time. Only the buckets of the delta's
    facts are read and written.
    """
    keys = list(state.keys)
    spark = delta.sparkSession
    asked = delta.where("source is not null and op in ('add', 'remove')").groupBy(*keys, "source").agg(F.min("op").alias("op"))
    asked = settled(asked.withColumn("bucket", _bucket(state)))
    touched = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return asked.select(*keys, F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("after")).limit(0)
    old = settled(state.read(spark).where(F.col("bucket").isin(touched)).drop("bucket"))
    left = old.withColumn("_old", F.lit(True)).join(asked.drop("bucket"), [*keys, "source"], "full_outer")
    left = left.withColumn("_now", F.when(F.col("op") == "remove", False).otherwise(True))
    left = settled(left.select(*keys, "source", F.coalesce("_old", F.lit(False)).alias("_old"), "_now"))
    kept = left.where("_now").select(*keys, "source")
    gone = set(touched) - {r.bucket for r in kept.select(_bucket(state).alias("bucket")).distinct().collect()}
    _write(state, kept)
    if gone:  # nothing is left in these: written as empty files, so that what stood there is no longer read
        for bucket in gone:
            kept.limit(0).write.mode("overwrite").parquet(f"{state.folder}/bucket={bucket}")
    changed = left.groupBy(*keys).agg(F.count_if("_old").alias("before"), F.count_if("_now").alias("after"))
    return settled(changed.where("before <> after"))


SUPPORTED, NAVIGATION = "supported_relation", "navigation"


def merged_links(current: DataFrame, incoming: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Links (page, target, kind, relation, evidence) of two increments together.

    What `current` has of the pages of rebuilt (page) is dropped first. Of links that share page, target, kind and relation the one
    with more evidence stays, of equals the current one. evidence is an array.
    """
    own = current.join(rebuilt.select("page").distinct(), "page", "left_anti").withColumn("_new", F.lit(0))
    both = own.unionByName(incoming.withColumn("_new", F.lit(1)))
    best = F.struct(-F.size(F.coalesce("evidence", F.array().cast("array<string>"))), "_new", F.to_json(F.struct("evidence")))
    return both.groupBy("page", "target", "kind", F.coalesce("relation", F.lit("")).alias("relation")).agg(F.min_by("evidence", best).alias("evidence"))


def withdrawn_links(links: DataFrame, live: DataFrame, gone: DataFrame, parts: int | None = None) -> DataFrame:
    """Links after sources went away: those of pages gone (page) go, a supported one without live evidence becomes plain navigation.

    links is (page, target, kind, relation, evidence), live (evidence_id). Evidence that is not live is taken out of the rest; links
    that become equal are one. Pieces of evidence are dealt over `parts` tasks, by default as many as Spark's shuffles have.
    """
    dealt = lambda rows, *by: rows.repartition(*([parts] if parts else []), *by)
    stays = links.join(gone.select("page").distinct(), "page", "left_anti")
    rows = stays.select("page", "target", "kind", "relation", F.explode_outer(F.array_distinct("evidence")).alias("evidence_id"))
    rows = rows.join(live.select("evidence_id", F.lit(True).alias("_live")).distinct(), "evidence_id", "left")
    rows = dealt(rows, "page", "target")  # once, for each link and for those that become equal
    told = rows.groupBy("page", "target", "kind", "relation").agg(F.array_sort(F.collect_list(F.when(F.col("_live"), F.col("evidence_id")))).alias("evidence"))  # a link's own
    falls = (F.col("kind") == SUPPORTED) & (F.size("evidence") == 0)
    told = told.select("page", "target", F.when(falls, NAVIGATION).otherwise(F.col("kind")).alias("kind"), F.when(falls, "").otherwise(F.col("relation")).alias("relation"), F.when(F.col("kind") == SUPPORTED, F.col("evidence")).otherwise(F.array().cast("array<string>")).alias("evidence"))
    return told.distinct()


def parent(path: str):
    return F.when(F.contains(F.col(path), F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def impact(before: DataFrame, after: DataFrame, old_links: DataFrame, new_links: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, action) of what a change of pages makes necessary: render a page, remove it, or write the index of a directory.

    before and after are (path, title, description), old_links and new_links (path, target), changed (path) the pages that were
    touched. Rendered are: pages that were touched and are there; pages at the other end of a link that came or went; and where a page
    came, went or changed its title, all pages that link to it or that it links to. Indexes of directories follow pages that came,
    went, or changed title or description. Everything starts from the changed pages; links are only joined with them.
    """
    touched = changed.select("path").distinct()
    side = lambda rows, n: rows.join(touched, "path", "left_semi").select("path", F.struct("title", "description").alias(n))
    both = settled(touched.join(side(before, "a"), "path", "left").join(side(after, "b"), "path", "left"))
    there, gone = both.where("b is not null"), both.where("a is not null and b is null")
    moved = both.where(~F.col("a.title").eqNullSafe(F.col("b.title")) | (F.col("a").isNull() != F.col("b").isNull())).select("path")
    told = both.where(~F.col("a").eqNullSafe(F.col("b"))).select(parent("path").alias("path"))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i - 1), "/"))
    held = told.where("path <> ''").distinct().join(after.select(F.explode(above).alias("path")).distinct(), "path", "left_semi")
    ends = lambda links: links.join(touched, "path", "left_semi").distinct()
    old, new = ends(old_links), ends(new_links)
    shifted = old.exceptAll(new).union(new.exceptAll(old)).where("path <> target").select(F.col("target").alias("path"))
    every = old_links.union(new_links)
    into = every.join(moved.select(F.col("path").alias("target")), "target", "left_semi").select("path")
    out = every.join(moved, "path", "left_semi").select(F.col("target").alias("path"))
    render = there.select("path").union(shifted).union(into).union(out).distinct().join(after.select("path"), "path", "left_semi")
    parts = [(render, "render"), (gone.select("path"), "remove"), (held, "index")]
    return reduce(DataFrame.union, [rows.select("path", F.lit(action).alias("action")) for rows, action in parts])


def dependents(edges: DataFrame, changed: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, round) of all that depend, directly or not, on the changed nodes; edges is (node, on), changed (node), which are round 0.

    Each round joins the nodes that the round before found, and no others, with the edges.
    """
    front = settled(changed.select("node").distinct())
    found = settled(front.withColumn("round", F.lit(0)))
    for turn in range(1, most_rounds + 1):
        front = settled(edges.join(front.select(F.col("node").alias("on")), "on").select("node").distinct().join(found, "node", "left_anti"))
        if front.isEmpty():
            return found
        found = settled(found.union(front.withColumn("round", F.lit(turn))))
    raise RuntimeError(f"not settled in {most_rounds} rounds")


class Stale(ValueError):
    pass


@dataclass(frozen=True)
class Walk:
    """A walk over shared labels and where it stands; the tables of its state are in a folder of their own."""

    folder: str
    scope: str
    found: int
    exhausted: bool

    @property
    def token(self) -> str:
        return json.dumps([self.folder, self.scope, self.found, self.exhausted])

    @staticmethod
    def of(token: str) -> Walk:
        try:
            folder, scope, found, exhausted = json.loads(token)
            return Walk(str(folder), str(scope), int(found), bool(exhausted))
        except (ValueError, TypeError):
            raise Stale("no token of a walk") from None

    def records(self, spark: SparkSession) -> DataFrame:
        """(place, record, label, via): what was found, in order, by which label, and which record led there."""
        return spark.read.parquet(f"{self.folder}/found")

    def frontier(self, spark: SparkSession) -> DataFrame:
        """(place, label, after, via): labels that are still to be looked up, in order, and the record after which to go on."""
        return spark.read.parquet(f"{self.folder}/labels").where("open").select("place", "label", "after", "via")


def _scope(occurrences: DataFrame) -> str:
    n, mark = occurrences.agg(F.count("*"), F.sum(F.xxhash64("record", "label").cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{n}:{mark}".encode()).hexdigest()[:16]


def _save(spark: SparkSession, scope: str, found: DataFrame, labels: DataFrame) -> Walk:
    folder = fresh_folder(spark, "walk")
    found.write.parquet(f"{folder}/found")
    labels.write.parquet(f"{folder}/labels")
    n, left = spark.read.parquet(f"{folder}/found").count(), spark.read.parquet(f"{folder}/labels").where("open").count()
    return Walk(folder, scope, n, left == 0)


def begin(occurrences: DataFrame, seeds: DataFrame) -> Walk:
    """A walk from labels (label) over occurrences (record, label); blanks and repeats are left out, the order is that of the labels."""
    kind = occurrences.schema["record"].dataType.simpleString()
    labels = numbered(seeds.where("trim(label) <> ''").select("label").distinct(), [F.col("label")], "place")
    labels = labels.select("place", "label", F.lit(None).cast(kind).alias("after"), F.lit(None).cast(kind).alias("via"), F.lit(True).alias("open"))
    spark = occurrences.sparkSession
    return _save(spark, _scope(occurrences), spark.createDataFrame([], f"place long, record {kind}, label string, via {kind}"), labels)


def go_on(walk: Walk, occurrences: DataFrame, most_records: int) -> Walk:
    """The walk after at most so many new records; what is left is told by the new walk, and the old one stays as it is.

    Labels are looked up in the order in which they were met, the records of a label in theirs; a record that was found brings its
    other labels, in order, to the end. So the walk finds the same in the same order however it is cut into calls. A label whose
    records are not used up stays with the last one of them. All labels that are open are looked up by one join.
    """
    if most_records < 1:
        raise ValueError("a walk needs room for a record")
    spark = occurrences.sparkSession
    if walk.scope != _scope(occurrences):
        raise Stale("the occurrences are not those that the walk began with")
    known = occurrences.select("record", "label").distinct()
    found, labels, room = walk.records(spark), spark.read.parquet(f"{walk.folder}/labels"), most_records
    while room:
        open_ = settled(labels.where("open"))
        if open_.isEmpty():
            break
        met = known.join(open_.select("label", "place", "after", "via"), "label").where("after is null or record > after").join(found.select("record"), "record", "left_anti")
        first = met.groupBy("record").agg(F.min_by(F.struct("place", "label", "via"), "place").alias("x")).select("record", "x.*")
        new = settled(numbered(first, [F.col("place"), F.col("record")], "turn"))
        taken = settled(new.where(F.col("turn") < room))
        n, last = taken.count(), None
        total = new.count()
        base = found.count()
        if total > n:  # the label of the last record taken stays open if more of its records wait, and so do all behind it
            last = new.where(F.col("turn") == n - 1).first()
            following = new.where(F.col("turn") == n).first()
        found = settled(found.unionByName(taken.select((F.col("turn") + base).alias("place"), "record", "label", "via")))
        brought = known.join(taken.select("record", "turn"), "record").join(labels.select("label"), "label", "left_anti")
        fresh = brought.groupBy("label").agg(F.min_by(F.struct("turn", F.col("record").alias("via")), "turn").alias("x")).select("label", "x.*")
        top = labels.agg(F.max("place")).first()[0]
        fresh = numbered(fresh, [F.col("turn"), F.col("label")], "n").select((F.col("n") + (top + 1 if top is not None else 0)).alias("place"), "label", F.lit(None).cast(labels.schema["after"].dataType).alias("after"), "via", F.lit(True).alias("open"))
        if last is None:
            closed = labels.withColumn("open", F.lit(False))
        else:
            inside = following.place == last.place
            still = F.col("open") & ((F.col("place") > last.place) | (F.lit(inside) & (F.col("place") == last.place)))
            closed = labels.withColumn("after", F.when(F.lit(inside) & (F.col("place") == last.place), F.lit(last.record).cast(labels.schema["after"].dataType)).otherwise(F.col("after"))).withColumn("open", still)
        labels = settled(closed.unionByName(fresh))
        room -= n
    return _save(spark, walk.scope, found, labels)
