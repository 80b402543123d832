"""What a question may see before a query runs: tables within reach, columns and joins by clearance, names with and without schema,
and what a query's columns come from, as Spark's own analysis tells.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.rounds import settled

#: Words by which a question asks for several columns, and by which it asks for a single value.
SEVERAL = r"(?i)\b(list|which|who|whom|names?|top\s+\d+|for each|per|each|every|by|rank|show me all)\b|列出|哪些|哪个|每个|分别|各|按|排名|前\s*\d+"
SINGLE = (
    r"(?i)\bhow many\b|\bhow much\b|\bwhat(?:'s| is) the\b[^.?]*\b(average|total|number|count|percentage|rate|ratio|maximum|minimum|highest|lowest|largest|smallest)\b|"
    r"\bwhat percentage\b|\bwhat fraction\b|多少|几(?:个|家|条|张|种)?|总数|平均|比例|占比|率|最高|最低|最大|最小"
)
#: Levels of secrecy, in order.
LEVELS = ("public", "internal", "confidential", "secret")


def parts(name: Column) -> Column:
    """A table's name as its parts, in lower case and without quotes; empty if there is none behind the last dot."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[\[\]`\"]", ""))
    return F.when(bare.endswith("."), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(bare, r"\."), lambda p: F.trim(p)), lambda p: p != ""))


def same_name(pairs: DataFrame, a: str, b: str) -> Column:
    """Whether one name ends with the other, part by part: orders is sales.orders, sales.orders is not archive.orders."""
    x, y = parts(F.col(a)), parts(F.col(b))
    short = F.least(F.size(x), F.size(y))
    return (short > 0) & (F.slice(F.reverse(x), F.lit(1), short) == F.slice(F.reverse(y), F.lit(1), short))


def resolved(names: DataFrame, tables: DataFrame) -> DataFrame:
    """(name, table_name) for each name the tables that it may mean, joined by the last part, then told apart by the rest."""
    last = lambda c: F.element_at(parts(F.col(c)), -1)
    left = names.select("name").distinct().where(F.size(parts(F.col("name"))) > 0).withColumn("_p", last("name"))
    right = tables.select("table_name").distinct().where(F.size(parts(F.col("table_name"))) > 0).withColumn("_p", last("table_name"))
    both = left.join(right, "_p")
    return both.where(same_name(both, "name", "table_name")).select("name", "table_name")


def reachable(anchor: DataFrame, joins: DataFrame, lineage: DataFrame, known: DataFrame, hops: int = 3) -> DataFrame:
    """(table_name, hop): the tables that a query about the anchor tables (table_name) may read.

    They are the anchors, and of the ends of lineage edges those that are known and within so many hops of joins and lineage; both are
    (from_table, to_table) and lead either way. A table of joins alone is passed through but not allowed. No anchors: none.
    """
    one = joins.select("from_table", "to_table").union(lineage.select("from_table", "to_table")).where("from_table <> '' and to_table <> ''")
    edges = settled(one.union(one.select("to_table", "from_table")).distinct())
    start = anchor.select("table_name").where("table_name <> ''").distinct().withColumn("hop", F.lit(0))
    found = front = settled(start)
    for hop in range(1, hops + 1):
        step = edges.join(front.select(F.col("table_name").alias("from_table")), "from_table").select(F.col("to_table").alias("table_name")).distinct()
        front = settled(step.join(found, "table_name", "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        found = settled(found.union(front))
    ends = lineage.select(F.col("from_table").alias("table_name")).union(lineage.select("to_table")).distinct().join(known.select("table_name"), "table_name", "left_semi")
    return found.where("hop = 0").union(found.where("hop > 0").join(ends, "table_name", "left_semi"))


def rank(level: Column) -> Column:
    """The place of a level of secrecy, the least if there is none, above all if it is unknown."""
    known = F.when(level.isNull() | (level == ""), 0)
    for i, name in enumerate(LEVELS):
        known = known.when(F.lower(level) == name, i)
    return known.otherwise(len(LEVELS))


def visible_columns(columns: DataFrame, levels: DataFrame, clearance: str) -> DataFrame:
    """columns (table_name, column_name, ...) without secret ones, if the clearance is below that; levels is (table_name, column_name, level).

    A level of a table (column_name null) holds for all its columns; the highest of all that apply counts.
    """
    if LEVELS.index(clearance) >= LEVELS.index("secret"):
        return columns
    secret = levels.where(rank(F.col("level")) >= LEVELS.index("secret"))
    named = secret.where("column_name is not null").select("table_name", "column_name").distinct()
    whole = secret.where("column_name is null").select("table_name").distinct()
    return columns.join(named, ["table_name", "column_name"], "left_anti").join(whole, "table_name", "left_anti")


def visible_joins(edges: DataFrame, levels: DataFrame, clearance: str) -> DataFrame:
    """edges (from_table, from_column, to_table, to_column, ...) that lead over no secret column, if the clearance is below that."""
    if LEVELS.index(clearance) >= LEVELS.index("secret"):
        return edges
    ends = edges.select(F.col("from_table").alias("table_name"), F.col("from_column").alias("column_name")).union(edges.select("to_table", "to_column")).distinct()
    seen = visible_columns(ends, levels, clearance)
    kept = edges
    for t, c in (("from_table", "from_column"), ("to_table", "to_column")):
        kept = kept.join(seen.select(F.col("table_name").alias(t), F.col("column_name").alias(c)), [t, c], "left_semi")
    return kept.select(*edges.columns)


def sources(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> dict[str, set[tuple[str, str]]]:
    """By each column that a query returns, the columns (table, column) that its values come from, through expressions, joins and subqueries.

    The query is analysed, by Spark, over empty stand-ins of the tables, in a session of its own, and not run. Columns that a query
    only filters, groups or sorts by are not among a column's sources; used() has those too.
    """
    return _traced(spark, sql, tables)[0]


def used(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> set[tuple[str, str]]:
    """All columns (table, column) that a query reads anywhere."""
    return _traced(spark, sql, tables)[1]


def _traced(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> tuple[dict[str, set[tuple[str, str]]], set[tuple[str, str]]]:
    session = spark.newSession()
    origin: dict[int, tuple[str, str]] = {}
    for name, rows in tables.items():
        session.createDataFrame([], rows.schema).createOrReplaceTempView(name)
    plan = session.sql(sql)._jdf.queryExecution().analyzed()
    holds_plan = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    each = lambda items: [items.apply(i) for i in range(items.length())]
    kind = lambda node: node.getClass().getSimpleName()
    steps: dict[int, set[int]] = {}
    met: set[int] = set()

    def references(node) -> set[int]:
        found = {node.exprId().id()} if kind(node) in ("AttributeReference", "OuterReference") and hasattr(node, "exprId") else set()
        if kind(node) == "OuterReference":
            found = references(node.e())
        if holds_plan.isInstance(node):
            walk(node.plan())
            found |= {a.exprId().id() for a in each(node.plan().output())}
        for child in each(node.children()):
            found |= references(child)
        return found

    def walk(node) -> None:
        name = kind(node)
        if name == "SubqueryAlias" and kind(node.child()) == "View":
            table = node.identifier().name().lower()
            for a in each(node.child().output()):
                origin[a.exprId().id()] = (table, a.name().lower())
            return
        if name == "WithCTE":
            for d in each(node.cteDefs()):
                walk(d)
                ctes[d.id()] = each(d.output())
            walk(node.plan())
            return
        if name == "CTERelationRef":
            for mine, theirs in zip(each(node.output()), ctes[node.cteId()], strict=True):
                steps.setdefault(mine.exprId().id(), set()).add(theirs.exprId().id())
            return
        for child in each(node.children()):
            walk(child)
        if name in ("Union", "Intersect", "Except"):
            for child in each(node.children()):
                for mine, theirs in zip(each(node.output()), each(child.output()), strict=True):
                    if mine.exprId().id() != theirs.exprId().id():
                        steps.setdefault(mine.exprId().id(), set()).add(theirs.exprId().id())
        for e in each(node.expressions()):
            told = references(e)
            met.update(told)
            stack = [e]
            while stack:
                x = stack.pop()
                if kind(x) == "Alias":
                    steps.setdefault(x.exprId().id(), set()).update(references(x.child()))
                stack += each(x.children())
        if name == "Generate":
            told = references(node.generator())
            for a in each(node.generatorOutput()):
                steps.setdefault(a.exprId().id(), set()).update(told)

    ctes: dict[int, list] = {}
    walk(plan)

    def ends(start: set[int]) -> set[tuple[str, str]]:
        seen, open_ = set(), list(start)
        while open_:
            x = open_.pop()
            if x not in seen:
                seen.add(x)
                open_ += steps.get(x, ())
        return {origin[x] for x in seen if x in origin}

    columns = {a.name(): ends({a.exprId().id()}) for a in each(plan.output())}
    return columns, ends(met | {a.exprId().id() for a in each(plan.output())})


def wide(columns: int, star: bool, question: str) -> str | None:
    """What is wrong with the shape of a query's result for a question: select_star, wide_scalar (a single value was asked for) or nothing."""
    if star:
        return "select_star"
    if re.search(SEVERAL, question or "") or not re.search(SINGLE, question or ""):
        return None
    return "wide_scalar" if columns > 1 else None


def shape(spark: SparkSession, sql: str) -> tuple[int, bool] | None:
    """How many columns a query's outermost selection names, and whether it takes all there are; None for what cannot be read."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:  # what cannot be read is the gate's to refuse
        return None
    kind = lambda node: node.getClass().getSimpleName()
    while kind(plan) not in ("Project", "Aggregate") and plan.children().length():
        plan = plan.children().apply(0)
    if kind(plan) not in ("Project", "Aggregate"):
        return None
    items = plan.projectList() if kind(plan) == "Project" else plan.aggregateExpressions()
    return items.length(), any("Star" in kind(items.apply(i)) for i in range(items.length()))
