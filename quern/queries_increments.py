"""Registered queries of increments, identity, scope, judging and the sink, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import scalar
from quern.operators import catalog, identity, increments, judging, nested, repository, scope
from quern.registry import Tables, query
from quern.streaming import sink

SAID = (
    "a AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem WHERE l_linestatus = 'O'), "
    "p AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'A'), m AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem WHERE l_discount < 0.03), "
    "b AS ((FROM a EXCEPT FROM m) UNION FROM p)"
)


def _facts(t: Tables) -> tuple[increments.Facts, DataFrame]:
    """Which supplier delivers which part, as orders say; the delta takes orders in and withdraws others."""
    lines = t("lineitem").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("source"), "l_linestatus", "l_returnflag", "l_discount")
    state = increments.facts(lines.where("l_linestatus = 'O'"), ["l_partkey", "l_suppkey"])
    ops = [lines.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey", "source", F.lit("add").alias("op")), lines.where("l_discount < 0.03").select("l_partkey", "l_suppkey", "source", F.lit("remove").alias("op"))]
    return state, increments.apply(state, ops[0].union(ops[1]))


@query("facts_after_delta", f"WITH {SAID} SELECT l_partkey, l_suppkey, count(*) AS support FROM b GROUP BY 1, 2")
def facts_after_delta(t: Tables) -> DataFrame:
    state, change = _facts(t)
    return state.facts(change.sparkSession)


query(
    "facts_changed",
    f"WITH {SAID}, x AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM a GROUP BY 1, 2), y AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM b GROUP BY 1, 2) "
    "SELECT coalesce(x.l_partkey, y.l_partkey) AS l_partkey, coalesce(x.l_suppkey, y.l_suppkey) AS l_suppkey, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after "
    "FROM x FULL JOIN y ON x.l_partkey = y.l_partkey AND x.l_suppkey = y.l_suppkey WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)",
)(lambda t: _facts(t)[1])


@query(
    "links_withdrawn",
    "WITH l AS (SELECT l_suppkey AS page, l_partkey AS target, count(DISTINCT l_orderkey) FILTER (WHERE o_orderstatus = 'F') AS live FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) "
    "SELECT page::VARCHAR AS page, target::VARCHAR AS target, CASE WHEN live > 0 THEN 'supported_relation' ELSE 'navigation' END AS kind, live AS evidence FROM l WHERE page NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)",
)
def links_withdrawn(t: Tables) -> DataFrame:
    """Suppliers' links to parts after orders that are not finished, and suppliers in debt, went away."""
    text = lambda c: F.col(c).cast("string")
    evidence = F.collect_set(text("l_orderkey"))  # of one supplier and part
    lines = t("lineitem").select(text("l_suppkey").alias("page"), text("l_partkey").alias("target"), "l_orderkey")
    parts = -(-lines.count() // 500_000) or 1  # so the memory of a task does not grow with the lines
    links = lines.repartition(parts, "page", "target").groupBy("page", "target").agg(F.lit("supported_relation").alias("kind"), F.lit("delivers").alias("relation"), evidence.alias("evidence"))
    live = t("orders").where("o_orderstatus = 'F'").select(text("o_orderkey").alias("evidence_id"))
    found = increments.withdrawn_links(links, live, t("supplier").where("s_acctbal < 0").select(text("s_suppkey").alias("page")), parts)
    return found.select("page", "target", "kind", F.size("evidence").cast("long").alias("evidence"))


PAGES = (
    "pages AS (SELECT 'part/' || p_brand || '/' || p_partkey AS path, p_name AS title, p_type AS description, p_size AS n FROM part UNION ALL SELECT 'supplier/' || s_suppkey, s_name, 'x', 20 FROM supplier), "
    "b AS (SELECT path, title, description FROM pages WHERE n <= 40), a AS (SELECT path, CASE WHEN n % 7 = 3 THEN title || '!' ELSE title END AS title, description FROM pages WHERE n >= 5), "
    "k AS (SELECT DISTINCT 'part/' || p_brand || '/' || p_partkey AS path, 'supplier/' || l_suppkey AS target, l_linestatus AS s FROM lineitem JOIN part ON l_partkey = p_partkey), "
    "o AS (SELECT path, target FROM k WHERE s = 'F'), w AS (SELECT path, target FROM k WHERE s = 'O'), t AS (SELECT path FROM pages WHERE n < 5 OR n > 40 OR n % 7 = 3), "
    "z AS (SELECT t.path, b.title AS bt, a.title AS an, b.path IS NOT NULL AS hb, a.path IS NOT NULL AS ha, b.description AS bd, a.description AS ad FROM t LEFT JOIN b USING (path) LEFT JOIN a USING (path)), "
    "moved AS (SELECT path FROM z WHERE hb <> ha OR bt IS DISTINCT FROM an), e AS (SELECT * FROM o UNION SELECT * FROM w), "
    "ch AS (SELECT * FROM ((SELECT * FROM o EXCEPT SELECT * FROM w) UNION (SELECT * FROM w EXCEPT SELECT * FROM o)) WHERE path IN (FROM t)), "
    "r AS (SELECT path FROM z WHERE ha UNION SELECT target FROM ch UNION SELECT path FROM e WHERE target IN (FROM moved) UNION SELECT target FROM e WHERE path IN (FROM moved))"
)


@query(
    "impact_of_changes",
    f"WITH {PAGES} SELECT path, 'render' AS action FROM r WHERE path IN (SELECT path FROM a) UNION ALL SELECT path, 'remove' FROM z WHERE hb AND NOT ha "
    "UNION ALL SELECT DISTINCT regexp_replace(path, '/[^/]*$', ''), 'index' FROM z WHERE (hb <> ha OR bt IS DISTINCT FROM an OR bd IS DISTINCT FROM ad) AND regexp_replace(path, '/[^/]*$', '') IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM a)",
)
def impact_of_changes(t: Tables) -> DataFrame:
    """Pages of parts and suppliers: small parts are new, large ones gone, some are renamed, and links follow the lines of orders."""
    path = F.concat(F.lit("part/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"))
    supplier = lambda key: F.concat(F.lit("supplier/"), F.col(key).cast("string"))
    pages = t("part").select(path.alias("path"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.col("p_size").alias("n"))
    pages = pages.union(t("supplier").select(supplier("s_suppkey"), "s_name", F.lit("x"), F.lit(20)))
    renamed = F.when(F.col("n") % 7 == 3, F.concat("title", F.lit("!"))).otherwise(F.col("title"))
    before = pages.where("n <= 40").select("path", "title", "description")
    after = pages.where("n >= 5").select("path", renamed.alias("title"), "description")
    links = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(path.alias("path"), supplier("l_suppkey").alias("target"), "l_linestatus").distinct()
    old, new = (links.where(F.col("l_linestatus") == s).select("path", "target") for s in "FO")
    return increments.impact(before, after, old, new, pages.where("n < 5 or n > 40 or n % 7 = 3").select("path"))


DEPENDS = "e AS (SELECT DISTINCT 'p' || l_partkey AS node, 's' || l_suppkey AS dep FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


@query(
    "dependents_of_region",
    f"WITH RECURSIVE {DEPENDS}, d AS (SELECT 'r1' AS node, 0 AS round UNION SELECT e.node, d.round + 1 FROM d JOIN e ON e.dep = d.node) SELECT node, min(round) AS round FROM d GROUP BY 1",
)
def dependents_of_region(t: Tables) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = t("lineitem").select(name("p", "l_partkey").alias("node"), name("s", "l_suppkey").alias("on")).distinct()
    edges = edges.union(t("supplier").select(name("s", "s_suppkey"), name("n", "s_nationkey"))).union(t("nation").select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    return increments.dependents(edges, t("region").where("r_regionkey = 1").select(name("r", "r_regionkey").alias("node")))


OCCUR = "o AS (SELECT o_orderkey AS r, 'c' || o_custkey AS l FROM orders UNION SELECT o_orderkey, 'w' || strftime(o_orderdate, '%Y%m') FROM orders)"


@query(
    "walk_in_calls",
    f"WITH {OCCUR}, one AS (SELECT r FROM o WHERE l IN ('c1', 'c4') ORDER BY l, r), ord AS (SELECT r, row_number() OVER (ORDER BY min(l), r) - 1 AS place FROM o WHERE l IN ('c1', 'c4') GROUP BY r), "
    "lab AS (SELECT l, min(place) AS p FROM o JOIN ord USING (r) WHERE l NOT IN ('c1', 'c4') GROUP BY l), q AS (SELECT l, row_number() OVER (ORDER BY p, l) AS k FROM lab), "
    "two AS (SELECT r, min(k) AS k FROM o JOIN q USING (l) WHERE r NOT IN (SELECT r FROM ord) GROUP BY r), "
    "every AS (SELECT r, 0 AS level, place AS k FROM ord UNION ALL SELECT r, 1, k FROM two) SELECT row_number() OVER (ORDER BY level, k, r) - 1 AS place, r AS record FROM every ORDER BY place LIMIT 60",
)
def walk_in_calls(t: Tables) -> DataFrame:
    """The first orders that a walk from two customers meets, over customers and months, in three calls."""
    rows = t("orders").select(F.col("o_orderkey").alias("record"), F.explode(F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("w"), F.date_format("o_orderdate", "yyyyMM")))).alias("label"))
    spark = rows.sparkSession
    walk = increments.begin(rows, spark.createDataFrame([("c1",), ("c4",)], "label string"))
    for most in (7, 13, 40):
        walk = increments.go_on(walk, rows, most)
    return walk.records(spark).select("place", "record")


FORMS = (
    "f AS (SELECT c_custkey AS id, c_mktsegment || CASE WHEN c_acctbal < 0 THEN ' ltd' ELSE '' END AS name, CASE WHEN c_nationkey % 5 = 0 THEN c_mktsegment END AS alias, "
    "CASE WHEN c_nationkey = 3 THEN 'g' || (c_custkey % 4) END AS xid, CASE WHEN c_acctbal > 5000 THEN 'topic' ELSE 'entity' END AS kind, CASE WHEN c_nationkey <> 7 THEN 'n' || c_nationkey ELSE '' END AS context FROM customer)"
)


def _forms(t: Tables) -> DataFrame:
    nation, number = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    return t("customer").select(
        F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.when(F.col("c_acctbal") < 0, " LTD").otherwise("")).alias("name"), F.when(nation % 5 == 0, F.array("c_mktsegment")).alias("aliases"),
        F.lit(None).cast("array<string>").alias("related"), F.when(nation == 3, F.concat(F.lit("g"), (F.col("c_custkey") % 4).cast("string"))).alias("explicit_id"),
        F.when(F.col("c_acctbal") > 5000, "topic").otherwise("entity").alias("kind"), F.when(nation != 7, F.concat(F.lit("n"), nation.cast("string"))).alias("context"), number.alias("_n"),
    ).drop("_n")


@query(
    "identity_decided",
    f"WITH {FORMS}, p AS (SELECT a.id AS l, b.id AS r, a.name AS an, b.name AS bn, a.alias AS aa, b.alias AS ba, a.xid AS ax, b.xid AS bx, a.kind AS ak, b.kind AS bk, a.context AS ac, b.context AS bc FROM f a JOIN f b ON b.id = a.id + 1), "
    "q AS (SELECT *, lower(an) = lower(bn) AS same, coalesce(lower(aa) = lower(bn), false) OR coalesce(lower(ba) = lower(an), false) AS alias, ac = bc AND ac <> '' AS ctx FROM p) "
    "SELECT l AS \"left\", r AS \"right\", CASE WHEN ax = bx THEN 'same' WHEN ax <> bx THEN 'different' WHEN ak <> bk THEN 'undetermined' WHEN (same OR alias) AND ctx THEN 'same' ELSE 'undetermined' END AS decision, "
    "CASE WHEN ax = bx THEN 'explicit_identifier' WHEN ax <> bx THEN 'conflicting_identifier' WHEN ak <> bk THEN 'topic_kept_separate' WHEN same AND ctx THEN 'name_and_context' WHEN alias AND ctx THEN 'alias_and_context' "
    "WHEN same OR alias THEN 'same_name_other_context' ELSE 'no_identifier' END AS basis FROM q",
)
def identity_decided(t: Tables) -> DataFrame:
    pairs = t("customer").select(F.col("c_custkey").alias("left"), (F.col("c_custkey") + 1).alias("right"))
    return identity.decided(pairs, _forms(t))


@query(
    "identity_groups",
    f"WITH {FORMS}, g AS (SELECT id, kind, context, name, CASE WHEN alias IS NOT NULL AND alias || ' ltd' = name AND EXISTS (SELECT 1 FROM f y WHERE y.kind = f.kind AND y.context = f.context AND y.name = f.alias) THEN alias ELSE name END AS root FROM f) "
    "SELECT id, CASE WHEN context = '' THEN id ELSE min(id) OVER (PARTITION BY kind, context, root) END AS same_as, false AS conflict FROM g",
)
def identity_groups(t: Tables) -> DataFrame:
    """Customers as forms of names, without identifiers, which would chain contexts further than a grouping in SQL follows."""
    return identity.groups(_forms(t).withColumn("explicit_id", F.lit(None).cast("string")))


@query(
    "tables_reachable",
    "WITH e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders), l AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem), "
    "h1 AS (SELECT DISTINCT b FROM e WHERE a = 'c1'), h2 AS (SELECT DISTINCT l.b FROM l JOIN h1 ON l.a = h1.b), h3 AS (SELECT DISTINCT l.a FROM l JOIN h2 ON l.b = h2.b WHERE l.a NOT IN (FROM h1)) "
    "SELECT 'c1' AS table_name, 0 AS hop UNION ALL SELECT b, 1 FROM h1 WHERE b IN (SELECT a FROM l) UNION ALL SELECT b, 2 FROM h2 UNION ALL SELECT a, 3 FROM h3",
)
def tables_reachable(t: Tables) -> DataFrame:
    """What is within three steps of a customer, over orders (joins) and their parts (lineage)."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    joins = t("orders").select(name("c", "o_custkey").alias("from_table"), name("o", "o_orderkey").alias("to_table"))
    lineage = t("lineitem").select(name("o", "l_orderkey").alias("from_table"), name("p", "l_partkey").alias("to_table"))
    known = lineage.select(F.col("from_table").alias("table_name")).union(lineage.select("to_table")).distinct()
    return scope.reachable(t("customer").where("c_custkey = 1").select(name("c", "c_custkey").alias("table_name")), joins, lineage, known)


@query(
    "columns_cleared",
    "WITH c AS (SELECT p_brand AS table_name, p_partkey::VARCHAR AS column_name, CASE WHEN p_size > 45 THEN 'secret' WHEN p_size > 30 THEN 'confidential' END AS level FROM part), "
    "w AS (SELECT p_brand FROM part GROUP BY 1 HAVING avg(p_size) > 26) SELECT table_name, column_name FROM c WHERE coalesce(level, '') <> 'secret' AND table_name NOT IN (FROM w)",
)
def columns_cleared(t: Tables) -> DataFrame:
    columns = t("part").select(F.col("p_brand").alias("table_name"), F.col("p_partkey").cast("string").alias("column_name"), "p_size")
    levels = columns.select("table_name", "column_name", F.when(F.col("p_size") > 45, "secret").when(F.col("p_size") > 30, "confidential").alias("level")).where("level is not null")
    whole = columns.groupBy("table_name").agg(F.avg("p_size").alias("m")).where("m > 26").select("table_name", F.lit(None).cast("string"), F.lit("secret"))
    return scope.visible_columns(columns.drop("p_size"), levels.union(whole), "confidential")


@query(
    "names_resolved",
    "WITH t AS (SELECT DISTINCT lower(c_mktsegment) || '.n' || c_nationkey AS table_name FROM customer), n AS (SELECT DISTINCT 'N' || s_nationkey AS name FROM supplier UNION SELECT DISTINCT c_mktsegment || '.\"N' || c_nationkey || '\"' FROM customer WHERE c_acctbal > 9000) "
    "SELECT name, table_name FROM n, t WHERE (contains(name, '.') AND lower(replace(name, '\"', '')) = table_name) OR (NOT contains(name, '.') AND split_part(table_name, '.', 2) = lower(name))",
)
def names_resolved(t: Tables) -> DataFrame:
    tables = t("customer").select(F.concat(F.lower("c_mktsegment"), F.lit(".n"), F.col("c_nationkey").cast("string")).alias("table_name"))
    names = t("supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("name"))
    names = names.union(t("customer").where("c_acctbal > 9000").select(F.concat("c_mktsegment", F.lit('."N'), F.col("c_nationkey").cast("string"), F.lit('"'))))
    return scope.resolved(names, tables)


@query(
    "results_matched",
    "SELECT o_custkey AS \"case\", bool_and(o_orderstatus <> 'P') AS matched, CASE WHEN bool_and(o_orderstatus <> 'P') THEN 0 END::BIGINT AS truth_no, false AS too_large FROM orders GROUP BY 1",
)
def results_matched(t: Tables) -> DataFrame:
    """Each customer's orders as a result table, and an answer with rows and cells turned round, whose prices are off where an order is pending."""
    truth = t("orders").select(F.col("o_custkey").alias("case"), F.lit(0).cast("long").alias("truth_no"), F.array(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), "o_orderpriority").alias("cells"))
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") * 3 + 1000).otherwise(F.col("o_totalprice") + 0.25)
    answer = t("orders").select(F.col("o_custkey").alias("case"), F.array("o_orderpriority", price.cast("string"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).alias("cells"))
    return judging.matched(truth, answer)


@query(
    "sink_totals",
    "SELECT day, round(sum(tokens), 2) AS tokens, sum(calls) AS calls FROM (SELECT event_id % 4 AS b, strftime(ts, '%Y-%m-%d') AS day, sum(value) AS tokens, count(*) AS calls FROM events WHERE event_type <> 'error' GROUP BY 1, 2) GROUP BY 1",
)
def sink_totals(t: Tables) -> DataFrame:
    """All events in four batches, two of which come again in another order; errors are dropped."""
    rows = t("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("value").alias("tokens"), "event_type", F.col("event_id").alias("at"))
    made = sink.sink(rows.sparkSession, ["event_id"], {"failed": F.col("event_type") == "error"}, ["day"], ["tokens"])
    for number in (0, 1, 2, 1, 3, 0):
        made.write(rows.where(F.col("event_id") % 4 == number), number)
    return made.totals(rows.sparkSession).select("day", F.round("tokens", 2).alias("tokens"), "calls")


@query(
    "lines_unnested",
    "SELECT l_orderkey, l_partkey AS part, p_brand, l_quantity AS quantity, nullif(l_returnflag, 'N') AS flag FROM lineitem JOIN part ON l_partkey = p_partkey",
)
def lines_unnested(t: Tables) -> DataFrame:
    """The lines of each order as JSON, taken apart again and joined with their parts."""
    flag = F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag"))
    lines = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), flag.alias("flag"), "l_linenumber", "l_extendedprice")
    whole = nested.built(lines, "l_orderkey", ["part", "quantity", "flag"], ["l_linenumber", "part", "l_extendedprice"])
    flat = nested.unnested(whole, "items", "part bigint, quantity double, flag string")
    return flat.join(t("part").select(F.col("p_partkey").alias("part"), "p_brand"), "part").select("l_orderkey", "part", "p_brand", "quantity", "flag")


@query(
    "objects_salvaged",
    "WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) "
    "SELECT l_orderkey, (n - 1)::INT AS position, '{\"part\":' || l_partkey || '}' AS object FROM l WHERE n < c",
)
def objects_salvaged(t: Tables) -> DataFrame:
    """The lines of each order as JSON that was cut off inside of the last object."""
    lines = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), "l_linenumber", "l_extendedprice")
    whole = nested.built(lines, "l_orderkey", ["part"], ["l_linenumber", "part", "l_extendedprice"])
    return nested.salvaged(whole.select("l_orderkey", F.expr("left(items, length(items) - 2)").alias("items")), "items").select("l_orderkey", "position", "object")


query(
    "edges_stale",
    "SELECT o_orderkey, (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 400 DAY) AS stale FROM orders",
)(
    lambda t: catalog.with_stale(t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "platform").otherwise("manual").alias("origin"), F.col("o_orderdate").cast("string").alias("last_seen_at")), "2001-01-01 00:00:00", 400).select("o_orderkey", "stale")
)
query(
    "documents_without_signature",
    "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderdate, o_orderkey LIMIT 100",
)(
    lambda t: repository.without_signature(
        t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("new").alias("status"), F.lit(0).alias("is_deleted"), F.col("o_orderdate").alias("created_at")),
        t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id")), 100,
    ).select("id")
)
query(
    "scalars_equal",
    "SELECT count(*) AS n, count(DISTINCT l_quantity::INT) AS different, 0 AS apart FROM lineitem",
)(
    lambda t: t("lineitem").select(scalar.norm_number(F.col("l_quantity").cast("string")).alias("a"), scalar.norm_number(F.concat(F.lit("+0"), F.col("l_quantity").cast("int").cast("string"), F.lit(".000"))).alias("b"))
    .agg(F.count("*").alias("n"), F.count_distinct("a").alias("different"), F.count_if(F.col("a") != F.col("b")).cast("int").alias("apart"))
)
