"""Registered queries of monitoring, governance and the catalogue, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import catalog, governance, monitor
from quern.registry import Tables, query

GOOD, BAD = "value >= 50", "value < 10"
_RATE = f"round(count(*) FILTER (WHERE {GOOD})::DOUBLE / nullif(count(*) FILTER (WHERE {GOOD} OR {BAD}), 0), 6)"

query(
    "monitor_object_list",
    f"SELECT coalesce(json_extract_string(props, '$.tool'), event_type) AS object_id, CASE WHEN user_id % 3 <> 0 THEN 'p' || user_id % 3 END AS protocol, count(*) AS calls, count(*) FILTER (WHERE {GOOD}) AS succeeded, "
    f"count(*) FILTER (WHERE {BAD}) AS failed, {_RATE} AS success_rate, max(ts) AS last_at FROM events WHERE (CASE WHEN user_id % 3 <> 0 THEN 'p' || user_id % 3 END) IS DISTINCT FROM 'p2' GROUP BY 1, 2 ORDER BY calls DESC, 1, 2 NULLS FIRST LIMIT 20 OFFSET 1",
)(
    lambda t: monitor.objects(
        t("events").withColumn("protocol", F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("p"), F.col("user_id") % 3))),
        F.coalesce(F.get_json_object("props", "$.tool"), "event_type"), "protocol", F.expr(GOOD), F.expr(BAD), "ts", 20, 1, "p2",
    )
)
query(
    "monitor_top_sources",
    "WITH e AS (SELECT event_type, user_id % 17 AS source, CASE WHEN user_id % 5 > 0 THEN user_id % 5 END AS tenant FROM events), "
    "s AS (SELECT event_type, source, count(*) AS calls, count(DISTINCT tenant) + max(CASE WHEN tenant IS NULL THEN 1 ELSE 0 END) AS tenants FROM e GROUP BY 1, 2) "
    "SELECT event_type, source, calls, tenants::INT AS tenants, row_number() OVER (PARTITION BY event_type ORDER BY calls DESC, source)::INT AS place FROM s QUALIFY place <= 3",
)(lambda t: monitor.top_sources(t("events").select("event_type", (F.col("user_id") % 17).alias("source"), F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 5).alias("tenant")), "event_type", "source", "tenant"))
query(
    "monitor_failure_list",
    f"SELECT event_id, ended FROM (SELECT event_id, value, CASE WHEN event_id % 3 > 0 THEN ts END AS ended FROM events) WHERE {BAD} ORDER BY ended DESC NULLS LAST, event_id LIMIT 50",
)(lambda t: monitor.last_failures(t("events").withColumn("ended", F.when(F.col("event_id") % 3 > 0, F.col("ts"))), F.expr(BAD), "ended", "event_id", 50).select("event_id", "ended"))
query(
    "monitor_half_open",
    "SELECT event_type, count(*) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-09' GROUP BY 1",
)(lambda t: monitor.between(t("events"), "ts", "2024-01-02", "2024-01-09").groupBy("event_type").agg(F.count("*").alias("total")))
query(
    "token_summary",
    "SELECT o_orderpriority, round(sum(tokens), 2) AS tokens, count(DISTINCT o_orderstatus) AS models, round(count(*) FILTER (WHERE tokens > 0) / count(*)::DOUBLE, 6) AS completeness, "
    "round(sum(tokens) FILTER (WHERE tokens > 0) / nullif(count(*) FILTER (WHERE tokens > 0), 0), 4) AS per_metered FROM (SELECT *, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice ELSE 0 END AS tokens FROM orders) GROUP BY 1",
)(lambda t: monitor.token_summary(t("orders").withColumn("tokens", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")).otherwise(0.0)), "tokens", "o_orderstatus", ["o_orderpriority"]))
for _name, _down in (("token_usage_nulls_last", True), ("token_usage_ascending", False)):
    query(
        _name,
        "SELECT model, count(*) AS calls, round(sum(tokens), 2) AS tokens, round(avg(tokens), 4) AS mean_tokens FROM (SELECT l_suppkey AS model, CASE WHEN l_suppkey % 4 > 0 THEN l_quantity END AS tokens FROM lineitem) "
        f"GROUP BY 1 ORDER BY mean_tokens {'DESC' if _down else 'ASC'} NULLS LAST, model LIMIT 8",
    )(lambda t, down=_down: monitor.usage_by(t("lineitem").select(F.col("l_suppkey").alias("model"), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_quantity")).alias("tokens")), "model", "tokens", "mean_tokens", down, 8))
query(
    "trend_closed",
    "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, event_type, count(*) AS total, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY <= TIMESTAMP '2024-01-15 12:00:00' AS closed FROM events GROUP BY 1, 2",
)(lambda t: monitor.closed(monitor.trend(t("events"), "ts", "day", ["event_type"], "value").drop("sum_value"), "1 day", "2024-01-15 12:00:00"))


def calls(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", (F.col("o_orderkey") % 6).cast("long").alias("told"), F.col("o_orderstatus").alias("state"))


def attempts(t: Tables) -> DataFrame:
    return t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))


query(
    "attempts_unreconciled",
    "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey, o_orderkey % 6 AS told, coalesce(n, 0) AS found FROM orders LEFT JOIN n ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'O' AND o_orderkey % 6 <> coalesce(n, 0)",
)(lambda t: monitor.unreconciled(calls(t), attempts(t), "o_orderkey", "told", F.col("state") == "O"))
query(
    "attempts_raised",
    "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey, greatest(o_orderkey % 6, coalesce(n, 0)) AS told FROM orders LEFT JOIN n ON o_orderkey = l_orderkey",
)(lambda t: monitor.raised(calls(t), attempts(t), "o_orderkey", "told").select("o_orderkey", "told"))
query(
    "current_attempt",
    "WITH c AS (SELECT l_orderkey, l_returnflag, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN c USING (l_orderkey, l_returnflag, l_linenumber) GROUP BY 1",
)(
    lambda t: t("lineitem").join(t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_linenumber").alias("l_linenumber")), ["l_orderkey", "l_returnflag", "l_linenumber"])
    .groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
)
query(
    "additive_rollup",
    "SELECT user_id % 50 AS tenant, date_trunc('day', ts)::TIMESTAMP AS bucket, round(sum(value), 2) AS value, count(*)::DOUBLE AS calls FROM events GROUP BY 1, 2",
)(
    lambda t: monitor.added(*[t("events").where(f"event_id % 2 = {i}").groupBy((F.col("user_id") % 50).alias("tenant"), monitor.bucket("ts", "day").alias("bucket")).agg(F.sum("value").alias("value"), F.count("*").cast("double").alias("calls")) for i in (0, 1)], ["tenant", "bucket"], ["value", "calls"])
)
query(
    "metric_compare_previous",
    "WITH s AS (SELECT sum(o_totalprice) FILTER (WHERE o_orderdate::DATE BETWEEN DATE '1996-03-01' AND DATE '1996-03-31') AS v, sum(o_totalprice) FILTER (WHERE o_orderdate::DATE BETWEEN DATE '1996-01-30' AND DATE '1996-02-29') AS b FROM orders) "
    "SELECT round(v, 2) AS value, round(b, 2) AS base, round(v - b, 2) AS absolute, round((v - b) / nullif(abs(b), 0) * 100, 4) AS pct FROM s",
)(lambda t: monitor.period_change(t("orders"), "o_orderdate", F.col("o_totalprice"), "1996-03-01", "1996-03-31"))

# Governance

_LEVEL = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CASE c_mktsegment WHEN 'BUILDING' THEN 'public' WHEN 'MACHINERY' THEN 'internal' WHEN 'FURNITURE' THEN 'confidential' ELSE 'secret' END END"


def classified(t: Tables) -> DataFrame:
    """Columns with levels, one for each customer: nation as table, name as column."""
    return t("customer").select(F.concat(F.lit("t"), "c_nationkey").alias("table_name"), F.lower("c_name").alias("column_name"), F.expr(_LEVEL).alias("level"))


def policies(t: Tables) -> DataFrame:
    return t("nation").select(
        F.concat(F.lit("p"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("id"), F.concat(F.lit("t"), F.col("n_nationkey") % 9).alias("table_name"),
        F.when(F.col("n_nationkey") % 2 == 0, F.lit("%1")).alias("column_pattern"), F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'deny' WHEN 1 THEN 'mask' ELSE 'allow' END").alias("effect"),
        (F.col("n_nationkey") % 4).alias("priority"), F.expr("CASE n_nationkey % 2 WHEN 0 THEN 'secret' ELSE 'internal' END").alias("min_clearance"), F.expr("CASE WHEN n_nationkey % 3 = 1 THEN 'partial' END").alias("mask"),
    )


query(
    "policy_decision",
    f"WITH c AS (SELECT 't' || c_nationkey AS table_name, lower(c_name) AS column_name, {_LEVEL} AS level FROM customer), "
    "p AS (SELECT 'p' || lpad(n_nationkey::VARCHAR, 2, '0') AS id, 't' || n_nationkey % 9 AS table_name, CASE WHEN n_nationkey % 2 = 0 THEN '%1' END AS pat, n_nationkey % 3 AS e, n_nationkey % 4 AS priority, CASE n_nationkey % 2 WHEN 0 THEN 3 ELSE 1 END AS least FROM nation), "
    "m AS (SELECT c.table_name, column_name, id, e, priority FROM c JOIN p ON c.table_name = p.table_name AND (pat IS NULL OR column_name LIKE pat) WHERE (e < 2 AND 1 < least) OR (e = 2 AND 1 >= least)), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY e, priority DESC, id) AS n FROM m) "
    "SELECT c.table_name, c.column_name, CASE WHEN e IS NOT NULL THEN ['deny', 'mask', 'allow'][e + 1] WHEN level IS NULL OR level IN ('public', 'internal') THEN 'allow' WHEN level = 'confidential' THEN 'mask' ELSE 'deny' END AS effect, id AS policy, "
    "CASE WHEN e = 1 THEN 'partial' WHEN e IS NULL AND level = 'confidential' THEN 'null' END AS mask FROM c LEFT JOIN b ON c.table_name = b.table_name AND c.column_name = b.column_name AND n = 1",
)(lambda t: governance.decided(classified(t), policies(t), "internal"))
query(
    "level_inherited",
    f"WITH c AS (SELECT c_custkey, coalesce({_LEVEL}, CASE WHEN c_nationkey % 3 = 0 THEN 'internal' END, CASE WHEN c_nationkey % 2 = 0 THEN 'odd' END) AS level FROM customer) SELECT c_custkey, level, CASE WHEN level IS NULL THEN -1 WHEN level = 'public' THEN 0 WHEN level = 'internal' THEN 1 WHEN level = 'confidential' THEN 2 WHEN level = 'secret' THEN 3 ELSE 1000000 END AS rank FROM c",
)(
    lambda t: t("customer").select("c_custkey", F.expr(_LEVEL).alias("_a"), F.when(F.col("c_nationkey") % 3 == 0, "internal").alias("_b"), F.when(F.col("c_nationkey") % 2 == 0, "odd").alias("_c"))
    .select("c_custkey", governance.inherited(t("customer"), ["_a", "_b", "_c"]).alias("level")).withColumn("rank", governance.rank(F.col("level")))
)
_NAMES = "lower(c_mktsegment) || CASE c_custkey % 6 WHEN 0 THEN '_phone' WHEN 1 THEN ' email' WHEN 2 THEN '_phone_id' WHEN 3 THEN 'phone' WHEN 4 THEN ' card_no address' WHEN 5 THEN CASE c_nationkey % 3 WHEN 0 THEN '_full_name' WHEN 1 THEN '护照' ELSE '-username-surname' END END"
query(
    "pii_names",
    f"WITH c AS (SELECT DISTINCT {_NAMES} AS column_name FROM customer), k AS (SELECT column_name, CASE WHEN column_name LIKE '% email' THEN 'email' WHEN column_name LIKE '% card_no address' THEN 'bank_card' WHEN column_name LIKE '%~_full~_name' ESCAPE '~' THEN 'name' "
    "WHEN column_name LIKE '%~_phone' ESCAPE '~' THEN 'phone' WHEN column_name LIKE '%护照' THEN 'passport' END AS kind FROM c) SELECT column_name, kind, CASE WHEN kind IN ('bank_card', 'passport') THEN 'secret' WHEN kind IS NOT NULL THEN 'confidential' END AS level, 'PII,' || upper(kind) AS tags FROM k",
)(lambda t: governance.named_kinds(t("customer").select(F.expr(_NAMES).alias("column_name")).distinct()).withColumn("tags", F.array_join("tags", ",")))
query(
    "issue_transitions",
    "WITH o AS (SELECT p_partkey AS rule FROM part WHERE p_size % 2 = 0), n AS (SELECT p_partkey AS rule, CASE p_size % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'passed' ELSE 'error' END AS outcome FROM part WHERE p_partkey % 10 > 0), "
    "j AS (SELECT coalesce(n.rule, o.rule) AS rule, o.rule IS NOT NULL AS open, outcome FROM n FULL JOIN o ON n.rule = o.rule) "
    "SELECT rule, CASE WHEN outcome = 'failed' THEN CASE WHEN open THEN 'kept' ELSE 'opened' END WHEN outcome = 'passed' AND open THEN 'closed' WHEN open THEN 'kept' END AS issue FROM j WHERE outcome = 'failed' OR open",
)(
    lambda t: governance.transitions(
        t("part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("rule")),
        t("part").where("p_partkey % 10 > 0").select(F.col("p_partkey").alias("rule"), F.expr("CASE p_size % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'passed' ELSE 'error' END").alias("outcome")),
    )
)


@query(
    "fk_direction",
    "WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders), b AS (SELECT DISTINCT c_custkey AS w FROM customer), s AS (SELECT count(v) AS n, count(w) AS m, count(*) FILTER (WHERE v IS NOT NULL AND w IS NOT NULL) AS shared FROM a FULL JOIN b ON v = w) "
    "SELECT 'o_custkey' AS \"left\", 'c_custkey' AS \"right\", CASE WHEN least(n, m) < 10 THEN NULL WHEN shared >= 0.8 * n AND (shared < 0.8 * m OR n <= m) THEN 'left' WHEN shared >= 0.8 * m THEN 'right' END AS foreign_side, shared FROM s",
)
def fk_direction(t: Tables) -> DataFrame:
    found = governance.containments([(t("orders"), "o_custkey", t("customer"), "c_custkey")])
    return t("orders").sparkSession.createDataFrame([(x["left"], x["right"], x["foreign"], x["shared"]) for x in found], "left string, right string, foreign_side string, shared long")


# Catalogue

query("catalog_keyword_like", r"SELECT o_orderkey, o_orderpriority || '_100%' AS title FROM orders WHERE (o_orderpriority || '_100%') ILIKE '%nt\_100\%%' ESCAPE '\'")(
    lambda t: t("orders").select("o_orderkey", F.concat("o_orderpriority", F.lit("_100%")).alias("title")).where(catalog.holds("title", "nt_100%"))
)
query(
    "json_array_member",
    "SELECT event_id FROM events WHERE event_id % 5 > 0 AND event_type IN ('click', 'view')",
)(lambda t: t("events").withColumn("tags", F.when(F.col("event_id") % 5 > 0, F.concat(F.lit('["x","'), F.when(F.col("event_type").isin("click", "view"), "hit").otherwise(F.col("event_type")), F.lit('"]'))).otherwise("broken")).where(catalog.member("tags", F.lit("hit"))).select("event_id"))

_JOINS = "j AS (SELECT 't' || l_partkey % 7 AS st, 'c' || l_partkey % 5 AS sc, 't' || l_suppkey % 6 AS dt, 'c' || l_suppkey % 4 AS dc, CASE l_linenumber % 4 WHEN 0 THEN 'declared' WHEN 1 THEN 'comment' WHEN 2 THEN 'naming' ELSE 'guess' END AS origin, CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS r FROM lineitem WHERE l_partkey % 7 <> l_suppkey % 6), "
_EDGES = _JOINS + "e AS (SELECT CASE WHEN (st, sc) < (dt, dc) THEN st ELSE dt END AS a_table, CASE WHEN (st, sc) < (dt, dc) THEN sc ELSE dc END AS a_column, CASE WHEN (st, sc) < (dt, dc) THEN dt ELSE st END AS b_table, CASE WHEN (st, sc) < (dt, dc) THEN dc ELSE sc END AS b_column, min(r) AS r FROM j GROUP BY 1, 2, 3, 4), o AS (SELECT DISTINCT r, origin FROM j)"


def joins(t: Tables) -> DataFrame:
    x = lambda a, c, n: F.concat(F.lit(a), F.col(c) % n)
    origin = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'declared' WHEN 1 THEN 'comment' WHEN 2 THEN 'naming' ELSE 'guess' END")
    return t("lineitem").where("l_partkey % 7 <> l_suppkey % 6").select(x("t", "l_partkey", 7).alias("src_table"), x("c", "l_partkey", 5).alias("src_column"), x("t", "l_suppkey", 6).alias("dst_table"), x("c", "l_suppkey", 4).alias("dst_column"), origin.alias("origin"))


query("join_edges", f"WITH {_EDGES} SELECT a_table, a_column, b_table, b_column, origin FROM e JOIN o USING (r)")(lambda t: catalog.join_edges(joins(t)))
query(
    "eligible_joins",
    f"WITH {_EDGES}, h AS (SELECT b_table AS other, a_column AS own_column, b_column AS other_column, r FROM e WHERE a_table = 't3' UNION ALL SELECT a_table, b_column, a_column, r FROM e WHERE b_table = 't3'), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY other ORDER BY r, own_column, other_column) AS n FROM h) SELECT other, own_column, other_column, origin FROM n JOIN o USING (r) ORDER BY n > 1, r, other, own_column, other_column LIMIT 20",
)(lambda t: catalog.eligible_joins(joins(t), "t3", 20))
query(
    "resolved_keys",
    f"WITH {_JOINS} g AS (SELECT st AS table_name, sc AS column_name, dt AS parent, origin, r FROM j) SELECT table_name, column_name, arg_min(parent, (r, parent)) AS parent, arg_min(origin, (r, parent)) AS origin, count(DISTINCT parent) - 1 AS conflicts FROM g GROUP BY 1, 2",
)(lambda t: catalog.resolved_keys(joins(t).select(F.col("src_table").alias("table_name"), F.col("src_column").alias("column_name"), F.col("dst_table").alias("parent"), "origin")))
query(
    "forbidden_joins",
    f"WITH {_EDGES} SELECT DISTINCT a_table, b_table FROM e WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 5 AND ((a_table = 't' || n_nationkey AND b_table = 't' || n_regionkey) OR (b_table = 't' || n_nationkey AND a_table = 't' || n_regionkey)))",
)(lambda t: catalog.allowed_joins(catalog.join_edges(joins(t)).select("a_table", "b_table").distinct(), t("nation").where("n_nationkey < 5").select(F.concat(F.lit("t"), "n_nationkey").alias("a"), F.concat(F.lit("t"), "n_regionkey").alias("b"))))
query(
    "star_edges",
    "WITH c AS (SELECT DISTINCT 't' || p_size AS table_name, lower(p_type) AS column_name FROM part UNION SELECT 't' || p_size, 'name' FROM part), h AS (SELECT column_name, min(table_name) AS hub FROM c GROUP BY 1 HAVING count(DISTINCT table_name) > 1) "
    "SELECT column_name, hub, table_name FROM c JOIN h USING (column_name) WHERE length(column_name) >= 4 AND column_name <> 'name' AND table_name <> hub",
)(lambda t: catalog.star_edges(t("part").select(F.concat(F.lit("t"), "p_size").alias("table_name"), F.explode(F.array(F.lower("p_type"), F.lit("name"))).alias("column_name"))))
query(
    "declared_keys",
    "WITH k AS (SELECT 't' || p_size AS table_name, 'c' || p_partkey % 9 AS column_name, min('x') AS parent FROM part WHERE p_type = 'PROMO' GROUP BY 1, 2), d AS (SELECT DISTINCT 't' || p_size AS table_name, 'c' || p_partkey % 9 AS column_name, lower(p_type) AS parent_name FROM part), "
    "f AS (SELECT DISTINCT 's' || p_size % 2 || '.' || lower(p_type) AS full_name FROM part WHERE p_type <> 'ECONOMY' UNION SELECT 's0.economy'), u AS (SELECT table_name, column_name, min(full_name) AS parent FROM d JOIN f ON ends_with(full_name, parent_name) GROUP BY 1, 2 HAVING count(DISTINCT full_name) = 1) "
    "SELECT * FROM k UNION ALL SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.table_name = u.table_name AND k.column_name = u.column_name)",
)(
    lambda t: catalog.with_declared(
        t("part").where("p_type = 'PROMO'").select(F.concat(F.lit("t"), "p_size").alias("table_name"), F.concat(F.lit("c"), F.col("p_partkey") % 9).alias("column_name"), F.lit("x").alias("parent")).distinct(),
        t("part").select(F.concat(F.lit("t"), "p_size").alias("table_name"), F.concat(F.lit("c"), F.col("p_partkey") % 9).alias("column_name"), F.lower("p_type").alias("parent_name")).distinct(),
        t("part").select(F.when(F.col("p_type") == "ECONOMY", "s0.economy").otherwise(F.concat(F.lit("s"), F.col("p_size") % 2, F.lit("."), F.lower("p_type"))).alias("full_name")).distinct(),
    )
)


def lineage(t: Tables) -> DataFrame:
    return joins(t).select("src_table", "src_column", "dst_table", "dst_column").distinct()


def known_columns(t: Tables) -> DataFrame:
    return t("nation").select(F.concat(F.lit("t"), "n_nationkey").alias("table_name"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("c"), i))).alias("column_name"))


_KNOWN = "k AS (SELECT 't' || n_nationkey AS t, 'c' || r_regionkey AS c FROM nation, region WHERE r_regionkey < 4)"
query(
    "lineage_coverage",
    f"WITH {_JOINS} {_KNOWN}, d AS (SELECT st AS t, sc AS c FROM j UNION SELECT dt, dc FROM j) SELECT k.t AS table_name, count(*) AS columns, count(d.t) AS covered, round(count(d.t) / count(*)::DOUBLE, 6) AS share FROM k LEFT JOIN d USING (t, c) GROUP BY 1",
)(lambda t: catalog.coverage(known_columns(t), lineage(t)))
query(
    "orphan_edges",
    f"WITH {_JOINS} {_KNOWN} SELECT DISTINCT st AS src_table, sc AS src_column, dt AS dst_table, dc AS dst_column FROM j WHERE (st, sc) NOT IN (SELECT (t, c) FROM k) OR (dt, dc) NOT IN (SELECT (t, c) FROM k)",
)(lambda t: catalog.orphan_edges(lineage(t), known_columns(t)))
query(
    "domain_rollup",
    "WITH r AS (SELECT c_nationkey, c_custkey % 11 AS owner, count(*) AS n FROM customer GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, owner) AS p FROM r), o AS (SELECT c_nationkey, string_agg(owner::VARCHAR, ',' ORDER BY p) AS owners FROM p WHERE p <= 3 GROUP BY 1) "
    "SELECT c_nationkey, count(*) AS assets, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS n_machinery, any_value(owners) AS owners FROM customer JOIN o USING (c_nationkey) GROUP BY 1",
)(lambda t: catalog.roll_up(t("customer").withColumn("owner", F.col("c_custkey") % 11), "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"], "owner", 3))
query("values_like", "SELECT DISTINCT p_name AS value FROM part WHERE contains(lower(p_name), 'wid') ORDER BY 1 LIMIT 10")(lambda t: catalog.values_like(t("part"), "p_name", "WID", 10))
query(
    "case_matches",
    "WITH v AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 AND p_name < 'd' THEN upper(p_name) ELSE p_name END AS value FROM part), b AS (SELECT lower(trim(value)) AS k, min(value) AS value FROM v GROUP BY 1 HAVING count(*) = 1), w AS (SELECT DISTINCT ' ' || upper(p_name) AS wanted FROM part) SELECT wanted, value FROM w JOIN b ON lower(trim(wanted)) = k",
)(lambda t: catalog.case_matches(t("part").select(F.expr("CASE WHEN p_partkey % 2 = 0 AND p_name < 'd' THEN upper(p_name) ELSE p_name END").alias("value")), t("part").select(F.concat(F.lit(" "), F.upper("p_name")).alias("wanted")).distinct()))
query(
    "value_matches",
    "WITH v AS (SELECT DISTINCT p_name AS value FROM part UNION SELECT DISTINCT p_type FROM part), w AS (SELECT DISTINCT upper(p_type) || '' AS wanted FROM part UNION SELECT DISTINCT left(lower(p_type), length(p_type) - 2) FROM part), "
    "c AS (SELECT wanted, min(value) AS value, 'case' AS how, 0 AS p FROM w JOIN v ON lower(value) = lower(wanted) GROUP BY 1 HAVING count(*) = 1 UNION ALL "
    "SELECT wanted, min(value), 'prefix', 2 FROM w JOIN v ON starts_with(lower(value), lower(wanted)) AND length(value) <= length(wanted) + 3 GROUP BY 1 HAVING count(*) = 1) SELECT wanted, arg_min(value, p) AS value, arg_min(how, p) AS how FROM c GROUP BY 1",
)(
    lambda t: catalog.value_matches(
        t("part").select(F.col("p_name").alias("value")).union(t("part").select("p_type")),
        t("part").select(F.upper("p_type").alias("wanted")).union(t("part").select(F.expr("left(lower(p_type), length(p_type) - 2)"))).distinct(),
    )
)
query(
    "terms_bound",
    "WITH t AS (SELECT DISTINCT lower(p_type) AS term, lower(p_brand) AS alias FROM part), c AS (SELECT DISTINCT lower(p_type) AS column_name FROM part UNION SELECT DISTINCT lower(p_type) || '_code' FROM part UNION SELECT DISTINCT lower(p_brand) FROM part) "
    "SELECT term, column_name, max(CASE WHEN term = column_name THEN 1.0 WHEN contains(column_name, term) OR contains(term, column_name) THEN 0.8 WHEN alias = column_name THEN 0.7 END)::DOUBLE AS score FROM t, c WHERE contains(column_name, term) OR contains(term, column_name) OR alias = column_name GROUP BY 1, 2",
)(
    lambda t: catalog.bound(
        t("part").select(F.lower("p_type").alias("term"), F.lower("p_brand").alias("alias")).distinct(),
        t("part").select(F.explode(F.array(F.lower("p_type"), F.concat(F.lower("p_type"), F.lit("_code")), F.lower("p_brand"))).alias("column_name")),
    )
)
