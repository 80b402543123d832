"""Registered queries of assets, bindings, runs and references, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import assets
from quern.registry import query

query(
    "tags_replaced",
    "WITH a AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_quantity <= 25), b AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_discount >= 0.05), "
    "i AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT l_orderkey, l_returnflag, 'remove' AS action FROM (FROM a EXCEPT FROM b) WHERE l_orderkey IN (FROM i) UNION ALL SELECT l_orderkey, l_returnflag, 'add' FROM (FROM b EXCEPT FROM a) WHERE l_orderkey IN (FROM i)",
)(
    lambda t: assets.replaced(
        t("lineitem").where("l_quantity <= 25").select("l_orderkey", "l_returnflag"), t("lineitem").where("l_discount >= 0.05").select("l_orderkey", "l_returnflag"),
        t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")),
    )
)
query(
    "projection_actions",
    "WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O') "
    "SELECT *, 'remove' AS action FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'add' FROM (FROM b EXCEPT FROM a)",
)(lambda t: assets.replaced(*[t("lineitem").where(F.col("l_linestatus") == s).select("l_partkey", "l_suppkey") for s in "FO"]))
query(
    "references_merged",
    "WITH a AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS label, c_nationkey AS n FROM customer WHERE c_acctbal > -500), "
    "b AS (SELECT o_custkey AS k, min(o_orderpriority) AS label, 0 AS n FROM orders GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.label, b.label) AS label, coalesce(a.n, b.n) AS n, "
    "CASE WHEN b.k IS NULL THEN 'first' WHEN a.k IS NULL THEN 'second' ELSE 'both' END AS origin FROM a FULL JOIN b ON a.k = b.k",
)(
    lambda t: assets.filled_from(
        t("customer").where("c_acctbal > -500").select(F.col("c_custkey").alias("k"), F.expr("CASE WHEN c_acctbal > 0 THEN c_mktsegment END").alias("label"), F.col("c_nationkey").alias("n")),
        t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("label"), F.lit(0).alias("n")), "k",
    )
)
query(
    "visible_definitions",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR (o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))",
)(
    lambda t: assets.seen_by(
        t("orders"), F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "O", t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey"
    ).select("o_orderkey")
)
query(
    "pending_before",
    "SELECT o_orderkey, EXISTS (SELECT 1 FROM (SELECT o_custkey AS c, min((o_orderdate, o_orderkey)) AS f FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) WHERE c = o.o_custkey AND f < (o.o_orderdate, o.o_orderkey)) AS waits FROM orders o",
)(lambda t: assets.waiting_before(t("orders"), "o_custkey", F.col("o_orderstatus") == "P", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "waits"))
query(
    "blanks_pruned",
    "SELECT l_orderkey, l_linenumber FROM lineitem a JOIN (SELECT l_orderkey AS k, bool_or(l_returnflag <> 'N') AS f FROM lineitem GROUP BY 1) ON k = l_orderkey WHERE l_returnflag <> 'N' OR NOT f",
)(lambda t: assets.without_blanks(t("lineitem"), "l_orderkey", F.col("l_returnflag") == "N").select("l_orderkey", "l_linenumber"))
query(
    "index_problems",
    "SELECT doc_id, 'not indexed' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'no file' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) "
    "UNION ALL SELECT doc_id, 'no text' FROM documents WHERE coalesce(trim(text), '') = '' UNION ALL SELECT doc_id, 'no lang' FROM documents WHERE coalesce(trim(lang), '') = ''",
)(lambda t: assets.index_problems(t("documents"), t("labels"), "doc_id", ["text", "lang"]))
query(
    "pages_merged",
    "WITH d AS (SELECT doc_id, coalesce(n_chars, -1) AS n, sha256(lower(trim(text))) AS k FROM documents WHERE text IS NOT NULL), w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY k ORDER BY n DESC, doc_id) AS winner FROM d) "
    "SELECT doc_id AS loser, winner FROM w WHERE doc_id <> winner",
)(lambda t: assets.merge_map(t("documents"), F.sha2(F.lower(F.trim("text")), 256), "doc_id", "n_chars"))
query(
    "graph_neighbours",
    "WITH e AS (SELECT 'part ' || l_partkey AS src, 'supplier ' || l_suppkey AS dst, l_returnflag AS family, count(*) AS evidence FROM lineitem GROUP BY ALL) "
    "SELECT src AS node, dst AS other, 'out' AS direction, family, evidence FROM e UNION ALL SELECT dst, src, 'in', family, evidence FROM e",
)(lambda t: assets.neighbours(t("lineitem").select(F.concat(F.lit("part "), "l_partkey").alias("src"), F.concat(F.lit("supplier "), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("family"))))
query(
    "unreferenced_past_grace",
    "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')",
)(lambda t: assets.unreferenced(t("orders"), t("lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "o_orderdate", "1998-01-01 00:00:00").select("o_orderkey"))
query(
    "page_envelope",
    "SELECT o_orderkey, (SELECT count(*) FROM orders) > 150 AS truncated, CASE WHEN (SELECT count(*) FROM orders) > 150 THEN 150 END AS next_offset FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 50",
)(lambda t: assets.page_of(t("orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100, 50).select("o_orderkey", "truncated", "next_offset"))
query(
    "tokens_for_keys",
    "SELECT user_id, round(sum(value), 2) AS value FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
)(lambda t: assets.sums_for(t("events"), t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id")), "user_id", "value", F.col("event_type") == "purchase"))
query("metering_by_day", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS calls, round(sum(value), 2) AS total, count(DISTINCT user_id) AS callers FROM events GROUP BY 1, 2")(
    lambda t: assets.metered(t("events"), [F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.col("event_type")], "value", "user_id")
)
query("metering_by_trace", "SELECT user_id, count(*) AS calls, round(sum(value), 2) AS total, count(DISTINCT event_type) AS callers FROM events GROUP BY 1")(lambda t: assets.metered(t("events"), [F.col("user_id")], "value", "event_type"))
query(
    "source_overview",
    "SELECT n_nationkey AS n, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS rules, (SELECT max(o_orderdate) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey) AS last_run, "
    "(SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS high, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal >= 0) AS low FROM nation",
)(
    lambda t: assets.overview(
        t("nation").select(F.col("n_nationkey").alias("n")), t("customer").select(F.col("c_nationkey").alias("n")),
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n"), "o_orderdate"),
        t("supplier").select(F.col("s_nationkey").alias("n"), F.when(F.col("s_acctbal") < 0, "h").otherwise("l").alias("severity")), "n", "o_orderdate", "severity", {"high": "h", "low": "l"},
    )
)
query(
    "standard_coverage",
    "SELECT p_brand, count(*) AS standards, count(*) FILTER (WHERE c > 0) AS covered, coalesce(sum(c), 0)::BIGINT AS bindings FROM part LEFT JOIN (SELECT l_partkey, count(*) AS c FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1",
)(lambda t: assets.standard_coverage(t("part"), t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "p_brand"))
query(
    "types_by_schema",
    "WITH d AS (SELECT DISTINCT p_type FROM part WHERE p_retailprice > 1000), r AS (SELECT p_type, count(*) AS n FROM part WHERE p_size < 25 GROUP BY 1) SELECT coalesce(d.p_type, r.p_type) AS p_type, coalesce(n, 0) AS n, d.p_type IS NOT NULL AS declared FROM d FULL JOIN r ON d.p_type = r.p_type",
)(lambda t: assets.by_schema(t("part").where("p_size < 25"), t("part").where("p_retailprice > 1000"), "p_type"))
query(
    "callers_identified",
    "SELECT event_id, c_custkey FROM events LEFT JOIN customer ON c_custkey = user_id AND event_type <> 'error'",
)(
    lambda t: assets.identified(
        t("events").withColumn("told", F.expr("CASE event_type WHEN 'purchase' THEN 'user:' || user_id WHEN 'error' THEN 'key=' || user_id WHEN 'signup' THEN 'mcp/u-' || user_id || '/x' ELSE string(user_id) END")),
        "told", [r"^user:(\d+)$", r"/u-(\d+)/", r"^(\d+)$"], t("customer"), "c_custkey",
    ).select("event_id", "c_custkey")
)
query(
    "rows_in_chunks",
    "WITH c AS (SELECT l_orderkey AS k, l_returnflag AS chunk, min(l_linenumber) AS s, max(l_linenumber) + 1 AS e FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, chunk FROM lineitem JOIN c ON k = l_orderkey AND l_linenumber >= s AND l_linenumber < e",
)(
    lambda t: assets.evidence(
        t("lineitem").select("l_orderkey", "l_linenumber"), t("lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("chunk")).agg(F.min("l_linenumber").alias("start"), (F.max("l_linenumber") + 1).alias("end")), "l_orderkey", "l_linenumber"
    ).select("l_orderkey", "l_linenumber", "chunk")
)
query(
    "mentions_supported",
    r"WITH m AS (SELECT doc_id, source, lang || ' ' || source AS name, text, list_filter(regexp_split_to_array(lang || ' ' || source, '[\W_]+'), lambda x: x <> '') AS parts FROM documents) "
    r"SELECT doc_id, CASE WHEN contains(text, name) THEN 'verbatim' WHEN contains(lower(regexp_replace(text, '[\W_]+', '', 'g')), lower(regexp_replace(name, '[\W_]+', '', 'g'))) THEN 'normalised' WHEN len(list_filter(parts, lambda x: contains(text, x))) * 2 >= len(parts) THEN 'parts' END AS how FROM m",
)(lambda t: t("documents").select("doc_id", assets.mentions(F.concat_ws(" ", "lang", "source"), F.col("text")).alias("how")))
query(
    "citations_recent",
    "WITH r AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY ORDER BY ts DESC, event_id DESC LIMIT 1000) SELECT props->>'k' AS item, count(*) AS n, max(ts) AS last_at FROM r WHERE props->>'k' IS NOT NULL GROUP BY 1",
)(lambda t: assets.cited(t("events"), "ts", "event_id", 30, 1000, F.get_json_object("props", "$.k")))
query(
    "feedback_stats",
    "WITH v AS (SELECT DISTINCT ON (user_id, event_type) user_id, event_type, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC) SELECT event_type, count(*) AS votes, count(*) FILTER (WHERE value > 100) AS good, count(*) FILTER (WHERE value <= 100) AS bad FROM v GROUP BY 1",
)(lambda t: assets.feedback(t("events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_type", F.col("value") > 100))
query("retries", "SELECT l_orderkey, greatest(max(l_linenumber) - 1, 0) AS retries FROM lineitem GROUP BY 1")(lambda t: t("lineitem").groupBy("l_orderkey").agg(F.greatest(F.max("l_linenumber") - 1, F.lit(0)).alias("retries")))
