"""Registered queries of joins that discover, rules over facts, evaluation, and document preparation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import scalar
from quern.operators import discovery, documents, graph, knowledge, retrieval, text
from quern.operators.rounds import settled
from quern.registry import Tables, query

query(
    "join_overlap_distinct",
    "WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders), b AS (SELECT DISTINCT c_custkey AS w FROM customer) "
    "SELECT count(*) FILTER (WHERE v IS NOT NULL AND w IS NOT NULL) AS shared, round(count(*) FILTER (WHERE v IS NOT NULL AND w IS NOT NULL) / nullif(least(count(v), count(w)), 0)::DOUBLE, 6) AS overlap FROM a FULL JOIN b ON v = w",
)(lambda t: discovery.overlap(t("orders"), "o_custkey", t("customer"), "c_custkey"))
query(
    "join_overlap_rows",
    "SELECT count(*) AS all_rows, count(o_custkey) AS matched FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
)(lambda t: discovery.row_overlap(t("customer"), "c_custkey", t("orders"), "o_custkey"))


@query(
    "suffix_fk_candidates",
    "WITH c AS (SELECT DISTINCT 't' || p_size || '_' || lower(p_type) AS table_name, x.c AS column_name FROM part, unnest([{'c': lower(p_type) || '_id'}, {'c': 't' || p_size % 7 || '_code'}, {'c': split_part(p_name, ' ', 1) || '_key'}, {'c': 'p_' || lower(p_type)}]) AS u(x)), "
    "h AS (SELECT *, regexp_replace(column_name, '^[a-z]_|_?(key|id|code)$', '', 'g') AS stem FROM c WHERE regexp_matches(column_name, '(key|id|code)$')), p AS (SELECT DISTINCT table_name AS parent FROM c), "
    "f AS (SELECT h.table_name, column_name, parent, CASE WHEN parent = stem THEN 0 WHEN starts_with(parent, stem) OR starts_with(stem, parent) THEN 1 ELSE 2 END AS fit FROM h JOIN p ON (contains(parent, stem) OR contains(stem, parent)) AND parent <> h.table_name WHERE length(stem) >= 3) "
    "SELECT table_name, column_name, parent, fit FROM f QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY fit, parent) <= 5",
)
def suffix_fk_candidates(t: Tables) -> DataFrame:
    """A catalogue made of parts: tables by size and type, whose columns point at types, sizes and materials."""
    kind = F.lower("p_type")
    names = F.array(F.concat(kind, F.lit("_id")), F.concat(F.lit("t"), (F.col("p_size") % 7).cast("string"), F.lit("_code")), F.concat(F.substring_index("p_name", " ", 1), F.lit("_key")), F.concat(F.lit("p_"), kind))
    columns = t("part").select(F.concat(F.lit("t"), F.col("p_size").cast("string"), F.lit("_"), kind).alias("table_name"), F.explode(names).alias("column_name"))
    return discovery.suffix_candidates(columns.distinct())


def newest() -> list:
    return [F.desc("o_orderdate"), F.desc("o_orderkey")]


query(
    "lateral_top1",
    "SELECT c_custkey, x.o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) x ON true",
)(lambda t: discovery.nearest(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate"), "c_custkey", newest(), 1).select("c_custkey", "o_orderkey"))
query(
    "lateral_top20_list",
    "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) "
    "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY n) AS newest FROM r WHERE n <= 20 GROUP BY 1",
)(lambda t: discovery.gathered(t("orders"), "o_custkey", newest(), 20, F.col("o_orderkey").cast("string")).select("o_custkey", F.array_join("items", ",").alias("newest")))
query(
    "policy_precedence",
    "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 9000 THEN 1 END, CASE WHEN n_nationkey % 2 = 0 THEN 30 END, CASE WHEN n_regionkey = 1 THEN 90 END, 365) AS days FROM customer JOIN nation ON c_nationkey = n_nationkey",
)(
    lambda t: discovery.settled(
        t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey"),
        [
            t("customer").where("c_acctbal > 9000").select("c_custkey", F.lit(1).alias("days")),
            t("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(30).alias("days")),
            t("region").where("r_regionkey = 1").select(F.col("r_regionkey").alias("n_regionkey"), F.lit(90).alias("days")),
        ],
        ["c_custkey", "c_nationkey", "n_regionkey"], "days", 365,
    ).select("c_custkey", "days")
)
query(
    "snapshot_diff",
    "WITH a AS (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0), b AS (SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 4 <> 0) "
    "SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.s_suppkey IS NULL THEN 'added' WHEN b.s_suppkey IS NULL THEN 'removed' ELSE 'changed' END AS change "
    "FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey WHERE a.s_suppkey IS NULL OR b.s_suppkey IS NULL OR (a.s_name, a.s_nationkey, a.s_acctbal) IS DISTINCT FROM (b.s_name, b.s_nationkey, b.s_acctbal)",
)(
    lambda t: discovery.changes(
        t("supplier").where("s_suppkey % 3 <> 0"),
        t("supplier").where("s_suppkey % 4 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))),
        "s_suppkey",
    )
)
query(
    "usage_in_batches",
    "WITH b AS (SELECT o_orderkey % 5 AS k, o_orderdate AS first, o_orderdate + INTERVAL 1 DAY AS last, o_orderkey AS batch FROM orders), u AS (SELECT l_orderkey % 5 AS k, l_shipdate AS seen_at, l_quantity FROM lineitem) "
    "SELECT batch, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM u JOIN b USING (k) WHERE seen_at BETWEEN first AND last GROUP BY 1",
)(
    lambda t: discovery.totals_in_interval(
        t("lineitem").select((F.col("l_orderkey") % 5).alias("k"), F.col("l_shipdate").alias("at"), "l_quantity"),
        t("orders").select((F.col("o_orderkey") % 5).alias("k"), F.col("o_orderdate").alias("first"), F.expr("o_orderdate + interval 1 day").alias("last"), F.col("o_orderkey").alias("batch")),
        "k", "at", "batch", "l_quantity",
    ).select("batch", "n", F.round("total", 2).alias("quantity"))
)
query(
    "unlinkable_count",
    "SELECT count(*) AS n FROM orders o WHERE 4 <> (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)",
)(lambda t: t("orders").join(t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines")), F.col("o_orderkey") == F.col("l_orderkey"), "left").where(F.coalesce("lines", F.lit(0)) != 4).agg(F.count("*").alias("n")))
query(
    "p95_nearest_rank",
    "SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY 1",
)(lambda t: t("events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50")))
query(
    "caller_sets",
    "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1",
)(lambda t: t("events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")))


def facts(t: Tables) -> DataFrame:
    """Facts from foreign keys: customers and suppliers live in nations, nations in regions, customers buy from suppliers."""
    parts = [
        t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("s"), F.lit("in").alias("p"), F.concat(F.lit("n"), "c_nationkey").alias("o")),
        t("supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.lit("in"), F.concat(F.lit("n"), "s_nationkey")),
        t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.lit("part of"), F.concat(F.lit("r"), "n_regionkey")),
        t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), "o_custkey"), F.lit("buys from"), F.concat(F.lit("s"), "l_suppkey")),
    ]
    return reduce(DataFrame.union, parts).distinct()


_FACTS = (
    "f AS (SELECT 'c' || c_custkey AS s, 'in' AS p, 'n' || c_nationkey AS o FROM customer UNION SELECT 's' || s_suppkey, 'in', 'n' || s_nationkey FROM supplier "
    "UNION SELECT 'n' || n_nationkey, 'part of', 'r' || n_regionkey FROM nation UNION SELECT 'c' || o_custkey, 'buys from', 's' || l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
)
LOCAL = knowledge.Rule((knowledge.Atom("?c", "buys from", "?s"), knowledge.Atom("?c", "in", "?n"), knowledge.Atom("?s", "in", "?n")), knowledge.Atom("?c", "neighbour of", "?s"))
REGIONAL = knowledge.Rule((knowledge.Atom("?x", "in", "?n"), knowledge.Atom("?n", "part of", "?r")), knowledge.Atom("?x", "within", "?r"))
SERVED = knowledge.Rule((knowledge.Atom("?c", "neighbour of", "?s"), knowledge.Atom("?s", "within", "?r")), knowledge.Atom("?c", "served in", "?r"))
_LOCAL = "l AS (SELECT a.s AS c, a.o AS s FROM f a JOIN f b ON a.s = b.s AND b.p = 'in' JOIN f d ON a.o = d.s AND d.p = 'in' AND d.o = b.o WHERE a.p = 'buys from')"
query("rule_conjunctive", f"WITH {_FACTS}, {_LOCAL} SELECT DISTINCT c AS s, 'neighbour of' AS p, s AS o FROM l")(lambda t: knowledge.concluded(facts(t), LOCAL))
query(
    "forward_chain",
    f"WITH {_FACTS}, {_LOCAL}, w AS (SELECT a.s AS x, b.o AS r FROM f a JOIN f b ON a.o = b.s AND b.p = 'part of' WHERE a.p = 'in') "
    "SELECT DISTINCT c AS s, 'neighbour of' AS p, s AS o FROM l UNION SELECT x, 'within', r FROM w UNION SELECT c, 'served in', r FROM l JOIN w ON l.s = w.x",
)(lambda t: knowledge.chained(facts(t), [[LOCAL, REGIONAL], [SERVED]]))
query(
    "components_merge",
    "WITH RECURSIVE p AS (SELECT DISTINCT c_custkey AS a, c_nationkey AS k FROM customer), e AS (SELECT p.a, m.b FROM p JOIN (SELECT k, min(a) AS b FROM p GROUP BY 1) m USING (k)), "
    "n AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a, b FROM n UNION SELECT w.a, n.b FROM w JOIN n ON w.b = n.a) SELECT a AS thing, min(b) AS winner FROM w GROUP BY 1",
)(lambda t: knowledge.merged(t("customer"), "c_custkey", "c_nationkey"))
query(
    "ab_compare",
    "WITH a AS (SELECT doc_id AS name, CASE quality WHEN 1 THEN 'pass' ELSE 'fail' END AS outcome FROM labels), b AS (SELECT doc_id AS name, CASE toxic WHEN 1 THEN 'fail' ELSE 'pass' END AS outcome FROM labels WHERE doc_id % 10 <> 0), "
    "j AS (SELECT a.outcome AS x, coalesce(b.outcome, 'error') AS y FROM a LEFT JOIN b USING (name)) "
    "SELECT count(*) AS cases, count(*) FILTER (WHERE x = 'pass' AND y = 'fail') AS new_red, count(*) FILTER (WHERE x <> 'error' AND y = 'error') AS new_error, count(*) FILTER (WHERE x = 'pass') - count(*) FILTER (WHERE y = 'pass') AS passes_dropped FROM j",
)(
    lambda t: knowledge.compared(
        t("labels").select(F.col("doc_id").alias("name"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("outcome")),
        t("labels").where("doc_id % 10 <> 0").select(F.col("doc_id").alias("name"), F.when(F.col("toxic") == 1, "fail").otherwise("pass").alias("outcome")),
    )
)
query(
    "recall_at_k",
    "WITH r AS (SELECT label AS question, vec_id AS item, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings), q AS (SELECT label AS question, vec_id AS item FROM embeddings WHERE embedding[1] > 0) "
    "SELECT q.question, round(count(*) FILTER (WHERE rank <= 20) / count(*)::DOUBLE, 6) AS recall, round(coalesce(1.0 / min(rank), 0), 6)::DOUBLE AS reciprocal_rank FROM q LEFT JOIN r USING (question, item) GROUP BY 1",
)(
    lambda t: knowledge.recall_at(
        t("embeddings").select(F.col("label").alias("question"), F.col("vec_id").alias("item"), F.expr("row_number() OVER (PARTITION BY label ORDER BY vec_id)").alias("rank")),
        t("embeddings").where("embedding[0] > 0").select(F.col("label").alias("question"), F.col("vec_id").alias("item")),
        20,
    )
)
query(
    "label_search",
    "SELECT DISTINCT p_name AS label, CASE WHEN lower(p_name) = 'widget' THEN 1000 WHEN starts_with(lower(p_name), 'widget') THEN 500 ELSE 100 - length(p_name) + CASE WHEN contains(lower(p_name), ' widget') OR contains(lower(p_name), '_widget') THEN 50 ELSE 0 END END AS score FROM part WHERE contains(lower(p_name), 'widget') ORDER BY score DESC, label LIMIT 20",
)(
    lambda t: graph.label_search(t("part").select(F.col("p_name").alias("label")), "widget", 20)
)
query(
    "stage_rollup",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS tasks, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, round(avg(date_diff('second', o_orderdate, l_shipdate)), 4) AS mean_seconds FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
)(
    lambda t: t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    .groupBy("o_orderstatus", "o_orderpriority")
    .agg(F.count("*").alias("tasks"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.round(F.avg(F.expr("timestampdiff(SECOND, o_orderdate, l_shipdate)")), 4).alias("mean_seconds"))
)
query(
    "diagnosis_rollup",
    "SELECT d.lang, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE 'sound' END AS cause, count(*) AS n, min(doc_id) AS example FROM labels JOIN documents d USING (doc_id) GROUP BY 1, 2",
)(
    lambda t: t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    .groupBy("lang", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("sound").alias("cause"))
    .agg(F.count("*").alias("n"), F.min("doc_id").alias("example"))
)
query("text_pack")(lambda t: documents.pack(t("documents"), 1000, text.NOISE, text.HEADING))
query("html_tables")(lambda t: documents.tables(t("pages")))
query("simhash_signatures")(lambda t: documents.signatures(t("documents")))
query("similar_documents")(lambda t: documents.alike(t("documents").select("doc_id", "text"), t("documents").where("doc_id % 100 = 0"), 0.8, 10))
query("simhash_pairs")(lambda t: documents.near(signed := settled(documents.signatures(t("documents"))), signed.where("doc_id % 100 = 0"), 0.85))
query("mmr_select")(lambda t: documents.diverse(t("conversations").select("conv_id", "turn", retrieval.jaccard(retrieval.tokens("text"), retrieval.tokens(F.lit("what is the best way to do that"))).alias("score"), retrieval.tokens("text").alias("tokens")).fillna(0.0, ["score"]), "conv_id", "turn", 3))
query("row_pack")(lambda t: documents.row_packs(t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.concat_ws(" | ", "l_partkey", "l_suppkey", "l_quantity").alias("line")), "l_orderkey", "l_linenumber", "l_returnflag", "line", 60))

# Column functions

query(
    "mask_sample",
    "SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN repeat('*', length(c_name)) ELSE left(c_name, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) END AS masked FROM customer",
)(lambda t: t("customer").select("c_custkey", scalar.mask_sample(F.col("c_name")).alias("masked")))
query(
    "coerce_number",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE round(p_retailprice, 2) END AS value FROM part",
)(lambda t: t("part").select("p_partkey", scalar.number(F.when(F.col("p_partkey") % 3 == 0, F.lit("about 3")).otherwise(F.format_number("p_retailprice", 2))).alias("value")))
query(
    "cell_equal",
    "SELECT l_returnflag, count(*) FILTER (WHERE CASE WHEN floor(a) = a AND floor(b) = b THEN a = b ELSE abs(a - b) <= greatest(0.5, 0.01 * greatest(abs(a), abs(b))) END) AS equal_cells "
    "FROM (SELECT l_returnflag, l_quantity AS a, l_quantity * (1 - l_discount / 4) AS b FROM lineitem) GROUP BY 1",
)(lambda t: t("lineitem").groupBy("l_returnflag").agg(F.count_if(scalar.cell_equal(F.col("l_quantity"), F.col("l_quantity") * (1 - F.col("l_discount") / 4))).alias("equal_cells")))
query(
    "stable_identity",
    "SELECT s_suppkey, left(sha256(lower(trim(s_name)) || chr(31) || s_nationkey::VARCHAR), 32) AS id FROM supplier",
)(lambda t: t("supplier").select("s_suppkey", scalar.identity(F.col("s_name"), F.col("s_nationkey"), length=32).alias("id")))
query(
    "lexical_scores",
    "WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]{2,})', 1)) AS ws FROM benchmark), q AS (SELECT ws AS qs FROM b ORDER BY item_id LIMIT 1) SELECT item_id, len(list_intersect(ws, qs))::INT AS score FROM b, q",
)(lambda t: t("benchmark").select("item_id", F.size(F.array_intersect(scalar.words(F.col("text")), scalar.words(F.lit(t("benchmark").orderBy("item_id").select("text").first().text)))).alias("score")))
query(
    "retention_due",
    "SELECT o_orderkey FROM orders WHERE CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 30 ELSE 365 END > 0 AND o_orderdate + to_days(CASE o_orderpriority WHEN '2-HIGH' THEN 30 ELSE 365 END) <= TIMESTAMP '1997-01-01'",
)(lambda t: t("orders").where(scalar.due(F.col("o_orderdate"), F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 30).otherwise(365), F.lit("1997-01-01").cast("timestamp"))).select("o_orderkey"))
