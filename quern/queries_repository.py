"""Registered queries of documents, runs, graphs, retrieval and attributes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import documents, graph, repository, retrieval, text
from quern.registry import Tables, query

# Counts and pages

query(
    "doc_stats",
    "WITH i AS (SELECT 'src' || range AS source FROM range(0, 12)) SELECT i.source, count(doc_id) FILTER (WHERE lang = 'en') AS english, count(doc_id) FILTER (WHERE n_chars > 1000) AS long FROM i LEFT JOIN documents d ON d.source = i.source GROUP BY 1",
)(lambda t: repository.counts_for(t("region").sparkSession.range(12).select(F.concat(F.lit("src"), "id").alias("source")), t("documents"), "source", {"english": F.col("lang") == "en", "long": F.col("n_chars") > 1000}))
query("doc_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")(lambda t: t("documents").groupBy("source", "lang").agg(F.count("*").alias("n")))
query(
    "unmanaged_docs",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 100",
)(lambda t: repository.unmanaged(t("documents"), t("labels"), "doc_id", [F.desc("n_chars"), F.col("doc_id")], 100).select("doc_id", "lang"))
query(
    "for_all_scope",
    "SELECT DISTINCT l_orderkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = b.l_suppkey AND s_acctbal > 0))",
)(lambda t: repository.in_scope(t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")), t("supplier").where("s_acctbal > 0"), "l_orderkey", "s_suppkey"))
query(
    "not_exists_nested",
    "SELECT c_custkey FROM customer WHERE NOT (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000))",
)(lambda t: repository.idle(t("customer").select("c_custkey"), "c_custkey", [t("orders").where(c).select(F.col("o_custkey").alias("c_custkey")) for c in ("o_orderstatus = 'P'", "o_totalprice > 400000")]))
query("doc_page", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 10 OFFSET 10")(
    lambda t: repository.paged(t("documents").select("doc_id", "n_chars"), "secret", ("n_chars", "doc_id"), "doc_id", 2, 3)
)
query("keyword_any", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the ') OR contains(lower(source), 'the ') OR contains(doc_id::VARCHAR, 'the ')")(
    lambda t: repository.matching(t("documents"), "The ", ["text", "source", "doc_id"]).select("doc_id")
)
query(
    "snapshot_fields",
    "WITH a AS (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0), b AS (SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 7 = 0 THEN '!' ELSE '' END AS s_name, s_nationkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 4 <> 0) "
    "SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.s_suppkey IS NULL THEN 'added' WHEN b.s_suppkey IS NULL THEN 'removed' ELSE 'changed' END AS change, "
    "CASE WHEN a.s_suppkey IS NULL OR b.s_suppkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.s_acctbal IS DISTINCT FROM b.s_acctbal THEN 's_acctbal' END, CASE WHEN a.s_name <> b.s_name THEN 's_name' END) END AS fields "
    "FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey WHERE a.s_suppkey IS NULL OR b.s_suppkey IS NULL OR a.s_acctbal IS DISTINCT FROM b.s_acctbal OR a.s_name <> b.s_name",
)(
    lambda t: repository.field_changes(
        t("supplier").where("s_suppkey % 3 <> 0"),
        t("supplier").where("s_suppkey % 4 <> 0").withColumns({"s_name": F.expr("s_name || CASE WHEN s_suppkey % 7 = 0 THEN '!' ELSE '' END"), "s_acctbal": F.expr("CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END")}),
        "s_suppkey",
    )
)
query(
    "suggestions_revived",
    "WITH k AS (SELECT l_partkey AS a, l_suppkey AS b, CASE min(l_linenumber) WHEN 1 THEN 'dismissed' WHEN 2 THEN 'accepted' ELSE 'pending' END AS status FROM lineitem WHERE l_partkey % 4 > 0 GROUP BY 1, 2), s AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, CASE WHEN l_partkey % 2 = 0 THEN l_partkey ELSE l_suppkey END AS who FROM lineitem WHERE l_suppkey % 3 > 0) "
    "SELECT coalesce(k.a, s.a) AS a, coalesce(k.b, s.b) AS b, CASE WHEN status IS NULL OR (status = 'dismissed' AND who = coalesce(k.a, s.a)) THEN 'pending' ELSE status END AS status FROM k FULL JOIN s ON k.a = s.a AND k.b = s.b",
)(
    lambda t: repository.revived(
        t("lineitem").where("l_partkey % 4 > 0").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.min("l_linenumber").alias("n")).select("a", "b", F.expr("CASE n WHEN 1 THEN 'dismissed' WHEN 2 THEN 'accepted' ELSE 'pending' END").alias("status")),
        t("lineitem").where("l_suppkey % 3 > 0").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.expr("CASE WHEN l_partkey % 2 = 0 THEN l_partkey ELSE l_suppkey END").alias("by")),
    )
)
query(
    "pair_orientation",
    "WITH p AS (SELECT DISTINCT l_orderkey AS a, (l_orderkey + l_linenumber) AS b FROM lineitem), j AS (SELECT x.o_orderkey AS i, x.o_orderdate AS d, y.o_orderkey AS k, y.o_orderdate AS e FROM p JOIN orders x ON x.o_orderkey = a JOIN orders y ON y.o_orderkey = b) SELECT DISTINCT CASE WHEN (d, i) > (e, k) THEN i ELSE k END AS source, CASE WHEN (d, i) > (e, k) THEN k ELSE i END AS target FROM j",
)(lambda t: repository.oriented(t("lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("b")).distinct(), t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))))

# Attributes

query(
    "attributes_merged",
    "WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS name, string_split(p_name, ' ') AS aliases FROM part), a AS (SELECT DISTINCT p_brand, unnest(aliases) AS x FROM p), u AS (SELECT p_brand, string_agg(x, ',' ORDER BY x) AS aliases FROM a GROUP BY 1) "
    "SELECT p_brand, arg_min(name, p_partkey) FILTER (WHERE name IS NOT NULL) AS name, any_value(u.aliases) AS aliases FROM p JOIN u USING (p_brand) GROUP BY 1",
)(
    lambda t: repository.merged_attributes(t("part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("name"), F.split("p_name", " ").alias("aliases")), "p_brand", ["name"], ["aliases"], "p_partkey")
    .withColumn("aliases", F.array_join("aliases", ","))
)
query("separated_values", "SELECT DISTINCT p_partkey, unnest([p_brand, p_type]) AS value FROM part")(
    lambda t: repository.split_values(t("part").select("p_partkey", F.concat("p_brand", F.lit("<SEP> "), "p_type", F.lit(" <SEP><SEP>"), "p_brand").alias("many")), "p_partkey", "many")
)
query(
    "file_source_parts",
    "SELECT o_orderkey, o_orderstatus AS kb, o_custkey::VARCHAR AS doc, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS tenant FROM orders",
)(
    lambda t: t("orders").select("o_orderkey", F.concat_ws("|", F.concat(F.lit("kb="), "o_orderstatus"), F.concat(F.lit("doc="), "o_custkey"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("tenant="), "o_orderpriority"))).alias("s"))
    .select("o_orderkey", *[c.alias(n) for n, c in repository.source_parts("s").items()])
)
query(
    "spans_normalized",
    "WITH s AS (SELECT l_orderkey, CASE WHEN l_partkey % 5 > 0 THEN l_linenumber END AS ordinal, l_partkey % 50 - 3 AS first, l_suppkey % 50 AS last FROM lineitem) "
    "SELECT l_orderkey, ordinal, first, last FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ordinal, first, last) AS n FROM s WHERE ordinal IS NOT NULL AND first >= 0 AND last > first) WHERE n <= 2",
)(lambda t: repository.sound_spans(t("lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 5 > 0, F.col("l_linenumber")).alias("ordinal"), (F.col("l_partkey") % 50 - 3).alias("first"), (F.col("l_suppkey") % 50).alias("last")), "l_orderkey", 2))
query(
    "ordered_chunks",
    "WITH c AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND turn = 1 THEN 0 ELSE turn END AS i, text FROM conversations), d AS (SELECT conv_id, count(*) = count(DISTINCT i) AS good FROM c GROUP BY 1) "
    "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY CASE WHEN good THEN i END, text)) AS content_sha256 FROM c JOIN d USING (conv_id) WHERE text IS NOT NULL GROUP BY 1",
)(lambda t: repository.ordered_text(t("conversations").select("conv_id", F.expr("CASE WHEN conv_id % 2 = 0 AND turn = 1 THEN 0 ELSE turn END").alias("i"), "text"), "conv_id", "i", "text").select("conv_id", F.sha2("content", 256).alias("content_sha256")))

# Results and runs

query("same_rows", "SELECT false AS as_bags, true AS as_sets")(lambda t: repository.same_rows(t("lineitem").select("l_returnflag", "l_linestatus"), t("lineitem").select("l_returnflag", "l_linestatus").distinct()))
query(
    "result_vote",
    "WITH r AS (SELECT o_orderpriority || o_orderstatus AS run, (count(*) // 10) AS answer FROM orders GROUP BY 1) SELECT min(run) AS run, count(*) AS votes FROM r GROUP BY answer ORDER BY votes DESC, 1 LIMIT 1",
)(lambda t: repository.voted(t("orders").groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("run")).agg(F.floor(F.count("*") / 10).alias("answer")), "run", "answer"))
_RUNS = "r AS (SELECT o_custkey AS name, o_custkey % 4 AS tier, CASE WHEN o_totalprice > 300000 THEN 'error' WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'pass' END AS outcome FROM orders), c AS (SELECT tier, name, min(CASE outcome WHEN 'error' THEN 0 WHEN 'fail' THEN 1 ELSE 2 END) AS w, max(CASE outcome WHEN 'error' THEN 0 WHEN 'fail' THEN 1 ELSE 2 END) AS b FROM r GROUP BY 1, 2)"
_TIERS = f"WITH {_RUNS} SELECT tier, count(*) AS cases, count(*) FILTER (WHERE w = 2) AS worst_passed, count(*) FILTER (WHERE b = 2) AS best_passed, round(count(*) FILTER (WHERE b = 2) / nullif(count(*) FILTER (WHERE b > 0), 0)::DOUBLE, 6) AS accuracy FROM c GROUP BY 1"


def tiers(t: Tables) -> DataFrame:
    runs = t("orders").select(F.col("o_custkey").alias("name"), (F.col("o_custkey") % 4).alias("tier"), F.expr("CASE WHEN o_totalprice > 300000 THEN 'error' WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'pass' END").alias("outcome"))
    return repository.repeats_judged(runs, "name", "tier")


query("eval_repeats", _TIERS)(tiers)
query("eval_gate", f"SELECT tier, CASE WHEN accuracy >= 0.99 THEN 'passed' WHEN accuracy >= 0.9 THEN 'review' ELSE 'blocked' END AS verdict FROM ({_TIERS})")(lambda t: repository.gate(tiers(t), 0.99, 0.9))
query(
    "score_stats",
    "SELECT event_type, count(*) FILTER (WHERE event_id % 4 > 0) AS n, round(avg(value) FILTER (WHERE event_id % 4 > 0), 6) AS mean, min(value) FILTER (WHERE event_id % 4 > 0) AS least, max(value) FILTER (WHERE event_id % 4 > 0) AS greatest FROM events GROUP BY 1",
)(lambda t: repository.scores_told(t("events").withColumn("value", F.when(F.col("event_id") % 4 > 0, F.col("value")).otherwise(F.lit(float("nan")))), "event_type", "value"))
query(
    "claims_supported",
    "SELECT doc_id AS claim, n_chars IS NOT NULL AND length(trim(excerpt)) > 0 AND contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(excerpt, '\\s+', ' ', 'g')))) AS is_supported "
    "FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN replace(substring(text, 11, 30), ' ', '  ') WHEN 1 THEN 'zzqq' || left(text, 9) ELSE ' ' END AS excerpt FROM documents) WHERE text IS NOT NULL",
)(
    lambda t: repository.supported(
        t("documents").where("text is not null").select("doc_id", F.col("doc_id").alias("claim"), F.expr("CASE doc_id % 3 WHEN 0 THEN replace(substring(text, 11, 30), ' ', '  ') WHEN 1 THEN 'zzqq' || left(text, 9) ELSE ' ' END").alias("excerpt")), t("documents"), "doc_id"
    )
)
query(
    "contributions_reconciled",
    "WITH b AS (SELECT l_orderkey AS source, l_partkey FROM lineitem WHERE l_linenumber < 3), i AS (SELECT l_orderkey AS source, l_partkey FROM lineitem WHERE l_linenumber = 3) SELECT source, l_partkey FROM b WHERE source NOT IN (SELECT source FROM i) UNION SELECT source, l_partkey FROM i",
)(lambda t: repository.reconciled(*[t("lineitem").where(c).select(F.col("l_orderkey").alias("source"), "l_partkey") for c in ("l_linenumber < 3", "l_linenumber = 3")], "source", ["l_partkey"]))
query(
    "edges_remapped",
    "WITH w AS (SELECT s_suppkey AS thing, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS winner FROM supplier), e AS (SELECT DISTINCT l_suppkey AS src, l_returnflag AS relation, (l_suppkey + l_partkey) % 100 AS dst FROM lineitem) "
    "SELECT DISTINCT coalesce(a.winner, src) AS src, relation, coalesce(b.winner, dst) AS dst FROM e LEFT JOIN w a ON a.thing = src LEFT JOIN w b ON b.thing = dst WHERE coalesce(a.winner, src) <> coalesce(b.winner, dst)",
)(
    lambda t: repository.remapped(
        t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("relation"), ((F.col("l_suppkey") + F.col("l_partkey")) % 100).alias("dst")).distinct(),
        t("supplier").join(t("supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("winner")), "s_nationkey").select(F.col("s_suppkey").alias("thing"), "winner"),
    )
)


def part_facts(t: Tables) -> DataFrame:
    rows = t("part").select(F.col("p_name").alias("s"), F.col("p_type").alias("k"), F.col("p_brand").alias("b"))
    return rows.select("s", F.lit("is a").alias("p"), F.col("k").alias("o")).union(rows.select("s", F.lit("made by"), "b")).union(rows.select("s", F.lit("brand"), "b")).distinct()


_PARTS = "f AS (SELECT DISTINCT p_name AS s, 'is a' AS p, p_type AS o FROM part UNION SELECT DISTINCT p_name, 'made by', p_brand FROM part UNION SELECT DISTINCT p_name, 'brand', p_brand FROM part)"
query("schema_validated", f"WITH {_PARTS} SELECT DISTINCT s, 'made by' AS p, o FROM f WHERE p <> 'is a'")(
    lambda t: repository.within_schema(part_facts(t), t("region").sparkSession.createDataFrame([("made by",)], "p string"), t("region").sparkSession.createDataFrame([("brand", "made by")], "alias string, p string"))
)
query(
    "axiom_conflicts",
    f"WITH {_PARTS} SELECT 'functional' AS kind, s, 'made by' AS detail FROM f WHERE p = 'made by' GROUP BY s HAVING count(DISTINCT o) > 1 UNION ALL SELECT 'disjoint', s, 'ECONOMY,PROMO' FROM f WHERE p = 'is a' GROUP BY s HAVING bool_or(o = 'ECONOMY') AND bool_or(o = 'PROMO')",
)(lambda t: repository.axiom_conflicts(part_facts(t), ["made by"], [("ECONOMY", "PROMO")]))
_LINKS = "l AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 4), p AS (SELECT p_partkey AS page FROM part WHERE p_size > 3)"
for _name, _side, _sql in (
    ("links_broken", 0, f"WITH {_LINKS} SELECT src, dst FROM l WHERE dst NOT IN (SELECT page FROM p)"),
    ("pages_orphaned", 1, f"WITH {_LINKS} SELECT page FROM p WHERE page NOT IN (SELECT dst FROM l WHERE src <> dst)"),
):
    query(_name, _sql)(
        lambda t, side=_side: repository.broken_links(t("lineitem").where("l_returnflag = 'R' and l_quantity < 4").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct(), t("part").where("p_size > 3").select(F.col("p_partkey").alias("page")))[side]
    )

# Graphs

_WEB = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_linenumber / 7.0 AS confidence FROM lineitem)"
_BOTH = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), d AS (SELECT src AS node, count(DISTINCT dst) AS degree FROM b GROUP BY 1)"


def web(t: Tables) -> DataFrame:
    return t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), (F.col("l_linenumber") / 7.0).alias("confidence")).distinct()


query("popular_labels", f"WITH {_WEB}, {_BOTH} SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 30")(lambda t: graph.popular(web(t), 30))
query("edge_degrees", f"WITH {_WEB}, {_BOTH} SELECT DISTINCT src, dst, x.degree + y.degree AS degree FROM e JOIN d x ON x.node = src JOIN d y ON y.node = dst")(lambda t: graph.edge_degrees(web(t)))
query("nodes_deleted", f"WITH {_WEB} SELECT DISTINCT src, dst FROM e WHERE dst NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0)")(
    lambda t: graph.without_nodes(web(t).select("src", "dst").distinct(), t("supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))
)
_BFS = (
    f"WITH {_WEB}, {_BOTH}, h AS (SELECT node, min(hops) AS hops FROM (SELECT 'p1' AS node, 0 AS hops UNION ALL SELECT dst, 1 FROM b WHERE src = 'p1' UNION ALL SELECT y.dst, 2 FROM b x JOIN b y ON x.dst = y.src WHERE x.src = 'p1') GROUP BY 1), "
    "n AS (SELECT node, hops, (SELECT count(*) FROM h) > 60 AS is_truncated FROM h JOIN d USING (node) ORDER BY hops, degree DESC, node LIMIT 60)"
)
query("graph_bfs", f"{_BFS} SELECT node, hops, is_truncated FROM n")(lambda t: graph.subgraph(web(t), "p1", 2, 60)[0])
query("graph_bfs_edges", f"{_BFS} SELECT DISTINCT least(src, dst) || '-' || greatest(src, dst) AS id, least(src, dst) AS src, greatest(src, dst) AS dst FROM b WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")(
    lambda t: graph.subgraph(web(t), "p1", 2, 60)[1]
)
query(
    "lineage_walk",
    f"WITH {_WEB}, g AS (SELECT DISTINCT src, dst FROM e WHERE confidence >= 0.5), "
    "a AS (SELECT src, dst, 1 AS hop, dst AS t FROM g WHERE src = 'p1'), c AS (SELECT g.src, g.dst, 2 AS hop, g.src AS t FROM g JOIN (SELECT DISTINCT t FROM a) a ON g.dst = a.t) "
    "SELECT src, dst, min(hop) AS hop FROM (SELECT src, dst, hop FROM a UNION ALL SELECT src, dst, hop FROM c) GROUP BY 1, 2",
)(lambda t: graph.walked(web(t), t("part").where("p_partkey = 1").select(F.concat(F.lit("p"), "p_partkey").alias("node")), "both", 2, 0.5))
query(
    "two_hop_pairs",
    f"WITH {_WEB}, {_BOTH}, s AS (SELECT DISTINCT src, dst FROM b WHERE src NOT IN (SELECT node FROM d WHERE degree > 30)) SELECT x.dst AS a, y.dst AS c, min(x.src) AS via FROM s x JOIN s y ON x.src = y.src AND x.dst < y.dst WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.src = x.dst AND b.dst = y.dst) GROUP BY 1, 2",
)(lambda t: graph.two_hop_pairs(t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")), 30))
query("table_levels", "SELECT 't' || c_nationkey AS table_name, coalesce(max(CASE WHEN c_custkey % 20 = 0 THEN c_custkey % 3 END), max(c_custkey % 4)) AS level FROM customer GROUP BY 1")(
    lambda t: graph.table_levels(t("customer").select(F.concat(F.lit("t"), "c_nationkey").alias("table_name"), (F.col("c_custkey") % 4).alias("level"), F.when(F.col("c_custkey") % 20 == 0, F.col("c_custkey") % 3).alias("pinned")))
)
query(
    "cycle_nodes",
    "WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2 + n_regionkey) % 25 AS dst FROM nation), w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON w.dst = e.src) SELECT DISTINCT src AS node FROM w WHERE src = dst",
)(lambda t: graph.cyclic(t("nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + F.col("n_regionkey")) % 25).alias("dst"))))

# Retrieval and texts

query(
    "vector_topk_per_label",
    "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) "
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE score >= 0.0 QUALIFY rank <= 5",
)(lambda t: retrieval.nearest_each(t("embeddings"), t("embeddings").where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), "label", 5, 0.0))
query(
    "column_scores",
    "WITH n AS (SELECT l_orderkey, list_sort(list(l_linenumber), 'DESC') AS l FROM lineitem GROUP BY 1) SELECT l_orderkey, (l[1] + 0.5 * coalesce(l[2], 0))::DOUBLE AS score FROM n",
)(lambda t: t("lineitem").groupBy("l_orderkey").agg(retrieval.column_score(F.collect_list("l_linenumber")).cast("double").alias("score")))
query(
    "value_scores",
    "WITH v AS (SELECT DISTINCT p_brand, length(p_name) AS n, p_name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS i FROM v) SELECT p_brand, round(sum(1 + n / 20.0), 6)::DOUBLE AS score FROM r WHERE i <= 3 GROUP BY 1",
)(lambda t: t("part").groupBy("p_brand").agg(F.round(retrieval.value_score(F.collect_set("p_name")), 6).alias("score")))
query(
    "unique_best",
    "WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS next FROM orders) SELECT o_custkey, o_orderkey, score FROM s WHERE n = 1 AND score >= 200000 AND score - coalesce(next, 0) >= 20000",
)(lambda t: retrieval.best_above(t("orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score")), "o_custkey", "o_orderkey", 200000.0, 20000.0))


@query("retrieve_candidates")
def retrieve_candidates(t: Tables) -> DataFrame:
    columns = t("part").select(F.concat(F.lit("brand "), F.substring("p_brand", 7, 2)).alias("table_name"), F.col("p_name").alias("column_name")).distinct()
    values = t("part").select(F.concat(F.lit("brand "), F.substring("p_brand", 7, 2)).alias("table_name"), F.col("p_type").alias("value")).distinct()
    edges = t("part").select(F.concat(F.lit("brand "), F.substring("p_brand", 7, 2)).alias("src"), F.concat(F.lit("brand "), F.lit("1"), F.col("p_size") % 5 + 1).alias("dst")).distinct()
    return retrieval.asked_tables(columns, values, edges, "how many cold widgets of brand 13 are economy or promo", 10)


query(
    "key_columns",
    "WITH s AS (SELECT count(*) AS n, count(DISTINCT c_custkey) AS a, count(DISTINCT c_nationkey) AS b, count(DISTINCT c_name) AS c FROM customer) SELECT unnest(['c_custkey', 'c_nationkey', 'c_name']) AS column_name, round(unnest([a, b, c]) / n::DOUBLE, 6) AS ratio, unnest([a, b, c]) >= 0.8 * n AS is_key FROM s",
)(lambda t: documents.key_columns(t("customer"), ["c_custkey", "c_nationkey", "c_name"]))
_CHANGED = "coalesce({0} IS DISTINCT FROM lag({0}) OVER w AND row_number() OVER w > 1, false)::INT"
query(
    "group_columns",
    f"WITH c AS (SELECT o_orderstatus, o_orderpriority, o_custkey // 60 AS block, {_CHANGED.format('o_orderpriority')} AS a, {_CHANGED.format('(o_custkey // 60)')} AS b FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey)), "
    "s AS (SELECT o_orderstatus, count(*) AS n, sum(a) AS a, sum(b) AS b, count(DISTINCT o_orderpriority) AS da, count(DISTINCT block) AS db FROM c GROUP BY 1) "
    "SELECT o_orderstatus, 'o_orderpriority' AS column_name, a::BIGINT AS changes FROM s WHERE 2 * a <= n AND da >= 2 UNION ALL SELECT o_orderstatus, 'block', b::BIGINT FROM s WHERE 2 * b <= n AND db >= 2",
)(lambda t: documents.group_columns(t("orders").withColumn("block", F.floor(F.col("o_custkey") / 60)), ["o_custkey", "o_orderkey"], ["o_orderpriority", "block"], "o_orderstatus"))
query(
    "table_relations",
    "SELECT DISTINCT s_name AS src, unnest(['nation', 'balance']) AS relation, unnest([s_nationkey::VARCHAR, round(s_acctbal)::BIGINT::VARCHAR]) AS dst FROM supplier",
)(
    lambda t: documents.passage_tables(
        t("supplier").select(F.lit("supplier").alias("table_name"), F.col("s_suppkey").alias("row_no"), F.explode(F.create_map(F.lit("name"), "s_name", F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("balance"), F.round("s_acctbal").cast("long").cast("string"))).alias("column_name", "value")), "name"
    )
)
_H = f"CASE WHEN regexp_matches(line, '{text.HEADING}') THEN length(trim(line)) <= 80 ELSE length(trim(line)) BETWEEN 1 AND 40 AND NOT contains('{text.SENTENCE_END}', right(trim(line), 1)) END"
query("heading_blocks", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block FROM documents) SELECT doc_id, block::INT AS block FROM l WHERE {_H}")(
    lambda t: text.blocks(t("documents")).where(text.heading("line")).select("doc_id", "block")
)
query("text_normalized", r"SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM benchmark")(lambda t: t("benchmark").select("item_id", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("text")))
query(
    "wikilinks_stripped",
    "WITH k AS (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'see [[NATION_' || c_nationkey || ']] of' ELSE 'see NATION_' || c_nationkey || ' of' END AS text FROM customer",
)(lambda t: text.known_links(t("customer").select("c_custkey", F.concat(F.lit("see [[NATION_"), "c_nationkey", F.lit("]] of")).alias("text")), "c_custkey", "text", t("nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("target"))))
query(
    "errors_sanitized",
    "SELECT o_orderkey, left('failed at ***:***@host token=*** after ' || o_orderpriority, 60) AS message FROM orders",
)(lambda t: t("orders").select("o_orderkey", text.sanitized(F.concat(F.lit("failed at user"), "o_custkey", F.lit(":pw"), "o_orderkey", F.lit("@host token=abc"), "o_custkey", F.lit(" after "), "o_orderpriority"), 60).alias("message")))
