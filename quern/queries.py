"""The registered queries of the library's own operators, and the SQL that gives the same rows.

Each is a call of an operator over whole tables; limits stand only where they are the feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import queries_assets, queries_increments, queries_operations, queries_relational, queries_repository, queries_search, queries_tables  # noqa: F401  register their own
from quern.operators import governance, graph, monitor, retrieval, text
from quern.plans import guard, metrics
from quern.registry import ORACLE_SQL, QUERIES, Tables, query  # noqa: F401
from quern.sources.tables import upsert


# Metrics

REVENUE = "l_extendedprice * (1 - l_discount)"


def catalog(t: Tables) -> metrics.Catalog:
    line = lambda agg, expr=None, **more: metrics.Simple("lineitem", agg, expr, time_column="l_shipdate", **more)
    order = lambda agg, expr=None, **more: metrics.Simple("orders", agg, expr, time_column="o_orderdate", **more)
    return metrics.Catalog(
        {"lineitem": lambda: t("lineitem"), "orders": lambda: t("orders")},
        {
            "revenue": line("sum", REVENUE),
            "lines": line("count", "*"),
            "parts": line("count_distinct", "l_partkey"),
            "mean_price": line("avg", "l_extendedprice"),
            "least_price": line("min", "l_extendedprice"),
            "most_price": line("max", "l_extendedprice"),
            "median_quantity": line("median", "l_quantity"),
            "p95_price": line("percentile", "l_extendedprice", percentile=95),
            "returned": line("sum", "l_quantity", filter="l_returnflag = 'R'"),
            "quantity": line("sum", "l_quantity"),
            "order_value": order("sum", "o_totalprice"),
            "orders": order("count", "*"),
            "urgent": order("count", "*", filter="o_orderpriority = '1-URGENT'"),
            "return_rate": metrics.Ratio("returned", "quantity"),
            "price_per_hundred": metrics.Ratio("order_value", 100),
            "basket": metrics.Derived("order_value / orders"),
            "rolling": metrics.Cumulative("order_value", window=(3, "month")),
            "rolling_days": metrics.Cumulative("order_value", window=(14, "day")),
            "quarter_to_date": metrics.Cumulative("order_value", to_date="quarter"),
            "year_to_date": metrics.Cumulative("order_value", to_date="year"),
        },
        {"orders": {"status": "o_orderstatus", "priority": "o_orderpriority"}},
    )


def rounded(rows: DataFrame, places: int = 2) -> DataFrame:
    return rows.withColumn("value", F.round("value", places))


def metric(name: str, of: str, sql: str, by: tuple[str, ...] = (), places: int = 2, **times: str) -> None:
    query(name, sql)(lambda t: rounded(metrics.compile_metric(catalog(t), of, by, **times), places))


for _name, _of, _sql in (
    ("metric_simple_sum", "revenue", f"sum({REVENUE})"),
    ("metric_simple_avg", "mean_price", "avg(l_extendedprice)"),
    ("metric_simple_min", "least_price", "min(l_extendedprice)"),
    ("metric_simple_max", "most_price", "max(l_extendedprice)"),
    ("metric_simple_median", "median_quantity", "median(l_quantity)"),
    ("metric_simple_p95", "p95_price", "quantile_cont(l_extendedprice, 0.95)"),
):
    metric(_name, _of, f"SELECT round({_sql}, 2) AS value FROM lineitem")
query("metric_simple_count", "SELECT count(*) AS value FROM lineitem")(lambda t: metrics.compile_metric(catalog(t), "lines"))
query("metric_simple_count_distinct", "SELECT count(DISTINCT l_partkey) AS value FROM lineitem")(lambda t: metrics.compile_metric(catalog(t), "parts"))
metric(
    "metric_grouped_month", "revenue",
    f"SELECT l_returnflag, date_trunc('month', l_shipdate)::TIMESTAMP AS period, round(sum({REVENUE}), 2) AS value FROM lineitem GROUP BY 1, 2",
    ("l_returnflag", "l_shipdate@month"),
)
metric("metric_filter", "returned", "SELECT l_linestatus, round(sum(l_quantity), 2) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1", ("l_linestatus",))
metric(
    "metric_time_window", "revenue",
    f"SELECT l_returnflag, round(sum({REVENUE}), 2) AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1996-12-31' GROUP BY 1",
    ("l_returnflag",), time_from="1996-01-01", time_to="1996-12-31",
)
metric(
    "metric_ratio_nullsafe", "return_rate",
    "SELECT l_linestatus, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R') / nullif(sum(l_quantity), 0), 6) AS value FROM lineitem GROUP BY 1",
    ("l_linestatus",), places=6,
)
metric("metric_ratio_scalar", "price_per_hundred", "SELECT o_orderstatus AS status, round(sum(o_totalprice) / 100, 2) AS value FROM orders GROUP BY 1", ("status",))
metric("metric_derived", "basket", "SELECT o_orderpriority AS priority, round(sum(o_totalprice) / count(*), 4) AS value FROM orders GROUP BY 1", ("priority",), places=4)
_MONTHS = "b AS (SELECT date_trunc('{0}', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1)"
metric(
    "metric_cumulative_rolling_3month", "rolling",
    f"WITH {_MONTHS.format('month')} SELECT period, round(sum(v) OVER (ORDER BY period RANGE BETWEEN INTERVAL '3' MONTH PRECEDING AND CURRENT ROW), 2) AS value FROM b",
    ("o_orderdate@month",),
)
metric(
    "metric_cumulative_rolling_14day", "rolling_days",
    f"WITH {_MONTHS.format('day')} SELECT period, round(sum(v) OVER (ORDER BY period RANGE BETWEEN INTERVAL '14' DAY PRECEDING AND CURRENT ROW), 2) AS value FROM b",
    ("o_orderdate@day",),
)
for _grain in ("quarter", "year"):
    metric(
        f"metric_grain_to_date_{_grain}", f"{_grain}_to_date",
        f"WITH {_MONTHS.format('month')} SELECT period, round(sum(v) OVER (PARTITION BY date_trunc('{_grain}', period) ORDER BY period ROWS UNBOUNDED PRECEDING), 2) AS value FROM b",
        ("o_orderdate@month",),
    )
for _name, _months in (("metric_mom", 1), ("metric_yoy", 12)):
    query(
        _name,
        f"WITH {_MONTHS.format('month')} SELECT b.period, round(b.v, 2) AS value, round(p.v, 2) AS previous, round((b.v - p.v) / nullif(p.v, 0), 6) AS change "
        f"FROM b LEFT JOIN b p ON b.period = p.period + INTERVAL '{_months}' MONTH",
    )(
        lambda t, months=_months: metrics.compared(metrics.compile_metric(catalog(t), "order_value", ("o_orderdate@month",)), months).select(
            "period", F.round("value", 2).alias("value"), F.round("previous", 2).alias("previous"), F.round("change", 6).alias("change")
        )
    )

# Operations


@query(
    "monitor_summary",
    "SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value >= 50) AS succeeded, count(*) FILTER (WHERE value < 10) AS failed, "
    "round(count(*) FILTER (WHERE value >= 50)::DOUBLE / nullif(count(*) FILTER (WHERE value >= 50 OR value < 10), 0), 6) AS success_rate, round(avg(value), 4) AS mean_value "
    "FROM events GROUP BY 1",
)
def monitor_summary(t: Tables) -> DataFrame:
    return monitor.summary(t("events"), ["event_type"], F.col("value") >= 50, F.col("value") < 10, "value")


for _name, _size, _sql in (
    ("monitor_trend_5m", "5 minutes", "time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01')"),
    ("monitor_trend_hour", "hour", "date_trunc('hour', ts)::TIMESTAMP"),
    ("monitor_trend_week", "week", "date_trunc('week', ts)::TIMESTAMP"),
):
    query(_name, f"SELECT {_sql} AS bucket, event_type, count(*) AS total, round(sum(value), 2) AS sum_value FROM events GROUP BY 1, 2")(
        lambda t, size=_size: monitor.trend(t("events"), "ts", size, ["event_type"], "value")
    )
query(
    "monitor_trend_day_tz",
    "SELECT date_trunc('day', ts + INTERVAL 8 HOUR)::TIMESTAMP - INTERVAL 8 HOUR AS bucket, event_type, count(*) AS total, round(sum(value), 2) AS sum_value FROM events GROUP BY 1, 2",
)(lambda t: monitor.trend(t("events"), "ts", "day", ["event_type"], "value", "Asia/Shanghai"))


@query(
    "monitor_trend_gapfill",
    "WITH b AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS total FROM events GROUP BY 1, 2), "
    "g AS (SELECT event_type, unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 5 MINUTE)) AS bucket FROM (SELECT DISTINCT event_type FROM b)) "
    "SELECT g.bucket::TIMESTAMP AS bucket, g.event_type, coalesce(total, 0)::BIGINT AS total FROM g LEFT JOIN b USING (bucket, event_type)",
)
def monitor_trend_gapfill(t: Tables) -> DataFrame:
    counts = monitor.trend(t("events"), "ts", "5 minutes", ["event_type"], "value").drop("sum_value")
    return monitor.filled(counts, "5 minutes", ["event_type"], {"total": 0})


query(
    "token_top_share",
    "WITH s AS (SELECT user_id, sum(value) AS v FROM events GROUP BY 1) "
    "SELECT user_id, round(v, 2) AS sum_value, round(v / nullif(sum(v) OVER (), 0), 6) AS share FROM s ORDER BY v DESC NULLS LAST, user_id LIMIT 10",
)(lambda t: monitor.shares(t("events"), "user_id", "value", 10))
query(
    "latest_version_distinct_on",
    "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC",
)(lambda t: monitor.latest(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate"))
query(
    "retention_fair_batch",
    "WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) "
    "SELECT o_custkey, o_orderkey, o_orderdate FROM r WHERE n <= 2 ORDER BY o_orderdate, o_orderkey LIMIT 500",
)(lambda t: monitor.capped(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], 2, 500))
query(
    "lww_dedupe",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1",
)(lambda t: monitor.last_write_wins(t("events").select("user_id", "event_type", "value", "event_id"), ["user_id"], "event_id").select("user_id", "event_type", "value"))
query(
    "key_antijoin_insert", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"
)(lambda t: monitor.absent(t("orders").select("o_orderkey", "o_custkey"), t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]))


@query(
    "upsert_orders",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS state FROM orders",
)
def upsert_orders(t: Tables) -> DataFrame:
    old = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    return upsert(old, old.where("state = 'F'").withColumn("state", F.lit("done")), ["o_orderkey"])


@query(
    "call_full_outer_attempts",
    "WITH a AS (SELECT o_custkey AS k, count(*) AS calls FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS attempts FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) "
    "SELECT coalesce(a.k, b.k) AS k, calls, attempts FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k",
)
def call_full_outer_attempts(t: Tables) -> DataFrame:
    calls = t("orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("calls"))
    attempts = t("orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("attempts"))
    return metrics.full_join(calls, attempts, ["k"])


@query(
    "cost_allocation",
    "WITH a AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS amount FROM orders), p AS (SELECT l_orderkey AS k, l_linenumber FROM lineitem), n AS (SELECT k, count(*) AS n FROM p GROUP BY 1) "
    "SELECT k, l_linenumber, floor((amount + n // 2) / n)::BIGINT AS allocated FROM p JOIN a USING (k) JOIN n USING (k)",
)
def cost_allocation(t: Tables) -> DataFrame:
    amounts = t("orders").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").alias("amount"))
    parts = t("lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    return monitor.even_split(amounts, parts, "k", "amount").select("k", "l_linenumber", "allocated")


query("json_props_unnest", "SELECT cast(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")(
    lambda t: t("events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))
)
query(
    "asset_catalog_union",
    "SELECT 'region' AS kind, r_regionkey::BIGINT AS id, r_name AS name FROM region UNION ALL SELECT 'nation', n_nationkey::BIGINT, n_name FROM nation UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier",
)(
    lambda t: t("region").select(F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    .union(t("nation").select(F.lit("nation"), F.col("n_nationkey").cast("long"), "n_name"))
    .union(t("supplier").select(F.lit("supplier"), "s_suppkey", "s_name"))
)

# Governance

RULES = [
    governance.Rule("rows", "rowCount", operator="mustBeGreaterThan", bounds=(0,)),
    governance.Rule("no_name", "nullValues", "c_name"),
    governance.Rule("twins", "duplicateValues", "c_custkey"),
    governance.Rule("nations", "duplicateValues", "c_nationkey", "mustBeBetween", (0, 10)),
    governance.Rule("segments", "invalidValues", "c_mktsegment", "mustBeLessThan", (1,), valid=("BUILDING", "MACHINERY")),
    governance.Rule("names", "invalidValues", "c_name", pattern="Customer%"),
    governance.Rule("balances", "missingValues", "c_nationkey", "mustNotBeBetween", (1, 2), missing=("0", "1")),
]


@query(
    "quality_rules_onepass",
    "WITH m AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_name IS NULL) AS a, count(*) - count(DISTINCT c_custkey) AS b, count(*) - count(DISTINCT c_nationkey) AS c, "
    "count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS d, count(*) FILTER (WHERE NOT c_name LIKE 'Customer%') AS e, count(*) FILTER (WHERE c_nationkey IS NULL OR c_nationkey IN (0, 1)) AS f FROM customer) "
    "SELECT 'rows' AS rule, n::BIGINT AS measured, n > 0 AS passed FROM m UNION ALL SELECT 'no_name', a, a = 0 FROM m UNION ALL SELECT 'twins', b, b = 0 FROM m UNION ALL SELECT 'nations', c, c BETWEEN 0 AND 10 FROM m "
    "UNION ALL SELECT 'segments', d, d < 1 FROM m UNION ALL SELECT 'names', e, e = 0 FROM m UNION ALL SELECT 'balances', f, f < 1 OR f > 2 FROM m",
)
def quality_rules_onepass(t: Tables) -> DataFrame:
    return governance.check(t("customer"), RULES)


query(
    "column_profile",
    "SELECT 'c_name' AS column_name, count(c_name) AS non_null, count(DISTINCT c_name) AS distinct_values, NULL::DOUBLE AS least, NULL::DOUBLE AS greatest FROM customer "
    "UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(DISTINCT c_nationkey), min(c_nationkey), max(c_nationkey) FROM customer "
    "UNION ALL SELECT 'c_acctbal', count(c_acctbal), count(DISTINCT c_acctbal), min(c_acctbal), max(c_acctbal) FROM customer",
)(lambda t: governance.profile(t("customer"), ["c_name", "c_nationkey", "c_acctbal"]))
query(
    "pii_value_scan",
    " UNION ALL ".join(
        f"SELECT '{k}' AS kind, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS rows_hit, round(count(*) FILTER (WHERE regexp_matches(text, '{p}')) / nullif(count(*), 0)::DOUBLE, 6) AS share FROM documents"
        for k, p in governance.PATTERNS.items()
    ),
)(lambda t: governance.scan(t("documents"), "text"))
query(
    "governance_mask",
    "SELECT c_custkey, sha256(c_name) AS c_name, repeat('*', greatest(0, length(c_mktsegment) - 4)) || right(c_mktsegment, 4) AS c_mktsegment, NULL::DOUBLE AS c_acctbal FROM customer",
)(lambda t: governance.masked(t("customer").drop("c_nationkey"), {"c_name": "hash", "c_mktsegment": "partial", "c_acctbal": "null"}))
query("governance_row_filter", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 3 OR c_acctbal < 0")(
    lambda t: governance.permitted(t("customer"), ["c_nationkey = 3", "c_acctbal < 0"]).select("c_custkey", "c_nationkey")
)
query(
    "fk_containment",
    "WITH o AS (SELECT DISTINCT o_custkey AS v FROM orders), k AS (SELECT DISTINCT c_custkey AS w FROM customer) "
    "SELECT count(v) AS distinct_values, count(w) AS contained, round(count(w) / nullif(count(v), 0)::DOUBLE, 6) AS containment FROM o LEFT JOIN k ON v = w",
)(lambda t: governance.containment(t("orders"), "o_custkey", t("customer"), "c_custkey"))


def workspace(t: Tables) -> guard.Workspace:
    rows = t("orders")
    space = guard.Workspace(rows.sparkSession, most_rows=50)
    space.register("orders", rows, {"o_custkey": "null"}, ["o_orderstatus <> 'P'"])
    return space


query(
    "guard_limit",
    "SELECT o_orderkey, NULL::BIGINT AS o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)(lambda t: workspace(t).query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey", limit=10_000))
query("cursor_page", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderkey LIMIT 20 OFFSET 40")(
    lambda t: workspace(t).query("SELECT o_orderkey FROM orders ORDER BY o_orderkey", limit=20, offset=guard.position(guard.cursor(40)))
)

# Graphs from foreign keys

_TREE = (
    "e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"
)


def tree(t: Tables) -> DataFrame:
    edge = lambda table, a, child, b, parent: t(table).select(F.concat(F.lit(a), child).alias("src"), F.concat(F.lit(b), parent).alias("dst"))
    return edge("nation", "n", "n_nationkey", "r", "n_regionkey").union(edge("customer", "c", "c_custkey", "n", "c_nationkey")).union(edge("supplier", "s", "s_suppkey", "n", "s_nationkey"))


query("graph_degree", f"WITH {_TREE}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src AS node, count(*) AS degree FROM b GROUP BY 1")(lambda t: graph.degrees(tree(t)))
query(
    "khop",
    f"WITH RECURSIVE {_TREE}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT 'r1' AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM w JOIN b ON node = src WHERE hops < 2) SELECT node, min(hops) AS hops FROM w GROUP BY 1",
)(lambda t: graph.levels(tree(t), t("region").where("r_regionkey = 1").select(F.concat(F.lit("r"), "r_regionkey").alias("node")), 2, directed=False))
query(
    "lineage_levels",
    f"WITH RECURSIVE {_TREE}, w AS (SELECT DISTINCT src AS node, 0 AS hops FROM e WHERE src LIKE 's%' UNION SELECT dst, hops + 1 FROM w JOIN e ON node = src WHERE hops < 3) SELECT node, min(hops) AS hops FROM w GROUP BY 1",
)(lambda t: graph.levels(tree(t), tree(t).where("src like 's%'").select(F.col("src").alias("node")), 3))
query(
    "subclass_closure",
    f"WITH RECURSIVE {_TREE}, w AS (SELECT src AS node, dst AS ancestor FROM e UNION SELECT w.node, e.dst FROM w JOIN e ON w.ancestor = e.src) "
    "SELECT ancestor, node FROM w UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e",
)(lambda t: graph.closure(tree(t)))
query(
    "label_propagation",
    f"WITH RECURSIVE {_TREE}, m AS (SELECT 's' || s_suppkey AS node, CASE WHEN s_acctbal > 5000 THEN 2 ELSE 1 END AS level FROM supplier), "
    "w AS (SELECT node, level, 0 AS hops FROM m UNION SELECT dst, level, hops + 1 FROM w JOIN e ON node = src WHERE hops < 3) SELECT node, max(level) AS level FROM w GROUP BY 1",
)(lambda t: graph.propagated(tree(t), t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.when(F.col("s_acctbal") > 5000, 2).otherwise(1).alias("level"))))


@query("path_search")
def path_search(t: Tables) -> DataFrame:
    """The best paths from the first nation of a region over suppliers (joins) and customers' segments (lineage)."""
    edge = lambda rows, a, b, kind, confidence: rows.select(F.col(a).alias("src"), F.lit("k").alias("src_column"), F.col(b).alias("dst"), F.lit("k").alias("dst_column"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit("declared").alias("origin")).distinct()
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = edge(rows, "n_name", "r_name", "join", 1.0)
    edges = edges.union(edge(t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "n_name", "join", 0.8))
    edges = edges.union(edge(t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")), "c_mktsegment", "n_name", "lineage", 0.9))
    names = [r.n_name for r in t("nation").where("n_regionkey = 1").orderBy("n_nationkey").select("n_name").limit(2).collect()]
    return graph.ranked_paths(edges, names[0], names[1:], 3, 200, 12, 2)


# Text and retrieval

TOKENS = r"(length(regexp_replace({0}, '[\x00-\x7F]+', '', 'g')) + coalesce(list_sum(list_transform(regexp_extract_all({0}, '[\x00-\x7F]+'), lambda r: (length(r) + 3) // 4)), 0))::INT"
query("estimate_tokens", f"SELECT doc_id, {TOKENS.format("coalesce(text, '')")} AS tokens FROM documents")(lambda t: t("documents").select("doc_id", text.estimated_tokens("text").alias("tokens")))
_HEADING = (
    f"CASE WHEN regexp_matches(line, '{text.HEADING}') THEN length(trim(line)) <= 80 "
    f"ELSE length(trim(line)) BETWEEN 1 AND 40 AND NOT contains('{text.SENTENCE_END}', right(trim(line), 1)) END"
)
query(
    "noise_blocks",
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) "
    f"SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '{text.NOISE}')) AS noise, count(*) FILTER (WHERE {_HEADING}) AS headings FROM l GROUP BY 1",
)(lambda t: text.blocks(t("documents")).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(text.noise("line")).alias("noise"), F.count_if(text.heading("line")).alias("headings")))
query(
    "repeated_lines",
    "WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT doc_id, line, count(*) AS times FROM l WHERE length(line) > 0 AND length(line) <= 20 GROUP BY 1, 2 HAVING count(*) >= 3",
)(lambda t: text.repeated_noise(text.blocks(t("documents"))))
query(
    "chunk_overlap",
    "WITH c AS (SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 100) / 900.0)::BIGINT))) AS chunk FROM documents WHERE length(text) > 0) "
    "SELECT doc_id, chunk::INT AS chunk, sha256(substring(text, chunk * 900 + 1, 1000)) AS content_sha256, " + TOKENS.format("substring(text, chunk * 900 + 1, 1000)") + " AS tokens FROM c",
)(lambda t: text.chunks(t("documents"), 1000, 100).select("doc_id", "chunk", F.sha2("content", 256).alias("content_sha256"), "tokens"))
query("page_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages")(lambda t: text.links(t("pages")))


def _vector(t: Tables) -> list[float]:
    return [float(x) for x in t("embeddings").orderBy("vec_id").select("embedding").first().embedding]


_COSINE = "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q) "
query("vector_topk", _COSINE + "SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 40")(lambda t: retrieval.above(t("embeddings"), _vector(t), -1.0, 40))
query("vector_threshold", _COSINE + "SELECT vec_id, score FROM s WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 1000")(lambda t: retrieval.above(t("embeddings"), _vector(t), 0.2, 1000))

_TERMS = ["the", "and", "ing"]
_WORDS = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents)"
_TF = "c AS (SELECT doc_id, len(ws) AS n, " + ", ".join(f"len(list_filter(ws, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(_TERMS)) + " FROM w)"
_BM25 = " + ".join(
    f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(_TERMS))
)
query(
    "bm25_topk",
    f"WITH {_WORDS}, {_TF}, s AS (SELECT count(*) AS docs, avg(n) AS mean, " + ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(_TERMS))) + " FROM c), "
    f"r AS (SELECT doc_id, round({_BM25}, 6) AS score FROM c, s) SELECT doc_id, score FROM r WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20",
)(lambda t: retrieval.bm25(t("documents"), _TERMS, 20))


@query(
    "rrf_fuse",
    f"WITH {_WORDS}, {_TF}, s AS (SELECT count(*) AS docs, avg(n) AS mean, " + ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(_TERMS))) + " FROM c), "
    f"b AS (SELECT doc_id AS id, round({_BM25}, 6) AS score FROM c, s), q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), v AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q), "
    "r AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id) - 1) AS part FROM v WHERE score > 0 UNION ALL SELECT id, 0.6 / (60 + row_number() OVER (ORDER BY score DESC, id) - 1) FROM b WHERE score > 0) "
    "SELECT id, round(sum(part), 8) AS score FROM r GROUP BY 1 ORDER BY score DESC, id LIMIT 20",
)
def rrf_fuse(t: Tables) -> DataFrame:
    """Both signals whole: every embedding by its likeness to the first, every document by its words."""
    asked = F.array(*[F.lit(x) for x in _vector(t)])
    near = t("embeddings").select(F.col("vec_id").alias("id"), F.round(retrieval.cosine(F.col("embedding"), asked), 6).alias("score"))
    words = retrieval.scored_terms(t("documents"), _TERMS).select(F.col("doc_id").alias("id"), "score")
    return retrieval.fused([(near, 1.0), (words, 0.6)], "id", 20)


@query(
    "jaccard_rank",
    "WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS ws FROM benchmark), q AS (SELECT ws AS qs FROM b ORDER BY item_id LIMIT 1) "
    "SELECT item_id, round(len(list_intersect(ws, qs)) / nullif(len(list_distinct(list_concat(ws, qs))), 0)::DOUBLE, 6) AS score FROM b, q",
)
def jaccard_rank(t: Tables) -> DataFrame:
    first = t("benchmark").orderBy("item_id").select("text").first().text
    return t("benchmark").select("item_id", F.round(retrieval.jaccard(retrieval.tokens("text"), retrieval.tokens(F.lit(first))), 6).alias("score"))


query(
    "rerank_aggregate",
    "SELECT conv_id AS doc_id, round(avg(length(text)), 6) AS score FROM conversations GROUP BY 1",
)(lambda t: retrieval.by_document(t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), F.length("text").alias("score")), "mean"))
query(
    "context_budget",
    "WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS total FROM conversations) SELECT conv_id, turn FROM r WHERE total <= 600",
)(lambda t: retrieval.budgeted(t("conversations").select("conv_id", "turn", F.length("text").alias("size")), ["conv_id"], [F.col("turn")], "size", 600).select("conv_id", "turn"))
query(
    "eval_judge_rollup",
    "SELECT d.source, count(*) AS cases, count(*) FILTER (WHERE quality = 1) AS passed, round(avg(quality), 6) AS accuracy FROM labels l JOIN documents d USING (doc_id) GROUP BY 1",
)(lambda t: t("labels").join(t("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("cases"), F.count_if(F.col("quality") == 1).alias("passed"), F.round(F.avg("quality"), 6).alias("accuracy")))
