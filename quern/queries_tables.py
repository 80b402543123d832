"""Registered queries of tables in documents, with their SQL: the tables are written from rows, and the SQL reads the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import grids
from quern.registry import Tables, query

NUMBERED = "o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS n, count(*) OVER (PARTITION BY o_custkey)::INT AS c FROM orders)"


def _cells(*texts: Column, tag: str = "td") -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>")) for x in texts], F.lit("</tr>"))


def order_pages(t: Tables, head: str) -> DataFrame:
    """(page_id, html): for each customer a page with a table of its orders under a head."""
    row = _cells(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.concat(F.col("o_orderpriority"), F.lit(" &amp; more")))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]), "")  # of one customer
    html = F.concat(F.lit(f"<html><body><p>Orders</p><table>{head}"), rows, F.lit("</table></body></html>"))
    return t("orders").groupBy(F.col("o_custkey").alias("page_id")).agg(html.alias("html"))


GROUPED = "<tr><th rowspan=2>order</th><th colspan=2>state</th></tr><tr><th>status</th><th>priority</th></tr>"
NOTED = "<tr><td colspan=3>The orders of one customer follow below this sentence, all of them.</td></tr>" + GROUPED
UNIT = "<tr><td>单位：元</td><td></td><td></td></tr>" + GROUPED


@query(
    "table_objects",
    f"WITH {NUMBERED} SELECT o_custkey AS page_id, n + 2 AS row_no, x.column_name, x.value FROM o, "
    "unnest([{'column_name': 'order', 'value': o_orderkey::VARCHAR}, {'column_name': 'state-status', 'value': o_orderstatus}, {'column_name': 'state-priority', 'value': o_orderpriority || ' & more'}]) AS u(x)",
)
def table_objects(t: Tables) -> DataFrame:
    rows = grids.grids(order_pages(t, NOTED))
    return grids.objects(rows, grids.headers(rows, ["page_id", "table_no"]), ["page_id", "table_no"]).select("page_id", "row_no", "column_name", "value")


@query(
    "table_headers",
    "SELECT o_custkey AS page_id, 'order,state-status,state-priority' AS header, 2 AS levels, 1 AS notes, 3 AS first_row FROM orders GROUP BY 1",
)
def table_headers(t: Tables) -> DataFrame:
    found = grids.headers(grids.grids(order_pages(t, NOTED)), ["page_id", "table_no"])
    return found.select("page_id", F.array_join("header", ",").alias("header"), "levels", F.size("notes").alias("notes"), "first_row")


@query(
    "tables_interpreted",
    "SELECT o_custkey AS page_id, true AS confirmed, '元' AS unit, 'unit_note_grouped_periods' AS structure, 'order | state / status | state / priority' AS labels FROM orders GROUP BY 1 HAVING count(*) > 0",
)
def tables_interpreted(t: Tables) -> DataFrame:
    found = grids.interpreted(grids.grids(order_pages(t, UNIT)), ["page_id", "table_no"])
    return found.select("page_id", "confirmed", "unit", "structure", F.array_join(F.transform("fields", lambda f: f["label"]), " | ").alias("labels"))


@query(
    "rows_shifted",
    "SELECT p_partkey, 0 AS row_no FROM part WHERE p_size < 25 AND p_type <> 'ECONOMY'",
)
def rows_shifted(t: Tables) -> DataFrame:
    """Parts as rows of six cells, of which small ones lack two inside and economical ones two at the end."""
    gap, economy = F.col("p_size") < 25, F.col("p_type") == "ECONOMY"
    cells = F.array("p_name", "p_brand", F.when(gap, "").otherwise(F.col("p_type")), F.when(gap, "").otherwise("x"), F.when(economy, "").otherwise("y"), F.when(economy, "").otherwise("z"))
    written = F.when(gap | economy, 4).otherwise(6)
    return grids.shifted(t("part").select("p_partkey", F.lit(0).alias("row_no"), cells.alias("cells"), written.alias("written")), ["p_partkey"])


PIECES = (
    "l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax)::INT AS n FROM lineitem), "
    "k AS (SELECT *, max(n) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l WHERE l_discount > 0)"
)


@query(
    "tables_assembled",
    f"WITH {PIECES} SELECT l_orderkey, n - 1 AS row_start, l_partkey || '|' || l_returnflag || '|' || l_linestatus || ' and ' || l_suppkey AS cells, n - 1 > coalesce(before, 0) AS broken, 'Lines' AS caption FROM k",
)
def tables_assembled(t: Tables) -> DataFrame:
    """Lines of orders as pieces of tables: rows without discount are lost, rows of returned goods come in two pieces of cells."""
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")
    lines = t("lineitem").withColumn("n", F.row_number().over(order)).where("l_discount > 0")
    head, end = F.lit("表格明细：【表】Lines（续：2/9）\n| part | flag | status |\n| "), F.lit(" |")
    last = F.concat(F.col("l_linestatus"), F.lit(" and "), F.col("l_suppkey").cast("string"))
    first = F.concat_ws(" | ", F.col("l_partkey").cast("string"), "l_returnflag")
    split = F.col("l_returnflag") == "R"
    none = F.lit(None).cast("int")
    piece = lambda k, text, a, b: F.struct((F.col("n") * 2 + k).alias("chunk"), F.concat(head, text, end).alias("content"), a.alias("cell_start"), b.alias("cell_end"))
    two = F.array(piece(1, F.concat(first, F.lit(" | "), F.col("l_linestatus")), F.lit(0), F.lit(3)), piece(0, F.concat(F.lit(" and "), F.col("l_suppkey").cast("string")), F.lit(2), F.lit(3)))
    one = F.array(piece(0, F.concat(first, F.lit(" | "), last), none, none))
    pieces = lines.select("l_orderkey", (F.col("n") - 1).alias("row_start"), F.col("n").alias("row_end"), F.explode(F.when(split, two).otherwise(one)).alias("x")).select("l_orderkey", "row_start", "row_end", "x.*")
    found = grids.assembled(pieces, ["l_orderkey"])
    return found.select("l_orderkey", "row_start", F.array_join("cells", "|").alias("cells"), "broken", "caption")
