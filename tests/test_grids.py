"""Grids, headers, objects, units and pieces of tables against tables whose answers are known."""

import pytest
from pyspark.sql import functions as F

from quern.operators import grids

MENU = """<p>x</p><table><tr><td colspan=4>本表为每周菜单，请各部门提前一天报送用餐人数，逾期不候。</td></tr>
<tr><th rowspan=2>Name</th><th colspan="2">Amount</th><th>—</th></tr><tr><td>net</td><td>gross</td><td>Note</td></tr>
<tr><td>a</td><td>1</td><td>2</td><td></td></tr><tr></tr><tr><td>b</td><td colspan=2>3<table><tr><td>inner</td></tr></table></td><td>n</td></tr></table>"""
PAGES = [
    (1, MENU + "<table><tr><td>only</td></tr></table>"),
    (2, "<table><tr><td rowspan=3>r</td><td>v1</td></tr><tr><td>v2</td></tr><tr><td>v3</td><td>too many</td></tr></table>"),
    (3, None), (4, "no tables"), (5, "<table></table><table><tr><td>open<td>cells<tr><td>2"), (6, "<table><tr><td rowspan=x colspan=0>odd</td></tr>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return grids.grids(spark.createDataFrame(PAGES, "page_id long, html string"))


def test_grids(pages):
    found = {(r.page_id, r.table_no, r.row_no): (r.cells, r.written, r.merged, r.regions) for r in pages.collect()}
    note = "本表为每周菜单，请各部门提前一天报送用餐人数，逾期不候。"
    assert found[1, 0, 0] == ([note] * 4, 1, True, [[1, 1, 1, 4]])
    assert found[1, 0, 1] == (["Name", "Amount", "Amount", "—"], 3, True, [[2, 1, 3, 1], [2, 2, 2, 3]])
    assert found[1, 0, 2] == (["Name", "net", "gross", "Note"], 3, False, [])
    assert found[1, 0, 4] == (["b", "3", "3", "n"], 3, True, [[5, 2, 5, 3]]) and found[1, 1, 0][0] == ["only"]
    assert [found[2, 0, k][0] for k in range(3)] == [["r", "v1"], ["r", "v2"], ["r", "v3"]]
    assert found[5, 0, 0][0] == ["open", "cells"] and found[5, 0, 1][0] == ["2", ""] and found[6, 0, 0][0] == ["odd"]
    assert {p for p, *_ in found} == {1, 2, 5, 6}


def grid(spark, tables):
    rows = [(t, n, row, n in merged) for t, (rows, merged) in tables.items() for n, row in enumerate(rows)]
    return spark.createDataFrame(rows, "t string, row_no int, cells array<string>, merged boolean")


NOTE = "This sentence is a note that says what stands below, at length"
TABLES = {
    "plain": ([["name", "city"], ["ann", "rome"], ["bob", "oslo"]], ()),
    "years": ([["2023", "2024", "2025"], ["100", "120", "140"]], ()),
    "measures": ([["1.1", "45", "0.3"], ["1", "2", "9"]], ()),
    "two levels": ([["name", "amount", "amount"], ["name", "net", "gross"], ["a", "1", "2"]], (0,)),
    "gap below": ([["name", "", "x"], ["", "net", "—"], ["a", "b", "c"]], ()),
    "third is data": ([["g", "", "h"], ["i", "", "j"], ["k", "", "l"], ["m", "n", "o"]], ()),
    "notes": ([["", ""], [NOTE, ""], [NOTE, ""], ["name", "city"], ["", ""], ["ann", "rome"]], ()),
    "prose and no header": ([[NOTE, ""], ["1", "7"], ["a", "b"]], ()),
    "prose after": ([["name", "remark"], ["a", NOTE]], ()),
    "far": ([[NOTE, ""]] + [["", ""]] * 50 + [["name", "city"], ["ann", "rome"]], ()),
    "near": ([[NOTE, ""]] + [["", ""]] * 49 + [["name", "city"], ["ann", "rome"]], ()),
    "alternates": ([["yes", "no", "yes", "no"], ["a", "b", "c", "d"]], ()),
    "blocks": ([["Q1", "Q1", "Q2", "Q2"], ["a", "b", "c", "d"]], ()),
    "one number": ([["day", "45"], ["a", "b"]], ()),
    "weekday": ([["day", "45292"], ["星期一", "b"]], ()),
    "long names": ([["a", "b", "duplicate_count_in_period"], ["1", "2", "3"]], ()),
    "all long": ([["x" * 30, "y" * 30, "z"], ["1", "2", "3"]], ()),
    "blank": ([["", ""], ["", " "]], ()),
    "one row": ([["name", "city"]], ()),
}
EXPECTED = {
    "plain": (["name", "city"], 1, [], 1), "years": (["2023", "2024", "2025"], 1, [], 1), "measures": (["col_0", "col_1", "col_2"], 0, [], 0),
    "two levels": (["name", "amount-net", "amount-gross"], 2, [], 2), "gap below": (["name", "net", "x"], 2, [], 2), "third is data": (["g-i", "col_1", "h-j"], 2, [], 2),
    "notes": (["name", "city"], 1, [NOTE, NOTE], 4), "prose and no header": (["col_0", "col_1"], 0, [], 0), "prose after": (["name", "remark"], 1, [], 1),
    "far": (["col_0", "col_1"], 0, [], 0), "near": (["name", "city"], 1, [NOTE], 51), "alternates": (["col_0", "col_1", "col_2", "col_3"], 0, [], 0), "blocks": (["Q1", "Q1", "Q2", "Q2"], 1, [], 1),
    "one number": (["col_0", "col_1"], 0, [], 0), "weekday": (["day", "45292"], 1, [], 1), "long names": (["a", "b", "duplicate_count_in_period"], 1, [], 1),
    "all long": (["col_0", "col_1", "col_2"], 0, [], 0), "blank": (["col_0", "col_1"], 0, [], 0), "one row": (["name", "city"], 1, [], 1),
}


def test_headers(spark):
    found = {r.t: (r.header, r.levels, r.notes, r.first_row) for r in grids.headers(grid(spark, TABLES).repartition(5), ["t"]).collect()}
    assert found == EXPECTED
    assert grids.headers(grid(spark, TABLES).limit(0), ["t"]).count() == 0


def test_objects(spark):
    rows = grid(spark, {k: TABLES[k] for k in ("two levels", "notes", "blank")})
    found = {(r.t, r.row_no, r.column_name): r.value for r in grids.objects(rows, grids.headers(rows, ["t"]), ["t"]).collect()}
    assert found == {("two levels", 2, "name"): "a", ("two levels", 2, "amount-net"): "1", ("two levels", 2, "amount-gross"): "2", ("notes", 5, "name"): "ann", ("notes", 5, "city"): "rome"}


def test_shifted(spark):
    rows = [("t", 0, ["a", "b", "", "", "c"], 3), ("t", 1, ["a", "b", "c", "", ""], 3), ("t", 2, ["a", "", "", "", "c"], 2), ("t", 3, ["a", "b", "", "", "c"], 5), ("t", 4, ["a", "b", "", "d", "e"], 4)]
    found = grids.shifted(spark.createDataFrame(rows, "t string, row_no int, cells array<string>, written int"), ["t"])
    assert [r.row_no for r in found.collect()] == [0]


def told(rows, regions=(), stub=False):
    return grids.interpret(rows[:10], [list(r) for r in regions], len(rows[0]), len(rows), stub)


def test_interpretation():
    unit = told([["单位：万元", "", ""], ["项目", "2023年", "2022年"], ["a", "1", "2"]])
    assert (unit["confirmed"], unit["unit"], unit["unit_row"], unit["header_rows"], unit["structure"]) == (True, "万元", 1, [2], "unit_note_single_row")
    group = told([["item", "2023", "2023"], ["item", "in", "out"], ["a", "1", "2"]], [(1, 1, 2, 1), (1, 2, 1, 3)])
    assert group["confirmed"] and [f["label"] for f in group["fields"]] == ["item", "2023 / in", "2023 / out"] and [f["label_source"] for f in group["fields"]] == ["header", "header", "merge_anchor"]
    assert told([["item", "2023", "2023"], ["a", "1", "2"]])["reason"] == "HEADER_LABEL_DUPLICATE"
    assert told([["Report", "Report"], ["a", "b"]], [(1, 1, 1, 2)])["reason"] == "HEADER_FIRST_ROW_SPANNING_NON_UNIT"
    assert told([["", "x"], ["a", "b"]])["reason"] == "HEADER_LABEL_MISSING" and told([["", "x"], ["a", "b"]], stub=True)["fields"][0]["label"] == "row_label"
    assert told([["", ""], ["1", "2"]])["reason"] == "HEADER_LABEL_MISSING;HEADER_ROW_EMPTY"
    blocks = told([["k", "mon", "all", "left", "tue", "all", "left"], list("1234567")])
    assert blocks["confirmed"] and [f["label"] for f in blocks["fields"]] == ["k", "mon", "mon / all", "mon / left", "tue", "tue / all", "tue / left"]
    assert told([["a", "b"], ["a", "c"]], [(1, 1, 2, 1)])["reason"] == "HEADER_DEPTH_UNRESOLVED"
    assert told([["(USD in millions, except per share data)", ""], ["x", "y"], ["1", "2"]])["fields"][0]["unit"] == ""
    assert told([["单位：元"]])["reason"] == "HEADER_ROW_MISSING"
    assert [grids.unit_of(x) for x in ("单位: 万元（未经审计）", "（元）", "Dollars in thousands", "单位", "12元", "")] == ["万元", "元", "Dollars in thousands", None, None, None]


def test_interpreted_tables(spark, pages):
    html = [(1, "<table><tr><td colspan=3>单位：元</td></tr><tr><td rowspan=2></td><td colspan=2>2023</td></tr><tr><td>in</td><td>out</td></tr><tr><td>rent</td><td>1</td><td>2</td></tr></table>"), (2, "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr></table>")]
    found = {r.page_id: r for r in grids.interpreted(grids.grids(spark.createDataFrame(html, "page_id long, html string")), ["page_id", "table_no"]).collect()}
    assert found[1].confirmed and found[1].unit == "元" and found[1].header_rows == [2, 3] and [f.label for f in found[1].fields] == ["row_label", "2023 / in", "2023 / out"]
    assert found[2].confirmed and found[2].structure == "single_row"
    assert grids.interpreted(pages.limit(0), ["page_id"]).count() == 0


PIECES = [
    ("d", "s", 0, "表格明细：【表】Prices（续：1/3）\nin euros\n| name | note |\n| a | x |\n| b | y |", 0, 2, None, None),
    ("d", "s", 1, "| name | note |\n| c | long te", 2, 3, 0, 2),
    ("d", "s", 2, "| name | note |\n| xt goes on |", 2, 3, 1, 2),
    ("d", "s", 3, "| name | note |\nname: d | note: z: 1\n\n", 3, 4, None, None),
    ("d", "s", 4, "| name | note |\n| other |", 3, 4, 0, 1),
    ("d", "s", 6, "| name | note |\n| f | w |", 6, 7, None, None),
    ("d", "s", 7, "no table at all", 9, 10, None, None),
    ("e", "s", 0, "| k |\n| 1 |", 0, 1, None, None),
]


def test_assembled(spark):
    rows = spark.createDataFrame([*PIECES, PIECES[2]], "doc string, sig string, chunk int, content string, row_start int, row_end int, cell_start int, cell_end int").repartition(4)
    found = grids.assembled(rows, ["doc", "sig"]).orderBy("doc", "row_start", "line").collect()
    assert [(r.doc, r.row_start, r.cells, r.broken) for r in found] == [
        ("d", 0, ["a", "x"], False), ("d", 0, ["b", "y"], False), ("d", 2, ["c", "long text goes on"], False), ("d", 3, ["d", "z: 1"], False), ("d", 6, ["f", "w"], True), ("e", 0, ["1"], False),
    ]
    assert {(r.doc, tuple(r.header), r.caption) for r in found} == {("d", ("name", "note"), "Prices\nin euros"), ("e", ("k",), "")}
    assert grids.assembled(rows.limit(0), ["doc"]).where(F.col("broken")).count() == 0


def test_pages_are_read_once(spark):
    """Headers and rows are both taken from what was read: no later plan runs the reader again."""
    rows = grids.grids(spark.createDataFrame([(1, "<table><tr><th>a</th><th>b</th></tr><tr><td>x</td><td>y</td></tr></table>")], "page_id long, html string"))
    found = grids.objects(rows, grids.headers(rows, ["page_id", "table_no"]), ["page_id", "table_no"])
    assert "MapInArrow" not in found._jdf.queryExecution().toString() and found.count() == 2
