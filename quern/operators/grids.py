"""Tables as they come in documents: grids with merged cells, headers found in them, rows as objects, tables put together from pieces.

A grid is a set of rows (table keys, row_no, cells, merged): row_no counts from 0 and takes blank rows along, all rows of a table
have as many cells, merged tells whether the row has a cell that spans others. What decides about a header is in the first rows of
a table; only these come together, whatever a table's length, and the rest of a table stays spread over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.rounds import settled

#: Letters of a cell that is too long for a name, and of one that is certainly prose; share of long cells in a header.
LONG, PROSE, SHARE = 24, 40, 0.5
#: Rows behind a note in which a header must begin; rows with text of a table that decide about it.
AHEAD, HEAD = 50, 52
#: What ends a sentence, what lists things, what stands for "as above", and words of weekdays.
SENTENCE, LISTS, PLACEHOLDERS, WEEKDAYS = "[。；！？]", "[、，,]", ("—", "-", "–", "--", "/", "\\"), "星期[一二三四五六日天]|周[一二三四五六日天]"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


class Reader(HTMLParser):
    """The outer tables of a page as rows of cells (text, columns, rows)."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.depth, self.cell, self.span = 0, None, (1, 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.close_cell()
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self.close_cell()
            size = lambda name: max(1, min(int(v), 1000)) if (v := (dict(attrs).get(name) or "").strip()).isdecimal() else 1
            self.cell, self.span = "", (size("colspan"), size("rowspan"))

    def handle_endtag(self, tag: str) -> None:
        if self.depth == 1 and tag in ("td", "th", "tr", "table"):
            self.close_cell()
        if tag == "table" and self.depth:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.depth == 1 and self.cell is not None:
            self.cell += data

    def close_cell(self) -> None:
        if self.cell is not None:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append((self.cell.strip(), *self.span))
            self.cell = None


def filled(rows: list[list[tuple[str, int, int]]]) -> tuple[list[list[str]], list[list[int]]]:
    """The rectangle that cells with spans cover, each place with its cell's text, and the regions (first row, first column, last
    row, last column; from 1) of cells that span others. A cell goes to the first free place of its row.
    """
    rows = [r for r in rows if r]
    width = max((sum(c for _, c, _ in r) for r in rows), default=0)
    grid: list[list[str | None]] = [[None] * width for _ in rows]
    regions = []
    for y, row in enumerate(rows):
        x = 0
        for text, columns, down in row:
            while x < width and grid[y][x] is not None:
                x += 1
            if x == width:
                break
            low, right = min(y + down, len(rows)), min(x + columns, width)
            for line in grid[y:low]:
                line[x:right] = [text] * (right - x)
            if (low - y, right - x) != (1, 1):
                regions.append([y + 1, x + 1, low, right])
    return [[c or "" for c in line] for line in grid], regions


def grids(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_no, row_no, cells, written, merged, regions) of all outer tables in pages.

    written counts the cells that the row itself has; regions are those of merged cells that begin in the row. Tables are numbered
    from 0 in each page. Null and empty pages have none; pages of any size are read whole, one by one, and once: what is read is
    written to the shared folder, as headers and rows are both taken from it.
    """
    schema = StructType([pages.schema[key], *StructType.fromDDL("table_no int, row_no int, cells array<string>, written int, merged boolean, regions array<array<int>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                reader = Reader()
                reader.feed(batch.column(1)[i].as_py() or "")
                reader.close_cell()
                rows = []
                for number, table in enumerate(t for t in reader.tables if any(t)):
                    cells, regions = filled(table)
                    for y, (line, own) in enumerate(zip(cells, [r for r in table if r], strict=True)):
                        rows.append((number, y, line, len(own), any(c > 1 or d > 1 for _, c, d in own), [r for r in regions if r[0] == y + 1]))
                if rows:
                    kinds = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.list_(pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows))), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], schema.names)

    return settled(pages.select(key, html).mapInArrow(run, schema))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _values(cells: Column) -> Column:
    return F.filter(F.transform(cells, _stripped), lambda c: c != "")


def is_blank(cells: Column) -> Column:
    return F.size(_values(cells)) == 0


def is_prose(cells: Column) -> Column:
    """Whether a cell reads like a note and not like the name of a column."""
    return F.exists(cells, lambda c: (F.length(c) > PROSE) | c.rlike(SENTENCE) | (c.rlike(LISTS) & (F.length(c) > LONG)))


def header_like(cells: Column, merged: Column, dated: Column, second: bool) -> Column:
    """Whether a row without prose can be a header: short cells, no measures, no alternation of two values.

    Numbers are names only as a sequence of equal steps (years), and that only in the first row of a header; a single number only
    in a table that tells weekdays. A row of merged cells may repeat its values.
    """
    values = _values(cells)
    plain = F.transform(values, lambda v: F.regexp_replace(v, "[,， ]", ""))
    numbers = F.transform(F.filter(plain, lambda v: v.rlike(NUMBER)), lambda v: v.cast("double"))
    n = F.size(numbers)
    step = F.get(numbers, 1) - F.get(numbers, 0)
    even = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.abs(F.get(numbers, i) - F.get(numbers, i - 1) - step) < 1e-9)
    sequence = (n >= 3) & (F.abs(step) >= 1e-9) & even
    names = F.when(n == 0, True).when(n == 1, dated).otherwise(F.coalesce(sequence, F.lit(False)) & F.lit(not second))
    long = F.size(F.filter(values, lambda v: F.length(v) > LONG))
    changes = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values) - 1)), lambda i: F.get(values, i) != F.get(values, i - 1)))
    alternates = ~merged & (F.size(values) >= 3) & (F.size(F.array_distinct(values)) <= 2) & (changes + 1 >= F.size(values) - 1)
    return (F.size(values) > 0) & ~((long > 0) & (long >= F.size(values) * SHARE)) & names & ~alternates


def headers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header, levels, notes, first_row, width) of each table: its column names and where its data begin.

    rows is a grid (keys, row_no, cells, merged). Long texts before the header are notes, if the header comes within AHEAD rows.
    A second row belongs to the header only if the first has merged or empty cells; names of both are joined by a hyphen, repeats
    and placeholders left out. Columns without a name are col_0, col_1 and so on; a table without a header has such names alone and
    its data begin at row 0. Blank rows are passed over. Of a table the first HEAD rows with text come together, no more.
    """
    told = rows.select(*keys, "row_no", "cells", F.coalesce("merged", F.lit(False)).alias("merged"))
    whole = told.groupBy(*keys).agg(F.max(F.size("cells")).alias("width"), F.bool_or(F.exists("cells", lambda c: c.rlike(WEEKDAYS))).alias("dated"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("row_no"))
    first = told.where(~is_blank(F.col("cells"))).withColumn("_p", place).where(F.col("_p") <= HEAD)
    head = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_no", "cells", "merged", is_prose(F.col("cells")).alias("prose")))).alias("head"))
    both = whole.join(head, keys, "left").withColumn("head", F.coalesce("head", F.expr("array()").cast(head.schema["head"].dataType)))
    both = both.withColumn("one", F.get(F.filter("head", lambda x: ~x.prose), 0))
    both = both.withColumn("before", F.filter("head", lambda x: x.prose & (x.row_no < F.col("one.row_no"))))
    near = (F.size("before") == 0) | (F.col("one.row_no") - F.get("before", 0)["row_no"] <= AHEAD)
    one = F.col("one").isNotNull() & near & header_like(F.col("one.cells"), F.col("one.merged"), F.col("dated"), False)
    both = both.withColumn("has_one", F.coalesce(one, F.lit(False)))
    both = both.withColumn("two", F.get(F.filter("head", lambda x: x.row_no > F.col("one.row_no")), 0))
    full = (F.size("one.cells") >= F.col("width")) & F.forall("one.cells", lambda c: c.rlike(r"\S")) & ~F.col("one.merged")
    two = F.col("has_one") & F.col("two").isNotNull() & ~F.col("two.prose") & ~full & header_like(F.col("two.cells"), F.col("two.merged"), F.col("dated"), True)
    both = both.withColumn("has_two", F.coalesce(two, F.lit(False)))
    levels = F.when(F.col("has_two"), F.array("one.cells", "two.cells")).when(F.col("has_one"), F.array("one.cells")).otherwise(F.expr("array()").cast("array<array<string>>"))
    both = both.withColumn("levels", levels)

    def name(c: Column) -> Column:
        parts = F.array_distinct(F.filter(F.transform("levels", lambda row: _stripped(F.get(row, c))), lambda v: (v != "") & ~v.isin(*PLACEHOLDERS)))
        return F.when(F.size(parts) > 0, F.array_join(parts, "-")).otherwise(F.concat(F.lit("col_"), c.cast("string")))

    header = F.when(F.col("width") > 0, F.transform(F.sequence(F.lit(0), F.col("width") - 1), name)).otherwise(F.expr("array()").cast("array<string>"))
    notes = F.when(F.col("has_one"), F.transform("before", lambda x: F.array_join(_values(x.cells), " "))).otherwise(F.expr("array()").cast("array<string>"))
    start = F.when(F.col("has_two"), F.col("two.row_no") + 1).when(F.col("has_one"), F.col("one.row_no") + 1).otherwise(0)
    return both.select(*keys, header.alias("header"), F.size("levels").alias("levels"), notes.alias("notes"), start.alias("first_row"), "width")


def objects(rows: DataFrame, headed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_no, column_no, column_name, value): the data rows of grids under the names that headers() found; blank rows are left out."""
    data = rows.join(headed.select(*keys, "header", "first_row"), keys).where((F.col("row_no") >= F.col("first_row")) & ~is_blank(F.col("cells")))
    return data.select(*keys, "row_no", F.posexplode(F.arrays_zip("header", "cells"))).select(*keys, "row_no", F.col("pos").alias("column_no"), F.col("col.header").alias("column_name"), _stripped(F.col("col.cells")).alias("value"))


def shifted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_no) of rows that may have slid to the left: fewer cells written than the table is wide, two or more texts at the
    start, and inside the row a gap of two or more empty places. rows is a grid with `written`.
    """
    shape = F.array_join(F.transform("cells", lambda c: F.when(c.rlike(r"\S"), "x").otherwise(".")), "")
    return rows.where((F.col("written") < F.size("cells")) & shape.rlike(r"^xx.*\.\.x")).select(*keys, "row_no")


#: A note of the unit, a unit alone in a cell, a unit in English, and a remark in brackets behind it.
UNIT_NOTE = re.compile(r"[（(]?\s*单位\s*[:：]\s*([^（）()]+?)\s*[）)]?")
UNIT_ALONE = re.compile(r"[（(]?\s*((?:人民币)?[万亿千百]?元|美元|港元|欧元|日元|英镑|百分点|%|‰|人|户|家|股|手|吨|千克|公斤|克|米|平方米|天|次|个|台|辆|小时|分钟)\s*[）)]?")
UNIT_ENGLISH = re.compile(r"(?:dollars|USD|US dollars) in (?:millions|thousands|billions)(?:,? except per share (?:data|amounts))?", re.I)
REMARK = re.compile(r"(?<=\S)\s*[（(][^（）()]*[）)]$")
#: Most levels of a header.
LEVELS = 8


def unit_of(text: str) -> str | None:
    """The unit that a note or a cell states, with nothing else beside it."""
    text = text.strip()
    for pattern, where in ((UNIT_NOTE, text), (UNIT_NOTE, REMARK.sub("", text).strip())):
        if found := pattern.fullmatch(where):
            return found[1].strip()
    if UNIT_ENGLISH.fullmatch(text.strip("()（） ")):
        return text.strip("()（） ")
    found = UNIT_ALONE.fullmatch(text)
    return found[1] if found else None


def told_apart(labels: list[str]) -> list[str] | None:
    """Repeated labels under the heads of equal blocks: a, x, y, b, x, y becomes a, a / x, a / y, b, b / x, b / y. None if they are no such blocks.

    Blocks may follow other columns; heads differ and are no labels of the blocks. The shortest block is taken.
    """
    n, unnamed = len(labels), re.compile(r"column_\d+")
    for size in range(2, n // 2 + 1):
        for skip in range(n % size, n - 2 * size + 1, size):
            blocks = [labels[i : i + size] for i in range(skip, n, size)]
            heads, inner = [b[0] for b in blocks], blocks[0][1:]
            if any(b[1:] != inner for b in blocks) or len(set(heads)) < len(heads) or set(inner) & set(heads) or any(map(unnamed.fullmatch, heads)) or all(map(unnamed.fullmatch, inner)):
                continue
            made = labels[:skip] + [x for h in heads for x in (h, *(f"{h} / {i}" for i in inner))]
            if len(set(made)) == n:
                return made
    return None


def interpret(top: list[list[str]], regions: list[list[int]], width: int, height: int, stub: bool) -> dict:
    """What a table's first rows and merged regions state: unit, header rows and each column's path of labels, or why they do not.

    A row below belongs to the header only if a merged region says so: one that reaches down into it, or one that lies over it and
    is the first row's or inside a wider one. stub: whether all texts below in the first column have letters.
    """
    regions = [r for r in regions if r[2] <= height and r[3] <= width]
    owner = {(y, x): (r[0], r[1]) for r in regions for y in range(r[0], min(r[2], len(top)) + 1) for x in range(r[1], r[3] + 1)}
    text = lambda y, x: top[owner.get((y, x), (y, x))[0] - 1][owner.get((y, x), (y, x))[1] - 1].strip()
    answer = {"confirmed": False, "reason": None, "structure": "unconfirmed", "unit": "", "unit_row": None, "header_rows": [], "fields": []}
    if not height or not width or not top:
        return answer | {"reason": "GRID_ABSENT"}
    first, prefix = 1, ""
    own = [x for x in range(1, width + 1) if top[0][x - 1].strip()]
    if [1, 1, 1, width] in regions:
        unit = unit_of(top[0][0])
        if unit is None:
            return answer | {"reason": "HEADER_FIRST_ROW_SPANNING_NON_UNIT", "structure": "spanning_caption"}
        first, prefix = 2, "unit_note_"
    elif len(own) == 1 and (unit := unit_of(top[0][own[0] - 1])) is not None:
        first, prefix = 2, "unit_note_"
    if prefix:
        answer |= {"unit": unit, "unit_row": 1}
    if first > height:
        return answer | {"reason": "HEADER_ROW_MISSING", "structure": prefix + "unconfirmed"}
    reaches = lambda y: any(first <= r[0] <= y < r[2] for r in regions)
    inside = lambda r: any(first <= p[0] < r[0] and p[1] <= r[1] and r[3] <= p[3] and r[3] - r[1] < p[3] - p[1] for p in regions)
    over = lambda y: any(r[0] == y and r[3] > r[1] and (y == first or inside(r)) for r in regions)
    last = first
    while last < min(height - 1, first + LEVELS - 1) and (reaches(last) or over(last)):
        last += 1
    if reaches(last):
        return answer | {"reason": "HEADER_DEPTH_UNRESOLVED", "structure": "nested_merge"}
    levels, fields = list(range(first, last + 1)), []
    for x in range(1, width + 1):
        path, inherited = [], False
        for y in levels:
            if (label := text(y, x)) and path[-1:] != [label]:
                path.append(label)
                inherited |= owner.get((y, x), (y, x)) != (y, x)
        fields.append({"column": x, "label": " / ".join(path) or f"column_{x}", "path": path, "unit": answer["unit"], "label_source": ("merge_anchor" if inherited else "header") if path else "position"})
    missing = [f for f in fields if f["label_source"] == "position"]
    if width > 1 and missing == fields[:1] and stub:
        fields[0] |= {"label": "row_label", "label_source": "row_stub"}
        missing = []
    if re.search(r"\bexcept\b", answer["unit"], re.I):  # a unit with exceptions is no column's own
        fields = [f | {"unit": ""} for f in fields]
    reasons = ["HEADER_LABEL_MISSING"] * bool(missing) + ["HEADER_ROW_EMPTY"] * (len(missing) == width)
    labels = [f["label"] for f in fields]
    if len(set(labels)) < width:
        apart = told_apart(labels)
        reasons += ["HEADER_LABEL_DUPLICATE"] * (apart is None)
        fields = [f | {"label": label} for f, label in zip(fields, apart or labels, strict=True)]
    structure = prefix + ("grouped_periods" if len(levels) > 1 else "single_row")
    return answer | {"confirmed": not reasons, "reason": ";".join(reasons) or None, "structure": structure, "header_rows": levels, "fields": fields}


INTERPRETED = "confirmed boolean, reason string, structure string, unit string, unit_row int, header_rows array<int>, fields array<struct<column: int, label: string, path: array<string>, unit: string, label_source: string>>"


def interpreted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, confirmed, reason, structure, unit, unit_row, header_rows, fields) of each table, by merged regions and not by looks.

    rows is a grid with `regions`, as grids() gives it. A repeated text is a group's label only where a region covers it; the first
    unique row is no header for that. A first row that states a unit alone, or over the whole width, is the unit's. Rows and columns
    count from 1. Blank rows count as rows. Only the first rows of a table and its regions in them come together.
    """
    numbered = rows.select(*keys, (F.col("row_no") + 1).alias("y"), "cells", "regions")
    letters = F.get("cells", 0).rlike("[A-Za-z㐀-鿿]")
    texts = F.get("cells", 0).rlike(r"\S")
    whole = numbered.groupBy(*keys).agg(F.max("y").alias("height"), F.max(F.size("cells")).alias("width"), F.min(F.size("cells")).alias("least"), F.max(F.when(texts, F.col("y"))).alias("stub"), F.max(F.when(texts & ~letters, F.col("y"))).alias("bare"))
    head = numbered.where(F.col("y") <= LEVELS + 2).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "cells", "regions"))).alias("head"))
    schema = StructType([*[rows.schema[k] for k in keys], *StructType.fromDDL(INTERPRETED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.select(["height", "width", "least", "stub", "bare", "head"]).to_pylist():
                if r["least"] != r["width"]:
                    made.append({"confirmed": False, "reason": "GRID_INCOMPLETE", "structure": "unconfirmed", "unit": "", "unit_row": None, "header_rows": [], "fields": []})
                    continue
                top, regions = [list(map(lambda c: c or "", h["cells"])) for h in r["head"]], [g for h in r["head"] for g in h["regions"] or []]
                plain = interpret(top, regions, r["width"], r["height"], False)
                below = max(plain["header_rows"], default=0)
                made.append(interpret(top, regions, r["width"], r["height"], (r["stub"] or 0) > below and (r["bare"] or 0) <= below))
            field = pa.struct([("column", pa.int32()), ("label", pa.string()), ("path", pa.list_(pa.string())), ("unit", pa.string()), ("label_source", pa.string())])
            types = {"confirmed": pa.bool_(), "reason": pa.string(), "structure": pa.string(), "unit": pa.string(), "unit_row": pa.int32(), "header_rows": pa.list_(pa.int32()), "fields": pa.list_(field)}
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([m[n] for m in made], t) for n, t in types.items())], [*keys, *types])

    return whole.join(head, keys).mapInArrow(run, schema)


#: What begins, ends and parts the cells of a row in a piece, what parts a name from its value, and marks of captions.
LEAD, TAIL, BETWEEN, NAMED, CAPTION, MORE = "| ", " |", " | ", ": ", "表格明细：【表】", r"（续：[^）]*）\s*$"


def _cut(line: Column) -> Column:
    """The cells of a line, as they are: between bars, or `name: value` pairs without their names."""
    body = F.when(line.endswith(TAIL) & (F.length(line) >= len(LEAD) + len(TAIL)), F.substring(line, F.lit(len(LEAD) + 1), F.length(line) - len(LEAD) - len(TAIL))).otherwise(F.substring(line, F.lit(len(LEAD) + 1), F.length(line)))
    split = lambda c: F.split(c, r" \| ", -1)
    value = lambda c: F.trim(F.when(F.contains(c, F.lit(NAMED)), F.substring(c, F.locate(NAMED, c) + len(NAMED), F.length(c))).otherwise(c))
    return F.when(line.startswith(LEAD), split(body)).otherwise(F.transform(split(line), value))


def assembled(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_start, row_end, line, cells, header, caption, broken) of tables that were cut into pieces.

    chunks has keys (the table's, such as a document and the signature of its header), chunk, content, row_start, row_end, and for
    a piece of a single row cell_start and cell_end. A content is a caption, a header line and data lines. Pieces are put in order
    by rows, then cells, then chunk; of several whole pieces of the same rows the first holds, and pieces of cells beside a whole one
    are left out. The cells of a row's pieces are strung together; a piece that goes on inside the last cell is added to it.
    broken: rows are missing before this one. A piece without a header line has no place and gives no rows. Repeated pieces do not
    repeat rows. Pieces of one row come together, and the numbers of a table's pieces, not its texts.
    """
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    at = F.array_position(F.transform(lines, lambda x: x.startswith(LEAD)), True).cast("int")
    piece = chunks.select(*keys, "chunk", "row_start", "row_end", "cell_start", "cell_end", lines.alias("lines"), at.alias("at")).where("at > 0")
    above = F.filter(F.transform(F.slice("lines", F.lit(1), F.col("at") - 1), lambda x: F.regexp_replace(F.regexp_replace(x, MORE, ""), f"^{CAPTION}", "")), lambda x: F.trim(x) != "")
    piece = piece.select(*keys, "chunk", "row_start", "row_end", "cell_start", "cell_end", F.transform(_cut(F.get("lines", F.col("at") - 1)), lambda c: F.trim(c)).alias("header"), F.array_join(above, "\n").alias("caption"), F.slice("lines", F.col("at") + 1, F.size("lines")).alias("data"))
    order = F.struct("row_start", F.coalesce("cell_start", F.lit(-1)), "chunk")
    top = piece.groupBy(*keys).agg(F.min_by("header", order).alias("header"), F.min_by("caption", F.when(F.col("caption") != "", order)).alias("caption"))
    held = piece.groupBy(*keys, "row_start", "row_end").agg(
        F.min_by("data", F.when(F.col("cell_start").isNull(), F.col("chunk"))).alias("whole"),
        F.array_sort(F.collect_set(F.when(F.col("cell_start").isNotNull(), F.struct("cell_start", "chunk", "cell_end", F.coalesce(F.get("data", 0), F.lit("")).alias("line"))))).alias("parts"),  # of one row
    )
    empty = F.expr("array()").cast("array<string>")
    start = F.struct(empty.alias("cells"), F.lit(0).cast("long").alias("next"))

    def joined(state: Column, x: Column) -> Column:
        values, n = _cut(x["line"]), F.size(state["cells"])
        goes_on = (x["cell_start"] == x["cell_end"] - 1) & (x["cell_start"] == n - 1) & (x["cell_start"] != state["next"])
        longer = F.concat(F.slice(state["cells"], F.lit(1), F.greatest(F.lit(0), n - 1)), F.array(F.concat(F.coalesce(F.get(state["cells"], n - 1), F.lit("")), F.coalesce(F.get(values, 0), F.lit("")))))
        return F.struct(F.when(goes_on, longer).otherwise(F.concat(state["cells"], values)).alias("cells"), F.when(goes_on, state["next"]).otherwise(x["cell_end"].cast("long")).alias("next"))

    row = F.array(F.aggregate("parts", start, joined)["cells"])
    whole = F.transform(F.filter("whole", lambda x: F.trim(x) != ""), _cut)
    text = held.select(*keys, "row_start", "row_end", F.posexplode(F.when(F.col("whole").isNotNull(), whole).otherwise(row)).alias("line", "cells"))
    before = F.max("row_end").over(W.partitionBy(*keys).orderBy("row_start", "row_end").rowsBetween(W.unboundedPreceding, -1))
    gaps = held.select(*keys, "row_start", "row_end", (F.col("row_start") > F.coalesce(before, F.lit(0))).alias("_gap"))
    told = text.join(gaps, [*keys, "row_start", "row_end"]).join(top, keys)
    return told.select(*keys, "row_start", "row_end", "line", F.transform("cells", lambda c: F.trim(c)).alias("cells"), "header", F.coalesce("caption", F.lit("")).alias("caption"), (F.col("_gap") & (F.col("line") == 0)).alias("broken"))
