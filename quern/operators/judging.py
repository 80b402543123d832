"""Result tables matched under tolerance, whatever the order of rows and columns, and answers judged by them."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: How far two numbers that are not both whole may be apart; reasons that count as an error, and as a rightful refusal.
RELATIVE, ABSOLUTE = 1e-2, 0.5
REFUSALS = ("not_answerable", "ambiguous", "no_candidate")
#: Rows of a result table that are compared; larger ones are told as such and not compared in part.
MOST_ROWS = 1000


def cell(value: str | None) -> float | int | str:
    """A cell as it is compared: a whole number, a number, or a trimmed text; missing ones and blanks are zero."""
    text = (value or "").strip()
    if not text:
        return 0
    try:
        return int(text)
    except ValueError:
        pass
    try:
        number = float(text)
    except ValueError:
        return text
    if math.isnan(number):
        return 0
    return int(number) if math.isfinite(number) and number.is_integer() else number


def same_cell(a: float | int | str, b: float | int | str) -> bool:
    """Whole numbers must be equal, other numbers near each other, texts the same."""
    if isinstance(a, str) or isinstance(b, str):
        return a == b
    if isinstance(a, int) and isinstance(b, int):
        return a == b
    return math.isclose(a, b, rel_tol=RELATIVE, abs_tol=ABSOLUTE)


def paired(left: list, right: list, same) -> bool:
    """Whether all of the left can be given partners of their own on the right, one for each; both are as many.

    Partners that are taken give way along other choices, so a near partner that is taken first hides no match.
    """
    if len(left) != len(right):
        return False
    choices = [[j for j, y in enumerate(right) if same(x, y)] for x in left]
    owner: dict[int, int] = {}  # of the right
    for i in range(len(left)):
        came, open_, free = {}, [i], None
        while open_ and free is None:
            x = open_.pop()
            for j in choices[x]:
                if j not in came:
                    came[j] = x
                    if j not in owner:
                        free = j
                        break
                    open_.append(owner[j])
        if free is None:
            return False
        while True:  # partners change along the way that led here
            x = came[free]
            before = next((j for j, o in owner.items() if o == x), None)
            owner[free] = x
            if x == i:
                break
            free = before
    return True


def same_table(truth: list[list], answer: list[list]) -> bool:
    """Whether an answer is the true table: rows in any order, cells of a row in any order, each with a partner of its own.

    A true table of a single cell is found in any cell of the answer. Empty tables match nothing.
    """
    if not truth or not answer:
        return False
    if sum(map(len, truth)) == 1:
        value = next(c for row in truth for c in row)
        return any(same_cell(value, c) for row in answer for c in row)
    return paired(truth, answer, lambda a, b: paired(a, b, same_cell))


def matched(truths: DataFrame, answers: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(case, matched, truth_no, too_large) of each case of truths (case, truth_no, cells): whether its answer (case, cells) is one of its true tables.

    cells are arrays of text. truth_no is the first that matches. A case with a table of more than most_rows rows is not compared but
    told as too large: results are capped before they get here. A case without an answer has no match; answers without truths are
    left out. Tables of one case come together in a task, so what comes together is bounded by the cap.
    """
    cases = truths.select("case").distinct()
    sizes = truths.groupBy("case", "truth_no").count().select("case", "count").union(answers.groupBy("case").count()).groupBy("case").agg(F.max("count").alias("n"))
    large = sizes.where(F.col("n") > most_rows).select("case")
    left = truths.select("case", "truth_no", "cells").join(large, "case", "left_anti")
    right = answers.select("case", "cells").join(large, "case", "left_anti").join(cases, "case", "left_semi")
    schema = StructType([truths.schema["case"], *StructType.fromDDL("matched boolean, truth_no long").fields])

    def run(true: pa.Table, given: pa.Table) -> pa.Table:
        tables: dict[int, list[list]] = {}
        for n, cells in zip(true["truth_no"].to_pylist(), true["cells"].to_pylist(), strict=True):
            tables.setdefault(n, []).append([cell(c) for c in cells or []])
        answer = [[cell(c) for c in cells or []] for cells in given["cells"].to_pylist()]
        found = next((n for n in sorted(tables) if same_table(tables[n], answer)), None)
        return pa.table({"case": true["case"][:1], "matched": [found is not None], "truth_no": pa.array([found], pa.int64())})

    told = left.groupBy("case").cogroup(right.groupBy("case")).applyInArrow(run, schema).where("matched is not null").withColumn("too_large", F.lit(False))
    return told.union(large.join(cases, "case", "left_semi").select("case", F.lit(False), F.lit(None).cast("long"), F.lit(True)))


def judged(outcomes: DataFrame, matches: DataFrame, errors: tuple[str, ...] = ("timeout", "unavailable")) -> DataFrame:
    """(case, outcome) of outcomes (case, expect, ok, reason): pass, fail, or error, which counts neither way.

    Where a refusal is expected, one for a rightful reason passes; where an answer is, it passes if it matches.
    """
    told = outcomes.join(matches.select("case", "matched"), "case", "left")
    ok, reason = F.coalesce("ok", F.lit(False)), F.coalesce("reason", F.lit(""))
    refuse = F.coalesce("expect", F.lit("answer")) == "refuse"
    outcome = F.when(~ok & reason.isin(*errors), "error").when(refuse, F.when(~ok & reason.isin(*REFUSALS), "pass").otherwise("fail")).when(ok & F.coalesce("matched", F.lit(False)), "pass").otherwise("fail")
    return told.select("case", outcome.alias("outcome"))
