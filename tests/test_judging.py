"""Tables matched against all arrangements of small ones, and answers judged; the sink against replays, late rows and drops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import judging
from quern.streaming import sink


def plain_same(truth, answer):
    if not truth or not answer:
        return False
    if sum(map(len, truth)) == 1:
        return any(judging.same_cell(c, x) for row in truth for c in row for a in answer for x in a)
    row = lambda a, b: len(a) == len(b) and any(all(judging.same_cell(x, y) for x, y in zip(a, p)) for p in itertools.permutations(b))
    return len(truth) == len(answer) and any(all(row(a, b) for a, b in zip(truth, p)) for p in itertools.permutations(answer))


def test_tables_as_all_arrangements():
    rng, both = random.Random(3), [0, 0]
    for _ in range(600):
        truth = [[judging.cell(rng.choice(["1", "2", "1.2", "1.4", "x", None])) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 4))]
        answer = [list(rng.sample(row, len(row))) for row in rng.sample(truth, len(truth))]
        for row in answer:
            if rng.random() < 0.5:
                row[rng.randrange(len(row))] = judging.cell(rng.choice(["1", "2.0", "1.6", "1.1", "y", " "]))
        expected = plain_same(truth, answer)
        both[expected] += 1
        assert judging.same_table(truth, answer) == expected
    assert min(both) > 80


@pytest.mark.parametrize("a,b,same", [("2225", "2203", False), ("5", "5.0", True), ("100.4", "101.2", True), ("0.2", "0.9", False), (" x ", "x", True), ("x", "X", False), (None, "0", True), ("nan", "", True), ("91110000710925243X", "91110000710925243X", True), ("9" * 20, "9" * 19 + "8", False)])
def test_cells(a, b, same):
    assert judging.same_cell(judging.cell(a), judging.cell(b)) == same


def test_matched_and_judged(spark):
    truths = spark.createDataFrame([(1, 0, ["shenzhen", "9"]), (1, 0, ["dongguan", "4"]), (2, 0, ["7"]), (2, 1, ["8"]), (3, 0, ["1"]), (4, 0, ["1", "2"]), (5, 0, ["1"]), (5, 0, ["2"]), (5, 0, ["3"])], "case long, truth_no long, cells array<string>")
    answers = spark.createDataFrame([(1, ["9", "shenzhen"]), (1, ["4", "dongguan"]), (2, ["a", "8.0"]), (4, ["1", "3"]), (9, ["1"]), (5, ["1"])], "case long, cells array<string>")
    found = {r.case: (r.matched, r.truth_no, r.too_large) for r in judging.matched(truths, answers, most_rows=2).collect()}
    assert found == {1: (True, 0, False), 2: (True, 1, False), 3: (False, None, False), 4: (False, None, False), 5: (False, None, True)}
    swapped = spark.createDataFrame([(1, ["shenzhen", "4"]), (1, ["dongguan", "9"])], "case long, cells array<string>")
    assert not judging.matched(truths.where("case = 1"), swapped).first().matched
    outcomes = spark.createDataFrame([(1, "answer", True, None), (2, "refuse", True, None), (3, "answer", True, None), (4, "answer", False, "timeout"), (6, "refuse", False, "ambiguous"), (7, "answer", False, "rejected_unsafe_sql"), (8, "refuse", False, None)], "case long, expect string, ok boolean, reason string")
    told = {r.case: r.outcome for r in judging.judged(outcomes, judging.matched(truths, answers)).collect()}
    assert told == {1: "pass", 2: "fail", 3: "fail", 4: "error", 6: "pass", 7: "fail", 8: "fail"}


ROW = "id string, day string, tokens long, at long"


def make(spark):
    unfit = {"no_id": F.col("id").isNull(), "no_tokens": F.col("tokens").isNull(), "negative": F.col("tokens") < 0}
    return sink.sink(spark, ["id"], unfit, ["day"], ["tokens"])


def state(made, spark):
    return ({tuple(r) for r in made.rows(spark).select("id", "day", "tokens", "at").collect()}, {tuple(r) for r in made.totals(spark).select("day", "tokens", "calls").collect()}, {tuple(r) for r in made.drops(spark).collect()})


def test_a_batch_that_comes_again_changes_nothing(spark):
    made = make(spark)
    one = [("a", "d1", 5, 1), ("a", "d1", 7, 2), ("b", "d1", 1, 1), (None, "d1", 1, 1), ("c", "d2", None, 1)]
    two = [("a", "d1", 9, 5), ("e", "d0", 4, 1), ("f", "d1", -1, 1), (None, None, None, None)]
    made.write(spark.createDataFrame(one, ROW), 0)
    made.write(spark.createDataFrame(two, ROW), 1)
    first = state(made, spark)
    assert first == ({("a", "d1", 9, 5), ("b", "d1", 1, 1), ("e", "d0", 4, 1)}, {("d1", 17, 3), ("d0", 4, 1)}, {("no_id", 2), ("no_tokens", 1), ("negative", 1)})
    for rows, number in ((one[::-1], 0), (two, 1), (one, 0)):
        made.write(spark.createDataFrame(rows, ROW).repartition(3), number)
    assert state(made, spark) == first
    folded = made.folded(spark)
    assert state(folded, spark) == first
    folded.write(spark.createDataFrame([("e", "d0", 6, 0)], ROW), 2)  # an older row, a day long gone
    rows, totals, _ = state(folded, spark)
    assert ("e", "d0", 4, 1) in rows and ("d0", 10, 2) in totals and state(made, spark) == first


def test_stream(spark, tmp_path):
    source, made = f"{tmp_path}/in", make(spark)
    put = lambda rows: spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(source)
    put([("a", "d1", 5, 1), ("b", "d1", 2, 1)])
    stream = lambda: spark.readStream.schema(ROW).parquet(source)
    made.start(stream(), f"{tmp_path}/ck").awaitTermination(60)
    put([("a", "d1", 6, 3), (None, "d1", 2, 1)])
    made.start(stream(), f"{tmp_path}/ck").awaitTermination(60)
    made.start(stream(), f"{tmp_path}/ck").awaitTermination(60)  # nothing new
    assert state(made, spark) == ({("a", "d1", 6, 3), ("b", "d1", 2, 1)}, {("d1", 13, 3)}, {("no_id", 1)})
