"""Stages that keep the columns of docs, whatever their names; rows that share an id; the shared folder."""

import pytest
from pyspark.sql import functions as F

from quern.llm import common, mixing, quality, simhash, suffix_dedup

LONG = "the same words again and again until they are more than a hundred bytes long, which takes a good many of them here"
NAMES = ["key", "mark", "spans", "kept", "n_bytes", "n_removed", "n_spans", "row", "_row", "_id", "_id_mark", "_mark", "_times", "_turn", "_source", "_quality", "set", "root", "node", "a b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "x"), (2, LONG + " and more", "y"), (3, "short", None), (None, LONG, "x"), (4, None, "x")]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return made.withColumns({n: F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in NAMES}).select(*[f"`{n}`" for n in NAMES[:9]], "doc_id", "text", "source", *[f"`{n}`" for n in NAMES[9:]])


def stages(spark):
    labels = spark.createDataFrame([(1, 1), (3, 1), (2, 1)], "doc_id long, quality int")
    return {"shortened": suffix_dedup.shortened, "accepted": lambda d: quality.accepted(d, labels), "drawn": mixing.drawn, "keep_one": simhash.keep_one}


@pytest.mark.parametrize("name", ["shortened", "accepted", "drawn", "keep_one"])
def test_columns_stay(spark, docs, name):
    found = stages(spark)[name](docs)
    assert found.columns == docs.columns
    rows = found.collect()
    assert rows and all(r[n] == f"{n} {r.doc_id if r.doc_id is not None else 'none'}" for r in rows for n in NAMES)


@pytest.mark.parametrize("name", ["shortened", "accepted", "drawn", "keep_one"])
def test_empty_tables(spark, docs, name):
    assert stages(spark)[name](docs.limit(0)).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(spark):
    other = "quite another text with other words in it that has nothing at all in common with the first of them"
    rows = [(1, LONG), (1, other), (2, LONG), (2, LONG), (3, other), (1, LONG)]
    for parts in (1, 3):
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted(map(tuple, kept)) == sorted([(1, LONG), (1, other)])


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
