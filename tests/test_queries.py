"""Each registered query of the library's own operators against its SQL, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quern import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(frame):
    def value(x):
        if not isinstance(x, (list, tuple)) and pd.isna(x):
            return None
        if isinstance(x, float):
            return int(x) if x.is_integer() else round(x, 5)
        return x

    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(value(getattr(x, "item", lambda x=x: x)()) for x in row)) for row in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    rows = queries.QUERIES[name](spark, FOLDER).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(rows) or name in ("html_tables", "similar_documents")  # these tables have none
        return
    known = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(rows.columns) == sorted(known.columns)
    assert plain(rows) == plain(known)


def test_every_query_has_sql_but_the_iterative_ones():
    rest = {"path_search", "text_pack", "html_tables", "simhash_signatures", "similar_documents", "mmr_select", "simhash_pairs", "row_pack", "retrieve_candidates", "words_grounded", "terms_rewritten"}
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == rest
