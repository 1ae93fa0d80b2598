"""Registered queries against their SQL in DuckDB, over the whole smallest tables."""

import duckdb
import pytest

from seqloom import queries as _  # noqa: F401  registers
from seqloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([round(r[i], 5) + 0.0 if isinstance(r[i], float) else r[i] for i in at] for r in rows), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(want.fetchall(), columns)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_encode_of_odd_texts_matches_sql(spark, tmp_path):
    texts = ["", None, " \t\n", "a\xa0b th", "a\x85b", "t\x1ch the", "t\u2028h", "x\ue000y", "tth\x00e", "t h", "e\u0301a", "\U0001f44d\U0001f3fda", "th" * 20]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = QUERIES["x3_encode"](spark, str(tmp_path)).select("doc_id", "ids", "length").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["x3_encode"]).fetchall())
