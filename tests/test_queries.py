"""Every query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

from quarrylight.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = db.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[i] for i in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= __spark_entry__.oracle_sql().keys()
    assert catalogue.QUERIES["bm25_topk"](spark, DIR).count() > 0
