"""Every registered query of the reference's operators against DuckDB."""

import duckdb
import pytest

from strandline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    one = lambda x: repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    want = duck.sql(catalog.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert plain(got) == plain([tuple(r[i] for i in at) for r in want.fetchall()])
