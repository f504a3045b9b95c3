"""Every query against its SQL, and the goldens of the converter, the checks and the files."""

import math

import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def names():
    from tidemill import queries

    return sorted(queries.QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, con, sf_dir, name):
    from tidemill import queries

    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.sql(queries.SQL[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted(rel.columns) == columns
    assert got == want


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 50 and df.columns == ["page_id", "url", "returned", "more", "total", "text"]
