"""Every query with an SQL twin against DuckDB over the smallest tables; the entry query's rows and schema."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["clip", "gop", "frame_start", "frame_count", "intra"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith(("op", "pipeline"))))
def test_twin(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got)
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert a == b
