"""Every registered query of the reference's operators that has SQL, against DuckDB."""

import datetime
import os

import duckdb
import pytest

from lexstrata.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(x):
    if x is None or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{round(float(x), 6) + 0.0:.6f}"
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)[:19].replace(" 00:00:00", "")
    return str(x) if isinstance(x, str) else repr(x) if not hasattr(x, "quantize") else f"{float(x):.6f}"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalog.oracles()[name]})")
    assert got == sorted(tuple(map(canon, r)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.basename(entry.__file__) == "__spark_entry__.py"
