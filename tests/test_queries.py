"""Every registered engine query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from kgspark.plans import catalogue
from kgspark.sources.collection import TABLES

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(data_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{data_dir}/{t}.parquet"
        db.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return db


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(float(v), 7) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, data_dir, name):
    df = catalogue.queries()[name](spark, data_dir)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    got = duck.execute(SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert normal(df.columns, rows) == normal(names, got.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["node", "in_degree", "out_degree", "ratio"] and set(e.oracle_sql()) <= set(e.queries())
