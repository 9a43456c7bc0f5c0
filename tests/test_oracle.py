"""Every query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest
from conftest import DATA

from inkwell import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def cell(v):
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    answer = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    assert ours == theirs


def test_queries_without_sql_run(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, DATA).count() > 0
