"""Every catalogued query against its SQL on the smallest tables, and the entry point."""

from __future__ import annotations

import duckdb
import pytest
from tests.conftest import DATA

from querncore.plans import candidates, catalogue, icon_choice, knowledge, page_marks, qualification, reviews, selections  # noqa: F401  each adds its queries to the catalogue

SF = DATA / "sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(catalogue.SQL[name])
    head = [d[0] for d in cur.description]
    assert sorted(head) == cols
    want = sorted(tuple(shown(dict(zip(head, r))[c]) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, str(SF)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
