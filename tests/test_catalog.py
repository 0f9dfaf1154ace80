"""Every catalogued query against its DuckDB statement on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from foliant.plans import catalog, lifecycle

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(plain(x) for x in v) if isinstance(v, list) else v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


QUERIES = catalog.queries() | lifecycle.queries()
SQL = catalog.oracle_sql() | lifecycle.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = rows(QUERIES[name](spark, DATA).toPandas())
    assert got == rows(duck.execute(SQL[name]).df())


def test_chunk_by_settings_covers_every_document_with_text(spark):
    df = catalog.queries()["chunk_by_settings"](spark, DATA).toPandas()
    assert set(df["method"]) == {"general", "context_enrichment", "hierarchy", "pcr", "symbol"}
    first = df.groupby("doc_id")["chunk_index"].min()
    assert (first == 0).all()


def test_nothing_outside_the_subpackage_imports_it():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "foliant")):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "foliant.llm" not in f.read(), n
