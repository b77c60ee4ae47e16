"""Every named query of the engine against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from lattiq import catalog_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def told(frame):
    names = sorted(frame.columns)
    text = frame[names].astype(object).where(frame[names].notna(), None).map(lambda v: v if v is None or isinstance(v, (str, bool)) else f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v))
    return names, sorted(map(tuple, text.values.tolist()), key=repr)


@pytest.mark.parametrize("name", list(catalog_queries.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = catalog_queries.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalog_queries.ORACLES[name]).df()
    assert told(got) == told(want)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["key", "name", "nationKey", "balance", "segment", "nation", "orders", "_count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog_queries.QUERIES) <= set(entry.queries())


def test_entry_works_without_the_training_data_operators():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['lattiq.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'flagship' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
