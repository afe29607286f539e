"""Every sketch query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame, columns):
    return sorted(repr([None if v != v else v for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, name):
    got, want = plans.QUERIES[name](spark, sf).toPandas(), duck.sql(plans.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_a_library_of_the_corpus_operators(tmp_path):
    """The sketch queries stay where what the other subpackage needs is missing."""
    import subprocess
    import sys

    code = "import sys; sys.modules['tokenizers'] = None; import __spark_entry__ as e; assert set(e.queries()) == set(e._plans.queries()) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0], check=True, timeout=120)
