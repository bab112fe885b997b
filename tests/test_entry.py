"""All queries with SQL against DuckDB on the smallest tables; the entry without the optional part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from pathloom import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for name in TABLES:
        out.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return out


def plain(frame, columns):
    cell = lambda v: None if pd.isna(v) else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(cell, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_as_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and plain(got, columns) == plain(want, columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_rows_only(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_alone():
    """With the optional part out of reach the entry still imports and lists the other queries."""
    code = "import re, sys; sys.modules['pathloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'substr_search' in q and 'pipeline' not in q and not any(re.match(r'op[0-9]+_', k) for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'substr_search' in q and 'pipeline' not in q and (e.llm is None or len(q) > 13)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)
