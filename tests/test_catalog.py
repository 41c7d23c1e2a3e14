"""Every query of the catalogue against its SQL on the smallest tables."""
import glob
import os

import duckdb
import pandas as pd
import pytest

from stratum.plans import catalog

from .conftest import SF


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    clean = lambda x: None if not isinstance(x, (list, dict)) and pd.isna(x) else x
    return columns, sorted((tuple(clean(x) for x in t) for t in frame[columns].itertuples(index=False)), key=lambda t: [(x is None, str(x)) for x in t])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, db, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(catalog.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_without_a_session():
    """The entry point lists queries and SQL before any session exists."""
    import pathlib
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).parent.parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
