"""Every query outside the corpus operators against its SQL in DuckDB."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from caseloom.entries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(df):
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].map(cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


#: What SQL cannot express is held against brute force elsewhere.
OTHERWISE = {"fuzzy_furniture": "test_furniture_names", "parties_in_windows": "test_furniture_names", "compound_tables": "test_tables", "barrier_regions": "test_pages", "folio_chains": "test_pages", "reading_changes": "test_pages"}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) == set(ORACLE) | set(OTHERWISE) and not set(ORACLE) & set(OTHERWISE)
    for module in OTHERWISE.values():
        assert (Path(__file__).parent / f"{module}.py").exists()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, duck, name):
    ours, theirs = plain(QUERIES[name](spark, sf_dir).toPandas()), plain(duck.execute(ORACLE[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, check_index_type=False, check_column_type=False)
