"""Every registered query of the library's own operators against its SQL."""

import math

import duckdb
import pandas as pd
import pytest

from sheaf.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that SQL can't express, tested on fixtures in test_fixtures.py.
WITHOUT_SQL = {"tolerance_cluster", "list_counters", "html_text", "html_outline", "html_elements", "spell_suggest", "lcs_diff", "box_clusters", "joined_fragments"}


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return None
        x = x.item() if hasattr(x, "item") else x
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, db, name):
    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:  # each of these has a test of its own
        assert name in WITHOUT_SQL and list(got.columns)
        return
    want = db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
