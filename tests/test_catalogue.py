import os

import duckdb
import pandas as pd
import pytest

from weirflow.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, list) or hasattr(v, "tolist") and getattr(v, "ndim", 0) else None if v is None or v is pd.NA or isinstance(v, float) and v != v else round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted(([plain(v.item() if hasattr(v, "item") and not getattr(v, "ndim", 0) else v) for v in r] for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, sf, db, name):
    got, want = catalogue.queries()[name](spark, sf).toPandas(), db.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_all_have_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql()) and os.path.exists("/root/testdata")
