"""Every query with SQL equals it on the smallest tables."""

import duckdb
import pytest

from quillfold.plans.oracles import ORACLES
from quillfold.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows_of(frame, columns):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, (bool, str)):
            return v
        if isinstance(v, float) or "float" in type(v).__name__:
            return round(float(v), 5)
        return bool(v) if "bool" in type(v).__name__ else int(v) if hasattr(v, "__int__") and "str" not in type(v).__name__ else str(v)

    return sorted(str([plain(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False))


def test_only_similarity_lacks_sql():
    assert set(QUERIES) - set(ORACLES) == {"typo_similarity"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert len(got) > 0
    assert rows_of(got, columns) == rows_of(want, columns)


def test_similarity_is_that_of_difflib(spark):
    got = QUERIES["typo_similarity"](spark, DIR)
    assert got.where("similarity < 0 OR similarity > 1").count() == 0 < got.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
