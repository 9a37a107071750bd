"""Every query against its SQL, on the small tables."""

import duckdb
import pytest

import vellum.queries_format  # noqa: F401
from vellum.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([None if x is None or x != x else round(x, 6) + 0.0 if isinstance(x, float) else x for x in r]) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in ORACLES:
        want = db.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_without_the_training_data_operators(spark, monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "_llm", lambda: None)
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLES)
    assert __spark_entry__.entry(spark).limit(1).count() == 1
