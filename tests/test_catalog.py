"""Every query against its SQL twin in another engine."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import canon, plain
from tests.conftest import SF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(name, spark, duck):
    got = queries()[name](spark, SF).toPandas()
    if name not in oracle_sql():
        assert len(got) > 0
        return
    want = plain(duck.execute(oracle_sql()[name]).df())
    assert sorted(got.columns) == sorted(want.columns)
    assert {c: str(t) for c, t in got.dtypes.items()} == {
        c: str(t) for c, t in want.dtypes.items()
    }
    assert canon(got) == canon(want)


def test_entry(spark):
    assert entry(spark).count() > 0
