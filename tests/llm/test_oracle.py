"""Every query of the subpackage that has SQL against it on the smallest tables."""
import duckdb
import pytest

from labelbench.llm import queries
from labelbench.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tests.test_oracle_parity import _digest


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_matches_sql(spark, duck, key):
    df = queries.QUERIES[key](spark, SF_SMALL)
    cur = duck.execute(queries.SQL[key])
    assert _digest(df.columns, [tuple(r) for r in df.collect()]) == _digest([d[0] for d in cur.description], cur.fetchall())
