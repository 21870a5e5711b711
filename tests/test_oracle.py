"""Every registered query with an oracle equals DuckDB on the same parquet (sf0.001),
and the driver contract holds (entry, queries, oracle keys)."""
import pytest

import __spark_entry__ as E
from critica.plans import catalog
from tests.oracle_util import compare, duck

SF = "/root/testdata/sf0.001"
ORACLE = dict(catalog.ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_contract(spark):
    q = E.queries()
    assert set(ORACLE) <= set(q)
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    problems, _ = compare(E.queries()[name](spark, SF), con, ORACLE[name])
    assert not problems, problems
