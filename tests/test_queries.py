"""Every query with an oracle against DuckDB; the others for rows and schema."""

import pytest

from oracle import canonical, connect
from quillspark.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0 and len(df.columns) > 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
