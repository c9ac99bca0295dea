"""Every query against its SQL, and the driver's contract."""

import pytest
from compare import difference, duck

import __spark_entry__
from tracewright.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert not df.isEmpty()  # an empty result would agree with any other empty one
    if name in catalogue.SQL:
        assert not difference(df, con, catalogue.SQL[name])


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["episode_index", "n_frames", "accepted", "reasons"] and df.count() > 0


def test_contract():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
