"""Every registered query against its SQL on a small scale factor."""

import os

import pytest

import oracle
from changelens.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, con, name):
    assert oracle.compare(registry.QUERIES[name](spark, SF), con, registry.ORACLE[name]) is None


def test_registry():
    assert set(registry.ORACLE) == set(registry.QUERIES)
