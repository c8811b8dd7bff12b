"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from queries import REGISTRY
from tests.compare import differences, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = list(REGISTRY)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    entry = REGISTRY[name]
    df = entry.run(spark, SF)
    if entry.oracle is None:
        assert df.count() > 0
    else:
        assert differences(df, con, entry.oracle) == []
