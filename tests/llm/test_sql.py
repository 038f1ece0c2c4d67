"""Operators with a SQL twin against DuckDB."""

import os

import pytest
from oracle import SF_DIR, connect, same

from kbloom.llm.catalogue import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_operator_equals_its_sql(spark, name):
    same(QUERIES[name](spark, SF_DIR), connect(), ORACLES[name])
