"""Every registered query against its SQL."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from tidepanel.registry import ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    with connect(FOLDER) as opened:
        yield opened


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, connection, name):
    _, problems = compare(spark, connection, FOLDER, name)
    assert problems == []
