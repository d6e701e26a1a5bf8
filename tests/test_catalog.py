"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import compare
import pytest

from gridlens.plans import catalog


@pytest.fixture(scope="module")
def connection(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, data, connection, name):
    assert compare.differences(catalog.QUERIES[name](spark, data), connection, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).limit(5).count() > 0
