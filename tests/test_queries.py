"""Every registered query against its SQL twin on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from tests import compare
from wallflow.plans import catalog, oracles

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no benchmark tables")


@pytest.fixture(scope="module")
def tables():
    return compare.open_tables(SMALL)


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(oracles.ORACLES)
    assert set(contract.queries()) >= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, tables, name):
    equal, n, _, note = compare.check(spark, tables, name, SMALL)
    assert equal and n > 0, note


def test_entry(spark):
    assert contract.entry(spark).count() > 0
