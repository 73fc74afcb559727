"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import compare
from jobloom.queries import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


# Queries whose result is legitimately empty on the smallest tables.
MAY_BE_EMPTY = {"both empty"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    found = compare.compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert found is None or found in MAY_BE_EMPTY, found


def test_every_inventory_row_has_a_query():
    spans = {"S": 9, "P": 41, "F": 10, "J": 15, "G": 14, "W": 9, "O": 7, "U": 6, "T": 9, "M": 11, "D": 13, "R": 11, "E": 5}
    wanted = {f"{k}{i}" for k, n in spans.items() for i in range(1, n + 1)}
    assert wanted == {c for cs in catalog.INVENTORY.values() for c in cs}
