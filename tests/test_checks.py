"""Every registered query against its SQL on the smallest tables."""

import pytest

from doorstep.checks import load_all
from tools.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
CHECKS = load_all()
#: An index finds most of what SQL finds; how much is a query of its own.
NO_SQL = ["memory_recall_indexed"]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_matches_sql(spark, con, name):
    state, note, _ = compare(spark, con, name, CHECKS[name], FOLDER)
    if name in NO_SQL:
        assert state == "ROWS", note
        return
    # No key is over-allocated in the smallest tables.
    assert state == "OK" or (state, name) == ("EMPTY", "over_allocated_keys"), note


def test_every_query_has_sql():
    assert [n for n, c in CHECKS.items() if not c.sql] == NO_SQL


# What the inventory lists.
INVENTORY = (
    [f"S{i}" for i in range(1, 13)]
    + [f"P{i}" for i in range(1, 27)]
    + [f"F{i}" for i in range(1, 8)]
    + [f"J{i}" for i in range(1, 17)]
    + [f"A{i}" for i in range(1, 18)]
    + [f"W{i}" for i in range(1, 10)]
    + [f"T{i}" for i in range(1, 8)]
    + [f"U{i}" for i in range(1, 5)]
    + [f"X-S{i}" for i in range(1, 6)]
    + [f"X{i}" for i in range(1, 8)]
)


def test_inventory_is_covered():
    covered = {row for c in CHECKS.values() for row in c.covers}
    assert [row for row in INVENTORY if row not in covered] == []
