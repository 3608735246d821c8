"""Every registered query beside its SQL, on the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from compare import check  # noqa: E402

ORACLES = entry.oracle_sql()


def test_names():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", entry.queries())
def test_query(name, spark, sf):
    assert check(spark, sf, entry.queries()[name], ORACLES.get(name)) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["node_id"]
