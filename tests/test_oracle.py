"""Every registered query against its SQL twin."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

from parlance.plans import ORACLES, QUERIES

sys.path.insert(0, str(Path(__file__).parent.parent / "tools"))
import check  # noqa: E402


@pytest.fixture(scope="module")
def con(data):
    return check.connect(data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, data, name):
    assert name in ORACLES
    same, text = check.compare(spark, con, name, data)
    assert same, text


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
