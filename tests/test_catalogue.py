"""Every query with SQL gives the SQL's rows; the others run and have rows."""

from __future__ import annotations

import pytest
from helpers import assert_same

from loomwright.plans import catalogue

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf_dir, name):
    frame = catalogue.queries()[name](spark, sf_dir)
    if name in ORACLES:
        assert_same(frame, duck, ORACLES[name])
    else:
        assert frame.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert {r["model"] for r in entry.entry(spark).collect()} == {"1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
