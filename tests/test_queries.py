"""Every registered query against its SQL twin, or for rows where it has none."""

from __future__ import annotations

import pytest
from conftest import SF

from compare import same
from tidemark.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, duck.sql(ORACLES[name]))
    else:
        assert df.columns and df.count() >= 0


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
