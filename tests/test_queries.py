"""Every query of the core that has SQL gives the same rows as DuckDB on the smallest tables."""

import pytest

from strandlake.plans import registry
from tests.compare import same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, small, duck, name):
    same(registry.QUERIES[name](spark, small), duck, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0
