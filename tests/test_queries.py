"""Every registered query of the interval engine against its SQL at the smallest scale."""

import pytest

from spanforge.plans import registry
from tests.harness import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    check(spark, name, registry.queries()[name], registry.oracle_sql()[name], SF)
