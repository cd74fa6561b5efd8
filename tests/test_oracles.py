"""Every registered query outside the training-data operators gives the rows of its SQL."""

from __future__ import annotations

import pytest
from compare import oracle, rows

from shelfspark.catalog_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = oracle(ORACLES[name], SF)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
