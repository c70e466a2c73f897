"""Every query of the catalog against its oracle, at the smallest scale."""

from __future__ import annotations

import pytest
from against import oracle, spark_rows

from quillstream import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    got = spark_rows(catalog.QUERIES[name](spark, sf_dir))
    assert got[1], "no rows"
    if name in catalog.ORACLES:
        want = oracle(catalog.ORACLES[name], sf_dir)
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert got[1] == want[1]


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
