"""Every query of the catalogue against its oracle SQL."""

from __future__ import annotations

import compare
import pytest

from tidemark.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf, name):
    assert compare.check(spark, sf, catalogue.queries()[name], SQL[name]) > 0


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(SQL)
