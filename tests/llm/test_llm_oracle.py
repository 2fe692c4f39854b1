"""The queries of the text operators against their oracle SQL."""

from __future__ import annotations

import compare
import pytest

from tidemark.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf, name):
    assert compare.check(spark, sf, queries.queries()[name], SQL[name]) > 0
