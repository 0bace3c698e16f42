"""Corpus queries against their SQL twins on whole tables."""

import pytest

from emberline.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, name):
    assert not differences(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001")
