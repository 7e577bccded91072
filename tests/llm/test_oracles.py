from __future__ import annotations

import pytest

from pagefold.llm.queries import ORACLES, QUERIES

from ..compare import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, small, duck):
    same(QUERIES[name](spark, small), duck, ORACLES[name])


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
