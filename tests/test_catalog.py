from __future__ import annotations

import pytest

from pagefold import catalog

from .compare import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, spark, small, duck):
    same(catalog.QUERIES[name](spark, small), duck, catalog.ORACLES[name])


def test_every_query_but_the_file_scan_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"dump_scan"}


def test_file_scan(spark, small):
    import os

    rows = catalog.QUERIES["dump_scan"](spark, small).collect()
    assert sum(r.size for r in rows) == os.path.getsize(f"{small}/nation.parquet")


def test_known_class_totals(spark, small):
    got = {r.cls: (r.total, r.distinct_contents) for r in catalog.QUERIES["classify_delta"](spark, small).collect()}
    assert got == {"SAME": (37, 7), "DEDUP": (2088, 301), "DIFF": (349, 347), "NEW": (526, 526)}


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_the_engine_stands_without_the_other_operators():
    import glob
    import os
    import re

    root = os.path.dirname(os.path.dirname(os.path.abspath(catalog.__file__)))
    for path in glob.glob(f"{root}/pagefold/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"\bllm\b", open(path).read()), path
