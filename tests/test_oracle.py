"""The correctness gate: every catalog query equals its DuckDB oracle at sf0.01."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")


def test_every_query_has_an_oracle():
    from seatwise.plans import catalog, oracle
    assert set(catalog.queries()) == set(oracle.oracle_sql())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert len(df.columns) == 25 and df.count() == 150


def test_queries_match_oracle(spark):
    from oracle_check import compare
    from seatwise.plans import catalog
    res = compare(spark, SF, list(catalog.queries()))
    bad = {k: v for k, v in res.items() if not (v.get("cols_match") and v.get("values_match") and v.get("types_match")
                                                 and v["spark_rows"] == v["oracle_rows"])}
    assert not bad, bad
