"""Typed-in cases against typed-in answers."""

import duckdb
import pytest
from goldens import CASES

from tessera.plans.registry import Tables


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    case, sql = CASES[name]
    df = case(Tables(spark, ""))
    cols = sorted(df.columns)
    plain = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    got = duckdb.sql(sql)
    assert sorted(got.columns) == cols
    want = sorted(tuple(plain(r[got.columns.index(c)]) for c in cols) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want
