"""Every registered query with an oracle matches DuckDB exactly (rows, columns, values)."""
import pandas as pd
import pytest

from verdure.plans import load_all

QUERIES, ORACLES = load_all()


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "None" if v is None or (isinstance(v, float) and v != v) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, sf, duck, key):
    got = QUERIES[key](spark, sf).toPandas()
    want = duck.execute(ORACLES[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _norm(got), _norm(want)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b)
