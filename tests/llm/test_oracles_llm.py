"""Corpus queries against their DuckDB SQL on the small tables."""
import pandas as pd
import pytest

from verdure.llm.queries import ORACLES, QUERIES


def _rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "None" if pd.isna(v) else str(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_all_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, sf, duck, key):
    got, want = QUERIES[key](spark, sf).toPandas(), duck.execute(ORACLES[key]).df()
    pd.testing.assert_frame_equal(_rows(got), _rows(want))
