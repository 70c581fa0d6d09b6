"""Every catalogue query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from quantspark.plans.oracle import ORACLE
from quantspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: Too few dates at this scale.
EMPTY_AT_THIS_SCALE = {"existence_probe", "liquidity_screen", "union_universe", "probe_sweep", "dollar_volume_21", "momentum_longs", "momentum_shorts", "long_short_targets"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))[:19]
    return float(v) if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in "iufb" and getattr(v, "dtype", None) is not None else v


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) or name in EMPTY_AT_THIS_SCALE or len(want) == 0


def test_every_query_has_sql_or_is_sequential():
    sequential = {"event_backtest", "portfolio_backtest", "gbt_walk_forward", "t_pvalue", "stream_features"}
    assert set(QUERIES) - set(ORACLE) == sequential
