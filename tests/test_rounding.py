"""Queries against their SQL where a price's hundredth part ends in half a cent that doubles can't hold."""

import datetime as dt

import duckdb
import pandas as pd
import pytest
from test_oracle import rows

from quantspark.plans.oracle import ORACLE
from quantspark.plans.queries import QUERIES

#: A hundredth of the first four, times 100, is below the half cent that its decimal text shows.
PRICES = (915.5, 940.5, 965.5, 990.5, 900.5, 912.3)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """One line item a day for 26 months, the price changing from day to day and the entry days' from month to month."""
    d = str(tmp_path_factory.mktemp("tables"))
    days = [dt.datetime(1995, 1, 1) + dt.timedelta(i) for i in range(790)]
    n, k = len(days), len(PRICES)
    frames = {
        "part": pd.DataFrame({"p_partkey": range(k), "p_brand": "Brand#11", "p_retailprice": PRICES}),
        "lineitem": pd.DataFrame({
            "l_orderkey": range(n), "l_linenumber": 1, "l_partkey": [i % k for i in range(n)], "l_suppkey": 0, "l_extendedprice": 1.0, "l_quantity": 1.0,
            "l_shipdate": pd.Series(days).astype("datetime64[us]"),
        }),
    }
    for name, df in frames.items():
        df.to_parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", ["moneyness_sweep", "option_legs", "straddle_pnl"])
def test_half_cents_match_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")
    want = con.execute(ORACLE[name]).df()
    assert len(want) > 6
    assert rows(QUERIES[name](spark, tables).toPandas()) == rows(want)
