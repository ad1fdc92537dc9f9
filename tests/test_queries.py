"""Every query of the panel engine against DuckDB on the smallest tables, and those without SQL by rows."""

import math
from pathlib import Path

import duckdb
import pytest

from marlstone.plans import panels, registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
#: A spread over all families; the driver compares every query.
CHOSEN = ["t03_rolling_volatility", "t17_rolling_max_drawdown", "s08_median_absolute_deviation", "s12_hurst_exponent", "s14_mutual_information", "x01_cross_sectional_rank", "k02_quantile_sides", "t09_rsi", "b05_backtest", "g04_liquidity_capacity", "m07_decile_returns", "m15_distribution_drift", "j09_latest_visible_revision", "c01_contracts_checked", "v12_dynamic_graph", "st03_store_round_trip", "snk01_bundle_as_of", "st05_backfill", "str01_event_bars"]
ROWS = ["f14_spectral_features", "e01_emd", "a16_v11_shrinkage_covariance", "c03_contract_metadata"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def text(v):
    if v is None or v != v or str(v) == "NaT":
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)[:10] if hasattr(v, "year") else str(v)


def table(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(text(v) for v in row) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, db, name):
    assert table(QUERIES[name](spark, SF).toPandas()) == table(db.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", ROWS)
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["e01_emd", "e04_vmd"])
def test_decompositions_cover_every_series(spark, name):
    want = panels.with_returns(panels.region_day(spark, SF)).where("ret is not null").select("date", "ticker").collect()
    got = QUERIES[name](spark, SF).where("mode = -1").select("date", "ticker").collect()
    assert sorted(got) == sorted(want) and len({r["ticker"] for r in got}) == 5


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) > 100 and math.isfinite(len(QUERIES))
