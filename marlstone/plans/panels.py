"""Panels ``(date, ticker, open, high, low, close, volume)`` derived from the driver's tables, and their SQL.

The close is a volume-weighted price built from whole cents and whole quantities, so that any engine gets the
same double whatever order it sums in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.trail import Trail

PANEL = ["date", "ticker", "open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame, ticker) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    units = F.sum(F.col("l_quantity").cast("bigint"))
    rows = rows.select(F.to_date("l_shipdate").alias("date"), ticker.alias("ticker"), price.alias("price"), "l_extendedprice", "l_quantity", "l_orderkey")
    return rows.groupBy("date", "ticker").agg(
        ((F.max("price") + F.min("price")) / 2).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.try_divide(cents.cast("double"), units * F.lit(100)).alias("close"),
        units.cast("double").alias("volume"),
    )


def region_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five tickers, one for each region, over all shipping days. Dimension tables are small and join first."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    where = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    rows = table(spark, sf_dir, "lineitem").join(where, F.col("l_suppkey") == F.col("s_suppkey"))
    return _bars(rows, F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))


def brand_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five tickers, one for each brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return _bars(rows, F.col("p_brand"))


def with_returns(panel: DataFrame) -> DataFrame:
    """Adds simple and log returns of the close, null on a ticker's first bar."""
    t = Trail(panel)
    before = t.lag(F.col("close"))
    return t.put(ret=F.try_divide(F.col("close"), before) - 1, lret=F.ln(F.try_divide(F.col("close"), before))).result()


def with_market(panel: DataFrame) -> DataFrame:
    """Adds the equal-weight mean return of each date. A window by date: the panel is made once, not once more to
    be joined with its own means."""
    return panel.withColumn("market", F.avg("ret").over(Window.partitionBy("date")))


_SQL = """
select cast(l_shipdate as date) as date, {ticker} as ticker,
  (max(l_extendedprice / l_quantity) + min(l_extendedprice / l_quantity)) / 2 as open,
  max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
  cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / (100 * sum(cast(l_quantity as bigint))) as close,
  cast(sum(cast(l_quantity as bigint)) as double) as volume
from {rows} group by 1, 2
"""
REGION_SQL = _SQL.format(ticker="'R' || cast(n_regionkey as varchar)", rows="lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey")
BRAND_SQL = _SQL.format(ticker="p_brand", rows="lineitem join part on l_partkey = p_partkey")


def returns_sql(panel: str) -> str:
    lag = "nullif(lag(close) over (partition by ticker order by date), 0)"
    return f"select *, close / {lag} - 1 as ret, ln(close / {lag}) as lret from ({panel})"


def market_sql(panel: str) -> str:
    return f"select *, avg(ret) over (partition by date) as market from ({returns_sql(panel)})"


def rounded(x):
    """Six decimals by an expression that any engine evaluates alike."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def rounded_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"
