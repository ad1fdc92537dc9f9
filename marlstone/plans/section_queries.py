"""Queries of cross-sections, targets, top-k, aggregates, joins and recursions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.nulls import finite
from marlstone.functions.shared import calendar_grid, written
from marlstone.functions.trail import Trail
from marlstone.operators import cross_sectional as xs
from marlstone.operators import features as fe
from marlstone.operators import recursive as rc
from marlstone.operators import technical as te
from marlstone.plans import panels as P
from marlstone.plans.feature_queries import div, lag

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand panel with 5- and 20-bar momentum."""
    t = Trail(P.with_returns(P.brand_day(spark, sf_dir)))
    return t.put(mom=te.momentum(t, F.col("close"), 20), rev=-te.simple_return(t, F.col("close"), 5)).result()


_SCORED = f"select *, {div('close', lag('close', 20))} - 1 as mom, -({div('close', lag('close', 5))} - 1) as rev from ({P.returns_sql(P.BRAND_SQL)})"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _round(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.select(*keys, *(P.rounded(F.col(c)).alias(c) for c in columns))


def _round_sql(keys: str, columns: list[str], source: str) -> str:
    return f"select {keys}, {', '.join(f'{P.rounded_sql(c)} as {c}' for c in columns)} from ({source})"


K = ["date", "ticker"]
_rank = "case when {0} is not null then (rank() over (partition by date, {0} is not null order by {0}) + (count(*) over (partition by date, {0}) - 1) / 2.0e0) / count({0}) over (partition by date) end"
add("x01_cross_sectional_rank", lambda s, d: _round(_scored(s, d).withColumn("x", xs.percent_rank_average(F.col("mom"))), K, ["x"]), _round_sql("date, ticker", ["x"], f"select *, {_rank.format('mom')} as x from ({_SCORED})"))
add("x02_cross_sectional_zscore", lambda s, d: _round(_scored(s, d).withColumn("x", xs.zscore(F.col("mom"))), K, ["x"]), _round_sql("date, ticker", ["x"], f"select *, (mom - avg(mom) over (partition by date)) / nullif(stddev_samp(mom) over (partition by date), 0) as x from ({_SCORED})"))
add("x03_cross_sectional_demean", lambda s, d: _round(_scored(s, d).withColumn("x", xs.demean(F.col("mom"))), K, ["x"]), _round_sql("date, ticker", ["x"], f"select *, mom - avg(mom) over (partition by date) as x from ({_SCORED})"))


def _targets(s: SparkSession, d: str) -> DataFrame:
    t = Trail(P.region_day(s, d))
    return _round(t.put(**xs.forward_targets(t, F.col("close"), 5)).result(), K, ["target_forward_return", "target_direction"])


_lead = "lead(close, 5) over (partition by ticker order by date) / nullif(close, 0) - 1"
add("x04_targets", _targets, _round_sql("date, ticker", ["target_forward_return", "target_direction"], f"select *, case when target_forward_return is not null then cast(target_forward_return > 0 as int) end as target_direction from (select *, {_lead} as target_forward_return from ({P.REGION_SQL}))"))

# top-k, limits, sets
_place = "row_number() over (partition by date order by mom {0}, ticker)"
add("k01_top_k", lambda s, d: xs.top_k(_scored(s, d), "mom", 3, floor=0.0).select("date", "ticker", "place"), f"select date, ticker, place from (select *, {_place.format('desc')} as place from ({_SCORED}) where mom > 0) where place <= 3")


def _quantiles(s: SparkSession, d: str) -> DataFrame:
    rows = _scored(s, d).where("mom is not null")
    w = Window.partitionBy("date")
    k = xs.quantile_count(F.count(F.lit(1)).over(w), 0.3)
    rows = rows.withColumns({"k": k, "up": F.row_number().over(w.orderBy(F.desc("mom"), "ticker")), "down": F.row_number().over(w.orderBy("mom", "ticker"))})
    return rows.where("up <= k or down <= k").select("date", "ticker", (F.col("up") <= F.col("k")).alias("top"), (F.col("down") <= F.col("k")).alias("bottom"))


add("k02_quantile_sides", _quantiles, f"select date, ticker, up <= k as top, down <= k as bottom from (select *, greatest(1, cast(round_even(n * 0.3e0, 0) as int)) as k from (select *, count(*) over (partition by date) as n, {_place.format('desc')} as up, {_place.format('asc')} as down from ({_SCORED}) where mom is not null)) where up <= k or down <= k")
add("k05_bounded_read", lambda s, d: P.region_day(s, d).where("date >= date'1995-03-01' and date <= date'1995-06-30'").orderBy("date", "ticker").limit(101).select("date", "ticker", "volume"), f"select date, ticker, volume from ({P.REGION_SQL}) where date between date '1995-03-01' and date '1995-06-30' order by date, ticker limit 101")
add("k07_union_all", lambda s, d: P.region_day(s, d).unionByName(P.brand_day(s, d)).groupBy("ticker").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume")), f"select ticker, count(*) as bars, sum(volume) as volume from (({P.REGION_SQL}) union all ({P.BRAND_SQL})) group by ticker")
add("k08_distinct_first", lambda s, d: P.region_day(s, d).groupBy("date").agg(F.min_by("volume", "ticker").alias("volume"), F.min("ticker").alias("ticker")), f"select date, min(ticker) as ticker, arg_min(volume, ticker) as volume from ({P.REGION_SQL}) group by date")
add("k09_set_difference", lambda s, d: P.table(s, d, "customer").select(F.col("c_custkey").alias("key")).exceptAll(P.table(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("key")).distinct()).distinct(), "select distinct c_custkey as key from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 200000)")

# aggregates
add("a01_panel_metadata", lambda s, d: P.region_day(s, d).agg(F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.min("date").alias("first"), F.max("date").alias("last")), f"select count(*) as n_rows, count(distinct ticker) as n_tickers, min(date) as first, max(date) as last from ({P.REGION_SQL})")
add("a02_market_proxy", lambda s, d: _round(P.with_market(P.with_returns(P.region_day(s, d))), K, ["market"]), _round_sql("date, ticker", ["market"], P.market_sql(P.REGION_SQL)))
add("a13_training_normaliser", lambda s, d: _round(fe.training_normaliser(P.with_returns(P.region_day(s, d)), ["ret"], "1995-01-01", "1996-12-31", keys=("ticker",)), ["ticker"], ["mean", "std"]), _round_sql("ticker", ["mean", "std"], f"select ticker, avg(ret) as mean, stddev_pop(ret) as std from ({P.returns_sql(P.REGION_SQL)}) where date between date '1995-01-01' and date '1996-12-31' group by ticker"))
add("a15_asset_mle", lambda s, d: _round(P.with_returns(P.region_day(s, d)).groupBy("ticker").agg(F.avg("ret").alias("mean"), F.greatest(F.stddev_pop("ret"), F.lit(1e-12)).alias("std"), F.count("ret").cast("double").alias("n")), ["ticker"], ["mean", "std", "n"]), _round_sql("ticker", ["mean", "std", "n"], f"select ticker, avg(ret) as mean, greatest(stddev_pop(ret), 1e-12) as std, cast(count(ret) as double) as n from ({P.returns_sql(P.REGION_SQL)}) group by ticker"))


def correlations(returns: DataFrame, value: str = "ret", date: str = "date", entity: str = "ticker", lagged: str | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlations (src, dst); ``lagged`` names the source side's column."""
    a = returns.select(F.col(date), F.col(entity).alias("src"), F.col(lagged or value).alias("a")).where("a is not null")
    b = returns.select(F.col(date), F.col(entity).alias("dst"), F.col(value).alias("b")).where("b is not null")
    if lagged:
        return a.join(b, date).groupBy("src", "dst").agg(F.corr("a", "b").alias("corr"), F.count("*").alias("n"))
    # symmetric: each pair once, then mirrored
    half = a.join(b, [a[date] == b[date], F.col("src") <= F.col("dst")]).groupBy("src", "dst").agg(F.corr("a", "b").alias("corr"), F.count("*").alias("n"))
    both = F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return half.select(F.inline(both), "corr", "n")


add("a07_correlation_matrix", lambda s, d: _round(correlations(P.with_returns(P.region_day(s, d))), ["src", "dst", "n"], ["corr"]), _round_sql("src, dst, n", ["corr"], f"select a.ticker as src, b.ticker as dst, corr(a.ret, b.ret) as corr, count(*) as n from ({P.returns_sql(P.REGION_SQL)}) a join ({P.returns_sql(P.REGION_SQL)}) b on a.date = b.date where a.ret is not null and b.ret is not null group by 1, 2"))


def _complete(s: SparkSession, d: str) -> DataFrame:
    r = P.with_returns(P.region_day(s, d)).where("ret is not null")
    w = Window.partitionBy("date")
    every = r.select("ticker").distinct().agg(F.count("*").alias("every"))
    r = r.withColumn("there", F.count("*").over(w)).join(F.broadcast(every), F.col("there") == F.col("every"))
    c = correlations(r)
    return _round(c.withColumn("corr", F.when(F.col("src") == F.col("dst"), 1.0).otherwise(F.coalesce(finite("corr"), F.lit(0.0)))), ["src", "dst"], ["corr"])


_full = f"(select * from (select *, count(*) over (partition by date) as there from ({P.returns_sql(P.REGION_SQL)}) where ret is not null) where there = (select count(distinct ticker) from ({P.returns_sql(P.REGION_SQL)}) where ret is not null))"
add("a08_train_correlation", _complete, _round_sql("src, dst", ["corr"], f"select a.ticker as src, b.ticker as dst, case when a.ticker = b.ticker then 1 else coalesce(corr(a.ret, b.ret), 0) end as corr from {_full} a join {_full} b on a.date = b.date group by 1, 2"))
add("a12_partition_evidence", lambda s, d: P.region_day(s, d).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last")), f"select year(date) as year, count(*) as n_rows, min(date) as first, max(date) as last from ({P.REGION_SQL}) group by 1")


def monthly(returns: DataFrame, value: str = "ret", date: str = "date") -> DataFrame:
    """Compounded returns by year and month, months as columns, and the year's with missing months as zero."""
    m = returns.where(F.col(value).isNotNull()).groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg((F.product(1 + F.col(value)) - 1).alias("r"))
    wide = m.groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("r"))
    whole = m.groupBy("year").agg((F.product(1 + F.col("r")) - 1).alias("whole"))
    return wide.join(whole, "year").select("year", *(F.col(str(i)).alias(f"m{i}") for i in range(1, 13)), "whole")


_m = f"(select year(date) as y, month(date) as m, product(1 + market * 0.01e0) - 1 as r from (select distinct date, market from ({P.market_sql(P.REGION_SQL)}) where market is not null) group by 1, 2)"
_months = [f"m{i}" for i in range(1, 13)]
add("a04_monthly_returns", lambda s, d: _round(monthly(P.with_market(P.with_returns(P.region_day(s, d))).groupBy("date").agg((F.first("market") * 0.01).alias("ret"))), ["year"], [*_months, "whole"]), _round_sql("year", [*_months, "whole"], f"select y as year, {', '.join(f'max(case when m = {i} then r end) as m{i}' for i in range(1, 13))}, product(1 + r) - 1 as whole from {_m} group by y"))

# joins
add("j01_one_to_one_left", lambda s, d: _round(fe.one_to_one(P.region_day(s, d), P.with_returns(P.region_day(s, d)).where("ret > 0").select("date", "ticker", "ret"), K), K, ["ret"]), _round_sql("date, ticker", ["ret"], f"select a.date, a.ticker, b.ret from ({P.REGION_SQL}) a left join (select * from ({P.returns_sql(P.REGION_SQL)}) where ret > 0) b on a.date = b.date and a.ticker = b.ticker"))
add("j02_market_lookup", lambda s, d: _round(P.with_returns(P.region_day(s, d)).join(P.with_returns(P.region_day(s, d)).where("ticker = 'R0'").select("date", F.col("ret").alias("bench")), "date", "left"), K, ["bench"]), _round_sql("date, ticker", ["bench"], f"select a.date, a.ticker, b.ret as bench from ({P.REGION_SQL}) a left join (select * from ({P.returns_sql(P.REGION_SQL)}) where ticker = 'R0') b on a.date = b.date"))
add("j04_tickers_in_common", lambda s, d: P.brand_day(s, d).select("ticker", "date").join(_scored(s, d).where("mom > 0.5").select("ticker").distinct(), "ticker", "left_semi").groupBy("ticker").agg(F.count("*").alias("bars")), f"select ticker, count(*) as bars from ({P.BRAND_SQL}) where ticker in (select ticker from ({_SCORED}) where mom > 0.5) group by ticker")


def calendar_fill(weights: DataFrame, calendar: DataFrame, tickers: DataFrame, value: str = "weight") -> DataFrame:
    """Weights on the whole calendar, the last known one carried forward, zero before the first.

    The grid is dates times tickers, which is what a backtest holds anyway.
    """
    full = calendar_grid(calendar, tickers).join(weights, K, "left")
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return full.select("date", "ticker", F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(0.0)).alias(value))


def _filled(s: SparkSession, d: str) -> DataFrame:
    r = P.region_day(s, d)
    month = r.where(F.dayofmonth("date") == 15).select("date", "ticker", F.col("volume").alias("weight"))
    return calendar_fill(month, r, r)


add("j05_calendar_fill", _filled, f"select date, ticker, coalesce(last_value(weight ignore nulls) over (partition by ticker order by date rows unbounded preceding), 0) as weight from (select c.date, t.ticker, p.volume as weight from (select distinct date from ({P.REGION_SQL})) c cross join (select distinct ticker from ({P.REGION_SQL})) t left join (select * from ({P.REGION_SQL}) where day(date) = 15) p on p.date = c.date and p.ticker = t.ticker)")
add("j07_semi_join", lambda s, d: P.brand_day(s, d).where(F.col("ticker").isin("Brand#11", "Brand#23") & F.col("date").between("1995-02-01", "1995-12-31")).select("date", "ticker", "volume"), f"select date, ticker, volume from ({P.BRAND_SQL}) where ticker in ('Brand#11', 'Brand#23') and date between date '1995-02-01' and date '1995-12-31'")
add("j08_anti_join", lambda s, d: P.table(s, d, "part").join(P.table(s, d, "lineitem").where("l_quantity >= 48"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey"), "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 48)")


def lead_lag(s: SparkSession, d: str) -> DataFrame:
    t = Trail(P.with_returns(P.region_day(s, d)))
    r = t.put(before=t.lag(F.col("ret"))).result()
    return _round(correlations(r, lagged="before"), ["src", "dst", "n"], ["corr"])


_lagged = f"(select *, lag(ret) over (partition by ticker order by date) as before from ({P.returns_sql(P.REGION_SQL)}))"
add("j10_lead_lag_correlation", lead_lag, _round_sql("src, dst, n", ["corr"], f"select a.ticker as src, b.ticker as dst, corr(a.before, b.ret) as corr, count(*) as n from {_lagged} a join {_lagged} b on a.date = b.date where a.before is not null and b.ret is not null group by 1, 2"))


def _next(s: SparkSession, d: str) -> DataFrame:
    t = Trail(_scored(s, d))
    r = t.put(ahead=t.lead(F.col("ret"))).result().where("mom is not null and ahead is not null")
    hit = F.avg((F.signum("mom") == F.signum("ahead")).cast("double"))
    return _round(r.groupBy("ticker").agg(F.corr("mom", "ahead").alias("ic"), hit.alias("hits"), F.count("*").alias("n")).where("n >= 20"), ["ticker", "n"], ["ic", "hits"])


add("j11_prediction_vs_next", _next, _round_sql("ticker, n", ["ic", "hits"], f"select ticker, corr(mom, ahead) as ic, avg(cast(sign(mom) = sign(ahead) as int)) as hits, count(*) as n from (select *, lead(ret) over (partition by ticker order by date) as ahead from ({_SCORED})) where mom is not null and ahead is not null group by ticker having count(*) >= 20"))


# recursions
def _smooth(column: str, alpha: float, least: int) -> str:
    fold = f"list_reduce(list({column}) filter ({column} is not null) over (partition by ticker order by date rows unbounded preceding), lambda a, b: {1 - alpha!r} * a + {alpha!r} * b)"
    return f"case when count({column}) over (partition by ticker order by date rows unbounded preceding) >= {least} then {fold} end"


def _emas(s: SparkSession, d: str) -> DataFrame:
    made = rc.along(P.region_day(s, d), lambda p: {"ema12": rc.ema(p["close"].to_numpy(float), 12), "ema26": rc.ema(p["close"].to_numpy(float), 26)}, ["ema12", "ema26"])
    return _round(made, K, ["ema12", "ema26"])


add("t07_ema", _emas, _round_sql("date, ticker", ["ema12", "ema26"], f"select *, {_smooth('close', 2 / 13, 6)} as ema12, {_smooth('close', 2 / 27, 13)} as ema26 from ({P.REGION_SQL})"))
_moves = f"select *, case when m is not null then greatest(m, 0) end as up, case when m is not null then greatest(-m, 0) end as dn from (select *, close - lag(close) over (partition by ticker order by date) as m from ({P.REGION_SQL}))"
add("t09_rsi", lambda s, d: _round(rc.along(P.region_day(s, d), lambda p: {"x": rc.rsi(p["close"].to_numpy(float))}, ["x"]), K, ["x"]), _round_sql("date, ticker", ["x"], f"select *, case when dl is null then null when dl = 0 then 100 else 100 - 100 / (1 + g / dl) end as x from (select *, {_smooth('up', 1 / 14, 14)} as g, {_smooth('dn', 1 / 14, 14)} as dl from ({_moves}))"))
_line = f"select *, e12 - e26 as macd from (select *, {_smooth('close', 2 / 13, 6)} as e12, {_smooth('close', 2 / 27, 13)} as e26 from ({P.REGION_SQL}))"
add("t10_macd", lambda s, d: _round(rc.along(P.region_day(s, d), lambda p: rc.macd(p["close"].to_numpy(float)), ["macd", "macd_signal", "macd_hist"]), K, ["macd", "macd_signal", "macd_hist"]), _round_sql("date, ticker", ["macd", "macd_signal", "macd_hist"], f"select *, macd - macd_signal as macd_hist from (select *, {_smooth('macd', 0.2, 9)} as macd_signal from ({_line}))"))
add("s04_ewma_volatility", lambda s, d: _round(rc.along(P.with_returns(P.region_day(s, d)), lambda p: {"x": rc.ewma_volatility(p["ret"].to_numpy(float))}, ["x"]), K, ["x"]), _round_sql("date, ticker", ["x"], f"select *, sqrt({_smooth('sq', 2 / 22, 21)}) * sqrt(252) as x from (select *, ret * ret as sq from ({P.returns_sql(P.REGION_SQL)}))"))


def _filters(s: SparkSession, d: str) -> DataFrame:
    def made(p):
        r = np.nan_to_num(p["ret"].to_numpy(float))
        k = rc.local_level(r, 0.01, 0.1)
        return {"forecast": k["forecast"], "variance": k["variance"], "ewma": rc.ewma_variance(r, 0.94, 0.01), "garch": rc.garch_variance(r, 0.001, 0.1, 0.8)}

    cols = ["forecast", "variance", "ewma", "garch"]
    return _round(rc.along(P.with_returns(P.region_day(s, d)), made, cols), K, cols)


_r = "coalesce(ret, 0)"
_kal = f"""
with recursive n as (select date, ticker, {_r} as r, row_number() over (partition by ticker order by date) as i from ({P.returns_sql(P.REGION_SQL)})),
k as (
  select i, date, ticker, r, cast(0 as double) as forecast, 1 + 0.01e0 as p, 0.01e0 as ewma, 0.001e0 / (1 - 0.1e0 - 0.8e0) as garch from n where i = 1
  union all
  select n.i, n.date, n.ticker, n.r, k.forecast + k.p / (k.p + 0.1e0) * (k.r - k.forecast),
    greatest((1 - k.p / (k.p + 0.1e0)) * (1 - k.p / (k.p + 0.1e0)) * k.p + (k.p / (k.p + 0.1e0)) * (k.p / (k.p + 0.1e0)) * 0.1e0, 1e-12) + 0.01e0,
    greatest(0.94e0 * k.ewma + (1 - 0.94e0) * k.r * k.r, 1e-12), greatest(0.001e0 + 0.1e0 * k.r * k.r + 0.8e0 * k.garch, 1e-12)
  from k join n on n.ticker = k.ticker and n.i = k.i + 1
)
select date, ticker, forecast, greatest(p + 0.1e0, 1e-12) as variance, ewma, garch from k
"""
add("v08_v10_filters", _filters, _round_sql("date, ticker", ["forecast", "variance", "ewma", "garch"], _kal))
