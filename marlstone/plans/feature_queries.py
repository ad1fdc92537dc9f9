"""Queries of the trailing operators over the region panel, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.trail import Trail
from marlstone.operators import liquidity as li
from marlstone.operators import recursive as rc
from marlstone.operators import statistics as st
from marlstone.operators import technical as te
from marlstone.plans import panels as P

Made = dict[str, Column]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}



def w(n: int) -> str:
    return f"over (partition by ticker order by date rows between {n - 1} preceding and current row)"


def agg(f: str, x: str, n: int, least: int | None = None) -> str:
    return f"case when count({x}) {w(n)} >= {n if least is None else least} then {f}({x}) {w(n)} end"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) over (partition by ticker order by date)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def bound(x: str, low: str | None = None, high: str | None = None) -> str:
    """A clip that keeps null; DuckDB's greatest and least pass over nulls."""
    y = f"greatest({low}, {x})" if low is not None else x
    y = f"least({high}, {y})" if high is not None else y
    return f"case when ({x}) is not null then {y} end"


def add(name: str, made: Callable[[Trail], Made], sql: dict[str, str], layers: list[dict[str, str]] | None = None) -> None:
    """A query of named columns; ``layers`` are SQL columns that the last ones read."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Trail(P.with_market(P.with_returns(P.region_day(spark, sf_dir))))
        found = t.put(**made(t)).result()
        return found.select("date", "ticker", *(P.rounded(F.col(c)).alias(c) for c in sql))

    QUERIES[name] = query
    source = P.market_sql(P.REGION_SQL)
    for layer in layers or []:
        source = f"select *, {', '.join(f'{x} as {c}' for c, x in layer.items())} from ({source})"
    source = f"select date, ticker, {', '.join(f'{x} as {c}' for c, x in sql.items())} from ({source})"
    ORACLES[name] = f"select date, ticker, {', '.join(f'{P.rounded_sql(c)} as {c}' for c in sql)} from ({source})"


Y = "sqrt(252)"
h = te.half
add("t01_simple_returns", lambda t: {"r1": te.simple_return(t, F.col("close")), "r5": te.simple_return(t, F.col("close"), 5)}, {"r1": div("close", lag("close")) + " - 1", "r5": div("close", lag("close", 5)) + " - 1"})
add("t02_log_returns", lambda t: {"x": te.log_return(t, F.col("close"))}, {"x": f"ln({div('close', lag('close'))})"})
add("t03_rolling_volatility", lambda t: {"x": te.rolling_volatility(t, F.col("ret"))}, {"x": f"({agg('stddev_samp', 'ret', 21, 10)}) * {Y}"})
add("t04_realized_volatility", lambda t: {"x": te.realized_volatility(t, F.col("ret"))}, {"x": f"sqrt(({agg('sum', 'sq', 21, 10)}) * (252.0 / 21))"}, [{"sq": "ret * ret"}])
add("t05_rolling_sharpe", lambda t: {"x": te.rolling_sharpe(t, F.col("ret"))}, {"x": f"{div(agg('avg', 'ret', 63, 31), agg('stddev_samp', 'ret', 63, 31))} * {Y}"})
add("t06_moving_average", lambda t: {"x": te.moving_average(t, F.col("close"))}, {"x": agg("avg", "close", 20, 10)})
add("t08_ma_ratio", lambda t: {"x": te.ma_ratio(t, F.col("close"))}, {"x": div("close", agg("avg", "close", 50, 25)) + " - 1"})
add("t11_bollinger", lambda t: te.bollinger(t, F.col("close")), {"upper": "m + 2 * s", "lower": "m - 2 * s", "pctb": div("close - (m - 2 * s)", "(m + 2 * s) - (m - 2 * s)"), "bandwidth": div("(m + 2 * s) - (m - 2 * s)", "m")}, [{"m": agg("avg", "close", 20, 10), "s": agg("stddev_samp", "close", 20, 10)}])
add("t12_momentum", lambda t: {"m63": te.momentum(t, F.col("close")), "m252_21": te.momentum(t, F.col("close"), 252, 21)}, {"m63": div("close", lag("close", 63)) + " - 1", "m252_21": div(lag("close", 21), lag("close", 252)) + " - 1"})
add("t13_zscore", lambda t: {"x": te.zscore(t, F.col("close"))}, {"x": div(f"close - ({agg('avg', 'close', 21, 10)})", agg("stddev_samp", "close", 21, 10))})
add("t14_volume_features", lambda t: te.volume_features(t, F.col("volume"), F.col("close")), {"log_dollar_volume": "ln(1 + volume * close)", "volume_zscore": div(f"volume - ({agg('avg', 'volume', 21, 10)})", agg("stddev_samp", "volume", 21, 10)), "relative_volume": div("volume", agg("avg", "volume", 21, 10))})
_both = "case when ret is not null and market is not null then 1 end"
add("t15_rolling_beta", lambda t: {"x": te.rolling_beta(t, F.col("ret"), F.col("market"))}, {"x": div(f"case when count({_both}) {w(63)} >= 31 then covar_samp(ret, market) {w(63)} end", agg("var_samp", "market", 63, 31))})
add("t16_drawdown", lambda t: {"x": te.drawdown(t, F.col("close"))}, {"x": "close / max(close) over (partition by ticker order by date rows unbounded preceding) - 1"})
add(
    "t17_rolling_max_drawdown",
    lambda t: rc.on(t, lambda p: {"x": rc.rolling_max_drawdown(p["close"].to_numpy(float), 63)}, ["x"]),
    {"x": "case when len(p) >= 31 then list_min(list_transform(range(1, len(p) + 1), lambda i: p[i] / list_max(p[1:i]) - 1)) end"},
    [{"p": f"list(close) {w(63)}"}],
)
add("t18_vwap_deviation", lambda t: {"x": te.vwap_deviation(t, F.col("high"), F.col("low"), F.col("close"), F.col("volume"))}, {"x": div("close", div(agg("sum", "tv", 21), agg("sum", "volume", 21))) + " - 1"}, [{"tv": "(high + low + close) / 3 * volume"}])
add("t19_regression_residual", lambda t: {"x": te.regression_residual(t, F.col("close"))}, {"x": f"case when count(lp) {w(63)} = 63 then lp - (avg(lp) {w(63)} + regr_slope(lp, i) {w(63)} * (i - avg(i) {w(63)})) end"}, [{"lp": "ln(close)", "i": "cast(row_number() over (partition by ticker order by date) as double)"}])

_k = 4 * math.log(2)
add("s01_parkinson_volatility", lambda t: {"x": st.parkinson_volatility(t, F.col("high"), F.col("low"))}, {"x": f"sqrt({bound(agg('avg', 'a', 21) + '', '0')}) * {Y}"}, [{"a": f"ln(high / low) * ln(high / low) / {_k!r}"}])
add("s02_garman_klass_volatility", lambda t: {"x": st.garman_klass_volatility(t, F.col("open"), F.col("high"), F.col("low"), F.col("close"))}, {"x": f"sqrt({bound(agg('avg', 'a', 21), '0')}) * {Y}"}, [{"a": f"0.5e0 * ln(high / low) * ln(high / low) - {2 * math.log(2) - 1!r} * ln(close / open) * ln(close / open)"}])
add("s03_rogers_satchell_volatility", lambda t: {"x": st.rogers_satchell_volatility(t, F.col("open"), F.col("high"), F.col("low"), F.col("close"))}, {"x": f"sqrt({bound(agg('avg', 'a', 21), '0')}) * {Y}"}, [{"a": "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"}])
add("s05_rolling_skewness", lambda t: {"x": st.rolling_skewness(t, F.col("ret"))}, {"x": agg("skewness", "ret", 63)})
add("s06_rolling_kurtosis", lambda t: {"x": st.rolling_kurtosis(t, F.col("ret"))}, {"x": agg("kurtosis", "ret", 63)})
add("s07_downside_deviation", lambda t: {"x": st.downside_deviation(t, F.col("ret"))}, {"x": f"sqrt({agg('avg', 'a', 63)}) * {Y}"}, [{"a": "case when ret is not null then least(ret, 0) * least(ret, 0) end"}])
add("s08_median_absolute_deviation", lambda t: rc.on(t, lambda p: {"x": rc.median_absolute_deviation(p["ret"].to_numpy(float))}, ["x"]), {"x": agg("mad", "ret", 63)})


def _corr(a: str, b: str, n: int) -> str:
    both = f"case when count(case when {a} is not null and {b} is not null then 1 end) {w(n)} >= {n} then covar_samp({a}, {b}) {w(n)} end"
    raw = div(both, f"({agg('stddev_samp', a, n)}) * ({agg('stddev_samp', b, n)})")
    return f"case when {raw} is not null then greatest(-1, least(1, {raw})) end"


add("s09_rolling_correlation", lambda t: {"x": t.correlation(F.col("ret"), F.col("market"), 63)}, {"x": _corr("ret", "market", 63)})
add("s10_autocorrelation", lambda t: {"x": st.autocorrelation(t, F.col("ret"))}, {"x": _corr("ret", "b", 63)}, [{"b": lag("ret")}])
add("s11_partial_autocorrelation", lambda t: {"x": st.partial_autocorrelation_2(t, F.col("ret"))}, {"x": f"case when one is not null and two is not null then greatest(-1, least(1, {div('two - one * one', '1 - one * one')})) end"}, [{"b1": lag("ret"), "b2": lag("ret", 2)}, {"one": _corr("ret", "b1", 63), "two": _corr("ret", "b2", 63)}])
_d = {f"d{k}": f"lp - ({lag('lp', k)})" for k in st.HURST_LAGS}
_y = {f"y{k}": f"case when stddev_pop(d{k}) {w(128 - k)} > 0 then ln(stddev_pop(d{k}) {w(128 - k)}) end" for k in st.HURST_LAGS}
_pts = ", ".join(f"({math.log(k)!r}, y{k})" for k in st.HURST_LAGS)
add("s12_hurst_exponent", lambda t: {"x": st.hurst_exponent(t, F.col("close"))}, {"x": f"case when count(lp) {w(128)} = 128 then (select regr_slope(y, x) from (values {_pts}) as p(x, y)) end"}, [{"lp": "ln(close)"}, _d, _y])
add("s13_variance_ratio", lambda t: {"x": st.variance_ratio(t, F.col("ret"))}, {"x": f"case when count(ret) {w(63)} = 63 then {div(f'(sum(qs * qs) {w(59)} - 10 * mu * sum(qs) {w(59)} + 59 * 25 * mu * mu) / (5 * 59 * (1 - 5 / 63.0e0))', f'var_samp(ret) {w(63)}')} end"}, [{"qs": agg("sum", "ret", 5), "mu": f"avg(ret) {w(63)}"}])
_cell = "least(7, cast(floor((v - list_min({0})) * 8 / nullif(list_max({0}) - list_min({0}), 0)) as int))"
_cells = {k: f"list_transform(l{k}, lambda v: coalesce({_cell.format(f'l{k}')}, 0))" for k in "ab"}


def _hist(x: str) -> str:
    return f"list_sum(list_transform(map_values(list_histogram({x})), lambda c: c * ln(c)))"


add(
    "s14_mutual_information",
    lambda t: rc.on(t, lambda p: {"x": rc.mutual_information(p["ret"].to_numpy(float), p["market"].to_numpy(float))}, ["x"]),
    {"x": f"case when count(ret) {w(63)} = 63 then greatest(0, ({_hist('cj')} - {_hist('ca')} - {_hist('cb')}) / 63.0e0 + ln(63)) end"},
    [{"la": f"list(ret) {w(63)}", "lb": f"list(market) {w(63)}"}, {"ca": _cells["a"], "cb": _cells["b"]}, {"cj": "list_transform(range(1, len(ca) + 1), lambda i: ca[i] * 8 + cb[i])"}],
)
add("l01_log_dollar_volume", lambda t: {"x": li.log_dollar_volume(t, F.col("close"), F.col("volume"))}, {"x": agg("avg", "a", 21)}, [{"a": "case when close * volume > 0 then ln(close * volume) end"}])
add("l02_volume_change", lambda t: {"x": li.volume_change(t, F.col("volume"))}, {"x": f"ln(volume) - ln({lag('volume')})"})
add("l03_relative_volume", lambda t: {"x": li.relative_volume(t, F.col("volume"))}, {"x": div("volume", agg("avg", "volume", 21))})
add("l04_amihud_illiquidity", lambda t: {"x": li.amihud_illiquidity(t, F.col("close"), F.col("volume"))}, {"x": agg("avg", "a", 21)}, [{"a": "abs(ret) / nullif(close * volume, 0) * 1e6"}])
add("l05_volume_imbalance", lambda t: {"x": li.volume_imbalance(t, F.col("close"), F.col("volume"))}, {"x": bound(div(agg("sum", "a", 21), agg("sum", "volume", 21)), "-1", "1")}, [{"a": "sign(ret) * volume"}])
_cs = 3 - 2 * math.sqrt(2)
add(
    "l06_corwin_schultz_spread",
    lambda t: {"x": li.corwin_schultz_spread(t, F.col("high"), F.col("low"))},
    {"x": agg("avg", "s", 21)},
    [{"ph": lag("high"), "pl": lag("low")}, {"be": "pow(ln(high / low), 2) + pow(ln(ph / pl), 2)", "ga": "case when ph is not null then pow(ln(greatest(high, ph) / least(low, pl)), 2) end"}, {"al": f"{math.sqrt(2) - 1!r} * sqrt(be) / {_cs!r} - sqrt(ga / {_cs!r})"}, {"s": "case when al is not null then greatest(0, 2 * (exp(al) - 1) / (1 + exp(al))) end"}],
)
add("l07_roll_spread", lambda t: {"x": li.roll_spread(t, F.col("ret"))}, {"x": f"2 * sqrt({bound('-c', '0')})"}, [{"b": lag("ret")}, {"c": f"case when count(case when ret is not null and b is not null then 1 end) {w(21)} >= 21 then covar_samp(ret, b) {w(21)} end"}])
add("l08_turnover", lambda t: {"x": li.turnover(t, F.col("volume"), F.col("close") * 1000)}, {"x": agg("avg", "a", 21)}, [{"a": "volume / nullif(close * 1000, 0)"}])
