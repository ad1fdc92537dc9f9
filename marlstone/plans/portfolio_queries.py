"""Queries of the portfolio simulation and risk figures, with their SQL.

Returns are scaled by a hundredth: the derived prices move by whole multiples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.shared import calendar_grid, written
from marlstone.functions.trail import Trail
from marlstone.operators import backtest as bt
from marlstone.operators import risk
from marlstone.operators import technical as te
from marlstone.plans import panels as P
from marlstone.plans.section_queries import _round, _round_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = ["date", "ticker"]


def add(name: str, query: Callable[[SparkSession, str], DataFrame], keys: list[str], columns: list[str], sql: str | None) -> None:
    QUERIES[name] = lambda s, d: _round(query(s, d), keys, columns)
    if sql:
        ORACLES[name] = _round_sql(", ".join(keys) or "", columns, sql) if keys else f"select {', '.join(f'{P.rounded_sql(c)} as {c}' for c in columns)} from ({sql})"


class Book:
    """What a portfolio query needs of one panel, each made once: the panel, the grid, and weights by policy."""

    def __init__(self, s: SparkSession, d: str):
        self.panel = written(P.region_day(s, d), "panel")
        t = Trail(P.with_returns(self.panel))
        rows = t.put(score=te.momentum(t, F.col("close"), 20)).result()
        full = calendar_grid(self.panel, self.panel).join(rows, K, "left")
        #: every date and region with scaled return (zero where there was no bar), and 20-bar momentum as score
        self.grid = written(full.select(*K, F.coalesce(F.col("ret") * 0.01, F.lit(0.0)).alias("ret"), "score"), "grid")
        self._held: dict[bt.Policy, DataFrame] = {}

    def held(self, p: bt.Policy | None = None, delay: int = 0) -> DataFrame:
        p = p or EQUAL
        if (p, delay) not in self._held:
            scores = self.grid.withColumn("score", F.lag("score", delay).over(bt.by_ticker())) if delay else self.grid
            self._held[p, delay] = written(bt.held_weights(scores, self.grid, p), "held")
        return self._held[p, delay]

    def days(self, p: bt.Policy | None = None, delay: int = 0) -> DataFrame:
        return bt.daily(self.held(p, delay), self.grid, p or EQUAL)

    def with_market(self) -> DataFrame:
        market = self.grid.groupBy("date").agg(F.avg("ret").alias("market"))
        return self.days().join(market, "date", "left")


def grid(s: SparkSession, d: str) -> DataFrame:
    return Book(s, d).grid


GRID = f"""select c.date, t.ticker, coalesce(r.ret * 0.01e0, 0) as ret, r.score from (select distinct date from ({P.REGION_SQL})) c cross join (select distinct ticker from ({P.REGION_SQL})) t
left join (select *, close / nullif(lag(close, 20) over (partition by ticker order by date), 0) - 1 as score from ({P.returns_sql(P.REGION_SQL)})) r on r.date = c.date and r.ticker = t.ticker"""


def wanted_sql(source: str) -> str:
    """Equal-weight long and short sides, share 0.3."""
    return f"""select *, case when nl = 0 or ns = 0 then 0 when lo then 0.5e0 / nl when sh then -0.5e0 / ns else 0 end as weight from (
      select *, sum(cast(lo as int)) over (partition by date) as nl, sum(cast(sh as int)) over (partition by date) as ns from (
      select *, score is not null and rn <= k as lo, score is not null and rn > n - k and rn > k as sh from (
      select *, greatest(1, cast(round_even(n * 0.3e0, 0) as int)) as k from (
      select *, count(score) over (partition by date) as n, row_number() over (partition by date order by score desc nulls last, ticker) as rn from ({source})))))"""


def limits_sql(source: str, cap: float = 0.0, both: bool = True) -> str:
    w = f"greatest({-cap}, least({cap}, weight))" if cap else "weight"
    s = f"select * replace ({w} as weight) from ({source})"
    if both:
        s = f"select * exclude (xl, xs) replace (weight * coalesce(case when weight > 0 then least(xl, xs) / nullif(xl, 0) else least(xl, xs) / nullif(xs, 0) end, 0) as weight) from (select *, sum(greatest(weight, 0)) over (partition by date) as xl, -sum(least(weight, 0)) over (partition by date) as xs from ({s}))"
    return f"select * exclude (xg) replace (weight * coalesce(least(1, 1 / nullif(xg, 0)), 1) as weight) from (select *, sum(abs(weight)) over (partition by date) as xg from ({s}))"


HELD = f"select date, ticker, ret, lag(weight, 2) over (partition by ticker order by date) as weight from ({limits_sql(limits_sql(wanted_sql(GRID)))})"
HELD = f"select * from ({HELD}) where weight is not null"
_DAYS = f"select date, sum(weight * ret) as gross, sum(abs(weight - before)) as turnover from (select *, coalesce(lag(weight) over (partition by ticker order by date), 0) as before from ({{0}})) group by date"


def _equity(days: str, keys: str = "") -> str:
    part = f"partition by {keys} " if keys else ""
    return f"select *, equity / greatest(1, max(equity) over ({part}order by date rows unbounded preceding)) - 1 as drawdown from (select *, product(1 + net) over ({part}order by date rows unbounded preceding) as equity from ({days}))"


DAYS = _equity(f"select *, turnover * 0.0005e0 as cost, gross - turnover * 0.0005e0 as net from ({_DAYS.format(HELD)})")
EQUAL = bt.Policy()


def held(s: SparkSession, d: str, p: bt.Policy = EQUAL) -> DataFrame:
    return Book(s, d).held(p)


def days(s: SparkSession, d: str, p: bt.Policy = EQUAL) -> DataFrame:
    return Book(s, d).days(p)


def _interval(s: SparkSession, d: str) -> DataFrame:
    """A bootstrapped interval of the Sharpe ratio."""
    from marlstone.operators import diagnostics as dg

    return dg.series_bootstrap(days(s, d), "net", lambda x: x.mean() / max(x.std(ddof=1), 1e-12) * 252**0.5)


QUERIES["m08_series_bootstrap"] = _interval


def _trades(s: SparkSession, d: str) -> DataFrame:
    b = Book(s, d)
    return bt.trade_summary(b.held(), b.days())


def _capacity(s: SparkSession, d: str) -> DataFrame:
    b = Book(s, d)
    return bt.capacity(b.held(), b.panel, [1e3, 1e5])


def _products(s: SparkSession, d: str) -> DataFrame:
    b = Book(s, d)
    return b.held().join(b.grid, K).groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("x"))


DAY = ["gross", "turnover", "cost", "net", "equity", "drawdown"]
add("b01_weights_equal", lambda s, d: bt.row_weights(grid(s, d), EQUAL), K, ["weight"], wanted_sql(GRID))
_rk = "(rank() over (partition by date, score is not null order by score) + (count(*) over (partition by date, score) - 1) / 2.0e0) / nullif(count(score) over (partition by date), 0)"
add("b01_weights_rank", lambda s, d: bt.row_weights(grid(s, d), bt.Policy(mode="rank")), K, ["weight"], f"select *, case when score is not null then coalesce(r / nullif(sum(abs(r)) over (partition by date), 0), 0) else 0 end as weight from (select *, r0 - avg(r0) over (partition by date) as r from (select *, case when score is not null then {_rk} end as r0 from ({GRID})))")
_prob = "select *, coalesce(case when lo then 1.0e0 / sum(cast(lo as int)) over (partition by date) end, 0) as weight from (select *, score is not null and score >= 0.55 and rn <= greatest(1, cast(round_even(n * 0.3e0, 0) as int)) as lo from (select *, count(score) over (partition by date) as n, row_number() over (partition by date order by score desc nulls last, ticker) as rn from ({0})))"
add("b01_weights_probability", lambda s, d: bt.row_weights(grid(s, d), bt.Policy(mode="probability", two_sided=False)), K, ["weight"], _prob.format(GRID))
add("b02_portfolio_limits", lambda s, d: bt.limits(bt.row_weights(grid(s, d), EQUAL), bt.Policy(max_weight=0.3)), K, ["weight"], limits_sql(wanted_sql(GRID), 0.3))
_band = f"""select date, ticker, list_reduce(list_prepend(cast(0 as double), list(weight) over (partition by ticker order by date rows unbounded preceding)), lambda a, b: case when abs(b - a) >= 0.4e0 then b else a end) as held from ({limits_sql(wanted_sql(GRID))})"""


def _banded(s: SparkSession, d: str) -> DataFrame:
    from marlstone.operators import recursive

    w = bt.limits(bt.row_weights(grid(s, d), EQUAL), EQUAL).select(*K, "weight")
    return recursive.along(w, lambda r: {"held": recursive.no_trade_band(r["weight"].to_numpy(float), 0.4)}, ["held"])


add("b03_no_trade_band", _banded, K, ["held"], _band)
add("b05_backtest", days, ["date"], DAY, DAYS)
_over = "coalesce(least(0.1e0 / nullif(case when count(g) over z >= 31 then stddev_samp(g) over z end * sqrt(252), 0), 3), 1)"
_LEV = f"select h.* replace (h.weight * m.m as weight) from ({HELD}) h join (select date, {_over} as m from (select date, sum(weight * ret) as g from ({HELD}) group by date) window z as (order by date rows between 63 preceding and 1 preceding)) m on h.date = m.date"
add("b04_vol_target", lambda s, d: days(s, d, bt.Policy(vol_target=0.1)), ["date"], ["gross", "turnover", "net"], f"select *, gross - turnover * 0.0005e0 as net from ({_DAYS.format(limits_sql(_LEV))})")
add("b05_trade_summary", _trades, ["n_days"], ["avg_positions", "avg_gross_exposure", "avg_net_exposure", "avg_daily_turnover", "best_day", "worst_day", "pct_positive_days"], f"select count(*) as n_days, avg(p) as avg_positions, avg(e.g) as avg_gross_exposure, avg(e.n) as avg_net_exposure, avg(turnover) as avg_daily_turnover, max(net) as best_day, min(net) as worst_day, avg(cast(net > 0 as int)) as pct_positive_days from ({DAYS}) d join (select date, sum(abs(weight)) as g, sum(weight) as n, count(*) filter (abs(weight) > 1e-8) as p from ({HELD}) group by date) e on d.date = e.date")
add("a06_exposure_summary", lambda s, d: bt.exposures(held(s, d)), ["date", "n_long", "n_short"], ["gross", "net", "long", "short"], f'select date, count(*) filter (weight > 0) as n_long, count(*) filter (weight < 0) as n_short, sum(abs(weight)) as gross, sum(weight) as net, sum(greatest(weight, 0)) as "long", sum(least(weight, 0)) as short from ({HELD}) group by date')


def _with_market(s: SparkSession, d: str) -> DataFrame:
    return Book(s, d).with_market()


_WM = f"select d.*, m.market from ({DAYS}) d left join (select date, avg(ret) as market from ({GRID}) group by date) m on d.date = m.date"
_ann = "(pow(product(1 + {0}), 252.0e0 / count({0})) - 1)"
_beta = "covar_samp(net, market) / nullif(var_samp(market), 0)"
FIGURES = {
    "ann_return": _ann.format("net"), "ann_volatility": "stddev_samp(net) * sqrt(252)", "sharpe": "avg(net) / stddev_samp(net) * sqrt(252)", "sortino": "avg(net) / sqrt(avg(net * net) filter (net < 0)) * sqrt(252)",
    "max_drawdown": "min(drawdown)", "calmar": f"{_ann.format('net')} / nullif(abs(min(drawdown)), 0)", "var": "greatest(0, -quantile_cont(net, 0.05))", "cvar": "greatest(0, -avg(net) filter (net <= q))",
    "beta": _beta, "alpha": f"{_ann.format('net')} - {_beta} * {_ann.format('market')}", "hit_rate": "avg(cast(net > 0 as int))", "skew": "skewness(net)", "kurtosis": "kurtosis(net)",
}
_SUM = f"select {', '.join(f'{v} as {k}' for k, v in FIGURES.items())} from (select *, (select quantile_cont(net, 0.05) from ({DAYS})) as q from ({_WM}))"
add("r05_performance_summary", lambda s, d: risk.summary(_with_market(s, d)), [], list(FIGURES), _SUM)
add("r01_annualized_return", lambda s, d: days(s, d).agg(risk.annualized_return(F.col("net")).alias("x")), [], ["x"], f"select {_ann.format('net')} as x from ({DAYS})")
add("r02_sharpe_sortino", lambda s, d: days(s, d).agg(risk.sharpe(F.col("net")).alias("sharpe"), risk.sortino(F.col("net")).alias("sortino")), [], ["sharpe", "sortino"], f"select {FIGURES['sharpe']} as sharpe, {FIGURES['sortino']} as sortino from ({DAYS})")
add("r03_drawdown", days, ["date"], ["drawdown"], DAYS)
add("r04_value_at_risk", lambda s, d: days(s, d).agg(risk.value_at_risk(F.col("net")).alias("x")), [], ["x"], f"select {FIGURES['var']} as x from ({DAYS})")


add("r04_gaussian_value_at_risk", lambda s, d: days(s, d).agg(risk.gaussian_value_at_risk(F.col("net")).alias("x")), [], ["x"], f"select greatest(0, -(avg(net) - 1.6448536269514722e0 * stddev_samp(net))) as x from ({DAYS})")


def _rolling(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-125, 0)
    n = F.col("net")
    return days(s, d).withColumn("x", F.when(F.count(n).over(w) >= 63, F.try_divide(F.avg(n).over(w), F.stddev_samp(n).over(w)) * F.sqrt(F.lit(252.0))))


add("r06_rolling_sharpe", _rolling, ["date"], ["x"], f"select date, case when count(net) over z >= 63 then avg(net) over z / nullif(stddev_samp(net) over z, 0) * sqrt(252) end as x from ({DAYS}) window z as (order by date rows between 125 preceding and current row)")
SHOCKS = {"equity_crash": -0.2, "vol_spike": 2.0, "rates_up": -0.03}
_shock = ", ".join(f"('{k}', {v}e0)" for k, v in SHOCKS.items())
add("r07_stress", lambda s, d: risk.stress(risk.summary(_with_market(s, d)), SHOCKS), ["scenario"], ["shock", "impact"], f"select scenario, shock, case when scenario like '%equity%' then beta * shock when scenario like '%vol%' then -var * shock else shock end as impact from ({_SUM}) cross join (values {_shock}) as t(scenario, shock)")
add("j03_beta_join", lambda s, d: _with_market(s, d).agg((F.covar_samp("net", "market") / F.var_samp("market")).alias("x")), [], ["x"], f"select {_beta} as x from ({_WM})")
add("j12_weights_times_returns", _products, ["date"], ["x"], f"select date, sum(weight * ret) as x from ({HELD}) group by date")
BPS = [0.0, 5.0, 10.0, 25.0]
add("g01_cost_sensitivity", lambda s, d: risk.summary(bt.cost_grid(days(s, d), BPS).withColumn("market", F.lit(0.0)), keys=("bps",)), ["bps"], ["ann_return", "sharpe", "max_drawdown"], f"select bps, {_ann.format('net')} as ann_return, avg(net) / stddev_samp(net) * sqrt(252) as sharpe, min(drawdown) as max_drawdown from ({_equity(f'select date, bps, gross - turnover * bps / 1e4 as net from ({DAYS}) cross join (select unnest({BPS}) as bps)', 'bps')}) group by bps")


def _delays(s: SparkSession, d: str) -> DataFrame:
    b = Book(s, d)
    rows = [b.days(delay=k).withColumn("delay", F.lit(k)) for k in (0, 1, 2)]
    return bt.delay_grid(rows)


def _late(k: int) -> str:
    g = f"select * replace (lag(score, {k}) over (partition by ticker order by date) as score) from ({GRID})" if k else GRID
    h = f"select * from (select date, ticker, ret, lag(weight, 2) over (partition by ticker order by date) as weight from ({limits_sql(limits_sql(wanted_sql(g)))})) where weight is not null"
    return f"select {k} as delay, *, gross - turnover * 0.0005e0 as net from ({_DAYS.format(h)})"


add("g02_execution_delay", _delays, ["delay"], ["gross", "turnover", "sharpe"], f"select delay, sum(gross) as gross, sum(turnover) as turnover, avg(net) / stddev_samp(net) * sqrt(252) as sharpe from ({' union all '.join(_late(k) for k in (0, 1, 2))}) group by delay")
add("g03_break_even_cost", lambda s, d: bt.break_even_bps(days(s, d)), ["n"], ["break_even_bps"], f"select count(*) as n, sum(gross) / nullif(sum(turnover), 0) * 1e4 as break_even_bps from ({DAYS})")
_cap = f"""select aum, count(*) filter (move > 0) as trades, count(x) as observed, count(x) / nullif(count(*) filter (move > 0), 0) as coverage, sum(move) * any_value(aum) as traded, quantile_cont(x * aum, 0.5) as median_rate,
  quantile_cont(x * aum, 0.95) as p95_rate, max(x * aum) as max_rate, avg(cast(x * aum > 0.1 as int)) as share_above, 0.1e0 / max(x) as capacity from (
  select *, case when move > 0 then move / liquidity end as x from (select h.*, l.liquidity, abs(weight - coalesce(lag(weight) over (partition by h.ticker order by h.date), 0)) as move from ({HELD}) h left join
  (select date, ticker, quantile_cont(case when close * volume > 0 then close * volume end, 0.5) over (partition by ticker order by date rows between 19 preceding and current row) as liquidity from ({P.REGION_SQL})) l on l.date = h.date and l.ticker = h.ticker)) cross join (select unnest([1000.0e0, 100000.0e0]) as aum) group by aum"""
add("g04_liquidity_capacity", _capacity, ["aum", "trades", "observed"], ["coverage", "traded", "median_rate", "p95_rate", "max_rate", "share_above", "capacity"], _cap)
