"""Cross-sectional portfolio simulation on long ``(date, ticker)`` rows.

Weights, limits, lag, costs and equity are windows over dates or tickers; only the no-trade band is a
recursion and runs in a grouped pass. Grids over costs, delays and fund sizes are columns of one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marlstone.functions.nulls import ratio
from marlstone.functions.shared import calendar_grid
from marlstone.operators import recursive
from marlstone.operators.cross_sectional import percent_rank_average, quantile_count
from marlstone.operators.technical import YEAR


def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


@dataclass(frozen=True)
class Policy:
    """``mode``: equal, rank or probability. ``two_sided`` is long and short in equal amounts."""

    mode: str = "equal"
    two_sided: bool = True
    quantile: float = 0.3
    leverage: float = 1.0
    max_weight: float = 0.0
    long_from: float = 0.55
    short_to: float = 0.45
    band: float = 0.0
    lag: int = 2
    cost_bps: float = 5.0
    vol_target: float | None = None


def row_weights(scores: DataFrame, p: Policy) -> DataFrame:
    """Adds ``weight`` to rows of (date, ticker, score); no score, no weight. A missing side means no position."""
    s, there = F.col("score"), F.col("score").isNotNull()
    n = F.count("score").over(by_date())
    sides = scores.withColumn("__k", quantile_count(n, p.quantile))
    if p.mode == "rank":
        r = sides.withColumn("__r", percent_rank_average(s))
        if p.two_sided:
            r = r.withColumn("__r", F.col("__r") - F.avg("__r").over(by_date()))
        else:
            r = r.withColumn("__r", F.greatest(F.col("__r") - (1 - p.quantile), F.lit(0.0)))
        weight = p.leverage * ratio(F.col("__r"), F.sum(F.abs("__r")).over(by_date()))
        return r.withColumn("weight", F.when(there, F.coalesce(weight, F.lit(0.0))).otherwise(0.0)).drop("__r", "__k")
    down, up = by_date().orderBy(s.desc_nulls_last(), "ticker"), by_date().orderBy(s.asc_nulls_last(), "ticker")
    k = F.col("__k")
    if p.mode == "probability":
        long, short = there & (s >= p.long_from) & (F.row_number().over(down) <= k), there & (s <= p.short_to) & (F.row_number().over(up) <= k)
    else:
        long = there & (F.row_number().over(down) <= k)
        # the last k of the same order, so that a name is never on both sides
        short = there & (F.row_number().over(down) > n - k) & ~(F.row_number().over(down) <= k)
    sides = sides.withColumns({"__long": long, "__short": short})
    longs, shorts = F.sum(F.col("__long").cast("int")).over(by_date()), F.sum(F.col("__short").cast("int")).over(by_date())
    if p.two_sided:
        weight = F.when((longs == 0) | (shorts == 0), 0.0).when(F.col("__long"), p.leverage / 2 / longs).when(F.col("__short"), -p.leverage / 2 / shorts)
    else:
        weight = F.when(F.col("__long"), p.leverage / longs)
    return sides.withColumn("weight", F.coalesce(weight, F.lit(0.0))).drop("__k", "__long", "__short")


def limits(weights: DataFrame, p: Policy, column: str = "weight") -> DataFrame:
    """Cap names, balance the sides down to the smaller, and scale gross exposure down to the leverage."""
    w = F.col(column)
    d = weights.withColumn(column, F.greatest(F.lit(-p.max_weight), F.least(F.lit(p.max_weight), w))) if p.max_weight > 0 else weights
    if p.two_sided:
        long, short = F.sum(F.greatest(w, F.lit(0.0))).over(by_date()), -F.sum(F.least(w, F.lit(0.0))).over(by_date())
        d = d.withColumns({"__l": long, "__s": short})
        even = F.least("__l", "__s")
        d = d.withColumn(column, w * F.coalesce(F.when(w > 0, ratio(even, F.col("__l"))).otherwise(ratio(even, F.col("__s"))), F.lit(0.0))).drop("__l", "__s")
    gross = F.sum(F.abs(w)).over(by_date())
    return d.withColumn(column, w * F.coalesce(F.least(F.lit(1.0), ratio(F.lit(p.leverage), gross)), F.lit(1.0)))


def vol_overlay(gross: Column, target: float, n: int = 63, cap: float = 3.0) -> Column:
    """Multiplier from the volatility of gross returns before the day; one where unknown. One row a date."""
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-n, -1)
    realised = F.when(F.count(gross).over(w) >= max(5, n // 2), F.stddev_samp(gross).over(w)) * F.sqrt(F.lit(YEAR))
    return F.coalesce(F.least(ratio(F.lit(target), realised), F.lit(cap)), F.lit(1.0))


def held_weights(scores: DataFrame, calendar: DataFrame, p: Policy) -> DataFrame:
    """Weights held on each date of the calendar: (date, ticker, weight), lagged by ``p.lag`` rows.

    Dates without a signal keep the last target. The grid of dates and tickers is what the backtest holds.
    """
    wanted = limits(row_weights(scores, p), p).select("date", "ticker", "weight")
    wanted = calendar_grid(calendar, scores).join(wanted, ["date", "ticker"], "left")
    # a date with any signal sets all its names; others carry the last such date forward
    signal = F.count("weight").over(by_date()) > 0
    wanted = wanted.withColumn("weight", F.when(signal, F.coalesce("weight", F.lit(0.0))))
    before = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    wanted = wanted.withColumn("weight", F.coalesce(F.last("weight", ignorenulls=True).over(before), F.lit(0.0)))
    if p.band > 0:
        wanted = recursive.along(wanted, lambda rows: {"held": recursive.no_trade_band(rows["weight"].to_numpy(float), p.band)}, ["held"]).drop("weight").withColumnRenamed("held", "weight")
    wanted = limits(wanted, p)
    return wanted.withColumn("weight", F.lag("weight", p.lag).over(by_ticker())).where("weight is not null")


def daily(weights: DataFrame, returns: DataFrame, p: Policy, lagged: bool = True) -> DataFrame:
    """One row a date: gross, turnover, cost, net, equity, drawdown. ``returns``: (date, ticker, ret).

    The first row trades from cash. A missing return of a held name is an error.
    """
    rows = weights.join(returns.select("date", "ticker", "ret"), ["date", "ticker"], "left")
    if p.vol_target is not None:
        base = rows.groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("g"))
        base = base.select("date", vol_overlay(F.col("g"), p.vol_target).alias("m"))
        rows = limits(rows.join(base, "date").withColumn("weight", F.col("weight") * F.col("m")).drop("m"), p)
    lost = (F.abs("weight") > 1e-12) & F.col("ret").isNull()
    part = F.when(lost, F.raise_error(F.lit("a held name has no return")).cast("double")).otherwise(F.col("weight") * F.col("ret"))
    move = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(by_ticker()), F.lit(0.0)))
    rows = rows.withColumns({"__part": part, "__move": move})
    d = rows.groupBy("date").agg(F.sum("__part").alias("gross"), F.sum("__move").alias("turnover"))
    d = d.withColumn("cost", F.col("turnover") * (p.cost_bps / 1e4)).withColumn("net", F.col("gross") - F.col("cost"))
    return with_equity(d)


def with_equity(d: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds equity (start 1) and drawdown from the running peak, which includes the start. Rows are dates."""
    w = Window.partitionBy(*keys or (F.lit(0),)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("equity", F.product(1 + F.col("net")).over(w))
    return d.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1)


def exposures(weights: DataFrame, eps: float = 0.0) -> DataFrame:
    w = F.col("weight")
    return weights.groupBy("date").agg(
        F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"), F.sum(F.greatest(w, F.lit(0.0))).alias("long"), F.sum(F.least(w, F.lit(0.0))).alias("short"),
        F.count_if(w > eps).alias("n_long"), F.count_if(w < -eps).alias("n_short"),
    )


def trade_summary(weights: DataFrame, days: DataFrame) -> DataFrame:
    """One row of averages over days."""
    e = exposures(weights, 1e-8).join(days.select("date", "turnover", F.col("net").alias("day_net")), "date")
    return e.agg(
        F.count("*").alias("n_days"), F.avg(F.col("n_long") + F.col("n_short")).alias("avg_positions"), F.avg("n_long").alias("avg_long_positions"), F.avg("n_short").alias("avg_short_positions"),
        F.avg("gross").alias("avg_gross_exposure"), F.avg("net").alias("avg_net_exposure"), F.avg("turnover").alias("avg_daily_turnover"),
        F.max("day_net").alias("best_day"), F.min("day_net").alias("worst_day"), F.avg((F.col("day_net") > 0).cast("double")).alias("pct_positive_days"),
    )


def cost_grid(days: DataFrame, bps: list[float]) -> DataFrame:
    """Net returns and equity under each total cost: weights, gross and turnover do not depend on it."""
    grid = F.explode(F.array(*(F.lit(float(b)) for b in bps))).alias("bps")
    d = days.select("date", "gross", "turnover", grid).withColumn("net", F.col("gross") - F.col("turnover") * F.col("bps") / 1e4)
    return with_equity(d, ("bps",))


def delay_grid(delayed: list[DataFrame]) -> DataFrame:
    """Summed gross returns, turnover and Sharpe ratio by ``delay``, of daily results that hold that column, over the
    dates that all of them have."""
    rows = delayed[0]
    for other in delayed[1:]:
        rows = rows.unionByName(other)
    rows = rows.withColumn("__n", F.count("*").over(by_date())).where(F.col("__n") == len(delayed))
    net = F.col("net")
    sharpe = ratio(F.avg(net), F.stddev_samp(net)) * F.sqrt(F.lit(YEAR))
    return rows.groupBy("delay").agg(F.sum("gross").alias("gross"), F.sum("turnover").alias("turnover"), sharpe.alias("sharpe"))


def break_even_bps(days: DataFrame) -> DataFrame:
    """One-way cost at which summed gross returns are used up; null without turnover."""
    both = days.where("gross is not null and turnover is not null")
    return both.agg((ratio(F.sum("gross"), F.sum("turnover")) * 1e4).alias("break_even_bps"), F.count("*").alias("n"))


def capacity(weights: DataFrame, panel: DataFrame, sizes: list[float], n: int = 20, limit: float = 0.10) -> DataFrame:
    """Participation of trades in trailing median dollar volume under each fund size, and the capacity."""
    dollars = F.when(F.col("close") * F.col("volume") > 0, F.col("close") * F.col("volume"))
    market = panel.select("date", "ticker", F.percentile(dollars, 0.5).over(by_ticker().rowsBetween(-(n - 1), 0)).alias("liquidity"))
    move = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(by_ticker()), F.lit(0.0)))
    rows = weights.withColumn("move", move).join(market, ["date", "ticker"], "left").withColumn("each", F.when(F.col("move") > 0, ratio(F.col("move"), F.col("liquidity"))))
    rows = rows.select("move", "each", F.explode(F.array(*(F.lit(float(x)) for x in sizes))).alias("aum"))
    part = F.col("each") * F.col("aum")
    return rows.groupBy("aum").agg(
        F.count_if(F.col("move") > 0).alias("trades"), F.count("each").alias("observed"), ratio(F.count("each").cast("double"), F.count_if(F.col("move") > 0)).alias("coverage"),
        (F.sum("move") * F.first("aum")).alias("traded"), F.percentile(part, 0.5).alias("median_rate"), F.percentile(part, 0.95).alias("p95_rate"), F.max(part).alias("max_rate"),
        F.avg((part > limit).cast("double")).alias("share_above"), ratio(F.lit(limit), F.max("each")).alias("capacity"),
    )
