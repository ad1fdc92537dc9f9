"""Registry of feature contracts: named, versioned columns with fixed inputs, look-back and warm-up.

A contract is null for the first ``warmup - 1`` rows of an entity, and after that wherever its inputs leave
it undefined. Windows need all their values. All trailing contracts share one window; those that are
recursive share one grouped pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from inspect import getsource

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.nulls import ratio
from marlstone.functions.trail import Trail
from marlstone.operators import cross_sectional as xs
from marlstone.operators import liquidity as li
from marlstone.operators import recursive as rc
from marlstone.operators import statistics as st
from marlstone.operators import technical as te

PREFIX = "fc_"


@dataclass(frozen=True)
class Contract:
    name: str
    family: str
    inputs: tuple[str, ...]
    warmup: int
    build: Callable[[Trail], Column] | None = None
    series: Callable[[pd.DataFrame], object] | None = None
    section: Callable[[Column], Column] | None = None
    base: str | None = None
    low: float | None = None
    high: float | None = None
    version: str = "1.0.0"
    default: bool = True

    def contains(self, x: float) -> bool:
        """Whether a value is within the contract's range."""
        return (self.low is None or x >= self.low) and (self.high is None or x <= self.high)

    def identity(self) -> str:
        made = self.build or self.series or self.section
        return hashlib.sha256(f"{self.name}|{self.version}|{self.warmup}|{getsource(made)}".encode()).hexdigest()


def _full_ratio(t: Trail, n: int) -> Column:
    return ratio(F.col("close"), t.mean(F.col("close"), n)) - 1


def _full_zscore(t: Trail, n: int) -> Column:
    return ratio(F.col("close") - t.mean(F.col("close"), n), t.std(F.col("close"), n))


def _all() -> list[Contract]:
    c, close, bar, hl = Contract, ("close",), ("open", "high", "low", "close"), ("high", "low")
    out = [c(f"ret_{k}d", "return", close, k, lambda t, k=k: te.simple_return(t, F.col("close"), k)) for k in (1, 5, 21)]
    out += [c("logret_1d", "return", close, 1, lambda t: te.log_return(t, F.col("close"))), c("roc_10", "return", close, 10, lambda t: te.simple_return(t, F.col("close"), 10))]
    out += [c(f"mom_{n}", "momentum", close, n, lambda t, n=n: te.momentum(t, F.col("close"), n)) for n in (63, 126, 252)]
    out += [c("mom_252_21", "momentum", close, 252, lambda t: te.momentum(t, F.col("close"), 252, 21))]
    out += [c(f"ma_dist_{n}", "trend", close, n, lambda t, n=n: _full_ratio(t, n)) for n in (20, 50, 200)]
    out += [c(f"ema_dist_{n}", "trend", close, n, series=lambda p, n=n: p["close"].to_numpy(float) / rc.ema(p["close"].to_numpy(float), n) - 1) for n in (12, 26)]
    out += [
        c("zscore_21", "reversion", close, 21, lambda t: _full_zscore(t, 21)),
        c("reversal_5", "reversion", close, 5, lambda t: -te.simple_return(t, F.col("close"), 5)),
        c("vwap_dev_21", "reversion", ("high", "low", "close", "volume"), 21, lambda t: te.vwap_deviation(t, F.col("high"), F.col("low"), F.col("close"), F.col("volume"), 21)),
        c("resid_63", "reversion", close, 63, lambda t: te.regression_residual(t, F.col("close"), 63)),
        c("cs_rank_mom_63", "cross_section", close, 63, section=xs.percent_rank_average, base="mom_63", low=0, high=1),
        c("cs_z_mom_63", "cross_section", close, 63, section=xs.zscore, base="mom_63"),
        c("parkinson_vol_21", "volatility", hl, 21, lambda t: st.parkinson_volatility(t, F.col("high"), F.col("low")), low=0),
        c("garman_klass_vol_21", "volatility", bar, 21, lambda t: st.garman_klass_volatility(t, F.col("open"), F.col("high"), F.col("low"), F.col("close")), low=0),
        c("rogers_satchell_vol_21", "volatility", bar, 21, lambda t: st.rogers_satchell_volatility(t, F.col("open"), F.col("high"), F.col("low"), F.col("close")), low=0),
        c("ewma_vol_21", "volatility", close, 21, series=lambda p: rc.ewma_volatility(p["ret"].to_numpy(float), 21), low=0),
        c("skew_63", "moment", close, 63, series=lambda p: rc.rolling_skewness(p["ret"].to_numpy(float))),
        c("kurt_63", "moment", close, 63, series=lambda p: rc.rolling_kurtosis(p["ret"].to_numpy(float))),
        c("downside_dev_63", "moment", close, 63, lambda t: st.downside_deviation(t, F.col("ret")), low=0),
        c("mad_63", "moment", close, 63, series=lambda p: rc.median_absolute_deviation(p["ret"].to_numpy(float)), low=0),
        c("autocorr_1_63", "dependence", close, 63, series=lambda p: rc.autocorrelation(p["ret"].to_numpy(float)), low=-1, high=1),
        c("pacf_2_63", "dependence", close, 63, series=lambda p: rc.partial_autocorrelation_2(p["ret"].to_numpy(float)), low=-1, high=1),
        c("hurst_128", "dependence", close, 128, series=lambda p: rc.hurst_exponent(p["close"].to_numpy(float))),
        c("var_ratio_5_63", "dependence", close, 63, series=lambda p: rc.variance_ratio(p["ret"].to_numpy(float)), low=0),
        c("beta_mkt_63", "market", close, 63, series=lambda p: rc.rolling_beta(p["ret"].to_numpy(float), p["market"].to_numpy(float))),
        c("corr_mkt_63", "market", close, 63, series=lambda p: rc.rolling_correlation(p["ret"].to_numpy(float), p["market"].to_numpy(float)), low=-1, high=1),
        c("mutual_info_mkt_63", "market", close, 63, series=lambda p: rc.mutual_information(p["ret"].to_numpy(float), p["market"].to_numpy(float)), low=0),
        c("volume_change_1", "liquidity", ("volume",), 1, lambda t: li.volume_change(t, F.col("volume"))),
        c("dollar_volume_21", "liquidity", ("close", "volume"), 21, lambda t: li.log_dollar_volume(t, F.col("close"), F.col("volume"))),
        c("rel_volume_21", "liquidity", ("volume",), 21, lambda t: li.relative_volume(t, F.col("volume")), low=0),
        c("amihud_21", "liquidity", ("close", "volume"), 21, lambda t: li.amihud_illiquidity(t, F.col("close"), F.col("volume")), low=0),
        c("volume_imbalance_21", "liquidity", ("close", "volume"), 21, lambda t: li.volume_imbalance(t, F.col("close"), F.col("volume")), low=-1, high=1),
        c("corwin_schultz_21", "liquidity", hl, 21, lambda t: li.corwin_schultz_spread(t, F.col("high"), F.col("low")), low=0),
        c("roll_spread_21", "liquidity", close, 21, lambda t: li.roll_spread(t, F.col("ret")), low=0),
        c("turnover_21", "liquidity", ("volume", "shares_outstanding"), 21, lambda t: li.turnover(t, F.col("volume"), F.col("shares_outstanding")), low=0, default=False),
    ]
    return out


REGISTRY: dict[str, Contract] = {c.name: c for c in _all()}


def get(name: str) -> Contract:
    if name not in REGISTRY:
        raise KeyError(f"no contract {name!r}")
    return REGISTRY[name]


def names(family: str | None = None, default_only: bool = True) -> list[str]:
    return [c.name for c in REGISTRY.values() if (family is None or c.family == family) and (c.default or not default_only)]


def metadata(spark: SparkSession) -> DataFrame:
    """One row a contract."""
    rows = [(c.name, c.version, c.family, list(c.inputs), c.warmup, None if c.low is None else float(c.low), None if c.high is None else float(c.high), c.default, c.identity()) for c in REGISTRY.values()]
    return spark.createDataFrame(rows, "name string, version string, family string, inputs array<string>, warmup int, low double, high double, is_default boolean, identity string")


def check_panel(panel: DataFrame, wanted: list[Contract], deep: bool = False) -> None:
    """Missing inputs are an error before anything runs; ``deep`` also reads the panel: no rows, days that occur
    twice and infinite inputs are errors."""
    inputs = sorted({i for c in wanted for i in c.inputs})
    lost = sorted(set(inputs) - set(panel.columns))
    if lost:
        raise ValueError(f"the panel lacks {lost}")
    if deep:
        infinite = sum((F.coalesce(F.abs(F.col(i).cast("double")) == F.lit(float("inf")), F.lit(False)).cast("int") for i in inputs), F.lit(0))
        keys = panel.groupBy("ticker", "date").agg(F.count("*").alias("n"), F.sum(infinite).alias("i"))
        r = keys.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeats"), F.sum("i").alias("infinite")).first()
        faults = [k for k, bad in (("no rows", not r["rows"]), ("repeated days", r["repeats"]), ("infinite inputs", r["infinite"])) if bad]
        if faults:
            raise ValueError(f"the panel has {', '.join(faults)}")


def build(panel: DataFrame, chosen: list[str] | None = None, deep: bool = False) -> DataFrame:
    """``(date, ticker, fc_*)`` for the chosen contracts (default: all default ones).

    The panel has the price columns; returns and the equal-weight market are added where missing.
    """
    from marlstone.plans.panels import with_market, with_returns

    wanted = [get(n) for n in chosen or names()]
    check_panel(panel, wanted, deep)
    d = panel if "ret" in panel.columns else with_returns(panel)
    if "market" not in d.columns and any(c.family == "market" for c in wanted):
        d = with_market(d)
    bases = [get(c.base) for c in wanted if c.base and c.base not in {x.name for x in wanted}]
    if series := [c for c in wanted if c.series]:
        d = rc.along(d, lambda p: {PREFIX + c.name: c.series(p) for c in series}, [PREFIX + c.name for c in series])
    t = Trail(d)
    place = t.series(t.number())
    for c in [*wanted, *bases]:
        if c.build or c.series:
            made = c.build(t) if c.build else F.col(PREFIX + c.name)
            t.put(**{PREFIX + c.name: F.when(place >= c.warmup, made)})
    d = t.result()
    for c in wanted:
        if c.section:
            d = d.withColumn(PREFIX + c.name, c.section(F.col(PREFIX + c.base)))
    return d.select("date", "ticker", *(PREFIX + c.name for c in wanted))


def violations(matrix: DataFrame) -> DataFrame:
    """Values outside their contract's range, by contract: one aggregate."""
    have = [c for c in REGISTRY.values() if PREFIX + c.name in matrix.columns]
    eps = 1e-9

    def out(c: Contract) -> Column:
        x = F.col(PREFIX + c.name)
        below = x < c.low - eps if c.low is not None else F.lit(False)
        return F.count_if(below | (x > c.high + eps if c.high is not None else F.lit(False)))

    rows = matrix.agg(*(out(c).alias(c.name) for c in have))
    return rows.select(F.inline(F.array(*(F.struct(F.lit(c.name).alias("name"), F.col(c.name).alias("outside")) for c in have))))


