"""Risk and performance of a return series, as aggregates."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.nulls import ratio
from marlstone.operators.technical import YEAR


def annualized_return(r: Column) -> Column:
    return F.pow(F.product(1 + r), ratio(F.lit(YEAR), F.count(r).cast("double"))) - 1


def volatility(r: Column) -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(YEAR))


def sharpe(r: Column, riskless: float = 0.0) -> Column:
    return F.when(F.stddev_samp(r) >= 1e-12, (F.avg(r) - riskless / YEAR) / F.stddev_samp(r) * F.sqrt(F.lit(YEAR)))


def sortino(r: Column, riskless: float = 0.0) -> Column:
    """Over the root mean square of the negative excess returns only."""
    e = r - riskless / YEAR
    down = F.sqrt(F.avg(F.when(e < 0, e * e)))
    return F.when(down >= 1e-12, F.avg(e) / down * F.sqrt(F.lit(YEAR)))


def value_at_risk(r: Column, level: float = 0.95) -> Column:
    """Historical loss at the level, zero at least."""
    return F.greatest(F.lit(0.0), -F.percentile(r, 1 - level))


def gaussian_value_at_risk(r: Column, level: float = 0.95) -> Column:
    """Loss at the level of a normal with the series' mean and deviation, zero at least."""
    z = NormalDist().inv_cdf(1 - level)
    return F.greatest(F.lit(0.0), -(F.avg(r) + z * F.stddev_samp(r)))


def summary(days: DataFrame, ret: str = "net", market: str = "market", level: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (a group) of performance figures; ``days`` has a date, the return and the market's return."""
    r, m = F.col(ret), F.col(market)
    own = Window.partitionBy(*keys or (F.lit(0),))
    path = own.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = days.where(r.isNotNull()).withColumn("__e", F.product(1 + r).over(path))
    d = d.withColumn("__dd", F.col("__e") / F.greatest(F.lit(1.0), F.max("__e").over(path)) - 1)
    d = d.withColumn("__q", F.percentile(r, 1 - level).over(own))
    n = F.count(r).cast("double")
    beta = ratio(F.covar_samp(r, m), F.var_samp(F.when(r.isNotNull(), m)))
    skew = F.skewness(r) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.kurtosis(r) + 6) * (n - 1) / ((n - 2) * (n - 3))
    figures = {
        "ann_return": annualized_return(r), "ann_volatility": volatility(r), "sharpe": sharpe(r), "sortino": sortino(r), "max_drawdown": F.min("__dd"),
        "calmar": ratio(annualized_return(r), F.abs(F.min("__dd"))), "var": value_at_risk(r, level), "cvar": F.greatest(F.lit(0.0), -F.avg(F.when(r <= F.col("__q"), r))),
        "beta": beta, "alpha": annualized_return(r) - beta * annualized_return(m), "hit_rate": F.avg((r > 0).cast("double")), "skew": skew, "kurtosis": kurt,
    }
    return d.groupBy(*keys).agg(*(v.alias(k) for k, v in figures.items()))


def stress(stats: DataFrame, scenarios: dict[str, float]) -> DataFrame:
    """Loss under named shocks: market ones through beta, volatility ones through the value at risk, others as they are."""
    s = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("shock")) for k, v in scenarios.items())))
    name = F.lower("scenario")
    d = stats.select("beta", "var", s.alias("s")).select("beta", "var", "s.*")
    impact = F.when(name.rlike("equity|market|drawdown"), F.col("beta") * F.col("shock")).when(name.contains("vol"), -F.col("var") * F.col("shock")).otherwise(F.col("shock"))
    return d.select("scenario", "shock", impact.alias("impact"))
