"""Dynamic asset graphs as edge lists, message passing over them, and shrinkage covariance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.nulls import ratio


def window_before(returns: DataFrame, as_of: DataFrame, n: int, date: str = "date") -> DataFrame:
    """Returns of the n dates strictly before each ``as_of`` date, tagged with it."""
    w = Window.partitionBy(F.lit(0)).orderBy(date)
    days = returns.select(date).distinct().withColumn("i", F.row_number().over(w))
    marks = as_of.join(days, as_of["as_of"] == days[date]).select("as_of", F.col("i").alias("at"))
    # each mark names its n dates; dates and marks are rows of a calendar, so hints are left to the planner's sizes
    near = marks.select("as_of", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - n), F.col("at") - 1)).alias("i")).where("i >= 1")
    return returns.join(near.join(days, "i").select(date, "as_of"), date)


def edges(windowed: DataFrame, value: str = "ret", lagged: str | None = None, threshold: float = 0.2, degree: int = 3) -> DataFrame:
    """(as_of, src, dst, weight): absolute correlations over the threshold, the strongest few of each node, rows summing to one."""
    a = windowed.select("as_of", "date", F.col("ticker").alias("src"), F.col(lagged or value).alias("a")).where("a is not null")
    b = windowed.select("as_of", "date", F.col("ticker").alias("dst"), F.col(value).alias("b")).where("b is not null")
    if lagged:
        c = a.join(b, ["as_of", "date"]).where("src <> dst").groupBy("as_of", "src", "dst").agg(F.abs(F.corr("a", "b")).alias("w"))
    else:  # symmetric: each pair once, then mirrored
        c = a.join(b, ["as_of", "date"]).where("src < dst").groupBy("as_of", "src", "dst").agg(F.abs(F.corr("a", "b")).alias("w"))
        c = c.select("as_of", F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))), "w")
    c = c.where((F.col("w") >= threshold) & ~F.isnan("w"))  # without spread there is no correlation
    node = Window.partitionBy("as_of", "src")
    c = c.withColumn("place", F.row_number().over(node.orderBy(F.desc("w"), "dst"))).where(F.col("place") <= degree)
    return c.select("as_of", "src", "dst", ratio(F.col("w"), F.sum("w").over(node)).alias("weight"))


def partial_correlations(spark, names: list[str], correlation: np.ndarray, ridge: float = 1e-3) -> DataFrame:
    """(src, dst, corr) from the inverse of a ridged correlation matrix of a few hundred assets at most."""
    p = np.linalg.inv(correlation + ridge * np.eye(len(names)))
    d = np.sqrt(np.diag(p))
    c = -p / np.outer(d, d)
    rows = [(a, b, float(c[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
    return spark.createDataFrame(rows, "src string, dst string, corr double")


def partial_edges(windowed: DataFrame, value: str = "ret", threshold: float = 0.2, degree: int = 3, ridge: float = 1e-3, most: int = 500) -> DataFrame:
    """The same from partial correlations: each mark's complete dates give a correlation matrix, whose ridged inverse
    holds them. A mark is a task; more than ``most`` entities in one is an error."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="date", columns="ticker", values=value).dropna()
        if wide.shape[1] > most:
            raise ValueError(f"more than {most} entities in one window")
        if len(wide) < 3 or wide.shape[1] < 2:
            return pd.DataFrame([], columns=["as_of", "src", "dst", "w"], dtype=object)
        p = np.linalg.inv(np.nan_to_num(np.corrcoef(wide.to_numpy().T)) + ridge * np.eye(wide.shape[1]))
        d = np.sqrt(np.diag(p))
        c, names = np.abs(p / np.outer(d, d)), list(wide.columns)
        pairs = [(rows["as_of"].iloc[0], a, b, float(c[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
        return pd.DataFrame(pairs, columns=["as_of", "src", "dst", "w"])

    c = windowed.select("as_of", "date", "ticker", value).groupBy("as_of").applyInPandas(run, "as_of date, src string, dst string, w double").where(F.col("w") >= threshold)
    node = Window.partitionBy("as_of", "src")
    c = c.withColumn("place", F.row_number().over(node.orderBy(F.desc("w"), "dst"))).where(F.col("place") <= degree)
    return c.select("as_of", "src", "dst", ratio(F.col("w"), F.sum("w").over(node)).alias("weight"))


def pass_messages(states: DataFrame, graph: DataFrame, own: float = 0.5, rounds: int = 1) -> DataFrame:
    """``own`` times a node's state plus the rest from its neighbours, a few times; (as_of, ticker, x)."""
    d = states.select("as_of", "ticker", F.coalesce("x", F.lit(0.0)).alias("x"))
    for _ in range(rounds):
        got = graph.join(d.select("as_of", F.col("ticker").alias("dst"), "x"), ["as_of", "dst"]).groupBy("as_of", F.col("src").alias("ticker")).agg(F.sum(F.col("weight") * F.col("x")).alias("m"))
        d = d.join(got, ["as_of", "ticker"], "left").select("as_of", "ticker", (own * F.col("x") + (1 - own) * F.coalesce("m", F.lit(0.0))).alias("x"))
    return d


def moments(wide: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and maximum-likelihood covariance of complete rows: one aggregate of sums and products."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    d = wide.dropna(subset=columns)
    r = d.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.zeros((len(columns),) * 2)
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
    return r["n"], np.array([r[f"m{i}"] for i in range(len(columns))]), cov


def oas(n: int, cov: np.ndarray, floor: float = 1e-12) -> tuple[np.ndarray, float]:
    """Oracle-approximating shrinkage toward a scaled identity; eigenvalues floored."""
    p = len(cov)
    mu, power = np.trace(cov) / p, (cov**2).sum() / p**2
    up, low = power + mu**2, (n + 1) * (power - mu**2 / p)
    rate = 1.0 if low == 0 else min(1.0, up / low)
    value, vector = np.linalg.eigh((1 - rate) * cov + rate * mu * np.eye(p))
    return (vector * np.maximum(value, floor)) @ vector.T, rate
