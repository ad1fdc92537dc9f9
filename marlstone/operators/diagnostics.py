"""Diagnostics of probability forecasts, data quality and drift. Inputs have columns ``p`` and ``y``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marlstone.functions.nulls import ratio
from marlstone.functions.shared import MAX_DATES, numbered, running



def _p() -> Column:
    return F.col("p")


def _y() -> Column:
    return F.col("y").cast("double")


def _all() -> WindowSpec:
    return Window.partitionBy(F.lit(0))


def uniform_bin(p: Column, n: int) -> Column:
    """Bins closed below; 1.0 in the last."""
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(p * n).cast("int")))


def quantile_edges(df: DataFrame, n: int) -> DataFrame:
    """One row with the inner edges by linear quantiles; repeated ones once."""
    inner = [i / n for i in range(1, n)]
    return df.agg(F.array_sort(F.array_distinct(F.percentile("p", inner))).alias("edges"))


def binned(df: DataFrame, n: int = 10, quantile: bool = False) -> DataFrame:
    if not quantile:
        return df.withColumn("bin", uniform_bin(_p(), n))
    d = df.crossJoin(F.broadcast(quantile_edges(df, n)))  # one row of n - 1 numbers
    return d.withColumn("bin", F.size(F.filter("edges", lambda e: e <= _p()))).drop("edges")


def calibration_table(df: DataFrame, n: int = 10, quantile: bool = False) -> DataFrame:
    """Each bin's count, share, mean forecast, observed rate, gap and weighted gap; empty bins are kept."""
    rows = binned(df, n, quantile).groupBy("bin").agg(F.count("*").alias("count"), F.avg(_p()).alias("mean_p"), F.avg(_y()).alias("rate"))
    spine = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    full = spine.join(rows, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    full = full.withColumn("fraction", ratio(F.col("count").cast("double"), F.sum("count").over(_all())))
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    return full.withColumns({"gap": gap, "weighted_gap": F.coalesce(gap * F.col("fraction"), F.lit(0.0))})


def expected_calibration_error(df: DataFrame, n: int = 10) -> DataFrame:
    return calibration_table(df, n).agg(F.sum("weighted_gap").alias("ece"))


def brier_decomposition(df: DataFrame, n: int = 10, quantile: bool = True) -> DataFrame:
    """Brier score as reliability less resolution plus uncertainty, and what binning leaves over."""
    d = binned(df, n, quantile)
    b = d.groupBy("bin").agg(F.count("*").alias("c"), F.avg(_p()).alias("mp"), F.avg(_y()).alias("r"), F.sum((_p() - _y()) * (_p() - _y())).alias("sq"))
    b = b.withColumns({"all": F.sum("c").over(_all()), "base": F.sum(F.col("r") * F.col("c")).over(_all()) / F.sum("c").over(_all())})
    w = F.col("c") / F.col("all")
    out = b.agg(F.sum(w * F.pow(F.col("mp") - F.col("r"), 2)).alias("reliability"), F.sum(w * F.pow(F.col("r") - F.col("base"), 2)).alias("resolution"), (F.max("base") * (1 - F.max("base"))).alias("uncertainty"), (F.sum("sq") / F.max("all")).alias("brier"))
    return out.withColumn("residual", F.col("brier") - (F.col("reliability") - F.col("resolution") + F.col("uncertainty")))


def scoring_rules(df: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Log loss, Brier score and its skill over the mean of the same labels, whose score is the labels' variance."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), _p()))
    brier, reference = F.avg((_p() - _y()) * (_p() - _y())), F.var_pop(_y())
    return df.agg(F.avg(-(_y() * F.ln(q) + (1 - _y()) * F.ln(1 - q))).alias("log_loss"), brier.alias("brier"), F.when(reference > eps, 1 - brier / reference).alias("skill"))


def selective_frontier(df: DataFrame, key: str, coverages: tuple[float, ...] = (0.2, 0.5, 1.0)) -> DataFrame:
    """Accuracy over the most confident share of rows; ties by key. Ranges of the order are ranked apart."""
    d = df.select(key, _p(), _y().alias("y"), (-F.abs(_p() - 0.5)).alias("order"))
    d = numbered(d, "order", key)
    every = d.agg(F.count("*").alias("n"))
    right = ((_p() >= 0.5) == (F.col("y") >= 0.5)).cast("double")
    d = d.withColumn("right", right).join(F.broadcast(every)).select("*", F.explode(F.array(*map(F.lit, coverages))).alias("coverage"))  # one row
    return d.where(F.col("rank") < F.ceil(F.col("coverage") * F.col("n"))).groupBy("coverage").agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"), F.min(F.abs(_p() - 0.5)).alias("least_confidence"))


def decile_returns(df: DataFrame, score: str, value: str, key: str, n: int = 10) -> DataFrame:
    """Balanced bins of ranked scores (first come by key): statistics of the value in each."""
    d = df.where(F.col(score).isNotNull() & F.col(value).isNotNull())
    d = numbered(d.select(score, value, key), score, key)
    d = d.join(F.broadcast(d.agg(F.count("*").alias("all"), F.avg(value).alias("mean_all"))))  # one row
    d = d.withColumn("bin", F.greatest(F.lit(1), F.ceil(F.col("rank") * n / F.greatest(F.col("all") - 1, F.lit(1)))).cast("int"))
    v = F.col(value)
    return d.groupBy("bin").agg(
        F.count("*").alias("count"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_samp(v).alias("std"),
        ratio(F.avg(v), F.stddev_samp(v) / F.sqrt(F.count(v).cast("double"))).alias("t_stat"), (F.avg(v) - F.max("mean_all")).alias("excess"),
    )


def classification_metrics(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts and what follows; ROC area by average ranks, average precision by steps over distinct scores."""
    hit, yes = _p() >= threshold, _y() >= 0.5
    d = df.groupBy("p").agg(F.sum(yes.cast("long")).alias("pos"), F.sum((~yes).cast("long")).alias("neg"))
    d = running(d.withColumn("down", -_p()), "down", ["pos", "neg"])
    area, steps = F.sum(F.col("neg") * (F.col("run_pos") - F.col("pos") / 2)), F.sum(F.col("pos") * F.col("run_pos") / (F.col("run_pos") + F.col("run_neg")))
    np_, nn = F.sum("pos"), F.sum("neg")
    curves = d.agg((area / (np_ * nn)).alias("roc_auc"), (steps / np_).alias("average_precision"))
    c = df.agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    made = {
        "accuracy": (tp + tn) / (tp + fp + fn + tn), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2, "precision": F.coalesce(ratio(tp, tp + fp), F.lit(0.0)), "recall": F.coalesce(ratio(tp, tp + fn), F.lit(0.0)),
        "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), "mcc": F.coalesce(ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0)),
    }
    return c.withColumns(made).crossJoin(curves)  # one row each


def fold_metrics(df: DataFrame, fold: str = "fold", threshold: float = 0.5, eps: float = 1e-12) -> DataFrame:
    """One row a fold: rows, share of ones, accuracy, precision, recall, Brier score and log loss; one aggregate."""
    hit, yes = _p() >= threshold, _y() >= 0.5
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), _p()))
    both = F.count_if(hit & yes).cast("double")
    return df.groupBy(fold).agg(
        F.count("*").alias("n"), F.avg(_y()).alias("rate"), F.avg((hit == yes).cast("double")).alias("accuracy"), F.coalesce(ratio(both, F.count_if(hit)), F.lit(0.0)).alias("precision"), F.coalesce(ratio(both, F.count_if(yes)), F.lit(0.0)).alias("recall"),
        F.avg((_p() - _y()) * (_p() - _y())).alias("brier"), F.avg(-(_y() * F.ln(q) + (1 - _y()) * F.ln(1 - q))).alias("log_loss"),
    )


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    t, g = F.col(truth), F.col(guess)
    both = df.where(t.isNotNull() & g.isNotNull())
    return both.agg(F.sqrt(F.avg((t - g) * (t - g))).alias("rmse"), F.avg(F.abs(t - g)).alias("mae"), (1 - ratio(F.sum((t - g) * (t - g)), F.var_pop(t) * F.count(t))).alias("r2"), F.avg((F.signum(t) == F.signum(g)).cast("double")).alias("directional_accuracy"))


def interval_diagnostics(df: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Coverage and width of normal intervals, spread of standardised misses, negative log score. Columns y, mean, variance."""
    s = F.sqrt("variance")
    miss = (F.col("y") - F.col("mean")) / s
    return df.where("y is not null").agg(F.avg((F.abs(miss) <= z).cast("double")).alias("coverage"), F.avg(2 * z * s).alias("width"), F.avg(miss).alias("mean_miss"), F.stddev_samp(miss).alias("std_miss"), F.avg(0.5 * (F.ln(2 * F.pi() * F.col("variance")) + miss * miss)).alias("nls"))


def quality_report(df: DataFrame, required: list[str], universe: list[str], keys: tuple[str, str] = ("date", "ticker"), max_missing: float = 0.05, max_gap: int = 5, as_of: str | None = None, max_stale: int = 5) -> DataFrame:
    """One row a check: code, passed, observed. Gaps count business days between a ticker's rows."""
    date, ticker = keys
    lost = [c for c in required if c not in df.columns]
    have = [c for c in required if c in df.columns and c not in keys]
    w = Window.partitionBy(ticker).orderBy(date)
    before = F.lag(date).over(w)
    d = df.withColumns({"__gap": business_days(before, F.col(date)), "__n": F.count("*").over(Window.partitionBy(*keys))})
    missing = sum((F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0) for c in have), F.lit(0))
    last = F.to_date(F.lit(as_of)) if as_of else F.max(date)
    a = d.agg(
        F.count("*").alias("rows"), F.count_if(F.col(date).isNull()).alias("no_date"), F.count_if(F.col("__n") > 1).alias("repeats"), F.max(F.coalesce("__gap", F.lit(0))).alias("gap"),
        F.sum(missing).alias("missing"), business_days(F.max(date), last).alias("stale"),
    )
    # the names asked for are given, so few; those in the panel are not gathered
    asked = df.sparkSession.createDataFrame([(u,) for u in universe], f"{ticker} string")
    a = a.crossJoin(asked.join(df.select(ticker).distinct(), ticker, "left_anti").agg(F.count("*").alias("absent")))  # one row each
    share = ratio(F.col("missing").cast("double"), F.col("rows") * max(1, len(have)))
    checks = [
        ("schema.required", F.lit(not lost), F.lit(float(len(lost)))), ("rows.non_empty", F.col("rows") > 0, F.col("rows")), ("dates.valid", F.col("no_date") == 0, F.col("no_date")), ("universe.complete", F.col("absent") == 0, F.col("absent")),
        ("keys.unique", F.col("repeats") == 0, F.col("repeats")), ("missing.fraction", share <= max_missing, share), ("gap.business_days", F.col("gap") <= max_gap, F.col("gap")), ("staleness", F.col("stale") <= max_stale, F.col("stale")),
    ]
    rows = F.array(*(F.struct(F.lit(c).alias("code"), F.coalesce(ok, F.lit(False)).alias("passed"), F.coalesce(x.cast("double"), F.lit(0.0)).alias("observed")) for c, ok, x in checks))
    return a.select(F.inline(rows))


def business_days(a: Column, b: Column) -> Column:
    """Weekdays from a (included) to b (excluded), in closed form."""

    def before(d: Column) -> Column:  # weekdays from a Monday long ago up to d
        n = F.datediff(d, F.lit("1900-01-01").cast("date"))
        return F.floor(n / 7) * 5 + F.least(n % 7, F.lit(5))

    return (before(b) - before(a)).cast("int")


def drift(reference: DataFrame, current: DataFrame, column: str, bins: int = 10, eps: float = 1e-8, least: int = 20) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and population stability index over reference quantiles.

    Values are counted before anything is ordered, so repeated ones cost nothing.
    """
    x = F.col(column).cast("double")
    both = reference.select(x.alias("x"), F.lit(1).alias("r")).unionByName(current.select(x.alias("x"), F.lit(0).alias("r"))).where("x is not null and not isnan(x)")
    per = both.groupBy("x").agg(F.sum("r").alias("a"), F.sum(1 - F.col("r")).alias("b"))
    e = running(per, "x", ["a", "b"])
    totals = per.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    e = e.join(F.broadcast(totals))  # one row
    ks = e.agg(F.max(F.abs(F.col("run_a") / F.col("na") - F.col("run_b") / F.col("nb"))).alias("ks"), F.max("na").alias("n_reference"), F.max("nb").alias("n_current"))
    inner = both.where("r = 1").agg(F.array_sort(F.array_distinct(F.percentile("x", [i / bins for i in range(1, bins)]))).alias("edges"))
    bin_ = F.size(F.filter("edges", lambda v: v < F.col("x")))
    c = both.crossJoin(F.broadcast(inner)).withColumn("bin", bin_).groupBy("bin").agg(F.sum("r").cast("double").alias("a"), F.sum(1 - F.col("r")).cast("double").alias("b"))
    c = c.withColumns({"pa": F.greatest(F.col("a") / F.sum("a").over(_all()), F.lit(eps)), "pb": F.greatest(F.col("b") / F.sum("b").over(_all()), F.lit(eps))})
    psi = c.agg(F.sum((F.col("pb") - F.col("pa")) * F.ln(F.col("pb") / F.col("pa"))).alias("psi"))
    return ks.crossJoin(psi).withColumn("enough", (F.col("n_reference") >= least) & (F.col("n_current") >= least))  # one row each


def block_bootstrap(df: DataFrame, parts: dict[str, Column], statistic: Callable[[dict[str, float]], float], date: str = "date", block: int = 20, draws: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Percentile interval of a statistic of sums under a circular moving-block bootstrap of dates.

    ``parts`` are aggregates that add up over dates (sums, counts); a drawn date brings all its rows through
    them. So only one row a date leaves the cluster, however many rows it has; draws run as tasks.
    """
    per = df.groupBy(date).agg(*(F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in parts.items())).orderBy(date).toPandas()
    keys = list(parts)
    sums = per[keys].to_numpy(float)

    def of(rows: np.ndarray) -> float:
        return float(statistic(dict(zip(keys, rows.sum(0), strict=True))))

    def run(batches):
        for b in batches:
            out = []
            for i in b["id"]:
                rng, n = np.random.default_rng([seed, int(i)]), len(sums)
                starts = rng.integers(0, n, -(-n // block))
                out.append(of(sums[((starts[:, None] + np.arange(block)) % n).ravel()[:n]]))
            yield pd.DataFrame({"x": out})

    rows = df.sparkSession.range(draws if len(sums) else 0).mapInPandas(run, "x double")
    tail = (1 - level) / 2
    point = of(sums) if len(sums) else float("nan")
    return rows.agg(F.lit(point).alias("point"), F.percentile("x", tail).alias("low"), F.percentile("x", 1 - tail).alias("high"), F.count("x").alias("draws"))


def series_bootstrap(days: DataFrame, column: str, statistic: Callable[[np.ndarray], float], date: str = "date", block: int = 20, draws: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """The same for any statistic of a series with one value a date (as daily returns); draws run as tasks.

    The series is one number a date of a calendar, whose length is checked.
    """
    rows = days.where(F.col(column).isNotNull()).select(date, F.col(column).cast("double").alias("x")).orderBy(date).limit(MAX_DATES + 1).toPandas()
    if len(rows) > MAX_DATES or rows[date].duplicated().any():
        raise ValueError("needs one row a date of a calendar")
    x = rows["x"].to_numpy(float)

    def run(batches):
        for b in batches:
            out = []
            for i in b["id"]:
                starts = np.random.default_rng([seed, int(i)]).integers(0, len(x), -(-len(x) // block))
                out.append(float(statistic(x[((starts[:, None] + np.arange(block)) % len(x)).ravel()[: len(x)]])))
            yield pd.DataFrame({"x": out})

    made = days.sparkSession.range(draws if len(x) else 0).mapInPandas(run, "x double")
    tail = (1 - level) / 2
    point = float(statistic(x)) if len(x) else float("nan")
    return made.agg(F.lit(point).alias("point"), F.percentile("x", tail).alias("low"), F.percentile("x", 1 - tail).alias("high"), F.count("x").alias("draws"))
