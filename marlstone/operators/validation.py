"""Checks of price panels. One aggregate over rows and one over keys, whatever the number of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.nulls import scrub

PRICES = ("open", "high", "low", "close")


def coerce_panel(df: DataFrame) -> DataFrame:
    """Canonical types: what can't be read as a number is null, names are trimmed, dates are dates."""
    numbers = [c for c in (*PRICES, "adj_close", "volume") if c in df.columns]
    d = df.withColumns({c: F.col(c).try_cast("double") for c in numbers})
    return scrub(d.withColumns({"date": F.col("date").try_cast("date"), "ticker": F.trim(F.col("ticker").cast("string"))}), numbers)


def clip_dates(df: DataFrame, first: str, last: str) -> DataFrame:
    """Rows with a close between two dates, both included."""
    return df.where(F.col("close").isNotNull() & F.col("date").between(first, last))


def panel_report(df: DataFrame, least: int = 100) -> DataFrame:
    """One row a ticker: counts of each fault and ``ok`` (no error; missing values and few rows only warn)."""
    same = F.count("*").over(Window.partitionBy("date", "ticker"))
    bad_price = F.greatest(*(F.when(F.col(c) <= 0, 1).otherwise(0) for c in PRICES))
    d = df.withColumn("__n", same).groupBy("ticker").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("__n") > 1).alias("repeated_keys"), F.sum(bad_price).alias("non_positive"), F.count_if(F.col("high") < F.col("low")).alias("high_below_low"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"), F.sum(sum((F.col(c).isNull().cast("int") for c in (*PRICES, "volume")), F.lit(0))).alias("missing"),
    )
    return d.withColumns({"few_rows": F.col("n_rows") < least, "ok": (F.col("repeated_keys") == 0) & (F.col("non_positive") == 0) & (F.col("high_below_low") == 0)})


def lookahead(df: DataFrame, feature: str, target: str, limit: float = 0.999) -> DataFrame:
    """Whether a feature is the target in disguise: equal everywhere, or correlated beyond the limit."""
    f, t = F.col(feature), F.col(target)
    return df.agg(F.bool_and(f.eqNullSafe(t)).alias("identical"), F.corr(f, t).alias("correlation")).withColumn("leaks", F.col("identical") | F.coalesce(F.abs("correlation") > limit, F.lit(False)))


def require(df: DataFrame, ok, message: str) -> DataFrame:
    """The rows, failing the job at the first that breaks the rule."""
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
