"""Versioned records: validity checks, what was visible at an instant, and the latest revision of each identity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE = ["effective_at", "available_at", "observed_at"]


def violations(df: DataFrame, identity: list[str], text: list[str] = (), rules: dict[str, Column | str] | None = None, prices: bool = False) -> DataFrame:
    """One row: how many rows break each rule. Zero everywhere means the records are sound."""
    counts = {f"missing_{c}": F.count_if(F.col(c).isNull()) for c in PRICE}
    counts["observed_before_available"] = F.count_if(F.col("observed_at") < F.col("available_at"))
    if "provider_updated_at" in df.columns:
        counts["provider_after_observed"] = F.count_if(F.col("provider_updated_at") > F.col("observed_at"))
    if prices:
        counts["available_before_effective"] = F.count_if(F.col("available_at") < F.col("effective_at"))
    counts |= {f"empty_{c}": F.count_if(F.coalesce(F.trim(F.col(c)) == "", F.lit(True))) for c in text}
    counts |= {k: F.count_if(F.coalesce(~(F.expr(ok) if isinstance(ok, str) else ok), F.lit(False))) for k, ok in (rules or {}).items()}
    key = F.struct(*identity, "available_at")
    counts["repeated_revision"] = F.count(key) - F.count_distinct(key)
    return df.agg(*(v.alias(k) for k, v in counts.items()))


ACTION_RULES = {
    "unknown_action": "action_type in ('cash_dividend', 'split', 'symbol_change', 'delisting', 'merger', 'spinoff')",
    "split_without_ratio": "action_type <> 'split' or split_ratio > 0",
    "dividend_without_cash": "action_type <> 'cash_dividend' or cash_amount > 0",
    "change_without_symbol": "action_type <> 'symbol_change' or length(trim(new_ticker)) > 0",
}


def visible(df: DataFrame, at: datetime | Column, effective: bool = True) -> DataFrame:
    """Rows known (and in force) at an instant, which must carry a time zone."""
    if isinstance(at, datetime):
        if at.tzinfo is None:
            raise ValueError("the instant needs a time zone")
        at = F.timestamp_micros(F.lit(round(at.timestamp() * 1_000_000)))
    rows = df.where(F.col("available_at") <= at)
    return rows.where(F.col("effective_at") <= at) if effective else rows


def latest_revisions(df: DataFrame, identity: list[str]) -> DataFrame:
    """The last revision of each identity by availability, then observation.

    An aggregate keeps one row for each key on the map side, so an identity with many revisions is no hot task.
    """
    row = F.struct(*df.columns)
    last = F.max_by(row, F.struct("available_at", "observed_at")).alias("row")
    return df.groupBy(*(F.col(c).alias(f"__{c}") for c in identity)).agg(last).select("row.*")


def as_of(df: DataFrame, at: datetime | Column, identity: list[str], effective: bool = True) -> DataFrame:
    return latest_revisions(visible(df, at, effective), identity)
