"""Streaming forms of the panel engine: bars by event time, latest revisions, and recursions with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(stream: DataFrame, time: str = "ts", entity: str = "event_type", value: str = "value", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of a tick stream; a bar is final once the watermark passes it."""
    w = F.window(time, every)
    d = stream.withWatermark(time, late).groupBy(w, entity).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("close"), F.count("*").alias("ticks"))
    return d.select(F.col("window.start").alias("date"), F.col(entity).alias("ticker"), "low", "high", "close", "ticks")


def latest_revisions(stream: DataFrame, identity: list[str]) -> DataFrame:
    """Running latest revision of each identity: state is one row a key (complete or update mode)."""
    row = F.struct(*stream.columns)
    last = F.max_by(row, F.struct("available_at", "observed_at")).alias("row")
    return stream.groupBy(*(F.col(c).alias(f"__{c}") for c in identity)).agg(last).select("row.*")


def ewm(stream: DataFrame, alpha: float, entity: str = "ticker", time: str = "date", value: str = "close") -> DataFrame:
    """Exponential average along each entity, carried in state from batch to batch."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(time, kind="stable")
        out = []
        for x in rows[value]:
            mean = x if mean is None else (1 - alpha) * mean + alpha * x
            out.append(mean)
        state.update((mean,))
        yield pd.DataFrame({time: rows[time].to_numpy(), entity: key[0], "ewm": out})

    return stream.groupBy(entity).applyInPandasWithState(step, f"{time} {kinds[time]}, {entity} {kinds[entity]}, ewm double", "mean double", "append", GroupStateTimeout.NoTimeout)
