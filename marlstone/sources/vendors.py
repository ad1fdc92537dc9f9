"""Price sources: retries, vendor pages staged as JSON and replayed, CSV quotes, a seeded synthetic panel.

The transport is a callable, so nothing here needs a network to be tested. Keys never reach a staged file.
"""

from __future__ import annotations

import csv
import hashlib
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.sources.files import Folder

Transport = Callable[[str, dict[str, str]], tuple[int, bytes, dict[str, str]]]
_SECRET = re.compile(r"((?:api_?key|token|secret)=)[^&\s]+", re.I)


class SourceError(RuntimeError):
    pass


def redact(text: str) -> str:
    return _SECRET.sub(r"\1***", text)


def retry(fn: Callable, retries: int = 3, backoff: float = 0.5, what: str = "source", sleep: Callable[[float], None] = time.sleep):
    """Call until something not empty comes; waits double."""
    error: Exception | None = None
    for i in range(retries):
        try:
            got = fn()
            if got is not None and len(got):
                return got
            error = SourceError(f"{what}: empty result")
        except Exception as e:
            error = e
        if i + 1 < retries:
            sleep(backoff * 2**i)
    raise SourceError(f"{what} failed: {redact(str(error))}")


@dataclass
class Budget:
    """Least seconds between requests and a hard number of them."""

    most: int = 100
    interval: float = 0.0
    used: int = 0
    last: float = field(default=-1e9)
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def take(self) -> None:
        if self.used >= self.most:
            raise SourceError("request budget is spent")
        wait = self.last + self.interval - self.clock()
        if wait > 0:
            self.sleep(wait)
        self.used, self.last = self.used + 1, self.clock()


def fetch_pages(spark: SparkSession, root: str, table: str, params: dict[str, str], transport: Transport, budget: Budget | None = None, mode: str = "prefer_cache", most_bytes: int = 50_000_000) -> DataFrame:
    """All cursor pages of a vendor table as strings; staged as JSON with hashes and replayed from there.

    ``mode``: prefer_cache, network or cache_only. Pages must agree on their columns.
    """
    key = hashlib.sha256(json.dumps([table, sorted((k, v) for k, v in params.items() if not re.search("key|token|secret", k, re.I))]).encode()).hexdigest()[:16]
    folder, budget = Folder(spark, f"{root.rstrip('/')}/{table}-{key}"), budget or Budget()
    if mode == "network" or not folder.exists("latest.json"):
        if mode == "cache_only":
            raise SourceError("no snapshot to replay")
        pages, cursor, columns = [], None, None
        while True:
            page = json.loads(_answer(transport, table, params | ({"cursor": cursor} if cursor else {}), budget, most_bytes))
            names = [c["name"] for c in page["datatable"]["columns"]]
            if columns not in (None, names):
                raise SourceError("columns changed between pages")
            columns = names
            name = f"page-{len(pages):05d}.json"
            folder.write_json(name, {"columns": names, "data": [[None if x is None else str(x) for x in r] for r in page["datatable"]["data"]]})
            pages.append({"name": name, "sha256": hashlib.sha256(folder.read_bytes(name)).hexdigest()})
            cursor = (page.get("meta") or {}).get("next_cursor_id")
            if not cursor:
                break
        folder.write_json("latest.json", {"pages": pages, "columns": columns, "retrieved_at": datetime.now(timezone.utc).isoformat()})
    m = folder.read_json("latest.json")
    for p in m["pages"]:
        if hashlib.sha256(folder.read_bytes(p["name"])).hexdigest() != p["sha256"]:
            raise SourceError(f"{p['name']} was changed")
    raw = spark.read.schema("columns array<string>, data array<array<string>>").option("multiLine", True).json([folder.child(p["name"]) for p in m["pages"]])
    row = raw.select(F.explode("data").alias("r"))
    return row.select(*(F.col("r")[i].alias(c) for i, c in enumerate(m["columns"])))


def normalise(rows: DataFrame, close_hour: int = 21, lag_hours: int = 8, adjustment: str = "adjusted", retrieved_at: datetime | None = None) -> DataFrame:
    """Typed bars with their instants; bad bars and bars of one day twice are an error when read.

    ``retrieved_at`` is when the rows came from the vendor (a snapshot's own instant where they are replayed).
    """
    from marlstone.operators.validation import coerce_panel, require

    d = coerce_panel(rows)
    good = (F.least("open", "high", "low", "close") > 0) & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    d = require(d, F.coalesce(good, F.lit(True)), "a bar is out of bounds")
    d = require(d.withColumn("__n", F.count("*").over(Window.partitionBy("ticker", "date"))), F.col("__n") == 1, "a day occurs twice").drop("__n")
    at = F.col("date").cast("timestamp") + F.make_interval(hours=F.lit(close_hour))
    return d.withColumns({"effective_at": at, "available_at": at + F.make_interval(hours=F.lit(lag_hours)), "observed_at": F.lit(retrieved_at or datetime.now(timezone.utc)), "adjustment_state": F.lit(adjustment)})


def check_scope(rows: DataFrame, tickers: list[str], start: str, end: str) -> None:
    """Rows outside the request, or tickers without rows, are an error."""
    out = rows.where(~F.col("ticker").isin(tickers) | ~F.col("date").between(start, end)).limit(1).count()
    asked = rows.sparkSession.createDataFrame([(t,) for t in tickers], "ticker string")
    lost = sorted(r["ticker"] for r in asked.join(rows.select("ticker").distinct(), "ticker", "left_anti").collect())  # of those asked for
    if out or lost:
        raise SourceError(f"rows out of scope: {bool(out)}; tickers without rows: {lost}")


QUOTES = ["date", "open", "high", "low", "close", "adj_close", "volume"]


def _quotes(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Strings as they came, the adjusted close being the close where there is none; one table for all tickers."""
    d = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*QUOTES, "ticker"]))
    return d.withColumn("adj_close", F.coalesce("adj_close", "close"))


def fetch_csv(spark: SparkSession, tickers: list[str], get: Callable[[str], str], retries: int = 3) -> DataFrame:
    """Daily quotes of a CSV service (as Stooq's), one text a ticker with a header in any order and case."""
    rows: list[tuple] = []
    for t in tickers:
        lines = retry(lambda t=t: get(t).strip().splitlines(), retries, 0.0, t)
        header = [c.strip().lower().replace(" ", "_") for c in next(csv.reader(lines[:1]))]
        if not {"date", "close"} <= set(header):
            raise SourceError(f"{t}: no quotes in the answer")
        for line in csv.reader(lines[1:]):
            r = dict(zip(header, line, strict=False))
            rows.append((*(r.get(c) or None for c in QUOTES), t))
    return _quotes(spark, rows)


def fetch_chart(spark: SparkSession, tickers: list[str], get: Callable[[str], str], retries: int = 3) -> DataFrame:
    """Daily quotes of a chart service (as Yahoo's), one JSON a ticker: instants, quote arrays, adjusted closes."""
    rows: list[tuple] = []
    for t in tickers:
        found = retry(lambda t=t: json.loads(get(t))["chart"]["result"], retries, 0.0, t)[0]
        quote = found["indicators"]["quote"][0]
        adjusted = (found["indicators"].get("adjclose") or [{}])[0].get("adjclose")
        for i, at in enumerate(found.get("timestamp") or []):
            day = datetime.fromtimestamp(at, tz=timezone.utc).date().isoformat()
            bar = {k: quote[k][i] for k in ("open", "high", "low", "close", "volume")} | {"adj_close": adjusted[i] if adjusted else None}
            if bar["close"] is not None:
                rows.append((day, *(None if bar[c] is None else str(bar[c]) for c in QUOTES[1:]), t))
    if not rows:
        raise SourceError("no quotes in any answer")
    return _quotes(spark, rows)


def fetch_series(spark: SparkSession, root: str, database: str, tickers: list[str], transport: Transport, params: dict[str, str] | None = None, budget: Budget | None = None, mode: str = "prefer_cache", suffix: str = "") -> DataFrame:
    """A vendor's time-series answers, one page a ticker; staged as JSON with hashes and replayed from there.

    Each answer must be of the database and code asked for; ``suffix`` marks codes of unadjusted series.
    """
    budget, pages = budget or Budget(), []
    folder = Folder(spark, f"{root.rstrip('/')}/{database}{suffix}")
    for t in tickers:
        name = f"{t}.json"
        if mode == "network" or not folder.exists(name):
            if mode == "cache_only":
                raise SourceError(f"no snapshot of {t} to replay")
            page = json.loads(_answer(transport, f"{database}/{t}{suffix}", params or {}, budget))["dataset"]
            if (page["database_code"], page["dataset_code"]) != (database, f"{t}{suffix}"):
                raise SourceError(f"{t}: the answer is of {page['database_code']}/{page['dataset_code']}")
            data = [[None if x is None else str(x) for x in r] for r in page["data"]]
            folder.write_json(name, {"ticker": t, "columns": page["column_names"], "data": data})
            folder.write_json(f"{t}.sha256.json", {"sha256": hashlib.sha256(folder.read_bytes(name)).hexdigest()})
        if hashlib.sha256(folder.read_bytes(name)).hexdigest() != folder.read_json(f"{t}.sha256.json")["sha256"]:
            raise SourceError(f"{name} was changed")
        pages.append(folder.read_json(name)["columns"])
    if any(c != pages[0] for c in pages):
        raise SourceError("columns differ between tickers")
    raw = spark.read.schema("ticker string, columns array<string>, data array<array<string>>").option("multiLine", True).json([folder.child(f"{t}.json") for t in tickers])
    row = raw.select("ticker", F.explode("data").alias("r"))
    return row.select("ticker", *(F.col("r")[i].alias(c.strip().lower().replace(" ", "_").replace(".", "")) for i, c in enumerate(pages[0])))


def _answer(transport: Transport, what: str, params: dict[str, str], budget: Budget, most_bytes: int = 50_000_000, tries: int = 4) -> bytes:
    """One answer within the budget; where the service asks to wait (429, 503), waits as long as it says."""
    for i in range(tries):
        budget.take()
        status, raw, headers = transport(what, params)
        low = {k.lower(): v for k, v in headers.items()}
        if len(raw) > most_bytes or int(low.get("content-length") or 0) > most_bytes:
            raise SourceError(f"{what}: more than {most_bytes} bytes")
        if status == 200:
            return raw
        if status not in (429, 503) or i + 1 == tries:
            break
        budget.sleep(min(60.0, float(low.get("retry-after") or 2**i)))
    raise SourceError(f"{what}: status {status}")


def http_transport(base: str, timeout: float = 30.0, most_bytes: int = 50_000_000) -> Transport:
    """A transport over HTTP that reads no more than a bound; errors carry no key."""
    import urllib.error
    import urllib.parse
    import urllib.request

    def get(what: str, params: dict[str, str]) -> tuple[int, bytes, dict[str, str]]:
        url = f"{base.rstrip('/')}/{what}.json?{urllib.parse.urlencode(params)}"
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return r.status, r.read(most_bytes + 1), dict(r.headers)
        except urllib.error.HTTPError as e:
            return e.code, b"", dict(e.headers or {})
        except OSError as e:
            raise SourceError(redact(str(e))) from None

    return get


def dispatch(kinds: list[str], sources: dict[str, Callable[[], DataFrame]], allow_synthetic: bool = False) -> DataFrame:
    """The first source that answers; a synthetic one only if it was opted into. Fails closed."""
    errors = []
    for k in kinds:
        if k == "synthetic" and not allow_synthetic:
            continue
        try:
            return sources[k]()
        except Exception as e:
            errors.append(f"{k}: {redact(str(e))}")
    raise SourceError("; ".join(errors) or "no source allowed")


def synthetic_panel(spark: SparkSession, tickers: list[str], days: int = 500, start: str = "2018-01-01", seed: int = 7) -> DataFrame:
    """Seeded bars: a common factor with changing volatility, betas, gaps and lognormal volume. One task a ticker."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        name, i = rows["ticker"].iloc[0], int(rows["i"].iloc[0])
        common, own = np.random.default_rng(seed), np.random.default_rng([seed, i + 1])
        regime = 0.01 * (1 + 0.5 * np.sin(2 * np.pi * np.arange(days) / 252))
        shock = common.normal(0, 1, days)
        market = np.empty(days)
        last = 0.0
        for t in range(days):
            last = 0.05 * last + regime[t] * shock[t]
            market[t] = last
        ret = own.normal(0.0002, 0.0001) + own.uniform(0.6, 1.4) * market + own.normal(0, 0.008, days)
        close = 100 * np.exp(np.cumsum(ret))
        open_ = np.r_[close[0], close[:-1]] * np.exp(own.normal(0, 0.002, days))
        high, low = np.maximum(open_, close) * np.exp(np.abs(own.normal(0, 0.004, days))), np.minimum(open_, close) * np.exp(-np.abs(own.normal(0, 0.004, days)))
        adjusted = close * (1 - 0.02 / 252) ** np.arange(days)[::-1]
        return pd.DataFrame({"date": pd.bdate_range(start, periods=days).date, "ticker": name, "open": open_, "high": high, "low": low, "close": close, "adj_close": adjusted, "volume": own.lognormal(14, 0.4, days).round()})

    base = spark.createDataFrame([(t, i) for i, t in enumerate(tickers)], "ticker string, i int")
    return base.groupBy("ticker").applyInPandas(run, "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double")


def ingest(spark: SparkSession, root: str, fetch: Callable[[], DataFrame], start: str, end: str, tag: dict) -> DataFrame:
    """Fetch, coerce, clip, validate, add returns, write by ticker; a fingerprint of the request skips all that."""
    from marlstone.operators.validation import clip_dates, coerce_panel, panel_report
    from marlstone.plans.panels import with_returns
    from marlstone.sources.canonical import content_hash, semantic_hash

    key = semantic_hash([start, end, tag])
    folder = Folder(spark, root)
    if not folder.exists(f"{key}.json"):
        d = clip_dates(coerce_panel(fetch()), start, end)
        with_returns(d).repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date").write.mode("overwrite").partitionBy("ticker").parquet(folder.child(key))
        wrote = spark.read.parquet(folder.child(key))
        bad = [r["ticker"] for r in panel_report(wrote, 1).where("not ok").collect()]
        if bad:
            folder.remove(key)
            raise SourceError(f"the panel is not valid for {bad}")
        r = wrote.agg(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b")).first()
        folder.write_json(f"{key}.json", {"rows": r["n"], "first": str(r["a"]), "last": str(r["b"]), "content": content_hash(wrote), "request": tag})
    return spark.read.parquet(folder.child(key)).orderBy("ticker", "date")
