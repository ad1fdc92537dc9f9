"""Queries that go through the store, bundles, backfill, vendor pages and streams, and come back as rows.

They write to the session's shared folder, as a cluster would.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import technical as te
from marlstone.functions.shared import folder
from marlstone.functions.trail import Trail
from marlstone.plans import panels as P
from marlstone.sources import backfill as bf
from marlstone.sources import bundle as bu
from marlstone.sources import store as so
from marlstone.sources import vendors as ve
from marlstone.streaming import updates as up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def scratch(s: SparkSession, label: str) -> str:
    return f"{folder(s)}/{label}-{uuid.uuid4().hex}"


def _store(s: SparkSession, d: str) -> DataFrame:
    store = so.FeatureStore(s, scratch(s, "store"))
    panel = P.region_day(s, d)
    m = store.materialize(panel, so.Request("volumes", ("close", "volume"), ("R0", "R1", "R2", "R3", "R4")))
    return store.read(m["object"], "1996-02-01", "1997-03-31", ["R1", "R3"], ["volume"])


QUERIES["st03_store_round_trip"] = _store
ORACLES["st03_store_round_trip"] = f"select date, ticker, volume from ({P.REGION_SQL}) where date between date '1996-02-01' and date '1997-03-31' and ticker in ('R1', 'R3')"


def _bundle(s: SparkSession, d: str) -> DataFrame:
    p = P.region_day(s, d)
    at = F.col("date").cast("timestamp") + F.make_interval(hours=F.lit(21))
    later = F.make_interval(hours=F.lit(8))
    first = p.select(F.col("ticker").alias("instrument_id"), "date", "ticker", F.lit("derived").alias("source"), F.col("volume"), at.alias("effective_at"), (at + later).alias("available_at"), (at + later).alias("observed_at"))
    fix = F.make_interval(days=F.lit(30))
    second = first.where("dayofmonth(date) = 1").withColumns({"volume": F.col("volume") * 2, "available_at": F.col("available_at") + fix, "observed_at": F.col("observed_at") + fix})
    root = scratch(s, "bundles")
    made = bu.export(s, root, {"prices": first.unionByName(second)}, {"name": "derived"})
    bu.validate(s, root, made)
    view = bu.load(s, root, made, datetime(1996, 7, 1, tzinfo=timezone.utc))
    return view.prices.select("date", "ticker", "volume")


QUERIES["snk01_bundle_as_of"] = _bundle
ORACLES["snk01_bundle_as_of"] = f"select date, ticker, case when day(date) = 1 and cast(date as timestamp) + to_hours(29) + to_days(30) <= timestamp '1996-07-01' then volume * 2 else volume end as volume from ({P.REGION_SQL}) where cast(date as timestamp) + to_hours(29) <= timestamp '1996-07-01'"


def _backfill(s: SparkSession, d: str) -> DataFrame:
    panel = P.region_day(s, d)

    def load(part: bf.Part) -> DataFrame:
        t = Trail(bf.window(panel, part, 200, 1))
        return t.put(x=te.moving_average(t, F.col("volume"), 20)).result().select("date", "ticker", "x")

    job = bf.Backfill(s, scratch(s, "backfill"), "averages", bf.parts(date(1996, 1, 1), date(1996, 6, 30), "month"))
    return job.run(load).select("date", "ticker", P.rounded(F.col("x")).alias("x"))


_w = "over (partition by ticker order by date rows between 19 preceding and current row)"
QUERIES["st05_backfill"] = _backfill
ORACLES["st05_backfill"] = f"select date, ticker, {P.rounded_sql('x')} as x from (select *, case when count(volume) {_w} >= 10 then avg(volume) {_w} end as x from ({P.REGION_SQL})) where date between date '1996-01-01' and date '1996-06-30'"


def _parts(s: SparkSession, d: str) -> DataFrame:
    rows = [(p.key, p.start, p.end) for p in bf.parts(date(2020, 2, 10), date(2021, 1, 5), "month")]
    return s.createDataFrame(rows, 'key string, first date, last date')


QUERIES["st06_date_partitions"] = _parts
ORACLES["st06_date_partitions"] = "select strftime(m, '%Y-%m') as key, greatest(cast(m as date), date '2020-02-10') as first, least(cast(last_day(m) as date), date '2021-01-05') as last from (select unnest(generate_series(timestamp '2020-02-01', timestamp '2021-01-01', interval 1 month)) as m)"


def _vendor(s: SparkSession, d: str) -> DataFrame:
    names = [r["n_name"] for r in P.table(s, d, "nation").select("n_name").orderBy("n_nationkey").limit(6).collect()]

    def transport(table: str, params: dict[str, str]) -> tuple[int, bytes, dict[str, str]]:
        at = int(params.get("cursor", "0"))
        page = {"datatable": {"columns": [{"name": "ticker"}, {"name": "rank"}], "data": [[n, at + i] for i, n in enumerate(names[at : at + 4])]}, "meta": {"next_cursor_id": str(at + 4) if at + 4 < len(names) else None}}
        return 200, json.dumps(page).encode(), {}

    root = scratch(s, "vendor")
    ve.fetch_pages(s, root, "quotes", {"api_key": "none"}, transport)
    return ve.fetch_pages(s, root, "quotes", {"api_key": "none"}, transport, mode="cache_only").select("ticker", F.col("rank").cast("int").alias("rank"))


QUERIES["src05_vendor_pages"] = _vendor
ORACLES["src05_vendor_pages"] = "select n_name as ticker, cast(row_number() over (order by n_nationkey) - 1 as int) as rank from (select * from nation order by n_nationkey limit 6)"
QUERIES["src11_synthetic_panel"] = lambda s, d: ve.synthetic_panel(s, ["AAA", "BBB", "SPY"], 300)


def _stream(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars by event time from the events table read as a stream, once over."""
    schema = P.table(s, d, "events").schema
    source = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    bars = up.bars(source.withColumn("ts", F.col("ts").cast("timestamp")), late="0 seconds")
    name = f"bars_{uuid.uuid4().hex}"
    out = scratch(s, name)
    q = bars.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(bars.schema).parquet(out).select("date", "ticker", P.rounded(F.col("close")).alias("close"), "ticks")


QUERIES["str01_event_bars"] = _stream
# the last hour stays open: the watermark has not passed its end
ORACLES["str01_event_bars"] = f"select date, ticker, {P.rounded_sql('close')} as close, ticks from (select date_trunc('hour', ts) as date, event_type as ticker, avg(value) as close, count(*) as ticks from events group by 1, 2) where date < (select date_trunc('hour', max(ts)) from events)"


def _tensors(s: SparkSession, d: str) -> DataFrame:
    """A tensor written, read back with its content verified, and how much power each surface holds."""
    from marlstone.operators import spectral as sp
    from marlstone.sources.tensor_store import TensorStore

    store = TensorStore(s, scratch(s, "tensors"))
    made = sp.tensor(P.with_returns(P.region_day(s, d)), {"return": "ret"})
    name = store.write(made, {"window": 64, "segment": 32, "hop": 8})
    return store.read(name).where("observed").groupBy("ticker", "channel").agg(F.count("*").alias("n"))


QUERIES["snk03_tensor_store"] = _tensors
# a surface is observed where its 64 returns are all there
ORACLES["snk03_tensor_store"] = f"select ticker, 'return' as channel, count(*) as n from (select ticker, count(ret) over (partition by ticker order by date rows between 63 preceding and current row) as k from ({P.returns_sql(P.REGION_SQL)})) where k = 64 group by 1, 2"


def _series(s: SparkSession, d: str) -> DataFrame:
    """Time-series answers, one a nation, staged and replayed."""
    names = [(r["n_nationkey"], r["n_name"]) for r in P.table(s, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").limit(5).collect()]

    def transport(what: str, params: dict[str, str]) -> tuple[int, bytes, dict[str, str]]:
        code = what.split("/")[1]
        return 200, json.dumps({"dataset": {"database_code": "DB", "dataset_code": code, "column_names": ["Date", "Close"], "data": [["2024-01-02", int(code[1:]) * 10], ["2024-01-03", int(code[1:]) * 10 + 1]]}}).encode(), {}

    root, codes = scratch(s, "series"), [f"N{k}" for k, _ in names]
    ve.fetch_series(s, root, "DB", codes, transport)
    return ve.fetch_series(s, root, "DB", codes, transport, mode="cache_only").select("ticker", F.to_date("date").alias("date"), F.col("close").cast("double").alias("close"))


QUERIES["src06_vendor_series"] = _series
ORACLES["src06_vendor_series"] = "select 'N' || n_nationkey as ticker, date '2024-01-02' + cast(i as int) as date, cast(n_nationkey * 10 + i as double) as close from (select * from nation order by n_nationkey limit 5) cross join (select unnest([0, 1]) as i)"


def _quotes(s: SparkSession, d: str) -> DataFrame:
    """Chart answers and CSV quotes of the same bars, normalised: a bar of each service for each region."""
    keys = [r["r_regionkey"] for r in P.table(s, d, "region").select("r_regionkey").orderBy("r_regionkey").collect()]

    def chart(t: str) -> str:
        k = int(t[1:])
        quote = {"open": [10 + k], "high": [12 + k], "low": [9 + k], "close": [11 + k], "volume": [100 * k]}
        return json.dumps({"chart": {"result": [{"timestamp": [1704205800], "indicators": {"quote": [quote]}}]}})

    def text(t: str) -> str:
        k = int(t[1:])
        return f"Date,Open,High,Low,Close,Volume\n2024-01-03,{10 + k},{12 + k},{9 + k},{11 + k},{100 * k}\n"

    rows = ve.fetch_chart(s, [f"R{k}" for k in keys], chart).unionByName(ve.fetch_csv(s, [f"R{k}" for k in keys], text))
    return ve.normalise(rows, retrieved_at=datetime(2024, 1, 5, tzinfo=timezone.utc)).select("date", "ticker", "close", "adj_close", "volume")


QUERIES["src03_src04_quotes"] = _quotes
ORACLES["src03_src04_quotes"] = "select date '2024-01-02' + cast(i as int) as date, 'R' || r_regionkey as ticker, cast(11 + r_regionkey as double) as close, cast(11 + r_regionkey as double) as adj_close, cast(100 * r_regionkey as double) as volume from region cross join (select unnest([0, 1]) as i)"


def _catalogued(s: SparkSession, d: str) -> DataFrame:
    """Two writers of the same keys: the first one's records stay."""
    from marlstone.sources.catalog import Catalog

    c = Catalog(s, scratch(s, "catalog"))
    names = [r["n_name"].replace(" ", "_") for r in P.table(s, d, "nation").select("n_name").orderBy("n_nationkey").limit(4).collect()]
    for version in ("1", "2"):
        for n in names:
            c.insert("features", n, {"name": n, "version": version, "identity": n.lower()})
    return c.rows("features").select("key", F.get_json_object("record", "$.version").alias("version"))


QUERIES["st04_catalog"] = _catalogued
ORACLES["st04_catalog"] = "select replace(n_name, ' ', '_') as key, '1' as version from (select * from nation order by n_nationkey limit 4)"
