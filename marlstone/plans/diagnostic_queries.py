"""Queries of forecast diagnostics, validation, quality, drift and versioned records, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.nulls import scrub
from marlstone.operators import bitemporal as bi
from marlstone.operators import diagnostics as dg
from marlstone.operators import validation as va
from marlstone.plans import panels as P
from marlstone.plans.section_queries import _round, _round_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query, keys: list[str], columns: list[str], sql: str | None) -> None:
    QUERIES[name] = lambda s, d: _round(query(s, d), keys, columns)
    if sql:
        ORACLES[name] = _round_sql(", ".join(keys), columns, sql) if keys and columns else f"select {', '.join([*keys, *(f'{P.rounded_sql(c)} as {c}' for c in columns)])} from ({sql})"


def forecasts(s: SparkSession, d: str) -> DataFrame:
    """A forecast and an outcome for each order, and its value."""
    o = P.table(s, d, "orders")
    p = (F.col("o_orderkey") % 101) / 100
    return o.select(F.col("o_orderkey").alias("key"), p.alias("p"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") * 13) % 100 < 60 * p + 20).cast("int").alias("y"), F.col("o_totalprice").alias("value"), F.to_date("o_orderdate").alias("date"))


FC = "select o_orderkey as key, (o_orderkey % 101) / 100.0e0 as p, cast((o_custkey * 7 + o_orderkey * 13) % 100 < 60 * ((o_orderkey % 101) / 100.0e0) + 20 as int) as y, o_totalprice as value, cast(o_orderdate as date) as date from orders"
_bin = "least(9, greatest(0, cast(floor(p * 10) as int)))"
CAL = f"select b.bin, coalesce(r.n, 0) as count, mean_p, rate, coalesce(r.n, 0) / sum(coalesce(r.n, 0)) over () as fraction, abs(mean_p - rate) as gap, coalesce(abs(mean_p - rate) * (r.n / sum(coalesce(r.n, 0)) over ()), 0) as weighted_gap from (select cast(unnest(range(10)) as int) as bin) b left join (select {_bin} as bin, count(*) as n, avg(p) as mean_p, avg(y) as rate from ({FC}) group by 1) r on b.bin = r.bin"
add("m01_calibration_table", lambda s, d: dg.calibration_table(forecasts(s, d)), ["bin", "count"], ["mean_p", "rate", "fraction", "gap", "weighted_gap"], CAL)
add("m02_expected_calibration_error", lambda s, d: dg.expected_calibration_error(forecasts(s, d)), [], ["ece"], f"select sum(weighted_gap) as ece from ({CAL})")
_qb = f"select *, len(list_filter((select list_sort(list_distinct(quantile_cont(p, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) from ({FC})), lambda e: e <= p)) as bin from ({FC})"
_bd = f"select sum(c / n * pow(mp - r, 2)) as reliability, sum(c / n * pow(r - base, 2)) as resolution, max(base) * (1 - max(base)) as uncertainty, sum(sq) / max(n) as brier from (select *, sum(c) over () as n, sum(r * c) over () / sum(c) over () as base from (select bin, count(*) as c, avg(p) as mp, avg(y) as r, sum((p - y) * (p - y)) as sq from ({_qb}) group by bin))"
add("m03_brier_decomposition", lambda s, d: dg.brier_decomposition(forecasts(s, d)), [], ["reliability", "resolution", "uncertainty", "brier", "residual"], f"select *, brier - (reliability - resolution + uncertainty) as residual from ({_bd})")
_q = "greatest(1e-12, least(1 - 1e-12, p))"
add("m04_m05_scoring_rules", lambda s, d: dg.scoring_rules(forecasts(s, d)), [], ["log_loss", "brier", "skill"], f"select avg(-(y * ln({_q}) + (1 - y) * ln(1 - {_q}))) as log_loss, avg((p - y) * (p - y)) as brier, 1 - avg((p - y) * (p - y)) / avg((base - y) * (base - y)) as skill from (select *, avg(y) over () as base from ({FC}))")
add("m06_selective_frontier", lambda s, d: dg.selective_frontier(forecasts(s, d), "key"), ["coverage", "n"], ["accuracy", "least_confidence"], f"select coverage, count(*) as n, avg(cast((p >= 0.5) = (y >= 0.5) as int)) as accuracy, min(abs(p - 0.5)) as least_confidence from (select *, row_number() over (order by abs(p - 0.5) desc, key) as rn, count(*) over () as n from ({FC})) cross join (select unnest([0.2e0, 0.5e0, 1.0e0]) as coverage) where rn <= ceil(coverage * n) group by coverage")
add("m07_decile_returns", lambda s, d: dg.decile_returns(forecasts(s, d), "p", "value", "key"), ["bin", "count"], ["mean", "median", "std", "t_stat", "excess"], f"select bin, count(*) as count, avg(value) as mean, quantile_cont(value, 0.5) as median, stddev_samp(value) as std, avg(value) / (stddev_samp(value) / sqrt(count(*))) as t_stat, avg(value) - max(m) as excess from (select *, greatest(1, cast(ceil((rn - 1) * 10 / cast(n - 1 as double)) as int)) as bin from (select *, row_number() over (order by p, key) as rn, count(*) over () as n, avg(value) over () as m from ({FC}))) group by bin")
_cm = f"select count(*) filter (p >= 0.5 and y = 1) as tp, count(*) filter (p >= 0.5 and y = 0) as fp, count(*) filter (p < 0.5 and y = 1) as fn, count(*) filter (p < 0.5 and y = 0) as tn from ({FC})"
_curve = f"select sum(neg * (ctp - pos / 2.0e0)) / max(tpos * tneg) as roc_auc, sum(pos * ctp / (ctp + cfp)) / max(tpos) as average_precision from (select *, sum(pos) over (order by p desc rows unbounded preceding) as ctp, sum(neg) over (order by p desc rows unbounded preceding) as cfp, sum(pos) over () as tpos, sum(neg) over () as tneg from (select p, sum(y) as pos, sum(1 - y) as neg from ({FC}) group by p))"
_metrics = f"select *, (tp + tn) / (tp + fp + fn + tn) as accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 as balanced_accuracy, tp / (tp + fp) as precision, tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1, (cast(tp as double) * tn - cast(fp as double) * fn) / sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn)) as mcc from ({_cm}) cross join ({_curve})"
add("m09_m11_classification", lambda s, d: dg.classification_metrics(forecasts(s, d)), ["tp", "fp", "fn", "tn"], ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc", "roc_auc", "average_precision"], _metrics)
add("a03_fold_metrics", lambda s, d: dg.fold_metrics(forecasts(s, d).withColumn("fold", F.year("date"))), ["fold", "n"], ["rate", "accuracy", "precision", "recall", "brier", "log_loss"], f"select year(date) as fold, count(*) as n, avg(y) as rate, avg(cast((p >= 0.5) = (y >= 0.5) as int)) as accuracy, coalesce(count(*) filter (p >= 0.5 and y = 1) / nullif(count(*) filter (p >= 0.5), 0), 0) as precision, coalesce(count(*) filter (p >= 0.5 and y = 1) / nullif(count(*) filter (y = 1), 0), 0) as recall, avg((p - y) * (p - y)) as brier, avg(-(y * ln({_q}) + (1 - y) * ln(1 - {_q}))) as log_loss from ({FC}) group by 1")
add("m10_regression", lambda s, d: dg.regression_metrics(forecasts(s, d).withColumn("guess", F.col("p") * 4e5), "value", "guess"), [], ["rmse", "mae", "r2", "directional_accuracy"], f"select sqrt(avg(pow(value - p * 4e5, 2))) as rmse, avg(abs(value - p * 4e5)) as mae, 1 - sum(pow(value - p * 4e5, 2)) / (var_pop(value) * count(*)) as r2, avg(cast(sign(value) = sign(p * 4e5) as int)) as directional_accuracy from ({FC})")
add("m12_interval_diagnostics", lambda s, d: dg.interval_diagnostics(forecasts(s, d).withColumns({"mean": F.col("p"), "variance": F.lit(0.2) + F.col("p") / 10})), [], ["coverage", "width", "mean_miss", "std_miss", "nls"], f"select avg(cast(abs(m) <= 1.959963984540054e0 as int)) as coverage, avg(2 * 1.959963984540054e0 * sqrt(v)) as width, avg(m) as mean_miss, stddev_samp(m) as std_miss, avg(0.5e0 * (ln(2 * pi() * v) + m * m)) as nls from (select (y - p) / sqrt(0.2e0 + p / 10) as m, 0.2e0 + p / 10 as v from ({FC}))")
QUERIES["m08_block_bootstrap"] = lambda s, d: dg.block_bootstrap(forecasts(s, d), {"s": F.sum("value"), "n": F.count("value")}, lambda t: t["s"] / t["n"], draws=100)
UNIVERSE = ["R0", "R1", "R2", "R3", "R4"]
_bd_of = "(cast(floor(date_diff('day', date '1900-01-01', {0}) / 7.0e0) as int) * 5 + least(date_diff('day', date '1900-01-01', {0}) % 7, 5))"
_gap = f"{_bd_of.format('date')} - {_bd_of.format('b')}"
_qr = f"select count(*) as n, count(*) filter (date is null) as nd, count(*) filter (k > 1) as rp, max(coalesce({_gap}, 0)) as gap, sum(cast(close is null as int) + cast(volume is null as int)) as ms, 5 - count(distinct ticker) as ab from (select *, lag(date) over (partition by ticker order by date) as b, count(*) over (partition by date, ticker) as k from ({P.REGION_SQL}))"
add("m14_quality_report", lambda s, d: dg.quality_report(P.region_day(s, d), ["date", "ticker", "close", "volume"], UNIVERSE), ["code", "passed"], ["observed"], f"select code, passed, cast(observed as double) as observed from (select unnest([{{'code': 'schema.required', 'passed': true, 'observed': 0.0e0}}, {{'code': 'rows.non_empty', 'passed': n > 0, 'observed': n}}, {{'code': 'dates.valid', 'passed': nd = 0, 'observed': nd}}, {{'code': 'universe.complete', 'passed': ab = 0, 'observed': ab}}, {{'code': 'keys.unique', 'passed': rp = 0, 'observed': rp}}, {{'code': 'missing.fraction', 'passed': ms / (n * 2) <= 0.05, 'observed': ms / (n * 2)}}, {{'code': 'gap.business_days', 'passed': gap <= 5, 'observed': gap}}, {{'code': 'staleness', 'passed': true, 'observed': 0}}], recursive := true) from ({_qr}))")


def _drift(s: SparkSession, d: str) -> DataFrame:
    f = forecasts(s, d)
    return dg.drift(f.where("key % 2 = 0"), f.where("key % 2 = 1"), "value")


_two = f"select value as x, cast(key % 2 = 0 as int) as r from ({FC})"
_ks = f"select max(abs(ca / na - cb / nb)) as ks, max(na) as n_reference, max(nb) as n_current from (select sum(a) over z as ca, sum(b) over z as cb, sum(a) over () as na, sum(b) over () as nb from (select x, sum(r) as a, sum(1 - r) as b from ({_two}) group by x) window z as (order by x rows unbounded preceding))"
_psi = f"select sum((pb - pa) * ln(pb / pa)) as psi from (select greatest(a / sum(a) over (), 1e-8) as pa, greatest(b / sum(b) over (), 1e-8) as pb from (select len(list_filter((select list_sort(list_distinct(quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) from ({_two}) where r = 1), lambda e: e < x)) as bin, sum(r) as a, sum(1 - r) as b from ({_two}) group by 1))"
add("m15_distribution_drift", _drift, ["n_reference", "n_current", "enough"], ["ks", "psi"], f"select *, n_reference >= 20 and n_current >= 20 as enough from ({_ks}) cross join ({_psi})")

# validation
_dirty = "select case when o_orderkey % 7 = 0 then 'n/a' else cast(o_totalprice as varchar) end as close, ' T' || cast(o_custkey % 3 as varchar) || ' ' as ticker, cast(cast(o_orderdate as date) as varchar) as date from orders"


def _coerced(s: SparkSession, d: str) -> DataFrame:
    o = P.table(s, d, "orders")
    raw = o.select(F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("close"), F.concat(F.lit(" T"), (F.col("o_custkey") % 3).cast("string"), F.lit(" ")).alias("ticker"), F.to_date("o_orderdate").cast("string").alias("date"))
    return va.coerce_panel(raw).groupBy("date", "ticker").agg(F.count("close").alias("n"), F.max("close").alias("close"))


add("p01_coercion", _coerced, ["date", "ticker", "n"], ["close"], f"select cast(date as date) as date, trim(ticker) as ticker, count(try_cast(close as double)) as n, max(try_cast(close as double)) as close from ({_dirty}) group by 1, 2")
add("p02_clip_dates", lambda s, d: va.clip_dates(P.region_day(s, d), "1996-01-01", "1996-03-31"), ["date", "ticker"], ["close"], f"select * from ({P.REGION_SQL}) where close is not null and date between date '1996-01-01' and date '1996-03-31'")
add("p03_validation_report", lambda s, d: va.panel_report(P.region_day(s, d)), ["ticker", "n_rows", "repeated_keys", "non_positive", "high_below_low", "negative_volume", "missing", "few_rows", "ok"], [], f"select ticker, count(*) as n_rows, count(*) filter (k > 1) as repeated_keys, count(*) filter (least(open, high, low, close) <= 0) as non_positive, count(*) filter (high < low) as high_below_low, count(*) filter (volume < 0) as negative_volume, 0 as missing, count(*) < 100 as few_rows, count(*) filter (k > 1) = 0 and count(*) filter (least(open, high, low, close) <= 0) = 0 and count(*) filter (high < low) = 0 as ok from (select *, count(*) over (partition by date, ticker) as k from ({P.REGION_SQL})) group by ticker")
add("p04_lookahead", lambda s, d: va.lookahead(P.with_returns(P.region_day(s, d)), "ret", "lret"), ["identical", "leaks"], ["correlation"], f"select bool_and(ret is not distinct from lret) as identical, corr(ret, lret) as correlation, bool_and(ret is not distinct from lret) or abs(corr(ret, lret)) > 0.999 as leaks from ({P.returns_sql(P.REGION_SQL)})")


def _holes(s: SparkSession, d: str) -> DataFrame:
    hole = F.when(F.col("volume") % 7 == 0, float("nan")).when(F.col("volume") % 7 == 1, float("-inf"))
    return P.with_returns(P.region_day(s, d)).withColumn("ret", hole.otherwise(F.col("ret")))


add("p08_scrub_dropna", lambda s, d: scrub(_holes(s, d), ["ret", "lret"]).dropna(subset=["ret", "lret"]), ["date", "ticker"], ["ret"], f"select * from ({P.returns_sql(P.REGION_SQL)}) where ret is not null and lret is not null and volume % 7 not in (0, 1)")


# versioned records: each event is a revision of its user's record
def records(s: SparkSession, d: str) -> DataFrame:
    e = P.table(s, d, "events")
    ts = F.col("ts")
    return e.select(
        F.col("user_id").alias("identity"), "event_type", "value", "event_id", ts.alias("effective_at"), (ts + F.expr("make_interval(0, 0, 0, 0, event_id % 48)")).alias("available_at"), (ts + F.expr("make_interval(0, 0, 0, 0, event_id % 48 + event_id % 5)")).alias("observed_at"),
    )


REC = "select user_id as identity, event_type, value, event_id, ts as effective_at, ts + to_hours(event_id % 48) as available_at, ts + to_hours(event_id % 48 + event_id % 5) as observed_at from events"
_AT = "(select min(ts) + to_hours(360) from events)"


def _instant(s: SparkSession, d: str) -> datetime:
    first = P.table(s, d, "events").agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("t")).first()["t"]
    return datetime.fromtimestamp(first / 1e6 + 360 * 3600, tz=timezone.utc)


add("p06_record_checks", lambda s, d: bi.violations(records(s, d), ["identity"], ["event_type"], {"negative_value": F.col("value") >= 0}, prices=True), ["missing_effective_at", "observed_before_available", "available_before_effective", "empty_event_type", "negative_value", "repeated_revision"], [], f"select count(*) filter (effective_at is null) as missing_effective_at, count(*) filter (observed_at < available_at) as observed_before_available, count(*) filter (available_at < effective_at) as available_before_effective, count(*) filter (coalesce(trim(event_type), '') = '') as empty_event_type, count(*) filter (value < 0) as negative_value, count(*) - count(distinct (identity, available_at)) as repeated_revision from ({REC})")
add("p07_as_of_predicate", lambda s, d: bi.visible(records(s, d), _instant(s, d)).groupBy("event_type").agg(F.count("*").alias("n")), ["event_type", "n"], [], f"select event_type, count(*) as n from ({REC}) where available_at <= {_AT} and effective_at <= {_AT} group by 1")
add("j09_latest_visible_revision", lambda s, d: bi.as_of(records(s, d), _instant(s, d), ["identity"]), ["identity", "event_id", "event_type"], ["value"], f"select identity, event_id, event_type, value from (select *, row_number() over (partition by identity order by available_at desc, observed_at desc, event_id desc) as rn from ({REC}) where available_at <= {_AT} and effective_at <= {_AT}) where rn = 1")
