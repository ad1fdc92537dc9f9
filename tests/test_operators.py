"""Operators on small inputs with known answers."""

from datetime import date, datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions.nulls import scrub
from marlstone.functions.trail import Trail
from marlstone.operators import backtest, bitemporal, contracts, decomposition, diagnostics, graphs, models, recursive, spectral, validation
from marlstone.operators import technical as te
from marlstone.sources import backfill, bundle, canonical, store, tracker, vendors
from marlstone.streaming import updates


@pytest.fixture(scope="module")
def panel(spark):
    return vendors.synthetic_panel(spark, ["AAA", "BBB", "SPY"], 300).persist()


def test_scrub_turns_nan_and_infinity_to_null(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert scrub(d).agg(F.count("x")).first()[0] == 1


def test_windows_equal_pandas(panel):
    t = Trail(panel)
    c = F.col("close")
    got = t.put(m=te.moving_average(t, c, 20), z=te.zscore(t, c, 21), **recursive.on(t, lambda p: {"d": recursive.rolling_max_drawdown(p["close"].to_numpy(float), 30)}, ["d"])).result().toPandas().sort_values(["ticker", "date"])
    for _, g in got.groupby("ticker"):
        x = g.close
        assert np.allclose(g.m, x.rolling(20, min_periods=10).mean(), equal_nan=True)
        assert np.allclose(g.z, (x - x.rolling(21, min_periods=10).mean()) / x.rolling(21, min_periods=10).std(), equal_nan=True)
        want = x.rolling(30, min_periods=15).apply(lambda v: (v / np.maximum.accumulate(v) - 1).min(), raw=True)
        assert np.allclose(g.d, want, equal_nan=True)


def test_features_do_not_look_ahead(panel):
    names = ["mom_63", "ma_dist_20", "skew_63", "hurst_128", "ema_dist_12", "corwin_schultz_21"]
    cut = "2018-12-01"
    a = contracts.build(panel, names).where(F.col("date") < cut).toPandas()
    b = contracts.build(panel.where(F.col("date") < cut), names).toPandas()
    key = ["ticker", "date"]
    pd.testing.assert_frame_equal(a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True))


def test_contracts_stay_in_range(panel):
    names = ["cs_rank_mom_63", "autocorr_1_63", "parkinson_vol_21", "volume_imbalance_21", "mutual_info_mkt_63"]
    assert all(r["outside"] == 0 for r in contracts.violations(contracts.build(panel, names)).collect())
    with pytest.raises(ValueError, match="lacks"):
        contracts.build(panel.drop("volume"), ["rel_volume_21"])


def test_ewm_equals_pandas():
    x = np.array([np.nan, 1.0, 2.0, np.nan, np.nan, 5.0, 4.0])
    want = pd.Series(x).ewm(alpha=0.3, adjust=False, min_periods=2).mean()
    assert np.allclose(recursive.ewm(x, 0.3, 2), want, equal_nan=True)


def test_kalman_tracks_a_level():
    x = np.random.default_rng(0).normal(3, 0.1, 500)
    assert abs(recursive.local_level(x, 1e-6, 0.01)["filtered"][-1] - 3) < 0.05
    with pytest.raises(ValueError, match="below one"):
        recursive.garch_variance(x, 0.1, 0.5, 0.6)


def test_spectrum_of_a_tone():
    x = np.sin(2 * np.pi * np.arange(256) / 8)
    f = spectral.frequencies(64)
    d = spectral.descriptors(spectral.welch(x[None], 64, 16), f)
    assert abs(d["peak_frequency"][0] - 0.125) < 1e-9 and d["entropy"][0] < 0.4 and abs(sum(d[f"band_{b[0]}"][0] for b in spectral.BANDS) - 1) < 1e-9
    e = spectral.dwt_energies(np.random.default_rng(1).normal(size=(3, 64)), 3, "db2")
    assert np.allclose(e.sum(1), 1)


@pytest.mark.parametrize("method", ["emd", "eemd", "ceemdan", "vmd"])
def test_modes_add_up(method):
    t = np.arange(200)
    x = np.sin(2 * np.pi * t / 8) + np.sin(2 * np.pi * t / 40) + 0.01 * t
    m = decomposition.METHODS[method](x, **({"members": 4} if "e" in method and method != "emd" and method != "vmd" else {}))
    assert m.error(x) < 1e-9 and len(m.modes) >= 2


def test_backtest_lags_two_rows(spark):
    days = [date(2024, 1, d) for d in range(1, 7)]
    r = spark.createDataFrame([(d, "A", x) for d, x in zip(days, [0.0, 0.01, 0.03, -0.02, 0.04, 0.01], strict=True)], "date date, ticker string, ret double")
    s = spark.createDataFrame([(d, "A", 1.0) for d in days[:4]], "date date, ticker string, score double")
    p = backtest.Policy(two_sided=False, cost_bps=0.0)
    got = backtest.daily(backtest.held_weights(s, r, p), r, p).orderBy("date").toPandas()
    assert got.date.iloc[0] == days[2] and got.gross.iloc[0] == pytest.approx(0.03)
    gap = r.where(F.col("date") != F.lit(days[3]))
    with pytest.raises(Exception, match="no return"):
        backtest.daily(backtest.held_weights(s, r, p), gap, p).collect()


def test_business_days(spark):
    d = spark.createDataFrame([(date(2024, 1, 5), date(2024, 1, 8)), (date(2024, 1, 1), date(2024, 2, 1))], "a date, b date")
    got = [r[0] for r in d.select(diagnostics.business_days(F.col("a"), F.col("b"))).collect()]
    assert got == [np.busday_count("2024-01-05", "2024-01-08"), np.busday_count("2024-01-01", "2024-02-01")]


def test_as_of_gives_the_revision_known_then(spark):
    t = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    rows = [("u", t(1), t(2), t(2), True), ("u", t(1), t(5), t(5), False)]
    d = spark.createDataFrame(rows, "id string, effective_at timestamp, available_at timestamp, observed_at timestamp, is_member boolean")
    assert bitemporal.as_of(d, t(3), ["id"]).first()["is_member"] is True and bitemporal.as_of(d, t(6), ["id"]).first()["is_member"] is False
    with pytest.raises(ValueError, match="time zone"):
        bitemporal.visible(d, datetime(2024, 1, 3))


def test_validation_finds_faults(spark):
    rows = [(date(2024, 1, 1), "A", 1.0, 2.0, 3.0, 1.0, 5.0), (date(2024, 1, 1), "A", 1.0, 2.0, 0.5, 0.0, -1.0)]
    d = spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double")
    r = validation.panel_report(d).first()
    assert (r["repeated_keys"], r["non_positive"], r["high_below_low"], r["negative_volume"], r["ok"]) == (2, 1, 1, 1, False)


def test_store_is_immutable_and_filters(spark, panel, tmp_path):
    s = store.FeatureStore(spark, str(tmp_path / "store"))
    req = store.Request("close", ("close",), ("AAA", "BBB", "SPY"))
    m = s.materialize(panel, req)
    assert s.materialize(panel, req)["object"] == m["object"] and s.validate(m["object"]) and s.lookup(req)["rows"] == 900
    assert s.read(m["object"], "2018-03-01", "2018-03-31", ["aaa"]).count() == 22
    with pytest.raises(store.StoreError, match="other content"):
        s.materialize(panel.withColumn("close", F.col("close") * 2), req)
    with pytest.raises(store.StoreError, match="quality"):
        s.materialize(panel, store.Request("more", ("close",), ("AAA", "ZZZ")))
    with pytest.raises(Exception, match="more rows"):
        s.read(m["object"], most=5).collect()
    with pytest.raises(store.StoreError, match="before it is applied"):
        store.Request("x", ("close",), ("A",), fit_end="2020-01-02", application_start="2020-01-01")


def test_content_hash_ignores_order_only(panel):
    a = canonical.content_hash(panel)
    assert a == canonical.content_hash(panel.repartition(7)) != canonical.content_hash(panel.limit(899))


def test_backfill_resumes_and_equals_one_pass(spark, panel, tmp_path):
    plan, calls = backfill.parts(date(2018, 1, 1), date(2018, 6, 30), "month"), []

    def load(part):
        calls.append(part.key)
        if len(calls) == 3:
            raise RuntimeError("stop")
        return panel.select("date", "ticker", "close")

    job = backfill.Backfill(spark, str(tmp_path), "job", plan)
    with pytest.raises(RuntimeError, match="stop"):
        job.run(load, 1)
    assert "failed" in job.status().values()
    assert job.run(load, 1).count() == panel.where(F.col("date") <= "2018-06-30").count() and len(calls) == 7
    with pytest.raises(RuntimeError, match="missing"):
        backfill.Backfill(spark, str(tmp_path), "other", plan).assemble()


def test_bundle_detects_changes(spark, tmp_path):
    t = datetime(2024, 1, 2, tzinfo=timezone.utc)
    d = spark.createDataFrame([("i", date(2024, 1, 1), "A", "s", t, t, t)], "instrument_id string, date date, ticker string, source string, effective_at timestamp, available_at timestamp, observed_at timestamp")
    made = bundle.export(spark, str(tmp_path), {"prices": d}, {"name": "x"})
    assert bundle.export(spark, str(tmp_path), {"prices": d}, {"name": "x"}) == made and bundle.validate(spark, str(tmp_path), made)
    (tmp_path / made / "extra.txt").write_text("x")
    with pytest.raises(bundle.BundleError, match="undeclared"):
        bundle.validate(spark, str(tmp_path), made)
    bad = d.withColumn("observed_at", F.col("available_at") - F.expr("interval 1 hour"))
    with pytest.raises(bundle.BundleError, match="observed_before"):
        bundle.export(spark, str(tmp_path), {"prices": bad}, {})


def test_sources_fail_closed(spark):
    waits = []
    with pytest.raises(vendors.SourceError, match="key=\\*\\*\\*"):
        vendors.retry(lambda: (_ for _ in ()).throw(OSError("http://x?api_key=abc")), 3, 1.0, "s", waits.append)
    assert waits == [1.0, 2.0]
    with pytest.raises(vendors.SourceError, match="budget"):
        vendors.Budget(most=0).take()
    with pytest.raises(vendors.SourceError):
        vendors.dispatch(["synthetic"], {"synthetic": lambda: None})
    d = vendors.fetch_csv(spark, ["A"], lambda t: "Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,1,2,10\n")
    assert d.first()["adj_close"] == "2"


def test_graph_weights_sum_to_one(spark, panel):
    r = Trail(panel).put(ret=F.log("close") - F.log(F.lag("close").over(Trail(panel).rows))).result()
    as_of = spark.createDataFrame([(date(2018, 9, 3),)], "as_of date")
    e = graphs.edges(graphs.window_before(r, as_of, 100), threshold=0.0, degree=1).toPandas()
    assert len(e) == 3 and np.allclose(e.groupby("src").weight.sum(), 1)
    cov, rate = graphs.oas(50, np.diag([1.0, 2.0, 3.0]))
    assert 0 <= rate <= 1 and np.isclose(np.trace(cov), 6)


def test_readiness_needs_all():
    limits = {"sharpe": (">=", 1.0), "drawdown": ("<=", 0.2)}
    assert models.readiness({"sharpe": 1.2, "drawdown": 0.1}, limits)[0]
    assert not models.readiness({"sharpe": float("nan"), "drawdown": 0.1}, limits)[0] and not models.readiness({}, {})[0]


def test_chains_agree():
    x = np.random.default_rng(0).normal(size=(4, 500))
    assert abs(models.split_r_hat(x) - 1) < 0.05 and models.effective_sample_size(x) > 200


def test_trackers(spark, tmp_path):
    run = tracker.Run("a", {"x": {"y": 1}}, {"m": 0.5})
    db = tracker.SqliteTracker(str(tmp_path / "runs.db"))
    db.log(run)
    j = tracker.JsonTracker(spark, str(tmp_path / "runs"))
    j.log(run)
    assert db.runs()[0][0] == j.runs().first()["run_id"] == run.run_id and '"x": {"y": 1}' in j.runs().first()["params"]


def test_streamed_average_carries_state(spark, tmp_path):
    rows = [(date(2024, 1, d), "A", float(d)) for d in range(1, 5)]
    for i in range(0, 4, 2):
        spark.createDataFrame(rows[i : i + 2], "date date, ticker string, close double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("date date, ticker string, close double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = updates.ewm(s, 0.5).writeStream.format("memory").queryName("ewm_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r["ewm"] for r in spark.table("ewm_out").orderBy("date").collect()]
    assert np.allclose(got, recursive.ewm(np.arange(1.0, 5.0), 0.5))
