"""Models, the whole run, stores and sources on small inputs with known answers."""

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone import cli, flow, report
from marlstone.functions import shared
from marlstone.operators import contracts, decomposition, diagnostics, features, graphs, models, recursive, sequence_net, spectral
from marlstone.plans import panels
from marlstone.sources import catalog, store, tensor_store, tracker, vendors


@pytest.fixture(scope="module")
def panel(spark):
    return shared.written(panels.with_market(panels.with_returns(vendors.synthetic_panel(spark, ["AAA", "BBB", "CCC", "SPY"], 700))), "panel")


# helpers
def test_numbers_running_sums_and_grids(spark):
    rng = np.random.default_rng(0)
    x = rng.permutation(500)
    d = spark.createDataFrame([(int(v), int(v) % 7) for v in x], "x int, y int").repartition(5)
    got = shared.numbered(d, "y", "x").toPandas().sort_values("rank")
    assert got["rank"].tolist() == list(range(500)) and got[["y", "x"]].values.tolist() == sorted(got[["y", "x"]].values.tolist())
    run = shared.running(d, "x", ["y"]).toPandas().sort_values("x")
    assert run.run_y.tolist() == np.cumsum(np.arange(500) % 7).tolist()
    grid = shared.calendar_grid(spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 2),)], "date date"), spark.createDataFrame([("a",), ("b",), ("a",)], "ticker string"))
    assert grid.count() == 4 and "Cartesian" not in grid._jdf.queryExecution().toString()
    assert shared.numbered(d.limit(0), "x").count() == 0 and shared.running(d.limit(0), "x", ["y"]).count() == 0


# hierarchical returns
def test_hierarchical_returns(spark):
    rng = np.random.default_rng(1)
    truth = {f"T{i}": 0.001 * i for i in range(6)}
    rows = [(t, date(2020, 1, 1) + pd.Timedelta(days=k), float(r)) for t, m in truth.items() for k, r in enumerate(m + 0.01 * rng.standard_t(5, 600))]
    returns = spark.createDataFrame(rows, "ticker string, date date, ret double")
    post = shared.written(models.gibbs(spark, returns, 150, 80), "post")
    p = post.toPandas()
    assert len(p) == 6 * 2 * 150
    means = p.groupby("asset").mu.mean()
    own = returns.toPandas().groupby("ticker").ret.mean()
    assert (abs(means - own) < 0.0012).all() and means.std() <= own.std() * 1.05 and p.nu.between(3, 10).mean() > 0.8
    assert abs(p.groupby("asset").sigma.mean() - 0.01).max() < 0.002
    again = models.gibbs(spark, returns.repartition(3), 150, 80).toPandas()
    pd.testing.assert_frame_equal(p.sort_values(["asset", "chain", "draw"]).reset_index(drop=True), again.sort_values(["asset", "chain", "draw"]).reset_index(drop=True))
    x = p[p.asset == "T3"].sort_values(["chain", "draw"]).mu.to_numpy().reshape(2, -1)
    assert models.split_r_hat(x) < 1.1
    checks = models.posterior_checks(post, returns).toPandas()
    assert len(checks) == 30 and checks[checks.statistic == "mean"].p.between(0.02, 0.98).all()
    shrunk = models.shrinkage(post, returns).toPandas()
    assert (shrunk.n == 600).all() and shrunk.shrinkage.between(-1, 1).all()
    few = returns.where("date < date'2020-02-10'")  # forty returns an asset: noise beyond the means' spread
    assert models.shrinkage(models.gibbs(spark, few, 150, 80), few).toPandas().shrinkage.median() > 0.2
    draws = models.predictive(post, 5).toPandas()
    assert len(draws) == len(p) and abs(draws.groupby("asset").ret.mean() - 5 * means).max() < 0.01
    density = models.log_predictive_density(post, returns).toPandas()
    assert (density.lpd > 2.5).all()


def test_scenarios_keep_the_correlation(spark):
    post = pd.DataFrame({"chain": 0, "draw": 0, "asset": ["a", "b"], "mu": 0.0, "sigma": 0.01, "nu": 30.0})
    x = models.scenarios(spark, post, np.array([[1.0, 0.8], [0.8, 1.0]]), 3000).toPandas().pivot(index="scenario", columns="asset", values="ret")
    assert abs(x.corr().iloc[0, 1] - 0.8) < 0.05


# ensembles
def labelled(spark, n=400, flat=False):
    rng = np.random.default_rng(2)
    x = rng.normal(size=n)
    y = (x + 0.7 * rng.normal(size=n) > 0).astype(float) * (not flat)
    return spark.createDataFrame([(date(2020, 1, 1) + pd.Timedelta(days=i // 2), "A" if i % 2 else "B", float(a), float(rng.normal()), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "date date, ticker string, f_a double, f_b double, target_direction double")


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_calibrated_ensembles(spark, method, tmp_path):
    rows = shared.written(labelled(spark), "rows")
    e = models.fit_ensemble(rows, ["f_a", "f_b"], ["logistic", "ridge"], method=method)
    got = e.score(rows).toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.target_direction == 1)).mean() > 0.7 and abs(sum(e.weights.values()) - 1) < 1e-9
    for k in e.models:  # calibration keeps the order
        p = models.probability(e.models[k], rows).toPandas().p.to_numpy()
        assert (np.diff(got[f"candidate_{k}"].to_numpy()[np.argsort(p, kind="stable")]) >= -1e-9).all()
    share = models.importances(e, ["f_a", "f_b"])
    assert abs(sum(share.values()) - 1) < 1e-9 and share["f_a"] > 0.7
    models.save(e, str(tmp_path / "model"), ["f_a", "f_b"])
    back, names = models.load(str(tmp_path / "model"))
    assert names == ["f_a", "f_b"] and np.allclose(back.score(rows).toPandas().sort_values(["date", "ticker"]).score, got.sort_values(["date", "ticker"]).score)


def test_one_label_gives_a_constant(spark):
    e = models.fit_ensemble(labelled(spark, flat=True), ["f_a"], ["logistic"])
    assert not e.models and e.score(labelled(spark)).select("score").distinct().first()[0] == pytest.approx(1 / 402)
    with pytest.raises(ValueError, match="no estimator"):
        models.estimator("tcn", ["f_a"])


# the sequence network
def test_sequence_network_gradient():
    shape = sequence_net.Shape(3, 9, 4, (1, 2))
    rng = np.random.default_rng(0)
    net, x, y = sequence_net.Net(shape), rng.normal(size=(5, 9, 3)), rng.integers(0, 2, 5).astype(float)

    def loss(flat, x):
        p, _ = sequence_net.Net(shape, flat).forward(x)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    p, kept = net.forward(x)
    g, by_input = net.backward(x, p - y, kept)
    for i in range(0, len(g), 3):
        e = np.zeros_like(g)
        e[i] = 1e-6
        assert abs((loss(net.flat + e, x) - loss(net.flat - e, x)) / 2e-6 - g[i]) < 1e-5
    for n, t, k in ((0, 8, 0), (3, 5, 2), (4, 6, 1)):
        e = np.zeros_like(x)
        e[n, t, k] = 1e-6
        assert abs((loss(net.flat, x + e) - loss(net.flat, x - e)) / 2e-6 - by_input[n, t, k]) < 1e-5
    later = x.copy()
    later[:, -1] += 1
    assert np.allclose(net.forward(x)[1][0][0][:, :-1], net.forward(later)[1][0][0][:, :-1])  # causal


def test_sequence_network_learns_and_ignores_partitions(spark):
    rng = np.random.default_rng(1)
    rows = []
    for t in "AB":
        x = rng.normal(size=(700, 2))
        y = (x[:, 0] + np.r_[0, 0, x[:-2, 0]] > 0).astype(float)  # this bar's and the one two before
        rows += [(date(2015, 1, 1) + pd.Timedelta(days=i), t, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    d = sequence_net.with_sequences(spark.createDataFrame(rows, "date date, ticker string, f_a double, f_b double, y double"), ["f_a", "f_b"], 8)
    assert d.count() == 2 * 693
    shape = sequence_net.Shape(2, 8, 8, (1, 2), rate=0.02, batch=64, rounds=6, part_rows=400)
    net = sequence_net.fit(d.where("date < date'2016-06-01'"), ["f_a", "f_b"], "y", shape)
    got = net.score(d.where("date >= date'2016-06-01'")).toPandas()
    assert ((got.score >= 0.5) == (got.y == 1)).mean() > 0.85 and "sequence" not in got
    share = {r["feature"]: r["importance"] for r in net.importances(d).collect()}
    assert share["f_a"] > 0.7 and abs(sum(share.values()) - 1) < 1e-9
    again = sequence_net.fit(d.where("date < date'2016-06-01'").repartition(5), ["f_a", "f_b"], "y", shape)
    assert np.allclose(again.flat, net.flat) and again.rounds == net.rounds


# the whole run
def test_flow_from_panel_to_report(spark, panel, tmp_path):
    s = flow.settings({"name": "t", "signal": "model", "benchmark": "SPY", "model": {"kinds": ["logistic"], "folds": 2, "test": 60, "least": 100}, "policy": {"quantile": 0.5}, "costs": [0, 10]})
    r = flow.run(spark, panel, s, str(tmp_path / "runs"))
    days = r.days.toPandas()
    assert 100 <= len(days) <= 120 and np.allclose(days.net, days.gross - days.turnover * 5e-4)
    text = r.report("t")
    page = report.to_html(text)
    assert page.count("<svg") == 2 and "<th>sharpe</th>" in page and "<h2>Costs</h2>" in page and "|" not in page.split("<table>")[1].split("</table>")[0]
    assert "## Performance" in text and "## Importances" in text and r.costs.count() == 2
    assert tracker.JsonTracker(spark, str(tmp_path / "runs")).runs().first()["name"] == "t"
    held = r.held.groupBy("date").agg(F.sum("weight").alias("w"), F.sum(F.abs("weight")).alias("g")).toPandas()
    assert held.w.abs().max() < 1e-9 and held.g.max() <= 1 + 1e-9
    for name in ("momentum", "crossover", "reversion"):
        assert flow.scores(panel, flow.settings({"signal": name}))[0].where("score is not null").count() > 0
    with pytest.raises(ValueError, match="unknown settings"):
        flow.settings({"policy": {"quantil": 1}})
    with pytest.raises(ValueError, match="no signal"):
        flow.scores(panel, flow.settings({"signal": "x"}))


def test_bootstrap_of_any_statistic(spark):
    x = np.random.default_rng(8).normal(1.0, 0.5, 400)
    d = spark.createDataFrame([(date(2020, 1, 1) + pd.Timedelta(days=i), float(v)) for i, v in enumerate(x)], "date date, x double")
    r = diagnostics.series_bootstrap(d, "x", np.median, draws=100).first()
    assert r["point"] == pytest.approx(np.median(x)) and r["low"] < r["point"] < r["high"] < r["low"] + 0.3 and r["draws"] == 100
    with pytest.raises(ValueError, match="one row a date"):
        diagnostics.series_bootstrap(d.union(d), "x", np.mean)
    w = models.policies(np.array([0.1, 0.0]), np.eye(2), np.random.default_rng(1).normal(size=(50, 2)), more={"first": lambda m, c, s: np.array([1.0, 0.0])})
    assert set(w) == {"first", "equal", "mean_variance", "inverse_vol", "robust_cvar"} and w["first"][0] == pytest.approx(0.5)


def test_figures_and_cells(spark):
    d = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0), (4, 5.0)], "x int, y double")
    svg = report.figure(d, "x", ["y"], "a <b>")
    assert svg.count("M") == 2 and svg.count("L") == 1 and "a &lt;b&gt;" in svg
    with pytest.raises(ValueError, match="more than 3"):
        report.figure(d, "x", ["y"], most=3)
    t = spark.createDataFrame([("a|b", 1.5)], "name string, v double")
    assert "<td>a|b</td><td>1.5</td>" in report.to_html(report.report("T", [("S", t), ("Text", "some <words>")])) and report.figure(d.limit(0), "x", ["y"]).startswith("<svg")


def test_commands_parse():
    p = cli.parser()
    assert p.parse_args(["run-full-pipeline", "a"]).panel == "a" and p.parse_args(["train-model", "a", "b"]).out == "b"
    assert p.parse_args(["backfill-features", "a", "b", "2020-01-01", "2020-12-31"]).end == "2020-12-31" and p.parse_args(["export-bundle", "a", "b", "c"]).name == "c"


def test_trackers_by_kind(spark, tmp_path):
    t = tracker.tracker("none", spark, "")
    t.log(tracker.Run("a"))
    assert t.runs() == [] and isinstance(tracker.tracker("json", spark, str(tmp_path)), tracker.JsonTracker)
    with pytest.raises(ValueError, match="no tracker"):
        tracker.tracker("x", spark, "")


# features
def test_registry_and_lineage(spark, panel):
    reg = features.registry(spark)
    made = features.build_features(panel)
    assert {r["name"] for r in reg.collect()} == set(features.feature_columns(made)) and reg.where("name = 'f_drawdown'").first()["lookback"] == features.WHOLE_PAST
    a = features.lineage(panel, ["f_ret_1d"], reg)
    assert a == features.lineage(panel.repartition(3), ["f_ret_1d"], reg) and a["columns"][0]["lookback"] == 1
    with pytest.raises(ValueError, match="not registered"):
        features.lineage(panel, ["f_x"], reg)


def test_joins_and_panel_checks(spark, panel):
    twice = panel.union(panel.limit(1))
    with pytest.raises(Exception, match="key twice"):
        features.one_to_one(panel, twice.select("date", "ticker", "ret"), ["date", "ticker"]).collect()
    assert features.one_to_one(panel.drop("ret"), panel.select("date", "ticker", "ret"), ["date", "ticker"]).count() == panel.count()
    for bad, what in ((twice, "repeated"), (panel.limit(0), "no rows"), (panel.withColumn("close", F.when(F.col("close") > 100, float("inf")).otherwise(F.col("close"))), "infinite")):
        with pytest.raises(ValueError, match=what):
            contracts.build(bad, ["mom_63"], deep=True)
    n = features.training_normaliser(panel, ["ret", "lret"], "2018-02-01", "2018-12-31")
    x = panel.where("date between date'2018-02-01' and date'2018-12-31'").toPandas()
    got = n.toPandas().set_index("column")
    assert np.isclose(got.loc["ret", "std"], x.ret.std(ddof=0)) and np.isclose(got.loc["lret", "mean"], x.lret.mean())
    assert features.normaliser_state(n, "a", "b") != features.normaliser_state(n, "a", "c")


# spectra
def test_transforms_equal_plain_loops():
    rng = np.random.default_rng(3)
    w = rng.normal(size=(4, 48)).cumsum(1)
    for name, want in (("hann", np.hanning), ("hamming", np.hamming), ("blackman", np.blackman)):
        assert np.allclose(spectral.taper(name, 17), want(17), atol=1e-12)
    t = np.arange(16)
    seg = spectral.segments(w, 16, 8)
    assert seg.shape == (4, 5, 16) and np.array_equal(seg[:, -1], w[:, -16:]) and np.array_equal(seg[:, 0], w[:, :16])
    got = spectral.stft(w, 16, 8)
    for i in range(4):
        for j in range(5):
            x = seg[i, j] - np.polyval(np.polyfit(t, seg[i, j], 1), t)
            x = x * np.hanning(16)
            for k in range(9):
                assert np.isclose(got[i, j, k], abs(sum(x[m] * np.exp(-2j * np.pi * k * m / 16) for m in range(16))), atol=1e-9)
    assert np.allclose(spectral.welch(w, 16, 8).sum(-1), (got**2 * np.r_[1, [2] * 7, 1]).sum(-1).mean(-1) / (np.hanning(16) ** 2).sum())
    m = got / got.sum(-1, keepdims=True)
    assert np.allclose(spectral.flux(got), [np.mean([np.sqrt(((m[i, j + 1] - m[i, j]) ** 2).sum()) for j in range(4)]) for i in range(4)])
    power = spectral.cwt_power(w, [4.0, 8.0])
    assert np.allclose(power[:, 1], [abs(sum(a * b for a, b in zip(row, spectral.morlet(8.0, 48), strict=True))) ** 2 for row in w])
    assert np.allclose(spectral.scale_frequencies([6.0 / (2 * np.pi)]), 1) and np.allclose(spectral.amplitude(w, "boxcar")[:, 0], abs(w.sum(1)))
    haar = spectral.dwt_energies(w[:, :8], 1)
    assert np.allclose(haar[:, 0], ((w[:, 0:8:2] - w[:, 1:8:2]) ** 2 / 2).sum(1) / (w[:, :8] ** 2).sum(1))
    d = spectral.digest(w)
    assert spectral.verify(w.copy(), d) and not spectral.verify(w + 1, d) and not spectral.verify(w.astype("f4"), d)


def test_tensors_channels_and_registry(spark, panel, tmp_path):
    got = spectral.tensor(panel, {"return": "ret"}, kind="scalogram").where("observed and ticker = 'AAA'").orderBy("date").first()
    x = panel.where("ticker = 'AAA' and ret is not null").orderBy("date").limit(64).toPandas().ret.to_numpy()
    surface = np.array(got["surface"])
    assert surface.shape == (8, 3) and np.allclose(surface[:, 2], spectral.cwt_power(spectral.detrend(x[None, 16:]), [2, 3, 4, 6, 8, 12, 16, 24])[0])
    assert np.allclose(surface[:, 0], spectral.cwt_power(spectral.detrend(x[None, :48]), [2, 3, 4, 6, 8, 12, 16, 24])[0])
    made = spectral.channels(panel, "SPY")
    assert made.where("ticker = 'SPY' and ch_residual is not null").count() == 0 and made.where("ticker = 'AAA' and ch_residual is not null").count() > 500
    with pytest.raises(ValueError, match="benchmark"):
        spectral.channels(panel, "ZZZ")
    cols = spectral.build_spectral(made, {c: f"ch_{c}" for c in spectral.CHANNELS}, wavelet=("return",)).columns
    assert {r["name"] for r in spectral.registry(spark, list(spectral.CHANNELS), ("return",)).collect()} == set(cols) - {"date", "ticker"}
    s = tensor_store.TensorStore(spark, str(tmp_path))
    t = spectral.tensor(panel, {"return": "ret"})
    name = s.write(t, {"n": 64})
    assert s.write(t.repartition(3), {"n": 64}) == name and s.names() == [name] and s.read(name).count() == panel.count()
    (next((tmp_path / "objects" / name).glob("*.parquet"))).unlink()
    with pytest.raises(tensor_store.TensorError, match="changed"):
        s.read(name)


def test_decompositions_tell_tones_apart():
    t = np.arange(400)
    fast, slow = np.sin(2 * np.pi * t / 10), np.sin(2 * np.pi * t / 60)
    for name, options in (("emd", {}), ("eemd", {"members": 8, "noise": 0.05}), ("ceemdan", {"members": 8, "noise": 0.05}), ("vmd", {"modes": 2})):
        m = decomposition.METHODS[name](fast + slow, **options)
        best = [max(abs(np.corrcoef(x[50:350], u[50:350])[0, 1]) for u in m.modes) for x in (fast, slow)]
        assert min(best) > 0.9, name
        d = decomposition.describe(m, fast + slow)
        assert 0 <= d["residual"] <= 1 and d["mode0_period"] < d["mode1_period"]
    z = decomposition.describe_raw(np.r_[np.zeros(50), np.ones(50)])
    assert abs(z["skew"]) < 1e-9 and z["ac1"] > 0.9


def test_dynamic_regression_equals_ridge_when_still():
    rng = np.random.default_rng(4)
    x = np.column_stack([np.ones(80), rng.normal(size=80)])
    y = x @ [0.5, 2.0] + 0.1 * rng.normal(size=80)
    k = recursive.dynamic_linear(y, x, 0.0, 0.01, prior_var=3.0)
    want = np.linalg.solve(x.T @ x / 0.01 + np.eye(2) / 3.0, x.T @ y / 0.01)
    assert np.allclose(k["coefficients"][-1], want, atol=1e-6)


def test_partial_correlations_and_messages(spark):
    c = np.array([[1, 0.5, 0.25], [0.5, 1, 0.5], [0.25, 0.5, 1.0]])
    got = {(r["src"], r["dst"]): r["corr"] for r in graphs.partial_correlations(spark, ["a", "b", "c"], c, 0.0).collect()}
    x = np.random.default_rng(5).multivariate_normal(np.zeros(3), c, 4000)
    days = [date(2000, 1, 1) + pd.Timedelta(days=i) for i in range(4000)]
    w = spark.createDataFrame([(date(2020, 1, 1), t, n, float(v)) for t, r in zip(days, x, strict=True) for n, v in zip("abc", r, strict=True)], "as_of date, date date, ticker string, ret double")
    e = {(r["src"], r["dst"]): r["weight"] for r in graphs.partial_edges(w, threshold=0.1).collect()}
    assert set(e) == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")} and e["a", "b"] == 1 and abs(e["b", "a"] - 0.5) < 0.05
    assert abs(got["a", "c"]) < 1e-9 and got["a", "b"] == pytest.approx(got["b", "a"]) and got["a", "b"] > 0.4


# stores and sources
def test_catalog_keeps_the_first_of_many_writers(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path))
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda i: c.insert("features", "k", {"name": "k", "version": str(i), "identity": "x"}), range(8)))
    assert len({json.dumps(r, sort_keys=True) for r, _ in won[4:]}) == 1 and c.rows("features").count() == 1
    with pytest.raises(catalog.CatalogError, match="lacks"):
        c.insert("features", "j", {"name": "j"})
    with pytest.raises(catalog.CatalogError, match="no such"):
        c.insert("features", "../j", {"name": "j", "version": "1", "identity": "x"})


def test_reads_verify_the_parts_they_open(spark, panel, tmp_path):
    s = store.FeatureStore(spark, str(tmp_path))
    m = s.materialize(panel, store.Request("close", ("close",), ("AAA", "BBB", "CCC", "SPY")))
    assert s.read(m["object"], "2019-02-01", "2019-02-28").count() == 80
    victim = next((tmp_path / "objects" / m["object"] / "part=2018").glob("*.parquet"))
    victim.unlink()
    assert s.read(m["object"], "2019-02-01", "2019-02-28").count() == 80
    with pytest.raises(store.StoreError, match="2018"):
        s.read(m["object"], "2018-02-01", "2019-02-28")


def test_vendor_answers(spark, tmp_path):
    asked, waits = [], []

    def transport(what, params):
        asked.append(what)
        if len(asked) == 1:
            return 429, b"", {"Retry-After": "7"}
        code = what.split("/")[1]
        return 200, json.dumps({"dataset": {"database_code": "DB", "dataset_code": code, "column_names": ["Date", "Adj. Close"], "data": [["2024-01-02", 5]]}}).encode(), {}

    budget = vendors.Budget(sleep=waits.append)
    got = vendors.fetch_series(spark, str(tmp_path), "DB", ["A"], transport, budget=budget, suffix="_UADJ")
    assert waits == [7.0] and asked == ["DB/A_UADJ"] * 2 and got.first().asDict() == {"ticker": "A", "date": "2024-01-02", "adj_close": "5"}
    with pytest.raises(vendors.SourceError, match="answer is of"):
        vendors.fetch_series(spark, str(tmp_path / "b"), "DX", ["A"], transport)
    with pytest.raises(vendors.SourceError, match="bytes"):
        vendors._answer(lambda w, p: (200, b"x" * 20, {}), "t", {}, vendors.Budget(), 10)
    bars = spark.createDataFrame([("2024-01-02", "A", "1", "2", "1", "2", "2", "5")] * 2, "date string, ticker string, open string, high string, low string, close string, adj_close string, volume string")
    at = datetime(2024, 1, 9, tzinfo=timezone.utc)
    assert vendors.normalise(bars.limit(1), retrieved_at=at).first()["observed_at"].replace(tzinfo=timezone.utc) == at
    with pytest.raises(Exception, match="twice"):
        vendors.normalise(bars).collect()
