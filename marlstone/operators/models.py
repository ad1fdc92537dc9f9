"""Models on features: estimators, calibrated ensemble, walk-forward, hierarchical returns, scenarios."""

from __future__ import annotations

import json
import math
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.shared import written

LABEL = "target_direction"


def estimator(kind: str, features: list[str], label: str = LABEL, seed: int = 7, trees: int = 40) -> Pipeline:
    """A pipeline that scores rows: logistic and ridge scale their inputs, trees don't. Others fail closed."""
    raw = VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="error")
    scale = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)
    made = {
        "logistic": lambda: [scale, LogisticRegression(featuresCol="__x", labelCol=label, regParam=1e-3, maxIter=25)],
        "ridge": lambda: [scale, LinearRegression(featuresCol="__x", labelCol=label, regParam=1e-2, elasticNetParam=0.0)],
        "random_forest": lambda: [RandomForestClassifier(featuresCol="__raw", labelCol=label, numTrees=trees, maxDepth=5, seed=seed)],
        "gbt": lambda: [GBTClassifier(featuresCol="__raw", labelCol=label, maxIter=15, maxDepth=3, seed=seed)],
    }
    if kind not in made:
        raise ValueError(f"no estimator {kind!r} here")
    return Pipeline(stages=[raw, *made[kind]()])


def probability(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df)
    p = vector_to_array("probability")[1] if "probability" in out.columns else F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction")))
    return out.withColumn(name, p).select(*df.columns, name)


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(q / (1 - q))


@dataclass
class Ensemble:
    """Fitted on early dates, each member calibrated on later ones, weighted by log loss on the last.

    ``maps`` holds each member's calibration: ("platt", slope, intercept) or ("isotonic", boundaries, predictions).
    A training set with one label only has no members: every score is the ``constant``.
    """

    models: dict[str, PipelineModel]
    maps: dict[str, tuple]
    weights: dict[str, float]
    constant: float | None = None

    def score(self, df: DataFrame) -> DataFrame:
        if not self.models:
            return df.withColumn("score", F.lit(float(self.constant)))
        out = df
        for k, m in self.models.items():
            out = probability(m, out, f"candidate_{k}").withColumn(f"candidate_{k}", calibrated(F.col(f"candidate_{k}"), self.maps[k]))
        parts = [F.col(f"candidate_{k}") * w for k, w in self.weights.items()]
        return out.withColumn("score", sum(parts[1:], parts[0]))


def calibrated(p: Column, how: tuple) -> Column:
    """A probability through a fitted map; between an isotonic map's boundaries it runs straight."""
    if how[0] == "platt":
        return 1 / (1 + F.exp(-(how[1] * logit(p) + how[2])))
    x, y = how[1], how[2]
    out = F.when(p <= x[0], F.lit(y[0]))
    for i in range(1, len(x)):
        slope = (y[i] - y[i - 1]) / (x[i] - x[i - 1]) if x[i] > x[i - 1] else 0.0
        out = out.when(p <= x[i], F.lit(y[i - 1]) + slope * (p - x[i - 1]))
    return out.otherwise(F.lit(y[-1]))


def _calibration(scored: DataFrame, label: str, method: str, most: int = 64) -> tuple:
    """The map from (p, label) rows. An isotonic map is thinned to ``most`` boundaries, so that it stays small."""
    if method == "isotonic":
        m = IsotonicRegression(featuresCol="p", labelCol=label).fit(scored.select("p", F.col(label).cast("double").alias(label)))
        x, y = m.boundaries.toArray(), m.predictions.toArray()
        at = np.unique(np.linspace(0, len(x) - 1, min(most, len(x))).round().astype(int))
        return "isotonic", [float(v) for v in x[at]], [float(v) for v in y[at]]
    rows = VectorAssembler(inputCols=["__l"], outputCol="__lx").transform(scored.withColumn("__l", logit(F.col("p"))))
    lr = LogisticRegression(featuresCol="__lx", labelCol=label, maxIter=25).fit(rows)
    return "platt", float(lr.coefficients[0]), float(lr.intercept)


def fit_ensemble(train: DataFrame, features: list[str], kinds: list[str], label: str = LABEL, date: str = "date", shares: tuple[float, float] = (0.6, 0.2), temperature: float = 0.25, method: str = "platt") -> Ensemble:
    a, b = (d for d in train.select(F.percentile(F.unix_date(date).cast("double"), [shares[0], sum(shares)]).alias("q")).first()["q"])
    day = F.unix_date(date)
    fit, cal, val = train.where(day <= a), train.where((day > a) & (day <= b)), train.where(day > b)
    y = F.col(label)
    seen = train.agg(F.sum(y).alias("ones"), F.count(y).alias("n"), F.sum(F.when(day <= a, y)).alias("f1"), F.count(F.when(day <= a, y)).alias("fn")).first()
    if not seen["fn"] or seen["f1"] in (0, seen["fn"]):  # one label: the share of ones with one of each added
        return Ensemble({}, {}, {}, ((seen["ones"] or 0) + 1) / (seen["n"] + 2))
    models, maps, loss = {}, {}, {}
    for k in kinds:
        m = models[k] = estimator(k, features, label).fit(fit)
        maps[k] = _calibration(probability(m, cal), label, method)
        q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), calibrated(F.col("p"), maps[k])))
        loss[k] = probability(m, val).agg(F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))).first()[0] or math.log(2)
    raw = {k: math.exp(-(v - min(loss.values())) / temperature) for k, v in loss.items()}
    return Ensemble(models, maps, {k: v / sum(raw.values()) for k, v in raw.items()})


def importances(e: Ensemble, features: list[str]) -> dict[str, float]:
    """Shares of the features: trees' own, or absolute coefficients of scaled inputs, by the members' weights."""
    total = np.zeros(len(features))
    for k, m in e.models.items():
        last = m.stages[-1]
        own = np.abs((last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray())
        total += e.weights[k] * own / own.sum() if own.sum() > 0 else 0.0
    return dict(zip(features, (total / total.sum() if total.sum() > 0 else total).tolist(), strict=True))


def save(e: Ensemble, path: str, features: list[str]) -> None:
    """A model bundle: each member's pipeline and a text file of calibration, weights and features."""
    spark = SparkSession.active()
    for k, m in e.models.items():
        m.write().overwrite().save(f"{path}/member={k}")
    text = json.dumps({"maps": e.maps, "weights": e.weights, "constant": e.constant, "features": features}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(path: str) -> tuple[Ensemble, list[str]]:
    """The ensemble and its features."""
    about = json.loads(SparkSession.active().read.text(f"{path}/about").first()["value"])
    models = {k: PipelineModel.load(f"{path}/member={k}") for k in about["weights"]}
    return Ensemble(models, {k: tuple(v) for k, v in about["maps"].items()}, about["weights"], about["constant"]), about["features"]


def walk_forward(rows: DataFrame, features: list[str], kinds: list[str], label: str = LABEL, method: str = "platt") -> tuple[DataFrame, DataFrame]:
    """Out-of-sample scores of every fold, and (fold, feature, importance); ``rows`` carry ``fold`` and ``part``.

    Fitting reads the rows many times, so they are written once; the scores are written fold by fold.
    """
    out, found, rows = None, [], written(rows, "folds")
    spark = rows.sparkSession
    for r in rows.select("fold").distinct().orderBy("fold").collect():
        mine = rows.where(F.col("fold") == r["fold"])
        e = fit_ensemble(mine.where("part = 'train'").drop("part"), features, kinds, label, method=method)
        scored = written(e.score(mine.where("part = 'test'")), "scored")
        found += [(r["fold"], f, float(v)) for f, v in importances(e, features).items()] if e.models else []
        out = scored if out is None else out.unionByName(scored, allowMissingColumns=True)
    if out is None:
        raise ValueError("no fold has enough history")
    return out, spark.createDataFrame(found, "fold int, feature string, importance double")


NU = np.array([3.0, 4.0, 5.0, 7.0, 10.0, 15.0, 30.0])
_NU_CONST = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) for v in NU])


class _Asset:
    """Student-t returns of one asset as a scale mixture of normals; one conditional draw of each parameter a step."""

    def __init__(self, r: np.ndarray, rng: np.random.Generator):
        self.r, self.rng = r, rng
        self.mu, self.var, self.nu = r.mean(), max(r.var(), 1e-12), 5.0

    def step(self, pop: float, tau2: float) -> None:
        scale = self.rng.gamma((self.nu + 1) / 2, 2 / (self.nu + (self.r - self.mu) ** 2 / self.var))
        precision = scale.sum() / self.var + 1 / tau2
        self.mu = self.rng.normal((scale @ self.r / self.var + pop / tau2) / precision, precision**-0.5)
        self.var = (1e-4 + scale @ (self.r - self.mu) ** 2 / 2) / self.rng.gamma(2 + len(self.r) / 2)
        z = np.log1p((self.r - self.mu) ** 2 / self.var / NU[:, None]).sum(1)
        like = _NU_CONST * len(self.r) - (NU + 1) / 2 * z
        p = np.exp(like - like.max())
        self.nu = float(self.rng.choice(NU, p=p / p.sum()))


def _seeded(seed: int, *parts) -> np.random.Generator:
    """A stream that depends on names only, not on the task that draws."""
    return np.random.default_rng([seed, *(zlib.crc32(str(x).encode()) for x in parts)])


def population(asset: DataFrame, draws: int, seed: int, points: int = 64) -> list[tuple[float, float]]:
    """Draws of the population's mean and spread from each asset's posterior mean and variance (``m``, ``v``).

    Given those, assets are normal around the population, so the spread has a one-dimensional posterior: five sums
    at each of a few points, in one aggregate, whatever the number of assets.
    """
    r = asset.agg(F.stddev_pop("m").alias("s"), F.avg(F.sqrt("v")).alias("e")).first()
    top = max(r["s"] or 0.0, r["e"] or 0.0, 1e-9) * 5
    grid = np.geomspace(top / 1e4, top, points)
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(t * t)).alias("t2")) for i, t in enumerate(grid))))
    w = 1 / (F.col("g.t2") + F.col("v"))
    sums = asset.select("m", "v", at.alias("g")).groupBy(F.col("g.i").alias("i")).agg(F.sum(w).alias("w"), F.sum(w * F.col("m")).alias("wm"), F.sum(w * F.col("m") * F.col("m")).alias("wmm"), F.sum(F.ln(w)).alias("l"))
    x = sums.orderBy("i").toPandas()  # one row a point
    mean = x["wm"] / x["w"]
    logp = 0.5 * x["l"] - 0.5 * np.log(x["w"]) - 0.5 * (x["wmm"] - x["wm"] * mean) + np.log(grid)  # flat in the spread, on a log grid
    p = np.exp(logp - logp.max()).to_numpy()
    rng = _seeded(seed, "population")
    chosen = rng.choice(points, draws, p=p / p.sum())
    return [(float(rng.normal(mean[i], x["w"][i] ** -0.5)), float(grid[i])) for i in chosen]


def gibbs(spark: SparkSession, returns: DataFrame, draws: int = 200, warmup: int = 100, chains: int = 2, seed: int = 3) -> DataFrame:
    """Hierarchical Student-t returns: (chain, draw, asset, mu, sigma, nu, mu_population, tau).

    In two stages (Lunn and others, 2013), so that no task holds more than one asset's returns and only population
    parameters move: assets are first sampled alone, in parallel; their posterior means and variances, taken as
    normal, give the population's posterior; then each asset is sampled again under every draw of the population.
    """
    rows = returns.where("ret is not null").select("ticker", "ret", "date")

    def alone(f: pd.DataFrame) -> pd.DataFrame:
        name, r = f["ticker"].iloc[0], f.sort_values("date")["ret"].to_numpy(float)
        asset, kept = _Asset(r, _seeded(seed, "alone", name)), []
        for i in range(warmup + draws):
            asset.step(r.mean(), 1e6 * max(r.var(), 1e-12))
            kept += [asset.mu] if i >= warmup else []
        return pd.DataFrame({"ticker": [name], "m": [np.mean(kept)], "v": [max(np.var(kept), 1e-300)]})

    every = population(rows.groupBy("ticker").applyInPandas(alone, "ticker string, m double, v double"), chains * (warmup + draws), seed)

    def under(f: pd.DataFrame) -> pd.DataFrame:
        name, r, out = f["ticker"].iloc[0], f.sort_values("date")["ret"].to_numpy(float), []
        for c in range(chains):
            asset = _Asset(r, _seeded(seed, c, name))
            for i, (pop, tau) in enumerate(every[c * (warmup + draws) : (c + 1) * (warmup + draws)]):
                asset.step(pop, tau * tau)
                if i >= warmup:
                    out.append((c, i - warmup, name, asset.mu, math.sqrt(asset.var), asset.nu, pop, tau))
        return pd.DataFrame(out, columns=["chain", "draw", "asset", "mu", "sigma", "nu", "mu_population", "tau"])

    return rows.groupBy("ticker").applyInPandas(under, "chain int, draw int, asset string, mu double, sigma double, nu double, mu_population double, tau double")


def predictive(posterior: DataFrame, horizon: int = 1, seed: int = 9) -> DataFrame:
    """(chain, draw, asset, ret): a return over ``horizon`` bars from each posterior draw."""

    def run(batches):
        for b in batches:
            out = []
            for c, d, a, mu, sigma, nu in b[["chain", "draw", "asset", "mu", "sigma", "nu"]].itertuples(index=False):
                out.append((c, d, a, float((mu + sigma * _seeded(seed, c, d, a).standard_t(nu, horizon)).sum())))
            yield pd.DataFrame(out, columns=["chain", "draw", "asset", "ret"])

    return posterior.select("chain", "draw", "asset", "mu", "sigma", "nu").mapInPandas(run, "chain int, draw int, asset string, ret double")


CHECKS: dict[str, Callable[[np.ndarray], float]] = {"mean": np.mean, "std": np.std, "min": np.min, "max": np.max, "abs_skew": lambda x: abs(float(((x - x.mean()) ** 3).mean() / max(x.std(), 1e-300) ** 3))}


def posterior_checks(posterior: DataFrame, returns: DataFrame, seed: int = 13) -> DataFrame:
    """(asset, statistic, observed, replicated, p): how often a replicated series reaches the observed statistic."""

    def run(key: tuple, seen: pd.DataFrame, post: pd.DataFrame) -> pd.DataFrame:
        r = seen.sort_values("date")["ret"].to_numpy(float)
        if not len(r) or not len(post):
            return pd.DataFrame([], columns=["asset", "statistic", "observed", "replicated", "p"], dtype=object)
        post = post.sort_values(["chain", "draw"])
        made = [x.mu + x.sigma * _seeded(seed, key[0], x.chain, x.draw).standard_t(x.nu, len(r)) for x in post.itertuples()]
        rows = []
        for name, f in CHECKS.items():
            rep = np.array([f(x) for x in made])
            rows.append((key[0], name, float(f(r)), float(rep.mean()), float((rep >= f(r)).mean())))
        return pd.DataFrame(rows, columns=["asset", "statistic", "observed", "replicated", "p"])

    seen = returns.where("ret is not null").select(F.col("ticker").alias("asset"), "date", "ret")
    return seen.groupBy("asset").cogroup(posterior.groupBy("asset")).applyInPandas(run, "asset string, statistic string, observed double, replicated double, p double")


def shrinkage(posterior: DataFrame, returns: DataFrame) -> DataFrame:
    """(asset, n, own, posterior, population, shrinkage): how far each mean moved from its own toward the population's."""
    own = returns.where("ret is not null").groupBy(F.col("ticker").alias("asset")).agg(F.count("*").alias("n"), F.avg("ret").alias("own"))
    post = posterior.groupBy("asset").agg(F.avg("mu").alias("posterior"), F.avg("mu_population").alias("population"))
    moved = 1 - F.try_divide(F.col("posterior") - F.col("population"), F.col("own") - F.col("population"))
    return own.join(post, "asset").withColumn("shrinkage", moved)


def split_r_hat(x: np.ndarray) -> float:
    """Of chains by draws."""
    half = x.shape[1] // 2
    s = np.concatenate([x[:, :half], x[:, half : 2 * half]])
    within, between = s.var(1, ddof=1).mean(), half * s.mean(1).var(ddof=1)
    return float(math.sqrt(((half - 1) / half * within + between / half) / within)) if within > 0 else math.nan


def effective_sample_size(x: np.ndarray) -> float:
    """Truncated at the first negative autocorrelation."""
    n, d = x.shape[1], x - x.mean(1, keepdims=True)
    var = (d**2).mean()
    total = 0.0
    for k in range(1, n):
        rho = (d[:, k:] * d[:, :-k]).mean() / var if var > 0 else -1
        if rho < 0:
            break
        total += rho
    return x.size / (1 + 2 * total)


def log_predictive_density(posterior: DataFrame, held: DataFrame) -> DataFrame:
    """Mean held-out log density by asset: the log of the mean density over draws, for each observation."""
    lgamma = {v: math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) for v in (3.0, 4.0, 5.0, 7.0, 10.0, 15.0, 30.0)}
    const = F.coalesce(*(F.when(F.col("nu") == k, F.lit(v)) for k, v in lgamma.items()))
    z = (F.col("ret") - F.col("mu")) / F.col("sigma")
    logp = const - F.ln("sigma") - (F.col("nu") + 1) / 2 * F.log1p(z * z / F.col("nu"))
    obs = held.where("ret is not null").select(F.col("ticker").alias("asset"), "date", "ret").join(posterior, "asset").withColumn("l", logp)
    each = obs.groupBy("asset", "date").agg(F.max("l").alias("m"), F.log(F.avg(F.exp("l"))).alias("d"))
    return each.groupBy("asset").agg(F.avg("d").alias("lpd"), F.count("*").alias("n"))


def scenarios(spark: SparkSession, posterior: pd.DataFrame, correlation: np.ndarray, n: int, horizon: int = 5, seed: int = 5) -> DataFrame:
    """(scenario, asset, ret): correlated normals through t marginals of posterior draws, summed over days.

    A scenario's numbers depend on its id only, not on the task that makes it.
    """
    assets = sorted(posterior["asset"].unique())
    value, vector = np.linalg.eigh(correlation)
    c = (vector * np.maximum(value, 1e-8)) @ vector.T
    d = np.sqrt(np.diag(c))
    root = np.linalg.cholesky(c / np.outer(d, d))
    by = {k: g.set_index("asset").loc[assets] for k, g in posterior.groupby(["chain", "draw"])}
    keys = sorted(by)

    def run(batches):
        for b in batches:
            rows = []
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i)])
                g = by[keys[rng.integers(len(keys))]]
                nu = float(g["nu"].iloc[0])
                z = rng.normal(size=(horizon, len(assets))) @ root.T
                t = z * np.sqrt(nu / rng.chisquare(nu, (horizon, len(assets))))
                r = (g["mu"].to_numpy() + g["sigma"].to_numpy() * t).sum(0)
                rows += zip([int(i)] * len(assets), assets, r.tolist(), strict=True)
            yield pd.DataFrame(rows, columns=["scenario", "asset", "ret"])

    return spark.range(n).mapInPandas(run, "scenario bigint, asset string, ret double")


def project(w: np.ndarray, cap: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Alternating projections to weights within 0 and the cap that sum to one."""
    for _ in range(rounds):
        w = np.clip(w + (1 - w.sum()) / len(w), 0, cap)
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


Policy = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def policies(mean: np.ndarray, cov: np.ndarray, draws: np.ndarray, aversion: float = 5.0, tail: float = 0.1, more: dict[str, Policy] | None = None) -> dict[str, np.ndarray]:
    """Weights by policy. ``more`` adds policies: each takes mean, covariance and draws; its weights are projected."""
    n, vol = len(mean), np.sqrt(np.maximum(np.diag(cov), 1e-12))
    w = np.full(n, 1 / n)
    worst = max(1, int(tail * len(draws)))
    for _ in range(200):
        at = np.argsort(draws @ w)[:worst]
        w = project(w + 0.05 * (mean + aversion * draws[at].mean(0)))
    own = {k: project(np.asarray(f(mean, cov, draws), float)) for k, f in (more or {}).items()}
    return own | {"equal": np.full(n, 1 / n), "mean_variance": project(np.linalg.solve(aversion * cov + 1e-8 * np.eye(n), mean)), "inverse_vol": project(1 / vol), "robust_cvar": w}


def evaluate_policies(sc: DataFrame, weights: DataFrame, tail: float = 0.05, cost: float = 0.0, realised: DataFrame | None = None) -> DataFrame:
    """Expected return, volatility, tail mean and effective number of assets of each (policy, asset, weight).

    ``realised`` (asset, ret) adds what each policy would have earned.
    """
    per = sc.join(F.broadcast(weights), "asset").groupBy("policy", "scenario").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"))
    q = per.groupBy("policy").agg(F.percentile("r", tail).alias("q"))
    per = per.join(F.broadcast(q), "policy")  # one row a policy
    eff = weights.groupBy("policy").agg((1 / F.sum(F.col("weight") * F.col("weight"))).alias("effective_assets"), F.sum(F.abs("weight")).alias("turnover"))
    out = per.groupBy("policy").agg(F.avg("r").alias("gross"), F.stddev_samp("r").alias("volatility"), (-F.avg(F.when(F.col("r") <= F.col("q"), F.col("r")))).alias("cvar"))
    out = out.join(eff, "policy").withColumn("net", F.col("gross") - cost * F.col("turnover"))
    if realised is not None:
        out = out.join(weights.join(realised, "asset").groupBy("policy").agg(F.sum(F.col("weight") * F.col("ret")).alias("realised")), "policy", "left")
    return out.orderBy("policy")


def coherence(sc: DataFrame) -> DataFrame:
    """Mean, deviation and count of each asset's scenarios."""
    return sc.groupBy("asset").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.count("*").alias("n"))


def warm_inference(score: Callable[[DataFrame], DataFrame], rows: DataFrame, sizes: tuple[int, ...] = (1, 64), runs: int = 3) -> list[dict[str, float]]:
    """Latency quantiles and throughput of scoring batches, after one run to warm up."""
    out = []
    for n in sizes:
        batch = rows.limit(n).cache()
        batch.count()
        took = []
        for i in range(runs + 1):
            at = time.perf_counter_ns()
            score(batch).write.format("noop").mode("overwrite").save()
            took += [(time.perf_counter_ns() - at) / 1e6] if i else []
        batch.unpersist()
        p50, p95, p99 = np.percentile(took, [50, 95, 99])
        out.append({"batch": n, "p50_ms": p50, "p95_ms": p95, "p99_ms": p99, "rows_per_s": n / (p50 / 1e3)})
    return out


def readiness(evidence: dict[str, float | None], limits: dict[str, tuple[str, float]]) -> tuple[bool, list[dict]]:
    """Each criterion passes, or fails when missing, not finite or beyond its limit; ready only if all pass."""
    rows = []
    for name, (op, limit) in limits.items():
        x = evidence.get(name)
        ok = x is not None and math.isfinite(x) and (x >= limit if op == ">=" else x <= limit)
        rows.append({"criterion": name, "observed": x, "rule": f"{op} {limit}", "passed": ok})
    return bool(rows) and all(r["passed"] for r in rows), rows
