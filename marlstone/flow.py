"""The whole run from a panel to a report: features, walk-forward scores, backtest, figures, a tracked record.

Settings are one frozen tree; unknown names are errors. Everything a later step needs is written once.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.shared import calendar_grid, written
from marlstone.operators import backtest as bt
from marlstone.operators import features as fe
from marlstone.operators import models as mo
from marlstone.operators import risk
from marlstone.operators import splits as sl
from marlstone.plans import panels
from marlstone.report import figure, report
from marlstone.sources import tracker


@dataclass(frozen=True)
class Model:
    kinds: tuple[str, ...] = ("logistic",)
    folds: int = 3
    test: int = 60
    embargo: int = 2
    least: int = 252
    calibration: str = "platt"


@dataclass(frozen=True)
class Settings:
    name: str = "run"
    #: model, momentum, crossover or reversion
    signal: str = "model"
    benchmark: str | None = None
    model: Model = field(default_factory=Model)
    policy: bt.Policy = field(default_factory=bt.Policy)
    costs: tuple[float, ...] = (0.0, 5.0, 10.0, 25.0)


def settings(tree: dict[str, Any], kind: type = Settings) -> Any:
    """Settings from nested dictionaries (as from a JSON file); unknown names are errors."""
    known = {f.name: f for f in fields(kind)}
    lost = sorted(set(tree) - set(known))
    if lost:
        raise ValueError(f"unknown settings: {lost}")
    made = {}
    for k, v in tree.items():
        inner = {"model": Model, "policy": bt.Policy}.get(k)
        made[k] = settings(v, inner) if inner and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v
    return kind(**made)


def scores(panel: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame | None]:
    """(date, ticker, score) of the chosen signal, and the importances of a model."""
    if s.signal != "model":
        kinds = {"momentum": fe.baseline_momentum, "crossover": fe.baseline_crossover, "reversion": fe.baseline_reversion}
        if s.signal not in kinds:
            raise ValueError(f"no signal {s.signal!r}")
        return kinds[s.signal](fe.build_features(panel, drop=False)).select("date", "ticker", "score"), None
    rows = fe.build_features(panel)
    folds = sl.walk_forward(rows, s.model.folds, s.model.test, s.model.embargo, s.model.least)
    out, found = mo.walk_forward(folds, fe.feature_columns(rows), list(s.model.kinds), method=s.model.calibration)
    return out.select("date", "ticker", "score"), found


@dataclass
class Result:
    scores: DataFrame
    held: DataFrame
    days: DataFrame
    summary: DataFrame
    costs: DataFrame
    importances: DataFrame | None

    def report(self, title: str) -> str:
        parts = [("Performance", self.summary), ("Equity", figure(self.days, "date", ["equity"], "Equity")), ("Drawdown", figure(self.days, "date", ["drawdown"], "Drawdown"))]
        parts += [("Costs", self.costs), ("Break-even", bt.break_even_bps(self.days))]
        return report(title, parts + ([("Importances", self.importances.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance")))] if self.importances is not None else []))


def backtest(panel: DataFrame, found: DataFrame, s: Settings, importances: DataFrame | None = None) -> Result:
    """Weights, daily results and figures of given scores over the dates from the first score on."""
    found = written(found, "scores")
    first = found.agg(F.min("date").alias("d")).first()["d"]
    full = calendar_grid(panel, panel).join(panel.select("date", "ticker", "ret"), ["date", "ticker"], "left").where(F.col("date") >= F.lit(first))
    returns = written(full.select("date", "ticker", F.coalesce("ret", F.lit(0.0)).alias("ret")), "returns")
    held = written(bt.held_weights(found, returns, s.policy), "held")
    days = written(bt.daily(held, returns, s.policy), "days")
    of = returns.where(F.col("ticker") == s.benchmark) if s.benchmark else returns
    market = of.groupBy("date").agg(F.avg("ret").alias("market"))
    with_market = days.join(market, "date", "left")
    costs = risk.summary(bt.cost_grid(days, list(s.costs)).join(market, "date", "left"), keys=("bps",)).select("bps", "ann_return", "sharpe", "max_drawdown").orderBy("bps")
    return Result(found, held, days, risk.summary(with_market), costs, importances)


def run(spark: SparkSession, panel: DataFrame, s: Settings, runs: str | None = None) -> Result:
    """All steps; ``runs`` names a folder for the tracked record. The panel has the price columns."""
    d = panel if "ret" in panel.columns else panels.with_returns(panel)
    d = written(d if "market" in d.columns else panels.with_market(d), "panel")
    found, importances = scores(d, s)
    result = backtest(d, found, s, importances)
    if runs:
        figures = {k: v for k, v in result.summary.first().asDict().items() if v is not None}
        tracker.JsonTracker(spark, runs).log(tracker.Run(s.name, asdict(s), figures))
    return result
