"""A temporal convolution network over feature sequences, trained in numpy across the cluster.

Causal convolutions of two taps at growing dilations, each added to what it reads, give the last bar's state, whose
logistic is the forecast. Training is local AdamW: in a round every part of the rows trains from the same parameters
for one pass, and the results are averaged, weighted by rows. Parts are dealt by a hash of entity and date and hold
about ``part_rows`` rows each, so nothing depends on partitions and no task grows with the data; only one vector of
parameters reaches the driver. The last dates of the training rows are held back: the round of least log loss on them
is kept, and training stops when a few rounds bring nothing better.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.shared import written
from marlstone.operators.splits import sequences


@dataclass(frozen=True)
class Shape:
    features: int
    length: int = 16
    channels: int = 12
    dilations: tuple[int, ...] = (1, 2, 4)
    rate: float = 3e-3
    decay: float = 1e-3
    batch: int = 256
    rounds: int = 8
    patience: int = 3
    part_rows: int = 50_000
    seed: int = 5


class Net:
    """Parameters as one flat vector with views."""

    def __init__(self, shape: Shape, flat: np.ndarray | None = None):
        self.shape, c = shape, shape.channels
        sizes = {"enter": (shape.features, c), "enter_bias": (c,), "now": (len(shape.dilations), c, c), "past": (len(shape.dilations), c, c), "bias": (len(shape.dilations), c), "leave": (c,), "leave_bias": (1,)}
        total = sum(int(np.prod(s)) for s in sizes.values())
        self.flat, at = np.array(flat, float) if flat is not None else np.random.default_rng(shape.seed).normal(0, 0.2, total), 0
        for name, size in sizes.items():
            n = int(np.prod(size))
            setattr(self, name, self.flat[at : at + n].reshape(size))
            at += n

    @staticmethod
    def _late(x: np.ndarray, d: int) -> np.ndarray:
        """The series d bars earlier, zero before the first."""
        out = np.zeros_like(x)
        out[:, d:] = x[:, :-d]
        return out

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Forecasts of (rows, length, features), and what each layer read and gave."""
        h, kept = x @ self.enter + self.enter_bias, []
        for k, d in enumerate(self.shape.dilations):
            a = np.maximum(0.0, h @ self.now[k] + self._late(h, d) @ self.past[k] + self.bias[k])
            kept.append((h, a))
            h = h + a
        kept.append((h, h))
        return 1 / (1 + np.exp(-np.clip(h[:, -1] @ self.leave + self.leave_bias[0], -30, 30))), kept

    def backward(self, x: np.ndarray, d_out: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients by the parameters and by the input, of the sum of ``d_out`` times the logits."""
        g = Net(self.shape, np.zeros_like(self.flat))
        h = kept[-1][0]
        g.leave[:], g.leave_bias[0] = d_out @ h[:, -1], d_out.sum()
        back = np.zeros_like(h)
        back[:, -1] = d_out[:, None] * self.leave
        for k in range(len(self.shape.dilations) - 1, -1, -1):
            d, (h, a) = self.shape.dilations[k], kept[k]
            through = back * (a > 0)
            g.now[k] = np.einsum("nti,ntj->ij", h, through)
            g.past[k] = np.einsum("nti,ntj->ij", self._late(h, d), through)
            g.bias[k] = through.sum((0, 1))
            early = through @ self.past[k].T
            back = back + through @ self.now[k].T
            back[:, :-d] += early[:, d:]
        g.enter[:], g.enter_bias[:] = np.einsum("nti,ntj->ij", x, back), back.sum((0, 1))
        return g.flat, back @ self.enter.T

    def train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of AdamW in a seeded order."""
        s, m, v = self.shape, np.zeros_like(self.flat), np.zeros_like(self.flat)
        order = rng.permutation(len(x))
        for step, i in enumerate(range(0, len(x), s.batch), 1):
            at = order[i : i + s.batch]
            p, kept = self.forward(x[at])
            g, _ = self.backward(x[at], (p - y[at]) / len(at), kept)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.flat -= s.rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + s.decay * self.flat)


@dataclass(frozen=True)
class Fitted:
    shape: Shape
    flat: tuple[float, ...]
    names: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    rounds: int

    def _input(self, rows: pd.Series) -> np.ndarray:
        x = np.array([np.stack(s) for s in rows], float).reshape(len(rows), self.shape.length, self.shape.features)
        return (x - np.array(self.mean)) / np.array(self.std)

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """``rows`` with ``sequence`` and the forecast in its place."""
        kept = [f for f in rows.schema.fields if f.name not in ("sequence", "valid")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", {name} double"

        def run(batches):
            net = Net(self.shape, np.array(self.flat))
            for b in batches:
                yield b[[f.name for f in kept]].assign(**{name: net.forward(self._input(b["sequence"]))[0] if len(b) else []})

        return rows.mapInPandas(run, schema)

    def importances(self, rows: DataFrame) -> DataFrame:
        """(feature, importance): shares of the mean absolute gradient times input."""

        def run(batches):
            net = Net(self.shape, np.array(self.flat))
            for b in batches:
                x = self._input(b["sequence"])
                _, kept = net.forward(x)
                _, by_input = net.backward(x, np.ones(len(x)), kept)
                yield pd.DataFrame({"feature": self.names, "importance": np.abs(by_input * x).sum((0, 1))})

        every = rows.select("sequence").mapInPandas(run, "feature string, importance double").groupBy("feature").agg(F.sum("importance").alias("importance"))
        whole = every.agg(F.sum("importance").alias("whole"))
        return every.crossJoin(F.broadcast(whole)).select("feature", F.try_divide("importance", "whole").alias("importance"))  # one row


def with_sequences(rows: DataFrame, names: list[str], length: int) -> DataFrame:
    """Rows with their last ``length`` bars of features; those with a shorter past go."""
    return sequences(rows, names, length).where(F.forall("valid", lambda v: v))


def fit(rows: DataFrame, names: list[str], label: str, shape: Shape | None = None, date: str = "date", entity: str = "ticker", held: float = 0.2) -> Fitted:
    """Fit on rows with ``sequence``; inputs are scaled by the mean and deviation of the rows that train."""
    shape = shape or Shape(len(names))
    at = rows.agg(F.percentile(F.unix_date(date).cast("double"), 1 - held).alias("q")).first()["q"]
    rows = written(rows.select(date, entity, "sequence", F.col(label).cast("double").alias("y"), *names).withColumn("val", F.unix_date(date) > at), "sequences")
    n = rows.where("not val").count()
    stats = rows.where("not val").agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names))).first()
    mean, std = (tuple(float(stats[f"{k}{i}"] or 0.0) for i in range(len(names))) for k in "ms")
    std = tuple(s if s > 1e-12 else 1.0 for s in std)
    parts = max(1, round(n / shape.part_rows))
    dealt = rows.where("not val").withColumn("part", F.pmod(F.xxhash64(entity, date), F.lit(parts)).cast("int"))
    flat, best, waited, rounds = Net(shape).flat, (np.inf, Net(shape).flat, 0), 0, 0

    def local(start: np.ndarray, turn: int):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values([entity, date], kind="stable")
            net, own = Net(shape, start), Fitted(shape, (), tuple(names), mean, std, 0)
            net.train(own._input(part["sequence"]), part["y"].to_numpy(float), np.random.default_rng([shape.seed, turn, int(part["part"].iloc[0])]))
            return pd.DataFrame({"i": np.arange(len(net.flat)), "v": net.flat * len(part), "w": float(len(part))})

        return run

    for rounds in range(1, shape.rounds + 1):
        found = dealt.groupBy("part").applyInPandas(local(flat, rounds), "i int, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).orderBy("i").collect()  # one vector
        flat = np.array([r["v"] for r in found]) if found else flat
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("score")))
        now = Fitted(shape, tuple(flat), tuple(names), mean, std, rounds)
        loss = now.score(rows.where("val").select("sequence", "y")).agg(F.avg(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))).alias("l")).first()["l"]
        loss = np.inf if loss is None else loss
        best, waited = ((loss, flat, rounds), 0) if loss < best[0] else (best, waited + 1)
        if waited >= shape.patience:
            break
    return Fitted(shape, tuple(best[1]), tuple(names), mean, std, best[2])


def walk_forward(rows: DataFrame, names: list[str], label: str, shape: Shape | None = None) -> tuple[DataFrame, DataFrame]:
    """Out-of-sample scores of every fold and (fold, feature, importance); ``rows`` carry sequence, fold and part."""
    out = shares = None
    rows = written(rows, "folds")
    for r in rows.select("fold").distinct().orderBy("fold").collect():
        mine = rows.where(F.col("fold") == r["fold"])
        net = fit(mine.where("part = 'train'"), names, label, shape)
        scored, share = written(net.score(mine.where("part = 'test'")), "scored"), net.importances(mine.where("part = 'test'")).withColumn("fold", F.lit(r["fold"]))
        out, shares = (scored, share) if out is None else (out.unionByName(scored), shares.unionByName(share))
    if out is None:
        raise ValueError("no fold has enough history")
    return out, shares
