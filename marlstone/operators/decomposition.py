"""Adaptive decompositions of a series into modes and a residual that add up to it, and their descriptors."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FAMILIES = ("raw", "spectral", "wavelet", "emd", "vmd")


@dataclass
class Modes:
    modes: np.ndarray
    residual: np.ndarray
    converged: bool
    steps: int

    def error(self, x: np.ndarray) -> float:
        """Largest difference between the series and the sum of its parts, relative to its size."""
        return float(np.abs(x - self.modes.sum(0) - self.residual).max() / max(np.abs(x).max(), 1e-300))


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with not-a-knot ends (line or parabola for two or three knots)."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0]) if n > 1 else np.full(len(at), y[0])
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a, rhs = np.zeros((n, n)), np.zeros(n)
    i = np.arange(1, n - 1)
    a[i, i - 1], a[i, i], a[i, i + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    rhs[1:-1] = 6 * np.diff(slope)
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, rhs)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    d = at - x[k]
    return y[k] + d * (slope[k] - h[k] * (2 * m[k] + m[k + 1]) / 6) + d**2 * m[k] / 2 + d**3 * (m[k + 1] - m[k]) / (6 * h[k])


def _turns(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sign(np.diff(x))
    return np.nonzero((s[:-1] > 0) & (s[1:] < 0))[0] + 1, np.nonzero((s[:-1] < 0) & (s[1:] > 0))[0] + 1


def _envelope(at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Spline through turning points, the outer two mirrored beyond either end."""
    end, k = len(x) - 1, min(2, len(at))
    place = np.concatenate([-at[:k][::-1], at, 2 * end - at[-k:][::-1]]).astype(float)
    value = np.concatenate([x[at[:k]][::-1], x[at], x[at[-k:]][::-1]])
    place, first = np.unique(place, return_index=True)
    return spline(place, value[first], np.arange(len(x), dtype=float))


def _sift(x: np.ndarray, tolerance: float, rounds: int) -> tuple[np.ndarray | None, bool, int]:
    h = x.copy()
    for i in range(rounds):
        up, down = _turns(h)
        if not len(up) or not len(down):
            return (h if i else None), True, i
        mean = (_envelope(up, h) + _envelope(down, h)) / 2
        power = float((h**2).sum())
        h = h - mean
        if power <= 0 or float((mean**2).sum()) / power < tolerance:
            return h, True, i + 1
    return h, False, rounds


def emd(x: np.ndarray, most: int = 8, tolerance: float = 0.2, rounds: int = 100) -> Modes:
    """Empirical modes by sifting, fastest first."""
    rest, found, ok, steps = x.astype(float).copy(), [], True, 0
    while len(found) < most:
        mode, settled, n = _sift(rest, tolerance, rounds)
        if mode is None:
            break
        found.append(mode)
        rest, ok, steps = rest - mode, ok and settled, steps + n
    return Modes(np.array(found).reshape(-1, len(x)), rest, ok, steps)


def _rng(seed: int, *label: object) -> np.random.Generator:
    """A stream for a label that is the same in every process."""
    return np.random.default_rng([seed, zlib.crc32(repr(label).encode())])


def eemd(x: np.ndarray, members: int = 20, noise: float = 0.2, seed: int = 7, most: int = 8) -> Modes:
    """Mean of modes over copies with noise; a mode's mean is over the members that have it."""
    total, count, ok, steps = np.zeros((most, len(x))), np.zeros(most), True, 0
    for i in range(members):
        m = emd(x + _rng(seed, "eemd", i).normal(0, noise * x.std(), len(x)), most)
        total[: len(m.modes)] += m.modes
        count[: len(m.modes)] += 1
        ok, steps = ok and m.converged, steps + m.steps
    modes = total[count > 0] / count[count > 0, None]
    return Modes(modes, x - modes.sum(0), ok, steps)


def ceemdan(x: np.ndarray, members: int = 20, noise: float = 0.2, seed: int = 7, most: int = 8) -> Modes:
    """Stage by stage the mean first mode of the common residual with noise modes added."""
    streams = [emd(_rng(seed, "ceemdan", i).normal(0, 1, len(x)), most).modes for i in range(members)]
    rest, found, ok, steps = x.astype(float).copy(), [], True, 0
    for stage in range(most):
        up, down = _turns(rest)
        if len(up) + len(down) < 3:
            break
        firsts = []
        for s in streams:
            added = s[stage] if stage < len(s) else np.zeros(len(x))
            m = emd(rest + noise * rest.std() * added / max(added.std(), 1e-12), 1)
            ok, steps = ok and m.converged, steps + m.steps
            firsts.append(m.modes[0] if len(m.modes) else np.zeros(len(x)))
        mode = np.mean(firsts, 0)
        found.append(mode)
        rest = rest - mode
    return Modes(np.array(found).reshape(-1, len(x)), rest, ok, steps)


def vmd(x: np.ndarray, modes: int = 4, alpha: float = 2000.0, tau: float = 0.0, tolerance: float = 1e-7, rounds: int = 500) -> Modes:
    """Variational modes: Wiener filters around centre frequencies on the half spectrum of the mirrored series."""
    n = len(x)
    left, right = n // 2, n - n // 2
    long_ = np.concatenate([x[:left][::-1], x, x[-right:][::-1]])
    spectrum, f = np.fft.rfft(long_), np.fft.rfftfreq(len(long_))
    # centre frequencies start evenly spread, as in the method's paper (Dragomiretskiy and Zosso, 2014)
    u, omega = np.zeros((modes, len(f)), complex), 0.5 * np.arange(modes) / modes
    dual, whole, ok, step = np.zeros(len(f), complex), np.zeros(len(f), complex), False, 0
    for step in range(1, rounds + 1):
        before = u.copy()
        for k in range(modes):
            whole = whole - u[k]
            u[k] = (spectrum - whole + dual / 2) / (1 + alpha * (f - omega[k]) ** 2)
            whole = whole + u[k]
            power = np.abs(u[k]) ** 2
            omega[k] = (f @ power) / power.sum() if power.sum() > 0 else omega[k]
        dual = dual + tau * (spectrum - whole)
        size = (np.abs(before) ** 2).sum()
        if size > 0 and (np.abs(u - before) ** 2).sum() / size < tolerance:
            ok = True
            break
    order = np.argsort(omega)[::-1]
    made = np.fft.irfft(u[order], len(long_), axis=1)[:, left : left + n]
    return Modes(made, x - made.sum(0), ok, step)


METHODS = {"emd": emd, "eemd": eemd, "ceemdan": ceemdan, "vmd": vmd}


def describe(m: Modes, x: np.ndarray, width: int = 4) -> dict[str, float]:
    """Fixed-width descriptors of a decomposition; absent modes are missing."""
    energy = (m.modes**2).sum(1)
    total = energy.sum() + (m.residual**2).sum()
    out: dict[str, float] = {}
    for k in range(width):
        names = [f"mode{k}_{s}" for s in ("energy", "period", "entropy", "stability")]
        if k >= len(m.modes) or total <= 0:
            out |= dict.fromkeys(names, math.nan)
            continue
        u = m.modes[k]
        p = np.abs(np.fft.rfft(u - u.mean())) ** 2
        f, q = np.fft.rfftfreq(len(u)), p / max(p.sum(), 1e-300)
        peak = int(p[1:].argmax()) + 1
        entropy = float(-(q[q > 0] * np.log(q[q > 0])).sum() / math.log(len(q)))
        half = len(u) // 2
        early, late = float((u[:half] ** 2).mean()), float((u[half:] ** 2).mean())
        stable = math.tanh(math.log(late / early)) if early > 0 and late > 0 else math.nan
        out |= dict(zip(names, (energy[k] / total, 1 / f[peak], entropy, stable), strict=True))
    out["residual"] = float((m.residual**2).sum() / total) if total > 0 else math.nan
    cross = math.nan
    if len(m.modes) > 1:
        c = np.abs(np.corrcoef(m.modes))
        cross = float(np.nanmax(c[~np.eye(len(c), dtype=bool)]))
    return out | {"cross": cross, "converged": float(m.converged)}


def describe_raw(x: np.ndarray) -> dict[str, float]:
    """Moments of a window, standardised by its own deviation."""
    s = x.std()
    if s <= 0:
        return dict.fromkeys(("skew", "kurt", "ac1", "ac5", "vr2"), math.nan)
    z = (x - x.mean()) / s
    pairs = z[1:] + z[:-1]
    return {"skew": float((z**3).mean()), "kurt": float((z**4).mean() - 3), "ac1": float((z[1:] * z[:-1]).mean()), "ac5": float((z[5:] * z[:-5]).mean()), "vr2": float(pairs.var() / 2)}


def representations(panel: DataFrame, column: str, family: str, n: int = 64, stride: int = 5, width: int = 4, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Descriptors of one family on every ``stride``-th causal window; all families share the same windows."""
    from marlstone.operators import spectral as sp

    probe = np.sin(np.arange(n)) + 0.01 * np.arange(n)

    def of(x: np.ndarray) -> dict[str, float]:
        if family == "raw":
            return describe_raw(x)
        if family == "spectral":
            return {k: float(v[0]) for k, v in sp.descriptors(sp.welch(x[None], n // 2, n // 8), sp.frequencies(n // 2)).items()}
        if family == "wavelet":
            return {f"dwt_{i}": float(e) for i, e in enumerate(sp.dwt_energies(x[None], 3)[0])}
        return describe(METHODS[family](x), x, width)

    cols = [f"{family}_{k}" for k in of(probe)]
    kinds = {f.name: f.dataType.simpleString() for f in panel.schema.fields}
    schema = f"{time} {kinds[time]}, {entity} {kinds[entity]}, " + ", ".join(f"{c} double" for c in cols)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time, kind="stable")
        w = sp.causal_windows(rows[column].to_numpy(float), n)
        at = [i for i in range(n - 1, len(rows), stride) if np.isfinite(w[i]).all()]
        made = [{f"{family}_{k}": v for k, v in of(w[i]).items()} for i in at]
        out = pd.DataFrame(made, columns=cols, dtype=float)
        out.insert(0, entity, rows[entity].to_numpy()[at])
        out.insert(0, time, rows[time].to_numpy()[at])
        return out

    return panel.select(time, entity, column).groupBy(entity).applyInPandas(run, schema)


#: Bars of one entity, and modes, that a task will decompose.
MOST_BARS, MOST_MODES = 100_000, 32


def _bounded(rows: int, options: dict) -> None:
    modes = options.get("modes", options.get("most", 0))
    if rows > MOST_BARS or modes > MOST_MODES or options.get("members", 1) < 1:
        raise ValueError(f"a series of {rows} bars with {options} is beyond the bounds ({MOST_BARS} bars, {MOST_MODES} modes)")


def decompose(panel: DataFrame, column: str, method: str = "emd", entity: str = "ticker", time: str = "date", **options) -> DataFrame:
    """One row a (date, ticker, mode): mode values of each entity's whole series; mode -1 is the residual."""
    kinds = {f.name: f.dataType.simpleString() for f in panel.schema.fields}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time, kind="stable")
        _bounded(len(rows), options)
        m = METHODS[method](rows[column].to_numpy(float), **options)
        parts = [(-1, m.residual), *enumerate(m.modes)]
        return pd.concat([pd.DataFrame({time: rows[time], entity: rows[entity], "mode": k, "value": v}) for k, v in parts])

    return panel.select(time, entity, column).where(f"{column} is not null").groupBy(entity).applyInPandas(run, f"{time} {kinds[time]}, {entity} {kinds[entity]}, mode int, value double")
