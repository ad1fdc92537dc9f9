"""Spectral, wavelet and time-frequency operators over causal windows.

Windows end at the current bar. A ticker's series goes through one grouped Arrow pass; all its windows are
transformed at once. Anything undefined is null: short history, a missing value in the window, no power.
"""

from __future__ import annotations

import hashlib
import json
import math
from inspect import getsource

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marlstone.functions.trail import Trail

DESCRIPTORS = ("centroid", "bandwidth", "entropy", "flatness", "rolloff", "peak_frequency", "sparsity", "concentration")
BANDS = (("low", 0.0, 0.1), ("mid", 0.1, 0.25), ("high", 0.25, 0.5))


def taper(name: str, n: int) -> np.ndarray:
    """Symmetric boxcar, hann, hamming or blackman."""
    if name == "boxcar" or n == 1:
        return np.ones(n)
    x = 2 * np.pi * np.arange(n) / (n - 1)
    shape = {"hann": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08)}[name]
    return shape[0] - shape[1] * np.cos(x) + shape[2] * np.cos(2 * x)


def detrend(w: np.ndarray, how: str = "linear") -> np.ndarray:
    """Remove the mean or line of each row; what is rounding noise becomes zero."""
    if how == "none":
        return w
    out = w - w.mean(-1, keepdims=True)
    if how == "linear":
        i = np.arange(w.shape[-1]) - (w.shape[-1] - 1) / 2
        out = out - (out @ i / (i @ i))[..., None] * i
    scale = np.abs(w).max(-1, keepdims=True)
    return np.where(np.abs(out) <= 1e-12 * scale, 0.0, out)


def causal_windows(x: np.ndarray, n: int) -> np.ndarray:
    """Row t holds the n values up to t; rows before are missing."""
    out = np.full((len(x), n), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n)
    return out


def segments(w: np.ndarray, n: int, hop: int) -> np.ndarray:
    """Overlapping parts of each row, oldest first, the last ending at the row's end."""
    k = (w.shape[-1] - n) // hop + 1
    first = w.shape[-1] - n - (k - 1) * hop
    return np.stack([w[..., first + i * hop : first + i * hop + n] for i in range(k)], axis=-2)


def stft(w: np.ndarray, n: int, hop: int, window: str = "hann", how: str = "linear") -> np.ndarray:
    """Magnitudes by row, segment and frequency."""
    return np.abs(np.fft.rfft(detrend(segments(w, n, hop), how) * taper(window, n), axis=-1))


def welch(w: np.ndarray, n: int, hop: int, window: str = "hann", how: str = "linear") -> np.ndarray:
    """One-sided density averaged over segments."""
    p = stft(w, n, hop, window, how) ** 2 / (taper(window, n) ** 2).sum()
    p[..., 1 : (n + 1) // 2] *= 2
    return p.mean(-2)


def frequencies(n: int) -> np.ndarray:
    return np.fft.rfftfreq(n)


def amplitude(w: np.ndarray, window: str = "hann") -> np.ndarray:
    return np.abs(np.fft.rfft(w * taper(window, w.shape[-1]), axis=-1))


def morlet(scale: float, n: int, omega: float = 6.0) -> np.ndarray:
    """One-sided complex wavelet whose centre is the latest bar, without mean, of unit energy."""
    t = np.arange(n)[::-1] / scale
    v = np.exp(-0.5 * t * t) * np.exp(-1j * omega * t)
    v = v - v.mean()
    return v / np.sqrt((np.abs(v) ** 2).sum())


def cwt_power(w: np.ndarray, scales: list[float], omega: float = 6.0) -> np.ndarray:
    """Power at the latest bar of each row by scale."""
    bank = np.stack([morlet(s, w.shape[-1], omega) for s in scales])
    return np.abs(w @ bank.T) ** 2


_FILTERS = {"haar": np.array([1.0, 1.0]) / math.sqrt(2), "db2": np.array([1 + math.sqrt(3), 3 + math.sqrt(3), 3 - math.sqrt(3), 1 - math.sqrt(3)]) / (4 * math.sqrt(2))}


def dwt_energies(w: np.ndarray, levels: int, wavelet: str = "haar") -> np.ndarray:
    """Share of energy of each detail level, then of the approximation; periodic cascade."""
    n = w.shape[-1]
    if n % (1 << levels):
        raise ValueError("the window's length must be a multiple of 2 ** levels")
    low = _FILTERS[wavelet]
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    out, a = [], w
    for _ in range(levels):
        at = (2 * np.arange(a.shape[-1] // 2)[:, None] + np.arange(len(low))) % a.shape[-1]
        parts = a[..., at]
        out.append(((parts @ high) ** 2).sum(-1))
        a = parts @ low
    out.append((a**2).sum(-1))
    e = np.stack(out, -1)
    total = e.sum(-1, keepdims=True)
    return np.divide(e, total, out=np.full_like(e, np.nan), where=total > 0)


def descriptors(psd: np.ndarray, f: np.ndarray, rolloff: float = 0.85, top: int = 3, bands=BANDS) -> dict[str, np.ndarray]:
    """Shape of each row's spectrum; rows without power are missing throughout."""
    total = psd.sum(-1, keepdims=True)
    ok = np.isfinite(total[..., 0]) & (total[..., 0] > 0)
    m = np.divide(psd, total, out=np.full_like(psd, np.nan), where=ok[..., None])
    k = len(f)
    with np.errstate(divide="ignore", invalid="ignore"):
        centre = m @ f
        out = {"centroid": centre, "bandwidth": np.sqrt((m * (f - centre[..., None]) ** 2).sum(-1))}
        out["entropy"] = -np.where(m > 0, m * np.log(np.where(m > 0, m, 1)), 0 * m).sum(-1) / np.log(k)
        out["flatness"] = np.exp(np.log(psd).mean(-1)) / np.where(ok, psd.mean(-1), np.nan)
        out["rolloff"] = np.where(ok, f[np.argmax(np.cumsum(m, -1) >= rolloff, -1)], np.nan)
        out["peak_frequency"] = np.where(ok, f[np.argmax(np.nan_to_num(m), -1)], np.nan)
        norm = np.sqrt((psd**2).sum(-1))
        out["sparsity"] = (math.sqrt(k) - psd.sum(-1) / np.where(norm > 0, norm, np.nan)) / (math.sqrt(k) - 1)
        out["concentration"] = np.sort(m, -1)[..., -min(top, k) :].sum(-1)
        for name, a, b in bands:
            held = (f >= a) & ((f < b) | (b >= f[-1]))
            out[f"band_{name}"] = m[..., held].sum(-1) if held.any() else np.full(m.shape[:-1], np.nan)
        for (a, _, _), (b, _, _) in zip(bands, bands[1:], strict=False):
            low = out[f"band_{b}"]
            out[f"ratio_{a}_{b}"] = out[f"band_{a}"] / np.where(low > 0, low, np.nan)
    return {key: np.where(ok, v, np.nan) for key, v in out.items()}


def flux(magnitudes: np.ndarray) -> np.ndarray:
    """Mean distance between consecutive normalised slices; missing with fewer than two."""
    if magnitudes.shape[-2] < 2:
        return np.full(magnitudes.shape[:-2], np.nan)
    total = magnitudes.sum(-1, keepdims=True)
    m = np.divide(magnitudes, total, out=np.full_like(magnitudes, np.nan), where=total > 0)
    return np.sqrt((np.diff(m, axis=-2) ** 2).sum(-1)).mean(-1)


def channel_columns(channel: str, wavelet: bool = False, levels: int = 3, bands=BANDS) -> list[str]:
    out = [f"f_{channel}_{d}" for d in DESCRIPTORS] + [f"f_{channel}_band_{b[0]}" for b in bands]
    out += [f"f_{channel}_ratio_{a[0]}_{b[0]}" for a, b in zip(bands, bands[1:], strict=False)] + [f"f_{channel}_flux"]
    return out + ([f"f_{channel}_dwt_{i}" for i in range(levels + 1)] if wavelet else [])


def build_spectral(panel: DataFrame, channels: dict[str, str], n: int = 64, seg: int = 32, hop: int = 8, wavelet: tuple[str, ...] = (), entity: str = "ticker", time: str = "date") -> DataFrame:
    """Spectral columns of each channel (name -> panel column) appended to (date, ticker)."""
    cols = [c for ch in channels for c in channel_columns(ch, ch in wavelet)]
    kinds = {f.name: f for f in panel.schema.fields}
    schema = StructType([kinds[time], kinds[entity], *(StructField(c, DoubleType()) for c in cols)])
    f = frequencies(seg)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time, kind="stable")
        if len(rows) * n > MOST_CELLS:
            raise ValueError("a series has too many windows for one task")
        out = {time: rows[time], entity: rows[entity]}
        for ch, source in channels.items():
            w = causal_windows(rows[source].to_numpy(float), n)
            ok = np.isfinite(w).all(1)
            made = {f"f_{ch}_{k}": v for k, v in descriptors(welch(w[ok], seg, hop), f).items()} | {f"f_{ch}_flux": flux(stft(w[ok], seg, hop))}
            if ch in wavelet:
                made |= {f"f_{ch}_dwt_{i}": e for i, e in enumerate(dwt_energies(w[ok], 3).T)}
            for k, v in made.items():
                full = np.full(len(rows), np.nan)
                full[ok] = v
                out[k] = full
        return pd.DataFrame(out)[[x.name for x in schema.fields]]

    return panel.select(time, entity, *dict.fromkeys(channels.values())).groupBy(entity).applyInPandas(run, schema)


def scale_frequencies(scales: list[float], omega: float = 6.0) -> np.ndarray:
    """Centre frequency of each wavelet scale, in cycles a bar."""
    return omega / (2 * np.pi * np.asarray(scales, float))


#: Channels of a panel: what each reads, and the longest look-back before its own window.
CHANNELS = {"return": (("ret",), 1), "volatility": (("ret",), 21), "volume": (("volume",), 0), "residual": (("ret", "market"), 63)}


def channels(panel: DataFrame, benchmark: str | None = None, entity: str = "ticker") -> DataFrame:
    """``panel`` with a column ``ch_<name>`` for each channel: return, 21-bar volatility, log volume, and the residual
    of the return over 63-bar beta times the benchmark's.

    The benchmark is a ticker of the panel, which must be there and has no residual of its own (null); without one
    the equal-weight ``market`` takes its place.
    """
    from marlstone.operators import technical as te

    if benchmark is not None:
        if not panel.where(F.col(entity) == benchmark).limit(1).count():
            raise ValueError(f"the panel lacks the benchmark {benchmark!r}")
        base = panel.where(F.col(entity) == benchmark).select("date", F.col("ret").alias("base"))
        panel = panel.drop("base").join(base, "date", "left")
    else:
        panel = panel.withColumn("base", F.col("market"))
    t = Trail(panel)
    beta = t.series(te.rolling_beta(t, F.col("ret"), F.col("base")))
    residual = F.col("ret") - beta * F.col("base")
    if benchmark is not None:
        residual = F.when(F.col(entity) != benchmark, residual)
    return t.put(ch_return=F.col("ret"), ch_volatility=t.std(F.col("ret"), 21), ch_volume=F.log1p("volume"), ch_residual=residual).result().drop("base")


def registry(spark, wanted: list[str], wavelet: tuple[str, ...] = (), n: int = 64, seg: int = 32, hop: int = 8) -> DataFrame:
    """One row a column: its channel, inputs, look-back in bars, settings and a hash of the code that makes it."""
    code = hashlib.sha256("".join(getsource(f) for f in (taper, detrend, segments, stft, welch, descriptors, flux, dwt_energies)).encode()).hexdigest()
    settings = json.dumps({"window": n, "segment": seg, "hop": hop}, sort_keys=True)
    unknown = sorted(set(wanted) - set(CHANNELS))
    if unknown:
        raise ValueError(f"no channels {unknown}")
    rows = [(c, ch, list(CHANNELS[ch][0]), n + CHANNELS[ch][1], settings, code) for ch in wanted for c in channel_columns(ch, ch in wavelet)]
    return spark.createDataFrame(rows, "name string, channel string, inputs array<string>, lookback int, settings string, implementation string")


#: No ticker's windows may hold more cells than this at once.
MOST_CELLS = 200_000_000


def tensor(panel: DataFrame, channels: dict[str, str], n: int = 64, seg: int = 32, hop: int = 8, entity: str = "ticker", time: str = "date", kind: str = "spectrogram", scales: tuple[float, ...] = (2, 3, 4, 6, 8, 12, 16, 24), steps: int = 3) -> DataFrame:
    """One row a (date, ticker, channel): a surface (frequency or scale by time) and whether it was observed.

    A spectrogram's times are the window's segments; a scalogram's are ``steps`` windows that end ``hop`` bars apart,
    the last at the row's bar, inside the row's window.
    """
    if kind not in ("spectrogram", "scalogram"):
        raise ValueError(f"no surface {kind!r}")
    kinds = {f.name: f for f in panel.schema.fields}
    schema = f"{time} {kinds[time].dataType.simpleString()}, {entity} {kinds[entity].dataType.simpleString()}, channel string, surface array<array<double>>, observed boolean"

    def surface(w: np.ndarray) -> np.ndarray:
        if kind == "spectrogram":
            return np.swapaxes(stft(w, seg, hop) ** 2, 1, 2)
        own = n - (steps - 1) * hop
        return np.stack([cwt_power(detrend(w[:, n - own - back * hop : n - back * hop]), list(scales)) for back in range(steps - 1, -1, -1)], axis=2)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time, kind="stable")
        if len(rows) * n > MOST_CELLS:
            raise ValueError("a series has too many windows for one task")
        out = []
        for ch, source in channels.items():
            w = causal_windows(rows[source].to_numpy(float), n)
            ok = np.isfinite(w).all(1)
            power = surface(np.nan_to_num(w))
            out.append(pd.DataFrame({time: rows[time], entity: rows[entity], "channel": ch, "surface": [p.tolist() if o else None for p, o in zip(power, ok, strict=True)], "observed": ok}))
        return pd.concat(out)

    return panel.select(time, entity, *dict.fromkeys(channels.values())).groupBy(entity).applyInPandas(run, schema)


def normalise_tensor(t: DataFrame, first: str, last: str, time: str = "date", floor: float = 1e-300) -> DataFrame:
    """Log power less its mean over the fit interval, over its deviation, by channel, frequency and time cell."""
    cells = t.where("observed").select(time, "ticker", "channel", F.posexplode("surface").alias("f", "row")).select(time, "ticker", "channel", "f", F.posexplode("row").alias("k", "p"))
    cells = cells.withColumn("x", F.ln(F.greatest("p", F.lit(floor))))
    key = ["channel", "f", "k"]
    fit = cells.where(F.col(time).between(first, last)).groupBy(*key).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n")).where("n >= 2")
    z = (F.col("x") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    return cells.join(fit, key).select(time, "ticker", *key, z.alias("z"))  # as many rows as a surface has cells


def digest(a: np.ndarray) -> str:
    """Hash of type, shape and bytes."""
    a = np.ascontiguousarray(a)
    return hashlib.sha256(f"{a.dtype.str}{a.shape}".encode() + a.tobytes()).hexdigest()


def verify(a: np.ndarray, wanted: str) -> bool:
    """Whether an array still has its digest."""
    return digest(a) == wanted
