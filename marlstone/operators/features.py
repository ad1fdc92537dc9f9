"""The model feature matrix: 41 trailing and cross-sectional columns and the targets."""

from __future__ import annotations

import hashlib
from inspect import getsource

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.nulls import scrub
from marlstone.functions.trail import Trail
from marlstone.operators import cross_sectional as xs
from marlstone.operators import recursive as rc
from marlstone.operators import technical as te
from marlstone.sources.canonical import content_hash, semantic_hash

PREFIX = "f_"
SECTION = ("mom_12_1", "reversal_5", "vol_63", "rsi_14")


def feature_columns(df: DataFrame, block: tuple[str, ...] = ()) -> list[str]:
    return [c for c in df.columns if c.startswith(PREFIX) and c not in block]


def build_features(panel: DataFrame, horizon: int = 1, drop: bool = True) -> DataFrame:
    """``panel`` with returns and ``market``: one grouped pass for recursions, one window for the rest, one by date."""
    c, r = F.col("close"), F.col("ret")

    def smooth(p):
        x = p["close"].to_numpy(float)
        return {"f_ema_ratio_12": x / rc.ema(x, 12) - 1, "f_ema_ratio_26": x / rc.ema(x, 26) - 1, "f_rsi_14": rc.rsi(x), "f_max_dd_252": rc.rolling_max_drawdown(x, 252), **{f"f_{k}": v for k, v in rc.macd(x).items()}}

    d = rc.along(panel, smooth, ["f_ema_ratio_12", "f_ema_ratio_26", "f_rsi_14", "f_macd", "f_macd_signal", "f_macd_hist", "f_max_dd_252"])
    t = Trail(d)
    band, vol = te.bollinger(t, c), te.volume_features(t, F.col("volume"), c)
    made = {"ret_1d": r, "logret_1d": F.col("lret"), "ret_5d": te.simple_return(t, c, 5)}
    made |= {f"vol_{n}": te.rolling_volatility(t, r, n) for n in (5, 21, 63)}
    made |= {"realized_vol_21": te.realized_volatility(t, r), "sharpe_63": te.rolling_sharpe(t, r)}
    made |= {f"ma_ratio_{n}": te.ma_ratio(t, c, n) for n in (10, 20, 50, 200)}
    made |= {"bb_pctb": band["pctb"], "bb_bandwidth": band["bandwidth"]}
    made |= {f"mom_{n}": te.momentum(t, c, n) for n in (21, 63, 126, 252)}
    made |= {"mom_12_1": te.momentum(t, c, 252, 21), "reversal_5": -te.simple_return(t, c, 5), "zscore_21": te.zscore(t, c), **vol}
    made |= {"beta_63": te.rolling_beta(t, r, F.col("market")), "drawdown": te.drawdown(t, c)}
    t.put(**{PREFIX + k: v for k, v in made.items()}, **xs.forward_targets(t, c, horizon))
    d = t.result()
    x = {name: F.col(PREFIX + name) for name in SECTION}
    d = d.withColumns({f"f_cs_rank_{name}": xs.percent_rank_average(c) for name, c in x.items()} | {f"f_cs_z_{name}": xs.zscore(c) for name, c in x.items()})
    wanted = [*feature_columns(d), "target_forward_return", "target_direction"]
    d = scrub(d, wanted)
    return d.dropna(subset=wanted) if drop else d


def _first(df: DataFrame, *names: str) -> Column:
    """The first of the columns that the matrix has; none is an error."""
    for name in names:
        if PREFIX + name in df.columns:
            return F.col(PREFIX + name)
    raise ValueError(f"the matrix has none of {names}")


def baseline_momentum(matrix: DataFrame) -> DataFrame:
    """``score``: cross-sectional rank of 12-1 momentum, of 252-bar momentum where the matrix lacks it."""
    return matrix.withColumn("score", xs.percent_rank_average(_first(matrix, "mom_12_1", "mom_252")))


def baseline_crossover(matrix: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """``score``: sign of the fast ratio less the slow one, zero where unknown; without these, the shortest and longest."""
    have = sorted(int(c.removeprefix("f_ma_ratio_")) for c in matrix.columns if c.startswith("f_ma_ratio_"))
    if not have:
        raise ValueError("the matrix has no price to average ratios")
    fast, slow = (fast, slow) if {fast, slow} <= set(have) else (have[0], have[-1])
    return matrix.withColumn("score", F.coalesce(F.signum(F.col(f"f_ma_ratio_{fast}") - F.col(f"f_ma_ratio_{slow}")), F.lit(0.0)))


def baseline_reversion(matrix: DataFrame) -> DataFrame:
    """``score``: cross-sectional rank of 5-bar reversal."""
    return matrix.withColumn("score", xs.percent_rank_average(_first(matrix, "reversal_5")))


#: Look-back of a column that reads all of its past.
WHOLE_PAST = 1_000_000
_LOOKBACK = {
    "ret_1d": 1, "logret_1d": 1, "ret_5d": 5, "vol_5": 5, "vol_21": 21, "vol_63": 63, "realized_vol_21": 21, "sharpe_63": 63, "ma_ratio_10": 10, "ma_ratio_20": 20, "ma_ratio_50": 50, "ma_ratio_200": 200, "bb_pctb": 20, "bb_bandwidth": 20,
    "mom_21": 21, "mom_63": 63, "mom_126": 126, "mom_252": 252, "mom_12_1": 252, "reversal_5": 5, "zscore_21": 21, "log_dollar_volume": 0, "volume_zscore": 21, "relative_volume": 21, "beta_63": 63, "drawdown": WHOLE_PAST, "max_dd_252": 252,
    "ema_ratio_12": WHOLE_PAST, "ema_ratio_26": WHOLE_PAST, "rsi_14": WHOLE_PAST, "macd": WHOLE_PAST, "macd_signal": WHOLE_PAST, "macd_hist": WHOLE_PAST,
}


def registry(spark: SparkSession) -> DataFrame:
    """One row a column of the matrix: family, inputs, bars it looks back, and a hash of the code that makes it."""
    code = hashlib.sha256((getsource(build_features) + getsource(te) + getsource(rc)).encode()).hexdigest()
    volume = {"log_dollar_volume", "volume_zscore", "relative_volume"}
    rows = [(PREFIX + k, "trailing", ["volume", "close"] if k in volume else ["close", "market"] if k == "beta_63" else ["close"], n, code) for k, n in _LOOKBACK.items()]
    rows += [(f"{PREFIX}cs_{how}_{k}", "cross_section", ["close"], _LOOKBACK[k], code) for k in SECTION for how in ("rank", "z")]
    return spark.createDataFrame(rows, "name string, family string, inputs array<string>, lookback int, implementation string")


def lineage(panel: DataFrame, names: list[str], registered: DataFrame) -> dict:
    """What a store request records of a matrix: the panel's content and each column's registered description."""
    wanted = registered.where(F.col("name").isin(names)).drop("inputs")
    found = {r["name"]: r.asDict() for r in wanted.collect()}
    lost = sorted(set(names) - set(found))
    if lost:
        raise ValueError(f"not registered: {lost}")
    return {"panel": content_hash(panel), "columns": [found[n] for n in names]}


def training_normaliser(df: DataFrame, columns: list[str], first: str, last: str, date: str = "date", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, column, mean, std, n) over the closed interval, std with n below; fitted on nothing later."""
    fit = df.where(F.col(date).between(first, last))
    rows = fit.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))))
    return rows.groupBy(*keys, "column").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("n"))


def normaliser_state(normaliser: DataFrame, first: str, last: str) -> str:
    """A hash of a fitted normaliser and its interval."""
    return semantic_hash([first, last, content_hash(normaliser)])


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join that fails, when read, where either side has a key twice."""

    def once(d: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*on))
        return d.withColumn("__n", n).where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"the {side} side has a key twice")).cast("boolean"))).drop("__n")

    return once(left, "left").join(once(right, "right"), on, "left")
