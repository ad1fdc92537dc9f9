"""Queries of the feature matrices, spectra, decompositions, splits, graphs, models and streams."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.shared import written
from marlstone.functions.trail import Trail
from marlstone.operators import contracts as ct
from marlstone.operators import decomposition as de
from marlstone.operators import features as fe
from marlstone.operators import graphs as gr
from marlstone.operators import models as mo
from marlstone.operators import recursive as rc
from marlstone.operators import sequence_net as sn
from marlstone.operators import spectral as sp
from marlstone.operators import splits as sl
from marlstone.plans import panels as P
from marlstone.plans import feature_queries, section_queries
from marlstone.plans.feature_queries import agg, div, lag
from marlstone.plans.section_queries import _rank, _round, _round_sql, _smooth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = ["date", "ticker"]


def region(s: SparkSession, d: str) -> DataFrame:
    return P.with_market(P.with_returns(P.region_day(s, d)))


# contracts: every default one against SQL. Those with a query of their own read its SQL.
_FROM = {
    "ret_1d": ("t01_simple_returns", "r1"), "ret_5d": ("t01_simple_returns", "r5"), "logret_1d": ("t02_log_returns", "x"), "vwap_dev_21": ("t18_vwap_deviation", "x"), "resid_63": ("t19_regression_residual", "x"),
    "parkinson_vol_21": ("s01_parkinson_volatility", "x"), "garman_klass_vol_21": ("s02_garman_klass_volatility", "x"), "rogers_satchell_vol_21": ("s03_rogers_satchell_volatility", "x"), "ewma_vol_21": ("s04_ewma_volatility", "x"),
    "skew_63": ("s05_rolling_skewness", "x"), "kurt_63": ("s06_rolling_kurtosis", "x"), "downside_dev_63": ("s07_downside_deviation", "x"), "mad_63": ("s08_median_absolute_deviation", "x"),
    "corr_mkt_63": ("s09_rolling_correlation", "x"), "autocorr_1_63": ("s10_autocorrelation", "x"), "pacf_2_63": ("s11_partial_autocorrelation", "x"), "hurst_128": ("s12_hurst_exponent", "x"),
    "var_ratio_5_63": ("s13_variance_ratio", "x"), "mutual_info_mkt_63": ("s14_mutual_information", "x"), "volume_change_1": ("l02_volume_change", "x"), "dollar_volume_21": ("l01_log_dollar_volume", "x"),
    "rel_volume_21": ("l03_relative_volume", "x"), "amihud_21": ("l04_amihud_illiquidity", "x"), "volume_imbalance_21": ("l05_volume_imbalance", "x"), "corwin_schultz_21": ("l06_corwin_schultz_spread", "x"), "roll_spread_21": ("l07_roll_spread", "x"),
}
_pairs = "case when ret is not null and market is not null then 1 end"
_w63 = "over (partition by ticker order by date rows between 62 preceding and current row)"
_HERE = {
    "ret_21d": f"{div('close', lag('close', 21))} - 1", "roc_10": f"{div('close', lag('close', 10))} - 1", **{f"mom_{n}": f"{div('close', lag('close', n))} - 1" for n in (63, 126, 252)}, "mom_252_21": f"{div(lag('close', 21), lag('close', 252))} - 1",
    **{f"ma_dist_{n}": f"{div('close', agg('avg', 'close', n))} - 1" for n in (20, 50, 200)}, **{f"ema_dist_{n}": f"{div('close', _smooth('close', 2 / (n + 1), n // 2))} - 1" for n in (12, 26)},
    "zscore_21": div(f"close - ({agg('avg', 'close', 21)})", agg("stddev_samp", "close", 21)), "reversal_5": f"-({div('close', lag('close', 5))} - 1)",
    "beta_mkt_63": div(f"case when count({_pairs}) {_w63} >= 63 then covar_samp(ret, market) {_w63} end", agg("var_samp", "market", 63)),
}
ALL = [*_HERE, *_FROM, "cs_rank_mom_63", "cs_z_mom_63"]
_masked = ", ".join(f"case when rn >= {ct.get(c).warmup} then {x} end as {c}" for c, x in _HERE.items())
_here = f"select *, {_rank.format('mom_63')} as cs_rank_mom_63, (mom_63 - avg(mom_63) over (partition by date)) / nullif(stddev_samp(mom_63) over (partition by date), 0) as cs_z_mom_63 from (select date, ticker, rn, {_masked} from (select *, row_number() over (partition by ticker order by date) as rn from ({P.market_sql(P.REGION_SQL)})))"
_own = [c for c in ALL if c not in _FROM]
QUERIES["c01_contracts_checked"] = lambda s, d: _round(ct.build(P.region_day(s, d), ALL), K, ["fc_" + c for c in ALL])
_ask = {c: (feature_queries.ORACLES | section_queries.ORACLES)[q] for c, (q, _) in _FROM.items()}
ORACLES["c01_contracts_checked"] = (
    f"select h.date, h.ticker, {', '.join(f'{P.rounded_sql(c)} as fc_{c}' for c in _own)}, {', '.join(f'case when rn >= {ct.get(c).warmup} then {c}.{x} end as fc_{c}' for c, (_, x) in _FROM.items())}"
    f" from ({_here}) h {' '.join(f'left join ({q}) {c} on {c}.date = h.date and {c}.ticker = h.ticker' for c, q in _ask.items())}"
)
QUERIES["c02_contract_matrix"] = lambda s, d: ct.build(P.region_day(s, d))
QUERIES["c03_contract_metadata"] = lambda s, d: ct.metadata(s)

# the model matrix
_Y = "sqrt(252)"
_up, _dn, _m12, _m26 = (f"({_smooth(c, a, n)})" for c, a, n in (("up", 1 / 14, 14), ("dn", 1 / 14, 14), ("close", 2 / 13, 6), ("close", 2 / 27, 13)))
_X0 = {"up": f"case when {lag('close')} is not null then greatest(close - {lag('close')}, 0) end", "dn": f"case when {lag('close')} is not null then greatest({lag('close')} - close, 0) end", "bm": agg("avg", "close", 20, 10), "bs": agg("stddev_samp", "close", 20, 10), "sq": "ret * ret", "px": f"list(close) over (partition by ticker order by date rows between 251 preceding and current row)"}
_X1 = {"f_macd": f"{_m12} - {_m26}", "gain": _up, "loss": _dn}
_X2 = {
    "f_ema_ratio_12": f"{div('close', _m12)} - 1", "f_ema_ratio_26": f"{div('close', _m26)} - 1", "f_rsi_14": "case when loss is null then null when loss = 0 then 100 else 100 - 100 / (1 + gain / loss) end", "f_macd_signal": _smooth("f_macd", 0.2, 9),
    "f_max_dd_252": "case when len(px) >= 126 then list_min(list_transform(range(1, len(px) + 1), lambda i: px[i] / list_max(px[1:i]) - 1)) end",
    "f_ret_1d": "ret", "f_logret_1d": "lret", "f_ret_5d": f"{div('close', lag('close', 5))} - 1", **{f"f_vol_{n}": f"({agg('stddev_samp', 'ret', n, max(2, n // 2))}) * {_Y}" for n in (5, 21, 63)},
    "f_realized_vol_21": f"sqrt(({agg('sum', 'sq', 21, 10)}) * (252.0 / 21))", "f_sharpe_63": f"{div(agg('avg', 'ret', 63, 31), agg('stddev_samp', 'ret', 63, 31))} * {_Y}", **{f"f_ma_ratio_{n}": f"{div('close', agg('avg', 'close', n, n // 2))} - 1" for n in (10, 20, 50, 200)},
    "f_bb_pctb": div("close - (bm - 2 * bs)", "(bm + 2 * bs) - (bm - 2 * bs)"), "f_bb_bandwidth": div("(bm + 2 * bs) - (bm - 2 * bs)", "bm"), **{f"f_mom_{n}": f"{div('close', lag('close', n))} - 1" for n in (21, 63, 126, 252)},
    "f_mom_12_1": f"{div(lag('close', 21), lag('close', 252))} - 1", "f_reversal_5": f"-({div('close', lag('close', 5))} - 1)", "f_zscore_21": div(f"close - ({agg('avg', 'close', 21, 10)})", agg("stddev_samp", "close", 21, 10)),
    "f_log_dollar_volume": "ln(1 + volume * close)", "f_volume_zscore": div(f"volume - ({agg('avg', 'volume', 21, 10)})", agg("stddev_samp", "volume", 21, 10)), "f_relative_volume": div("volume", agg("avg", "volume", 21, 10)),
    "f_beta_63": div(f"case when count({_pairs}) {_w63} >= 31 then covar_samp(ret, market) {_w63} end", agg("var_samp", "market", 63, 31)), "f_drawdown": "close / max(close) over (partition by ticker order by date rows unbounded preceding) - 1",
    "target_forward_return": "lead(close, 1) over (partition by ticker order by date) / nullif(close, 0) - 1",
}
_X3 = {"f_macd_hist": "f_macd - f_macd_signal", "target_direction": "case when target_forward_return is not null then cast(target_forward_return > 0 as int) end"}
for _c in fe.SECTION:
    _X3 |= {f"f_cs_rank_{_c}": _rank.format(f"f_{_c}"), f"f_cs_z_{_c}": f"(f_{_c} - avg(f_{_c}) over (partition by date)) / nullif(stddev_samp(f_{_c}) over (partition by date), 0)"}
MATRIX = ["f_macd", *(c for c in (*_X2, *_X3) if c.startswith("f_")), "target_forward_return", "target_direction"]
MATRIX_SQL = P.market_sql(P.REGION_SQL)
for _layer in (_X0, _X1, _X2, _X3):
    MATRIX_SQL = f"select *, {', '.join(f'{x} as {c}' for c, x in _layer.items())} from ({MATRIX_SQL})"


def matrix(s: SparkSession, d: str, drop: bool = True) -> DataFrame:
    return fe.build_features(region(s, d), drop=drop)


QUERIES["x05_build_features"] = lambda s, d: _round(matrix(s, d), K, MATRIX)
ORACLES["x05_build_features"] = _round_sql("date, ticker", MATRIX, f"select * from ({MATRIX_SQL}) where {' and '.join(f'{c} is not null and isfinite({c}::double)' for c in MATRIX)}")
_scores = {"x06_baseline_momentum": (fe.baseline_momentum, _rank.format("f_mom_12_1")), "x07_baseline_ma_crossover": (fe.baseline_crossover, "coalesce(sign(f_ma_ratio_50 - f_ma_ratio_200), 0)"), "x08_baseline_mean_reversion": (fe.baseline_reversion, _rank.format("f_reversal_5"))}
for _name, (_made, _x) in _scores.items():
    QUERIES[_name] = lambda s, d, made=_made: _round(made(matrix(s, d, False)), K, ["score"])
    ORACLES[_name] = _round_sql("date, ticker", ["score"], f"select *, {_x} as score from ({MATRIX_SQL})")

# spectra
CHANNELS = {"return": "ret", "volume": "lv"}


def channels(s: SparkSession, d: str) -> DataFrame:
    return region(s, d).withColumns({"lv": F.log1p("volume"), "ret": F.col("ret")})




def _windows(s: SparkSession, d: str) -> DataFrame:
    def made(p):
        w = sp.causal_windows(p["volume"].to_numpy(float), 8)
        return {"total": w.sum(1), "oldest": w[:, 0]}

    return rc.along(P.region_day(s, d), made, ["total", "oldest"]).select(*K, "total", "oldest").dropna()


QUERIES["f03_causal_windows"] = _windows
ORACLES["f03_causal_windows"] = f"select date, ticker, list_sum(w) as total, w[1] as oldest from (select date, ticker, list(volume) over (partition by ticker order by date rows between 7 preceding and current row) as w from ({P.REGION_SQL})) where len(w) = 8"
QUERIES["f13_channel_builders"] = lambda s, d: _round(sp.channels(region(s, d)).withColumnsRenamed({"ch_volatility": "volatility", "ch_volume": "lv", "ch_residual": "residual"}), K, ["volatility", "lv", "residual"])


_both = "case when ret is not null and market is not null then 1 end"
_z = "over (partition by ticker order by date rows between 62 preceding and current row)"
ORACLES["f13_channel_builders"] = _round_sql("date, ticker", ["volatility", "lv", "residual"], f"select *, {agg('stddev_samp', 'ret', 21)} as volatility, ln(1 + volume) as lv, ret - {div(f'case when count({_both}) {_z} >= 31 then covar_samp(ret, market) {_z} end', agg('var_samp', 'market', 63, 31))} * market as residual from ({P.market_sql(P.REGION_SQL)})")
QUERIES["f14_spectral_features"] = lambda s, d: sp.build_spectral(channels(s, d), CHANNELS, wavelet=("return",))
QUERIES["f15_spectral_registry"] = lambda s, d: sp.registry(s, list(sp.CHANNELS), ("return",))
QUERIES["f14_all_channels"] = lambda s, d: sp.build_spectral(sp.channels(region(s, d), "R0"), {c: f"ch_{c}" for c in sp.CHANNELS}, wavelet=("return",))
QUERIES["f16_time_frequency_tensor"] = lambda s, d: sp.tensor(channels(s, d), {"return": "ret"}).select(*K, "channel", "observed", F.size("surface").alias("frequencies"), F.aggregate(F.flatten("surface"), F.lit(0.0), lambda a, x: a + x).alias("power"))
QUERIES["f16_scalogram"] = lambda s, d: sp.tensor(channels(s, d), {"return": "ret"}, kind="scalogram").select(*K, "channel", "observed", F.size("surface").alias("scales"))
QUERIES["a14_tensor_normaliser"] = lambda s, d: sp.normalise_tensor(sp.tensor(channels(s, d), {"return": "ret"}), "1992-01-01", "1995-12-31")
QUERIES["e01_emd"] = lambda s, d: de.decompose(region(s, d), "ret", "emd")
QUERIES["e04_vmd"] = lambda s, d: de.decompose(region(s, d), "ret", "vmd", modes=3)
QUERIES["e08_representations"] = lambda s, d: de.representations(region(s, d), "ret", "wavelet", stride=21)
QUERIES["e02_eemd"] = lambda s, d: de.decompose(region(s, d), "ret", "eemd", members=8)
QUERIES["e03_ceemdan"] = lambda s, d: de.decompose(region(s, d), "ret", "ceemdan", members=8)


def _dynamic(s: SparkSession, d: str) -> DataFrame:
    """One-step forecasts of a ticker's return from the market's, by a random-walk regression."""

    def made(p):
        x = np.column_stack([np.ones(len(p)), p["market"].to_numpy(float)])
        k = rc.dynamic_linear(p["ret"].to_numpy(float), x, 1e-4, 0.1)
        return {"forecast": k["forecast"], "variance": k["variance"], "beta": k["coefficients"][:, 1]}

    return rc.along(region(s, d), made, ["forecast", "variance", "beta"]).select(*K, "forecast", "variance", "beta")


QUERIES["v09_dynamic_linear"] = _dynamic
QUERIES["st10_feature_registry"] = lambda s, d: fe.registry(s)
for _f in ("raw", "spectral", "emd", "vmd"):
    QUERIES[f"e08_representations_{_f}"] = lambda s, d, f=_f: de.representations(region(s, d), "ret", f, stride=21)

# splits, sequences
_SPLIT = f"select date, fold, case when i < a - 2 then 'train' when i >= a and i < a + 50 then 'test' end as part from (select *, n - (3 - fold) * 50 as a from (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from (select distinct date from ({P.REGION_SQL}))) cross join (select unnest([0, 1, 2]) as fold)) where a >= 0 and a - 2 >= 100"
QUERIES["v01_walk_forward_split"] = lambda s, d: sl.walk_forward(P.region_day(s, d), 3, 50, 2).groupBy("fold", "part").agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_days"), F.min("date").alias("first"), F.max("date").alias("last"))
ORACLES["v01_walk_forward_split"] = f"select fold, part, count(*) as n_rows, count(distinct p.date) as n_days, min(p.date) as first, max(p.date) as last from ({P.REGION_SQL}) p join ({_SPLIT}) f on p.date = f.date where part is not null group by fold, part"
QUERIES["v06_panel_sequences"] = lambda s, d: sl.sequences(P.region_day(s, d), ["volume"], 5).select(*K, F.element_at("sequence", 1)[0].cast("double").alias("oldest"), F.size(F.filter("valid", lambda x: x)).alias("n"))
ORACLES["v06_panel_sequences"] = f"select date, ticker, coalesce(cast(lag(volume, 4) over (partition by ticker order by date) as float), 0)::double as oldest, least(5, row_number() over (partition by ticker order by date))::int as n from ({P.REGION_SQL})"

# graphs
_MARKS = "select date as as_of from (select date, row_number() over (order by date) as i from (select distinct date from ({0}))) where i % 21 = 0"


def graph(s: SparkSession, d: str) -> DataFrame:
    r = P.with_returns(P.region_day(s, d))
    days = r.select("date").distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))
    marks = days.where("i % 21 = 0").select(F.col("date").alias("as_of"))
    return gr.edges(gr.window_before(r, marks, 100), threshold=0.02, degree=2)


def _partial(s: SparkSession, d: str) -> DataFrame:
    r = P.with_returns(P.region_day(s, d))
    days = r.select("date").distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))
    marks = days.where("i % 21 = 0 and i > 100").select(F.col("date").alias("as_of"))
    return gr.partial_edges(gr.window_before(r, marks, 100), threshold=0.02, degree=2)


QUERIES["v12_partial_correlation_graph"] = _partial
_days = f"(select date, row_number() over (order by date) as i from (select distinct date from ({P.REGION_SQL})))"
_near = f"(select d.date, m.as_of from {_days} d join (select date as as_of, i as at from {_days} where i % 21 = 0) m on d.i < m.at and d.i >= m.at - 100)"
_win = f"(select n.as_of, r.* from ({P.returns_sql(P.REGION_SQL)}) r join {_near} n on r.date = n.date)"
# a correlation that is not defined (no spread) is no edge; DuckDB gives NaN, which is above any threshold
_edges = f"select as_of, src, dst, w / nullif(sum(w) over (partition by as_of, src), 0) as weight from (select *, row_number() over (partition by as_of, src order by w desc, dst) as place from (select a.as_of, a.ticker as src, b.ticker as dst, abs(corr(a.ret, b.ret)) as w from {_win} a join {_win} b on a.as_of = b.as_of and a.date = b.date where a.ticker <> b.ticker and a.ret is not null and b.ret is not null group by 1, 2, 3) where w >= 0.02 and isfinite(w)) where place <= 2"
QUERIES["v12_dynamic_graph"] = lambda s, d: _round(graph(s, d), ["as_of", "src", "dst"], ["weight"])
ORACLES["v12_dynamic_graph"] = _round_sql("as_of, src, dst", ["weight"], _edges)


def _messages(s: SparkSession, d: str) -> DataFrame:
    g = graph(s, d)
    x = P.with_returns(P.region_day(s, d)).join(g.select("as_of").distinct(), F.col("date") == F.col("as_of")).select("as_of", "ticker", F.col("ret").alias("x"))
    return gr.pass_messages(x, g, 0.5, 1)


QUERIES["v13_message_passing"] = lambda s, d: _round(_messages(s, d), ["as_of", "ticker"], ["x"])
ORACLES["v13_message_passing"] = _round_sql("as_of, ticker", ["x"], f"with e as ({_edges}), x as (select date as as_of, ticker, coalesce(ret, 0) as x from ({P.returns_sql(P.REGION_SQL)}) where date in (select as_of from e)) select x.as_of, x.ticker, 0.5 * x.x + 0.5 * coalesce(m.m, 0) as x from x left join (select e.as_of, e.src as ticker, sum(e.weight * y.x) as m from e join x y on e.as_of = y.as_of and e.dst = y.ticker group by 1, 2) m on x.as_of = m.as_of and x.ticker = m.ticker")


def _shrunk(s: SparkSession, d: str) -> DataFrame:
    names = ["R0", "R1", "R2", "R3", "R4"]
    wide = P.with_returns(P.region_day(s, d)).groupBy("date").pivot("ticker", names).agg(F.first("ret"))
    n, _, cov = gr.moments(wide, names)
    found, rate = gr.oas(n, cov)
    return s.createDataFrame([(a, b, float(found[i, j]), float(rate)) for i, a in enumerate(names) for j, b in enumerate(names)], "src string, dst string, covariance double, shrinkage double")


QUERIES["a16_v11_shrinkage_covariance"] = _shrunk


# models
KINDS = ["logistic", "random_forest"]


def _modelled(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = matrix(s, d).drop("target_forward_return")
    return mo.walk_forward(sl.walk_forward(rows, 3, 120, 2, 252), fe.feature_columns(rows), KINDS)


QUERIES["v04_walk_forward_train"] = lambda s, d: _modelled(s, d)[0].select(*K, "fold", "score", *(f"candidate_{k}" for k in KINDS), "target_direction")


def _isotonic(s: SparkSession, d: str) -> DataFrame:
    rows = matrix(s, d).drop("target_forward_return")
    folds = sl.walk_forward(rows, 2, 252, 2, 252)
    return mo.walk_forward(folds, fe.feature_columns(rows), ["logistic", "gbt"], method="isotonic")[1]


QUERIES["v03_isotonic_importances"] = _isotonic
_SEQUENCE = ["f_ret_1d", "f_vol_21", "f_mom_21", "f_rsi_14", "f_zscore_21", "f_relative_volume"]


def _sequence_net(s: SparkSession, d: str) -> DataFrame:
    rows = sn.with_sequences(matrix(s, d).select(*K, *_SEQUENCE, "target_direction"), _SEQUENCE, 16)
    return sn.walk_forward(sl.walk_forward(rows, 2, 252, 2, 252), _SEQUENCE, "target_direction")[0].select(*K, "fold", "score", "target_direction")


QUERIES["v07_sequence_net"] = _sequence_net
DRAWS, WARMUP = 500, 250


def _posterior(s: SparkSession, d: str, until: str = "2999-12-31") -> DataFrame:
    return written(mo.gibbs(s, P.with_returns(P.region_day(s, d)).where(F.col("date") < until), DRAWS, WARMUP), "posterior")


def _split_at(s: SparkSession, d: str, share: float = 0.8) -> str:
    """The date up to which a share of all dates lies."""
    return str(P.region_day(s, d).agg(F.date_from_unix_date(F.percentile(F.unix_date("date").cast("double"), share).cast("int")).alias("at")).first()["at"])


def _held_out(s: SparkSession, d: str) -> DataFrame:
    at = _split_at(s, d)
    return mo.log_predictive_density(_posterior(s, d, at), P.with_returns(P.region_day(s, d)).where(F.col("date") >= at))


QUERIES["v15_hierarchical_returns"] = _posterior
QUERIES["v16_held_out_density"] = _held_out
QUERIES["v16_predictive_draws"] = lambda s, d: mo.predictive(_posterior(s, d), 5)
QUERIES["v16_posterior_checks"] = lambda s, d: mo.posterior_checks(_posterior(s, d), P.with_returns(P.region_day(s, d)))
QUERIES["v16_shrinkage"] = lambda s, d: mo.shrinkage(_posterior(s, d), P.with_returns(P.region_day(s, d)))


def _convergence(s: SparkSession, d: str) -> DataFrame:
    """Split R-hat and effective sample size of each asset's mean, in a task for each asset."""

    def run(f):
        x = f.sort_values(["chain", "draw"])["mu"].to_numpy(float).reshape(f["chain"].nunique(), -1)
        return pd.DataFrame({"asset": [f["asset"].iloc[0]], "r_hat": [mo.split_r_hat(x)], "ess": [mo.effective_sample_size(x)]})

    return _posterior(s, d).groupBy("asset").applyInPandas(run, "asset string, r_hat double, ess double")


QUERIES["m13_convergence"] = _convergence


def _scenarios(s: SparkSession, d: str) -> DataFrame:
    """Scenarios through the correlations of the assets' returns over the dates they have in common."""
    returns = P.with_returns(P.region_day(s, d))
    post = _posterior(s, d).toPandas()
    names = sorted(post["asset"].unique())
    _, _, cov = gr.moments(returns.groupBy("date").pivot("ticker", names).agg(F.first("ret")), names)
    spread = np.sqrt(np.diag(cov))
    return mo.scenarios(s, post, cov / np.outer(spread, spread), 2000)


QUERIES["n01_scenarios"] = _scenarios
QUERIES["n03_coherence"] = lambda s, d: mo.coherence(_scenarios(s, d))


def _policies(s: SparkSession, d: str) -> DataFrame:
    sc = written(_scenarios(s, d), "scenarios")
    wide = sc.groupBy("scenario").pivot("asset").agg(F.first("ret")).orderBy("scenario").drop("scenario").toPandas()
    x = wide.to_numpy()
    made = mo.policies(x.mean(0), np.cov(x.T), x)
    w = s.createDataFrame([(p, a, float(v)) for p, ws in made.items() for a, v in zip(wide.columns, ws, strict=True)], "policy string, asset string, weight double")
    realised = P.with_returns(P.region_day(s, d)).groupBy(F.col("ticker").alias("asset")).agg(F.max_by("ret", "date").alias("ret"))
    return mo.evaluate_policies(sc, w, cost=0.001, realised=realised)


QUERIES["n03_policies"] = _policies


def _ready(s: SparkSession, d: str) -> DataFrame:
    """The readiness gate over the portfolio's own figures."""
    from marlstone.plans import portfolio_queries as pq

    r = pq.risk.summary(pq.Book(s, d).with_market()).first().asDict()
    evidence = {k: r.get(k) for k in ("sharpe", "max_drawdown", "hit_rate", "volatility")}
    _, rows = mo.readiness(evidence, {"sharpe": (">=", 0.5), "max_drawdown": (">=", -0.25), "hit_rate": (">=", 0.5), "volatility": ("<=", 0.3)})
    return s.createDataFrame([(x["criterion"], x["observed"], x["rule"], x["passed"]) for x in rows], "criterion string, observed double, rule string, passed boolean")


QUERIES["g06_readiness"] = _ready
