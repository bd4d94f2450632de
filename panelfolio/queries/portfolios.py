"""Targets, backtests, strategy blends and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfolio import testpanel as T
from panelfolio.operators import accounting as B
from panelfolio.operators import bootstrap as BS
from panelfolio.operators import metrics as M
from panelfolio.operators import panel as P
from panelfolio.operators import signals as G
from panelfolio.operators import weights as A
from panelfolio.params import ParamSet, overlay_ladder, universe_dim
from panelfolio.plans import reports as R
from panelfolio.plans import strategies as X
from panelfolio.plans.backtest import backtest, holdings_log as holdings_log_of
from panelfolio.queries.signals import zscore_book
from panelfolio.queries.common import market, prices, query, rounded
from panelfolio.queries.market import FACTORS, limited
from panelfolio.session import stage

BENCH, BOND = T.TYPES.benchmark, T.TYPES.bond
FULL = ParamSet("full", trend_ma=200)
VARIANTS = [FULL, ParamSet("top3", trend_ma=200, hold_all=False), ParamSet("inv_vol", hold_all=False, weighting="inv_vol"),
            ParamSet("capped", hold_all=False, top_n=2, max_weight=0.3, vol_target=None),
            ParamSet("crash", crash_prot=True, crash_thr=0.05, trend_ma=120, trend_cut=0.0),
            ParamSet("skip_risk", skip=21, risk_adj=True, hold_all=False, top_n=4)]


def dim(spark: SparkSession) -> DataFrame:
    return universe_dim(spark, [T.TYPES])


def flags(spark: SparkSession, px: DataFrame) -> DataFrame:
    return P.limit_flags(limited(spark, T.with_preclose(px))).select("universe", "asset", "dt", "cant_buy", "cant_sell")


@query
def targets_variants(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.decide_targets(market(spark, sf), dim(spark), VARIANTS))


@query
def targets_two_tier(spark: SparkSession, sf: str) -> DataFrame:
    """A separate cash-like leg takes the volatility and momentum proceeds, the bond leg the rest."""
    runs = [FULL, ParamSet("top2", hold_all=False, top_n=2, trend_ma=200, max_weight=0.4)]
    return rounded(A.decide_targets(market(spark, sf), universe_dim(spark, [T.TYPES_TWO_TIER]), runs))


@query
def holdings_log(spark: SparkSession, sf: str) -> DataFrame:
    return holdings_log_of(market(spark, sf), dim(spark), [ParamSet("top3", hold_all=False)])


@query
def backtest_ladder(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    rets = backtest(panel, dim(spark), overlay_ladder())
    return rounded(M.perf(R.series(rets, B.buy_and_hold(panel, BENCH, "0_benchmark"))))


@query
def backtest_variants(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.perf(backtest(market(spark, sf), dim(spark), VARIANTS)))


@query
def daily_book(spark: SparkSession, sf: str) -> DataFrame:
    """Every daily column of one run, with NAV and the underwater curve."""
    rets = backtest(market(spark, sf), dim(spark), [FULL])
    return rounded(G.underwater(G.nav(rets)))


@query
def executed_with_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings after each decision when limit days block one side."""
    px = prices(spark, sf)
    panel = market(spark, sf)
    targets = A.decide_targets(panel, dim(spark), VARIANTS[:3])
    out = B.execute_with_limits(B.decision_grid(targets), flags(spark, px), panel.calendar)
    return rounded(out.select("universe", "run_id", "asset", "reb_no", "weight"))


@query
def backtest_limits(spark: SparkSession, sf: str) -> DataFrame:
    px = prices(spark, sf)
    return rounded(M.perf(backtest(market(spark, sf), dim(spark), VARIANTS[:3], flags(spark, px))))


@query
def bench_perf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.perf(B.buy_and_hold(market(spark, sf), BENCH, "bench")))


@query
def bench_60_40(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.perf(B.fixed_mix(market(spark, sf), [(BENCH, 0.6), (BOND, 0.4)], "60_40")))


@query
def static_equal_hold(spark: SparkSession, sf: str) -> DataFrame:
    assets = [*T.TYPES.pool, BOND]
    return rounded(M.perf(B.fixed_mix(market(spark, sf), [(a, 1.0 / len(assets)) for a in assets], "static", 0)))


@query
def turnover(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.annual_turnover(backtest(market(spark, sf), dim(spark), VARIANTS)))


@query
def turnover_attribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.decision_rows(market(spark, sf), dim(spark), [FULL.but("attribution", drawdown_prot=False)])
    return rounded(B.turnover_attribution(rows))


@query
def turnover_top_months(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.largest_turnover(market(spark, sf), dim(spark), FULL.but("attribution", drawdown_prot=False)))


@query
def turnover_causes(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.decision_rows(market(spark, sf), dim(spark), [FULL.but("attribution", drawdown_prot=False)])
    return B.turnover_causes(B.turnover_attribution(rows))


@query
def cost_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.cost_sensitivity(market(spark, sf), dim(spark), FULL, [0.0, 0.00075, 0.003]))


@query
def asset_timing(spark: SparkSession, sf: str) -> DataFrame:
    """Every asset timed by its own momentum, with and without the trend filter."""
    panel = market(spark, sf)
    out = None
    for name, trend, need in (("plain", False, 126), ("trend", True, 200)):
        r = B.single_asset_timing(panel, G.ts_momentum(panel.obs, trend), need).withColumn(
            "run_id", F.concat(F.lit(name + "_"), "asset")).select("universe", "run_id", "dt", "net")
        out = r if out is None else out.unionByName(r)
    return rounded(M.perf(out))


OVERLAY, BONDS = X.OverlayStrategy(FULL), X.AssetMomentum(BOND)


@query
def blend_targets(spark: SparkSession, sf: str) -> DataFrame:
    nested = X.Blend((X.Blend((OVERLAY, BONDS), (3.0, 1.0)), BONDS))
    return rounded(nested.targets(market(spark, sf), dim(spark)))


@query
def risk_parity_targets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.RiskParityBlend((OVERLAY, BONDS)).targets(market(spark, sf), dim(spark)))


@query
def min_variance_targets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.MinVarianceBlend((OVERLAY, BONDS)).targets(market(spark, sf), dim(spark)))


@query
def multi_strategy_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.multi_strategy_report(market(spark, sf), dim(spark), FULL, BOND))


@query
def alloc_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.perf(R.alloc_sweep_returns(OVERLAY, BONDS, (0.0, 0.25, 0.5, 0.75, 1.0), market(spark, sf), dim(spark))))


@query
def path_equality(spark: SparkSession, sf: str) -> DataFrame:
    """A blend of one strategy is that strategy."""
    panel = market(spark, sf)
    direct = backtest(panel, dim(spark), [FULL])
    return rounded(R.path_equality(direct, R.strategy_returns([X.Blend((OVERLAY,))], panel, dim(spark))))


def base_runs(spark: SparkSession, panel: P.Panel) -> DataFrame:
    """full, top3 and the benchmark, staged for several readers."""
    rets = backtest(panel, dim(spark), VARIANTS[:2])
    return stage(R.series(rets, B.buy_and_hold(panel, BENCH, "bench")), "runs")


@query
def return_mix(spark: SparkSession, sf: str) -> DataFrame:
    runs = base_runs(spark, market(spark, sf))
    mix = B.return_mix(runs, [("full", 0.5), ("bench", 0.5)], "half").select(*R.SERIES)
    mean = B.return_mix(runs, [("full", 0.0), ("top3", 0.0), ("bench", 0.0)], "mean", common_only=False).select(*R.SERIES)
    return rounded(M.perf(mix.unionByName(mean)))


@query
def monthly_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.monthly_returns(base_runs(spark, market(spark, sf))).select("universe", "run_id", "dt", "net"))


@query
def annual_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.annual_sharpe(base_runs(spark, market(spark, sf))))


@query
def segment_perf(spark: SparkSession, sf: str) -> DataFrame:
    runs = base_runs(spark, market(spark, sf))
    return rounded(M.segment_perf(runs, [("all", None, None), ("early", None, "1998-06-30"), ("late", "1998-07-01", None),
                                         ("short", "1997-01-01", "1997-01-31")]))


@query
def segment_table(spark: SparkSession, sf: str) -> DataFrame:
    """Return of the benchmark between the first and the last order of every customer: one segment each, from a table."""
    runs = base_runs(spark, market(spark, sf)).filter("run_id = 'bench'")
    spans = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("segment")).agg(
        F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return rounded(M.segment_cumulative_return(runs, spans, 1))


@query
def recent_vs_full(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.recent_vs_full(base_runs(spark, market(spark, sf)), 3))


@query
def capm(spark: SparkSession, sf: str) -> DataFrame:
    runs = base_runs(spark, market(spark, sf))
    bench = runs.filter("run_id = 'bench'").select("universe", "dt", F.col("net").alias("bench"))
    return rounded(M.capm(runs.filter("run_id <> 'bench'"), bench))


@query
def multi_factor(spark: SparkSession, sf: str) -> DataFrame:
    """Two-factor attribution, which has an exact statement in SQL."""
    panel = market(spark, sf)
    factors = P.factor_returns(P.daily_returns(panel), panel.calendar, FACTORS)
    return rounded(M.multi_factor_ols(base_runs(spark, panel), factors, ["MKT", "BOND"]).filter("run_id <> 'bench'"))


SIX = [("MKT", "ECONOMY", None), ("SIZE", "SMALL", "ECONOMY"), ("BOND", "STANDARD", None), ("MID", "MEDIUM", None), ("PROMO", "PROMO", "LARGE"), ("TERM", "LARGE", "STANDARD")]


@query
def multi_factor_six(spark: SparkSession, sf: str) -> DataFrame:
    """Six-factor attribution of the overlay run; the benchmark itself is a factor, so it is no run here."""
    panel = market(spark, sf)
    factors = P.factor_returns(P.daily_returns(panel), panel.calendar, SIX)
    return rounded(M.multi_factor_ols(base_runs(spark, panel).filter("run_id <> 'bench'"), factors, [f for f, _, _ in SIX]))


@query
def stripped_alpha(spark: SparkSession, sf: str) -> DataFrame:
    """Single-factor alpha minus the alpha left after three factors."""
    panel = market(spark, sf)
    runs = base_runs(spark, panel)
    bench = runs.filter("run_id = 'bench'").select("universe", "dt", F.col("net").alias("bench"))
    one = M.capm(runs, bench).select("universe", "run_id", "alpha")
    factors = P.factor_returns(P.daily_returns(panel), panel.calendar, FACTORS[:3])
    many = M.multi_factor_ols(runs, factors, ["MKT", "SIZE", "BOND"]).filter("factor = 'alpha'").select(
        "universe", "run_id", F.col("contribution").alias("factor_alpha"))
    return rounded(one.join(many, ["universe", "run_id"]).withColumn("stripped", F.col("alpha") - F.col("factor_alpha")))


@query
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    factors = P.factor_returns(P.daily_returns(panel), panel.calendar, FACTORS[:3])
    return rounded(M.corr_matrix(factors, "factor", "f_ret"))


@query
def asset_corr_summary(spark: SparkSession, sf: str) -> DataFrame:
    rets = P.daily_returns(market(spark, sf))
    return rounded(M.corr_summary(M.corr_matrix(rets, "asset", "ret"), high=0.05))


@query
def corr_by_regime(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    runs = base_runs(spark, panel)
    pick = lambda n: runs.filter(F.col("run_id") == n)
    return rounded(M.corr_by_regime(pick("full"), pick("bench"), G.regime_labels(panel, BENCH)))


@query
def regime_report(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    return rounded(M.regime_report(base_runs(spark, panel), G.regime_labels(panel, BENCH)))


@query
def deflated_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    """Daily and monthly frequency over a range of trial counts."""
    runs = base_runs(spark, market(spark, sf))
    trials = [10, 50, 100, 200, 500, 1000]
    daily = M.deflated_sharpe(runs, trials, 252).withColumn("freq", F.lit("daily"))
    monthly = M.deflated_sharpe(M.monthly_returns(runs), trials, 12).withColumn("freq", F.lit("monthly"))
    return rounded(daily.unionByName(monthly))


@query
def normal_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Normal distribution function and quantile over customer balances."""
    from panelfolio.functions import scalars as S
    df = T.table(spark, sf, "customer").select("c_custkey", S.norm_cdf(F.col("c_acctbal") / 2000 - 2).alias("cdf"))
    inner = F.least(F.greatest(F.col("cdf"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return rounded(df.withColumn("ppf", S.norm_ppf(inner)), 7)


def candidates(spark: SparkSession, panel: P.Panel) -> tuple[DataFrame, DataFrame]:
    """(candidates, base): bond momentum, 60/40 and the z-score book next to the overlay run."""
    base = stage(backtest(panel, dim(spark), [FULL]).select(*R.SERIES), "base")
    bond = B.single_asset_timing(panel, G.ts_momentum(panel.obs.filter(F.col("asset") == BOND), True), 200).withColumn("run_id", F.lit("bond"))
    z = zscore_book(panel, "zscore")
    mix = B.fixed_mix(panel, [(BENCH, 0.6), (BOND, 0.4)], "60_40")
    return stage(R.series(bond, z, mix), "candidates"), base


@query
def candidate_report(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    runs, base = candidates(spark, panel)
    return rounded(R.candidate_report(runs, base, G.regime_labels(panel, BENCH)))


@query
def candidate_regimes(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate inside each market regime."""
    panel = market(spark, sf)
    return rounded(M.regime_report(candidates(spark, panel)[0], G.regime_labels(panel, BENCH)))


@query
def candidate_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate against the overlay run by paired block bootstrap."""
    runs, base = candidates(spark, market(spark, sf))
    series = BS.pair_series(R.series(runs, base), [(c, FULL.run_id) for c in ("bond", "zscore", "60_40")])
    return rounded(BS.paired_bootstrap(stage(series, "pairs")))
