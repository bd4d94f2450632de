"""Parameter scans, walk-forward, purged folds, bootstrap and stress variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfolio import testpanel as T
from panelfolio.operators import accounting as B
from panelfolio.operators import metrics as M
from panelfolio.operators import panel as P
from panelfolio.params import ParamSet, momentum_weight_grid, robust_grid, sweep_grid, universe_dim, Universe
from panelfolio.plans import reports as R
from panelfolio.plans import validation as V
from panelfolio.plans.backtest import backtest
from panelfolio.functions import tables
from panelfolio.queries.common import ANCHORS, market, query, rounded
from panelfolio.queries.market import limited
from panelfolio.queries.portfolios import BENCH, BOND, FULL, dim
from panelfolio.session import stage

SELECT = FULL.but("select", hold_all=False)
HOLD = FULL.but("hold")
TRAIN_YEARS = 3


@query
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    return rounded(V.walk_forward(panel, V.grid_returns(panel, dim(spark)), TRAIN_YEARS)[0])


@query
def walk_forward_five_years(spark: SparkSession, sf: str) -> DataFrame:
    """The default lengths: five years to train, one to test."""
    panel = market(spark, sf)
    return rounded(V.walk_forward(panel, V.grid_returns(panel, dim(spark)))[0])


@query
def walk_forward_summary(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    return rounded(V.walk_forward(panel, V.grid_returns(panel, dim(spark)), TRAIN_YEARS)[1])


@query
def purged_cv(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    return rounded(V.purged_cv(panel, V.grid_returns(panel, dim(spark)))[0])


@query
def purged_cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    return rounded(V.purged_cv(panel, V.grid_returns(panel, dim(spark)))[1])


@query
def overfit_ranks(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    return rounded(V.overfit_ranks(panel, V.grid_returns(panel, dim(spark))))


@query
def overfit_probability(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    return rounded(V.overfit_probability(V.overfit_ranks(panel, V.grid_returns(panel, dim(spark)))))


@query
def sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Lookback sets x number held."""
    return rounded(M.perf(backtest(market(spark, sf), dim(spark), sweep_grid(FULL.but("s", hold_all=False)))))


@query
def robust(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty one-at-a-time variations around the base."""
    return rounded(M.perf(backtest(market(spark, sf), dim(spark), robust_grid())))


@query
def momentum_weights(spark: SparkSession, sf: str) -> DataFrame:
    grid = [p.but(p.run_id, hold_all=False) for p in momentum_weight_grid()]
    return rounded(M.perf(backtest(market(spark, sf), dim(spark), grid)))


@query
def momentum_weights_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    grid = [p.but(p.run_id, hold_all=False) for p in momentum_weight_grid() if p.run_id in ("equal", "by_length")]
    rets = V.grid_returns(market(spark, sf), dim(spark), grid)
    return rounded(V.compare(rets, [("by_length", "equal")]))


@query
def selection_margin(spark: SparkSession, sf: str) -> DataFrame:
    """Selection against holding everything: paired block bootstrap over the same hashed starts."""
    rets = V.grid_returns(market(spark, sf), dim(spark), [SELECT, HOLD])
    return rounded(V.compare(rets, [("select", "hold"), ("hold", "select")]))


@query
def freeze_test(spark: SparkSession, sf: str) -> DataFrame:
    """Full sample, tuning span and frozen span for three series."""
    panel = market(spark, sf)
    rets = R.series(backtest(panel, dim(spark), [SELECT, HOLD]), B.buy_and_hold(panel, BENCH, "bench"))
    return rounded(M.segment_perf(rets, [("all", None, None), ("tuning", None, "1999-01-01"), ("frozen", "1999-01-01", None)]))


@query
def overlay_review(spark: SparkSession, sf: str) -> DataFrame:
    """Drawdown overlay on and off, and volatility target x weighting."""
    runs = [FULL.but("dd_on"), FULL.but("dd_off", drawdown_prot=False)]
    runs += [FULL.but(f"vt{vt}_{w}", vol_target=vt, weighting=w, hold_all=False) for vt in (None, 0.10, 0.15) for w in ("equal", "inv_vol")]
    return rounded(M.perf(backtest(market(spark, sf), dim(spark), runs)))


ABLATED = ("PROMO", "SMALL")
REDUCED = Universe("types_reduced", tuple(a for a in T.TYPES.pool if a not in ABLATED), bond=BOND, benchmark=BENCH)


@query
def universe_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """The same run with and without two pool assets: two universes in one job."""
    panel = market(spark, sf)
    both = P.union_panels([panel, P.universe_variant(panel, "types", REDUCED.name, list(ABLATED))])
    return rounded(M.perf(backtest(both, universe_dim(spark, [T.TYPES, REDUCED]), [SELECT])))


@query
def bond_stress(spark: SparkSession, sf: str) -> DataFrame:
    """Real, flat and falling bond leg: three universes in one job."""
    panel = market(spark, sf)
    panels, universes = [panel], [T.TYPES]
    for name, annual in (("bond_flat", 0.0), ("bond_falling", -0.02)):
        panels.append(P.synthetic_drift(panel, "types", name, BOND, annual))
        universes.append(Universe(name, T.TYPES.pool, bond=BOND, benchmark=BENCH))
    return rounded(M.perf(backtest(P.union_panels(panels), universe_dim(spark, universes), [FULL])))


def two_markets(spark: SparkSession, sf: str) -> P.Panel:
    by_flag = F.when(F.col("l_returnflag") == "R", "returned").otherwise("kept")
    return P.prepare_panel(stage(T.test_prices(spark, sf, universe=by_flag), "prices"), anchors=ANCHORS, staged=True)


CROSS = [SELECT, HOLD, ParamSet("bare", vol_target=None)]


@query
def cross_market(spark: SparkSession, sf: str) -> DataFrame:
    """Unchanged parameters on two markets, next to each market's benchmark."""
    panel = two_markets(spark, sf)
    rets = backtest(panel, universe_dim(spark, [T.RETURNED, T.KEPT]), CROSS)
    return rounded(M.perf(R.series(rets, B.buy_and_hold(panel, BENCH, "bench"))))


@query
def cross_market_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    panel = two_markets(spark, sf)
    rets = V.grid_returns(panel, universe_dim(spark, [T.RETURNED, T.KEPT]), CROSS[:2])
    return rounded(V.compare(rets, [("select", "hold")]))


@query
def calendar_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Walk-forward and purged windows of the market's calendar by the table function, called from SQL."""
    tables.register(spark)
    days = market(spark, sf).calendar.select("universe", "dt")
    calls = {"walk_forward": "126, 3, 1", "purged": "126, 6, 21, 21"}
    both = [spark.sql(f"select '{kind}' as kind, w.* from calendar_windows(table({{days}}), '{kind}', {numbers}) w", days=days) for kind, numbers in calls.items()]
    return both[0].unionByName(both[1])
