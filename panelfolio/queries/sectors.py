"""Baskets of brands: cross-section selection, slot timing, gates; and asset pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfolio import testpanel as T
from panelfolio.operators import accounting as B
from panelfolio.operators import metrics as M
from panelfolio.operators import pairs as PR
from panelfolio.operators import panel as P
from panelfolio.operators import signals as G
from panelfolio.operators import weights as A
from panelfolio.plans import reports as R
from panelfolio.plans.backtest import backtest
from panelfolio.queries.common import market, query, rounded
from panelfolio.queries.portfolios import FULL, dim
from panelfolio.session import stage

MIN_ROW, TOP = 200, 3
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def basket(spark: SparkSession, sf: str) -> P.Panel:
    """Brand panel with every gap carried forward; real prices are the rows with is_filled = false."""
    px = stage(T.test_prices(spark, sf, asset="p_brand", universe=F.lit("brands")), "prices")
    return on_own_months(P.prepare_panel(px, limit=None, staged=True))


def on_own_months(panel: P.Panel) -> P.Panel:
    """Rebalance on every date that ends a month for some asset."""
    real = panel.obs.filter("not is_filled")
    out = P.with_rebalance_dates(panel, P.own_month_ends(real, MIN_ROW))
    return P.Panel(stage(out.obs, "obs"), out.calendar)


def method_targets(panel: P.Panel, n: int = TOP) -> DataFrame:
    """Momentum, low volatility and reversal: top n of each score at equal weights."""
    scores = {"momentum": G.momentum_score(panel.obs.filter("not is_filled")), "low_vol": G.low_vol_score(panel.obs), "reversal": G.reversal_score(panel.obs)}
    out = None
    for name, s in scores.items():
        t = A.cross_section_targets(s, panel, name, n, 0)
        out = t if out is None else out.unionByName(t)
    return out


def basket_returns(panel: P.Panel, n: int = TOP) -> DataFrame:
    """The three selections and the equal-weight reference, from the first rebalance on."""
    first = P.rebalances(panel.calendar).groupBy("universe").agg(F.min("reb_row").alias("need"))
    runs = first.select("universe", F.explode(F.array(*[F.lit(r) for r in ("momentum", "low_vol", "reversal", "equal")])).alias("run_id"), "need")
    targets = stage(method_targets(panel, n).unionByName(A.equal_weight_targets(panel, "equal")), "targets")
    return B.backtest_targets(targets, panel, runs)


def slot_timing(panel: P.Panel, n: int) -> DataFrame:
    """Each asset timed on its own and worth 1/n of the book; days without a row add nothing."""
    real = panel.obs.filter("not is_filled")
    long_enough = P.min_history(real, MIN_ROW + 126)
    own = P.Panel(long_enough, panel.calendar)
    return B.slot_book(own, G.ts_momentum(long_enough, True), MIN_ROW, "slots", n)


@query
def cross_section_targets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(method_targets(basket(spark, sf)))


@query
def basket_methods(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.perf(basket_returns(basket(spark, sf))))


@query
def slot_timing_perf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.perf(slot_timing(basket(spark, sf), len(BRANDS))))


@query
def basket_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Every selection and the slot book against the overlay run: three gates in one aggregate."""
    panel = basket(spark, sf)
    base = backtest(market(spark, sf), dim(spark), [FULL]).withColumn("universe", F.lit("brands"))
    both = basket_returns(panel).select("universe", "run_id", "dt", "net").unionByName(slot_timing(panel, len(BRANDS)).select("universe", "run_id", "dt", "net"))
    return rounded(M.three_gates(stage(both, "candidates"), base))


@query
def basket_vs_equal(spark: SparkSession, sf: str) -> DataFrame:
    runs = stage(basket_returns(basket(spark, sf)), "runs")
    return rounded(M.beats_reference(runs, runs.filter("run_id = 'equal'")))


CUTOFFS = {"long": ("1995-01-04", 3), "full": ("1996-01-01", 4)}


@query
def two_panels(spark: SparkSession, sf: str) -> DataFrame:
    """The methods on two baskets that differ by listing cutoff and start, as two universes of one panel."""
    px = stage(T.test_prices(spark, sf, asset="p_brand", universe=F.lit("brands")), "prices")
    out = None
    for name, (cutoff, n) in CUTOFFS.items():
        kept = P.min_history(px, 750, cutoff).filter(F.col("dt") >= F.to_date(F.lit(cutoff))).withColumn("universe", F.lit(name))
        r = basket_returns(on_own_months(P.prepare_panel(kept, limit=None, staged=True)), n)
        out = r if out is None else out.unionByName(r)
    return rounded(M.perf(out))


@query
def high_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of brands whose carried prices correlate at 0.2 or more; brands that start late are compared on common dates."""
    return rounded(M.high_correlations(basket(spark, sf).obs, "asset", "close", 0.2))


ASSETS = [*T.TYPES.pool, T.TYPES.bond]


@query
def pair_spread_z(spark: SparkSession, sf: str) -> DataFrame:
    z = PR.spread_z(PR.pair_prices(market(spark, sf), ASSETS))
    return rounded(z.select("universe", "a", "b", "dt", "beta", "z"))


@query
def pair_states(spark: SparkSession, sf: str) -> DataFrame:
    s = PR.hysteresis_state(PR.spread_z(PR.pair_prices(market(spark, sf), ASSETS)))
    return s.select("universe", "a", "b", "dt", "pos")


@query
def pair_perf(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair and the equal mean of all pairs."""
    s = PR.hysteresis_state(PR.spread_z(PR.pair_prices(market(spark, sf), ASSETS)))
    each = stage(PR.pair_returns(s), "pairs")
    mean = each.groupBy("universe", "dt").agg(F.avg("net").alias("net")).withColumn("run_id", F.lit("mean"))
    trades = each.groupBy("universe", "run_id").agg(F.count_if("changed").alias("n_trades"))
    cols = ["universe", "run_id", "dt", "net"]
    return rounded(M.perf(each.select(*cols).unionByName(mean.select(*cols))).join(trades, ["universe", "run_id"], "left").na.fill(0, ["n_trades"]))


@query
def pair_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen lag, statistic and probability of every pair."""
    return rounded(PR.cointegration(PR.pair_prices(market(spark, sf), ASSETS)))


@query
def pair_screen(spark: SparkSession, sf: str) -> DataFrame:
    tests = PR.cointegration(PR.pair_prices(market(spark, sf), ASSETS))
    return rounded(PR.pair_screen(tests))
