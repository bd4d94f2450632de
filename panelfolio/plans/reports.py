"""Comparison tables composed from backtests and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.operators import accounting as B
from panelfolio.operators import metrics as M
from panelfolio.operators import weights as A
from panelfolio.operators.panel import Panel
from panelfolio.params import ParamSet
from panelfolio.plans import strategies as P
from panelfolio.plans.backtest import backtest
from panelfolio.session import stage

SERIES = ("universe", "run_id", "dt", "row_no", "net")


def series(*frames: DataFrame) -> DataFrame:
    """Union of return series cut to their common columns."""
    out = None
    for f in frames:
        f = f.select(*SERIES)
        out = f if out is None else out.unionByName(f)
    return out


def strategy_returns(strategies: list, panel: Panel, dim: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Daily returns of several strategies in one accounting job."""
    targets = None
    for s in strategies:
        t = s.targets(panel, dim).select(*P.TARGETS)
        targets = t if targets is None else targets.unionByName(t)
    runs = B.runs_of(panel, [(s.name, P.FIRST_ROW) for s in strategies])
    return B.backtest_targets(stage(targets, "targets"), panel, runs, flags)


def alloc_sweep_returns(first, second, shares: tuple[float, ...], panel: Panel, dim: DataFrame) -> DataFrame:
    targets = stage(P.alloc_sweep(first, second, shares, panel, dim), "sweep")
    return B.backtest_targets(targets, panel, B.runs_of(panel, [(f"share_{s:.2f}", P.FIRST_ROW) for s in shares]))


def path_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest absolute NAV difference of two series per universe, with the dates only one of them has."""
    from panelfolio.operators.signals import nav
    left = nav(a, keys=("universe",)).select("universe", "dt", F.col("nav").alias("_a"))
    right = nav(b, keys=("universe",)).select("universe", "dt", F.col("nav").alias("_b"))
    return left.join(right, ["universe", "dt"], "full").groupBy("universe").agg(
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_unmatched"), F.count(F.lit(1)).alias("n_days"))


def multi_strategy_report(panel: Panel, dim: DataFrame, params: ParamSet, bond: str, flags: DataFrame | None = None) -> DataFrame:
    """Both members, their equal blend and the risk-parity blend: metrics plus correlation of the members."""
    overlay, bonds = P.OverlayStrategy(params), P.AssetMomentum(bond)
    runs = stage(strategy_returns([overlay, bonds, P.Blend((overlay, bonds)), P.RiskParityBlend((overlay, bonds))], panel, dim, flags), "runs")
    pick = lambda n: runs.filter(F.col("run_id") == n)
    corr = M.corr_matrix(runs.filter(F.col("run_id").isin(overlay.name, bonds.name)), "run_id", "net").select("universe", "corr")
    return M.perf(runs).join(corr, "universe", "left")


def cost_sensitivity(panel: Panel, dim: DataFrame, params: ParamSet, rates: list[float]) -> DataFrame:
    """Same targets under several cost rates: one backtest, the rate only enters the last column."""
    base = backtest(panel, dim, [params])
    dim_rates = F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("cost_rate")
    rows = base.select("universe", "run_id", "dt", "gross", "turnover", dim_rates)
    rows = rows.withColumn("net", F.col("gross") - F.col("turnover") * F.col("cost_rate"))
    return M.perf(rows, ("universe", "run_id", "cost_rate")).select(
        "universe", "run_id", "cost_rate", "total_return", "cagr", "sharpe", "mdd")


def largest_turnover(panel: Panel, dim: DataFrame, params: ParamSet, k: int = 10) -> DataFrame:
    """The k months with the largest turnover of every universe and run (a report, hence the limit)."""
    rank = Window.partitionBy("universe", "run_id").orderBy(F.desc("turnover"), "signal_dt")
    rows = B.turnover_attribution(A.decision_rows(panel, dim, [params]))
    return rows.withColumn("_k", F.row_number().over(rank)).filter(F.col("_k") <= k).drop("_k")


def candidate_report(candidates: DataFrame, base: DataFrame, regimes: DataFrame) -> DataFrame:
    """All candidate series against the base strategy in one job: own metrics, 50/50 metrics, correlation, gates."""
    b = base.select("universe", "dt", F.col("net").alias("_b"))
    both = candidates.join(b, ["universe", "dt"])
    mixed = both.withColumn("net", 0.5 * F.col("net") + 0.5 * F.col("_b"))
    own = M.perf(candidates).select("universe", "run_id", "cagr", "sharpe", "mdd", "sortino")
    mix = M.perf(mixed).select("universe", "run_id", F.col("cagr").alias("mix_cagr"), F.col("mdd").alias("mix_mdd"))
    bear = both.join(regimes.filter("regime = 'bear'"), ["universe", "dt"]).groupBy("universe", "run_id").agg(
        F.corr("net", "_b").alias("bear_corr"))
    gates = M.three_gates(candidates, base).select("universe", "run_id", "corr", "own_sharpe", "mix_sharpe", "passed")
    keys = ["universe", "run_id"]
    return own.join(mix, keys).join(gates, keys).join(bear, keys, "left")
