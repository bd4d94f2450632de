"""Composed plans: prices to daily returns to metrics, for many parameter sets in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfolio.operators import accounting as B
from panelfolio.operators import weights as A
from panelfolio.operators.panel import Panel
from panelfolio.params import ParamSet
from panelfolio.session import stage


def backtest(panel: Panel, dim: DataFrame, params: list[ParamSet], flags: DataFrame | None = None,
             cost_rate: float = B.COST_RATE) -> DataFrame:
    """Daily returns of every parameter set on every universe of the panel.

    The targets table is small (runs x month ends x pool) but its plan is deep, so it is staged once.
    """
    targets = stage(A.decide_targets(panel, dim, params), "targets")
    runs = B.runs_of(panel, [(p.run_id, p.need) for p in params])
    return B.backtest_targets(targets, panel, runs, flags, cost_rate)


def holdings_log(panel: Panel, dim: DataFrame, params: list[ParamSet]) -> DataFrame:
    """Assets picked at each decision, in rank order."""
    return (A.picks(panel, dim, params).filter("held").groupBy("universe", "run_id", "signal_dt")
            .agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "asset"))),
                                              lambda x: x["asset"])).alias("assets"), F.count(F.lit(1)).alias("n_held")))
