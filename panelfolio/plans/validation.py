"""Overfitting checks over many parameter sets; one backtest of the grid serves every window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.operators import bootstrap as BS
from panelfolio.operators import folds as W
from panelfolio.operators import metrics as M
from panelfolio.operators.panel import Panel
from panelfolio.params import ParamSet, selection_grid
from panelfolio.plans.backtest import backtest
from panelfolio.session import stage


def grid_returns(panel: Panel, dim: DataFrame, grid: list[ParamSet] | None = None, flags: DataFrame | None = None) -> DataFrame:
    """Full-period daily returns of the grid, written once and sliced by every window."""
    return stage(backtest(panel, dim, grid or selection_grid(), flags), "grid")


def fold_results(returns: DataFrame, windows: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report per window, summary): the summary holds the stitched test metrics, the full-sample best and the decay."""
    windows = stage(windows, "windows")
    scores = stage(W.window_scores(returns, windows), "scores")
    oos = M.perf(W.stitched_returns(returns, scores, windows), ("universe",), order="seq")
    by = Window.partitionBy("universe").orderBy(F.desc("sharpe"), "run_id")
    best = (M.perf(returns).withColumn("_k", F.row_number().over(by)).filter("_k = 1")
            .select("universe", F.col("run_id").alias("best_run"), F.col("sharpe").alias("best_sharpe")))
    decay = F.when(F.col("best_sharpe") > 0, F.col("sharpe") / F.nullif(F.col("best_sharpe"), F.lit(0.0)))
    return W.fold_report(scores, windows, calendar), oos.join(best, "universe").withColumn("decay", decay)


def walk_forward(panel: Panel, returns: DataFrame, train_years: int = 5, test_years: int = 1) -> tuple[DataFrame, DataFrame]:
    return fold_results(returns, W.walk_forward_windows(panel.calendar, 126, train_years, test_years), panel.calendar)


def purged_cv(panel: Panel, returns: DataFrame, n_splits: int = 6, label_horizon: int = 21, embargo: int = 21) -> tuple[DataFrame, DataFrame]:
    return fold_results(returns, W.purged_folds(panel.calendar, n_splits, label_horizon, embargo), panel.calendar)


def overfit_ranks(panel: Panel, returns: DataFrame, n_splits: int = 6, label_horizon: int = 21, embargo: int = 21) -> DataFrame:
    windows = W.purged_folds(panel.calendar, n_splits, label_horizon, embargo)
    return W.rank_of_best(stage(W.window_scores(returns, windows), "scores"))


def overfit_probability(ranks: DataFrame) -> DataFrame:
    """Share of folds whose training winner lands in the lower half of the test ranking."""
    lower = (F.col("test_rank") >= F.floor(F.col("n_runs") / 2)).cast("double")
    return ranks.groupBy("universe").agg(F.avg(lower).alias("pbo"), F.count(F.lit(1)).alias("n_folds"))


def compare(returns: DataFrame, pairs: list[tuple[str, str]], n_boot: int = 2000, block: int = 21, seed: int = 7) -> DataFrame:
    """Paired bootstrap of several run pairs in one job."""
    return BS.paired_bootstrap(stage(BS.pair_series(returns, pairs), "pairs"), n_boot, block, seed)
