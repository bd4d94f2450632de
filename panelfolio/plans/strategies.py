"""Strategies yield a targets table for a whole panel; combiners are strategies themselves and nest."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.operators import signals as G
from panelfolio.operators import weights as A
from panelfolio.operators.covariance import min_variance_weights, pair_weights, shrunk_covariance
from panelfolio.operators.panel import ASSET, Panel, rebalances
from panelfolio.params import ParamSet
from panelfolio.session import stage

FIRST_ROW = 126
TARGETS = ("universe", "run_id", "reb_no", "asset", "weight")


class Strategy(Protocol):
    """targets(universe, run_id, reb_no, asset, weight): no rows = keep holdings, an explicit 0 = sell out."""

    name: str

    def targets(self, panel: Panel, dim: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class OverlayStrategy:
    """Pool selection with the stacked overlays."""

    params: ParamSet
    name: str = "overlay"

    def targets(self, panel: Panel, dim: DataFrame) -> DataFrame:
        return A.decide_targets(panel, dim, [self.params]).withColumn("run_id", F.lit(self.name)).select(*TARGETS)


@dataclass(frozen=True)
class AssetMomentum:
    """All in one asset while it trends up, else out (an explicit zero)."""

    asset: str
    with_trend: bool = True
    name: str = "asset_momentum"

    def targets(self, panel: Panel, dim: DataFrame) -> DataFrame:
        sig = G.ts_momentum(panel.obs.filter(F.col("asset") == self.asset), self.with_trend)
        at = A.in_force_at_rebalances(sig).join(rebalances(panel.calendar), ["universe", "reb_no"])
        return at.filter(F.col("reb_row") >= FIRST_ROW).select(
            "universe", F.lit(self.name).alias("run_id"), "reb_no", "asset", F.col("signal").alias("weight"))


@dataclass(frozen=True)
class PythonStrategy:
    """Escape hatch: any per-decision Python on the recent closes of the listed assets.

    ``decide(closes)`` gets a frame (asset, k, close), newest k = 0, the whole past of each asset or its last
    ``history`` rows, and returns (asset, weight) rows. The history of an asset is one row; a task gets it once for ``together``
    decisions and cuts it for each of them.
    """

    decide: Callable[[pd.DataFrame], pd.DataFrame]
    assets: tuple[str, ...]
    history: int | None = None
    name: str = "python"
    together: int = 24

    def targets(self, panel: Panel, dim: DataFrame) -> DataFrame:
        obs = panel.obs.filter(F.col("asset").isin(*self.assets))
        whole = obs.groupBy(*ASSET).agg(F.array_sort(F.collect_list(F.struct("row_no", "close"))).alias("_h"))
        whole = whole.select(*ASSET, F.transform("_h", lambda h: h["row_no"]).alias("rows"), F.transform("_h", lambda h: h["close"]).alias("closes"))
        rebs = rebalances(panel.calendar).filter(F.col("reb_row") >= FIRST_ROW)
        chunks = rebs.groupBy("universe", F.floor(F.col("reb_no") / self.together).alias("chunk")).agg(
            F.array_sort(F.collect_list(F.struct("reb_row", "reb_no"))).alias("_r"))
        chunks = chunks.select("universe", "chunk", F.transform("_r", lambda r: r["reb_no"]).alias("reb_nos"), F.transform("_r", lambda r: r["reb_row"]).alias("reb_rows"))
        decide, name, history = self.decide, self.name, self.history

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            head, out = pdf.iloc[0], []
            for reb_no, reb_row in zip(head["reb_nos"], head["reb_rows"]):
                parts = []
                for asset, rows, closes in zip(pdf["asset"], pdf["rows"], pdf["closes"]):
                    end = int(np.searchsorted(rows, reb_row, "right"))
                    first = 0 if history is None else max(0, end - history)
                    parts.append(pd.DataFrame({"asset": asset, "k": np.arange(end - first), "close": np.asarray(closes)[first:end][::-1]}))
                closes = pd.concat(parts, ignore_index=True)
                if len(closes):
                    got = decide(closes)
                    out += [(head["universe"], name, reb_no, a, float(w)) for a, w in zip(got["asset"], got["weight"])]
            return pd.DataFrame(out, columns=list(TARGETS))

        return chunks.join(whole, "universe").groupBy("universe", "chunk").applyInPandas(
            run, "universe string, run_id string, reb_no int, asset string, weight double")


def _members(strategies: tuple, panel: Panel, dim: DataFrame) -> DataFrame:
    out = None
    for i, s in enumerate(strategies):
        t = s.targets(panel, dim).select(*TARGETS).withColumn("member", F.lit(i))
        out = t if out is None else out.unionByName(t)
    return out


@dataclass(frozen=True)
class Blend:
    """Fixed allocations (equal by default), overlapping assets add up."""

    strategies: tuple
    allocs: tuple[float, ...] | None = None
    name: str = "blend"

    def __post_init__(self):
        if not self.strategies:
            raise ValueError("a blend needs a strategy")
        if self.allocs is not None and (len(self.allocs) != len(self.strategies) or sum(self.allocs) <= 0):
            raise ValueError("one allocation per strategy with a positive sum")

    def targets(self, panel: Panel, dim: DataFrame) -> DataFrame:
        a = self.allocs or (1.0,) * len(self.strategies)
        share = F.get(F.array(*[F.lit(x / sum(a)) for x in a]), F.col("member"))
        rows = _members(self.strategies, panel, dim)
        return (rows.groupBy("universe", F.lit(self.name).alias("run_id"), "reb_no", "asset")
                .agg(F.sum(share * F.col("weight")).alias("weight")))


def member_returns(members: DataFrame, panel: Panel, window: int) -> DataFrame:
    """Returns of each member's previous target over the last common returns: (universe, reb_no, member, k, x, len).

    The previous target is that of the previous month end; k = 1 is the latest return.
    """
    before = members.select("universe", (F.col("reb_no") + 1).alias("reb_no"), "member", "asset", "weight")
    closes = A.closes_at_rebalances(panel.obs.select(*ASSET, "row_no", "reb_before", "n_reb", "close"), window + 1)
    tails = closes.select("universe", "asset", "reb_no", F.filter(A.returns_of(F.col("closes")), lambda r: r.isNotNull()).alias("tail"))
    rows = before.join(tails, ["universe", "asset", "reb_no"]).withColumn(
        "len", F.min(F.size("tail")).over(Window.partitionBy("universe", "reb_no"))).filter("len > 0")
    spread = rows.select("universe", "reb_no", "member", "weight", "tail", "len", F.explode(F.sequence(F.lit(1), F.col("len"))).alias("k"))
    return spread.groupBy("universe", "reb_no", "member", "len", "k").agg(
        F.sum(F.col("weight") * F.element_at("tail", -F.col("k"))).alias("x"))


def _apply(members: DataFrame, allocs: DataFrame, n: int, name: str) -> DataFrame:
    return (members.join(allocs, ["universe", "reb_no", "member"], "left")
            .groupBy("universe", F.lit(name).alias("run_id"), "reb_no", "asset")
            .agg(F.sum(F.coalesce("alloc", F.lit(1.0 / n)) * F.col("weight")).alias("weight")))


@dataclass(frozen=True)
class RiskParityBlend:
    """Allocations by inverse volatility of each member's own recent holdings; equal when any cannot be measured."""

    strategies: tuple
    window: int = 63
    min_weight: float = 0.05
    name: str = "risk_parity"

    def allocations(self, members: DataFrame, panel: Panel) -> DataFrame:
        n = len(self.strategies)
        vol = member_returns(members, panel, self.window).groupBy("universe", "reb_no", "member", "len").agg(
            (F.stddev_samp("x") * F.sqrt(F.lit(252.0))).alias("vol"))
        group = Window.partitionBy("universe", "reb_no")
        usable = (F.col("len") >= self.window // 2) & (F.col("vol") >= 1e-9)
        df = vol.withColumn("_ok", F.count_if(usable).over(group) == n).filter("_ok")
        df = df.withColumn("_inv", 1 / F.col("vol"))
        df = df.withColumn("_a", F.greatest(F.col("_inv") / F.sum("_inv").over(group), F.lit(self.min_weight)))
        return df.select("universe", "reb_no", "member", (F.col("_a") / F.sum("_a").over(group)).alias("alloc"))

    def targets(self, panel: Panel, dim: DataFrame) -> DataFrame:
        members = stage(_members(self.strategies, panel, dim), "members")
        return _apply(members, self.allocations(members, panel), len(self.strategies), self.name)


@dataclass(frozen=True)
class MinVarianceBlend:
    """Allocations by long-only minimum variance on the shrunk covariance of the members' recent holdings."""

    strategies: tuple
    window: int = 63
    min_weight: float = 0.05
    name: str = "min_variance"

    def allocations(self, members: DataFrame, panel: Panel) -> DataFrame:
        n = len(self.strategies)
        x = member_returns(members, panel, self.window).select(
            "universe", "reb_no", "k", F.col("member").alias("name"), "x")
        complete = F.size(F.collect_set("name").over(Window.partitionBy("universe", "reb_no"))) == n
        x = x.withColumn("_c", complete).filter("_c").drop("_c")
        solve = pair_weights if n == 2 else min_variance_weights
        w = solve(shrunk_covariance(x, ("universe", "reb_no")), ("universe", "reb_no"))
        floor = F.greatest(F.col("weight"), F.lit(self.min_weight))
        return w.select("universe", "reb_no", F.col("name").alias("member"),
                        (floor / F.sum(floor).over(Window.partitionBy("universe", "reb_no"))).alias("alloc"))

    def targets(self, panel: Panel, dim: DataFrame) -> DataFrame:
        members = stage(_members(self.strategies, panel, dim), "members")
        return _apply(members, self.allocations(members, panel), len(self.strategies), self.name)


def alloc_sweep(first: Strategy, second: Strategy, shares: tuple[float, ...], panel: Panel, dim: DataFrame) -> DataFrame:
    """Targets of every split between two strategies, run_id = share of the second. Members are decided once."""
    members = _members((first, second), panel, dim)
    split = F.explode(F.array(*[F.struct(F.lit(f"share_{s:.2f}").alias("run_id"), F.lit(float(s)).alias("share")) for s in shares]))
    rows = members.drop("run_id").withColumn("split", split)
    mix = F.when(F.col("member") == 1, F.col("split.share")).otherwise(1 - F.col("split.share"))
    return rows.groupBy("universe", F.col("split.run_id").alias("run_id"), "reb_no", "asset").agg(
        F.sum(mix * F.col("weight")).alias("weight"))
