"""From target weights to holdings, daily net returns and turnover.

Time line: signal on row t, holdings change on row t + 1, first return earned on row t + 2. Weights do not drift
between rebalances, so a holding is one row per (run, asset, decision), never one per day.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.operators.panel import ASSET, Panel, daily_returns, rebalances
from panelfolio.operators.scan import running
from panelfolio.operators.signals import hold_between_rebalances
from panelfolio.params import COST_RATE

RUN = ("universe", "run_id")


def decisions_of(rows: DataFrame) -> DataFrame:
    """(run, reb_no, dec_no, next_reb, n_dec): the distinct decisions of each run, at most one per rebalance of the calendar."""
    run = Window.partitionBy(*RUN)
    return rows.select(*RUN, "reb_no").distinct().select(
        *RUN, "reb_no", F.row_number().over(run.orderBy("reb_no")).alias("dec_no"),
        F.lead("reb_no").over(run.orderBy("reb_no")).alias("next_reb"), F.count(F.lit(1)).over(run).alias("n_dec"))


def decision_grid(targets: DataFrame) -> DataFrame:
    """Targets with an explicit null target for every decision that leaves a once-targeted asset out.

    A blocked sale is asked for again at each later decision, so the nulls run until the asset returns.
    """
    decisions = decisions_of(targets)
    numbered = targets.join(decisions, [*RUN, "reb_no"])
    decisions = decisions.select(*RUN, "dec_no", "reb_no")
    back = Window.partitionBy(*RUN, "asset").orderBy("dec_no")
    gap = F.coalesce(F.lead("dec_no").over(back), F.col("n_dec") + 1) - F.col("dec_no") - 1
    spread = (numbered.withColumn("_reach", gap)
              .select(*RUN, "asset", "dec_no", "weight", F.explode(F.sequence(F.lit(0), F.col("_reach"))).alias("_k")))
    return (spread.select(*RUN, "asset", (F.col("dec_no") + F.col("_k")).cast("int").alias("dec_no"),
                          F.when(F.col("_k") == 0, F.col("weight")).alias("target"))
            .join(decisions, [*RUN, "dec_no"]))


def execute_all(targets: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every trade fills: holdings(run, asset, weight, reb_no, until, reb_row, trade) without path dependence.

    ``until`` is the last rebalance ordinal a row serves. An asset that a decision leaves out gets one zero row there.
    What comes next is looked up among the distinct decisions; every window over targets is per asset of a run.
    """
    path = "over (partition by universe, run_id, asset order by reb_no)"
    steps = decisions_of(targets).select(*RUN, "reb_no", F.col("dec_no").alias("_dec"), F.col("next_reb").alias("_next"))
    df = targets.join(steps, [*RUN, "reb_no"]).selectExpr(
        "*", f"lag(weight) {path} as _w", f"lag(_dec) {path} as _d", f"lead(_dec) {path} as _e")
    kept = "case when _dec - _d = 1 then _w else 0D end"
    rows = f"""inline(filter(array(
        struct(weight as weight, reb_no as reb_no, _next - 1 as until, abs(weight - coalesce({kept}, 0D)) as trade, true as used),
        struct(0D as weight, _next as reb_no, _next as until, weight as trade,
               _next is not null and coalesce(_e - _dec, 2) > 1 as used)), x -> x.used))"""
    out = df.selectExpr(*RUN, "asset", rows).drop("used")
    return out.join(rebalances(calendar).select("universe", "reb_no", "reb_row", "n_reb"), ["universe", "reb_no"]).withColumn(
        "until", F.coalesce("until", "n_reb")).drop("n_reb")


SOME = math.nextafter(1e-12, 1.0)  # the least weight that a sale finds
EVERY = float("inf")


def _piece(low: Column, high: Column, value: Column) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), value.cast("double").alias("value"))


def decision_map() -> Column:
    """A decision as a map from the old weight to the new one: pieces on which the new weight is a constant, elsewhere the old
    one stays. Where the target cannot be bought old weights below it stay, where it cannot be sold those above it."""
    target, buy, sell = F.col("target"), F.col("cant_buy"), F.col("cant_sell")
    low = F.when(buy, target - 1e-9).otherwise(F.lit(-EVERY))
    high = F.when(sell, target + 1e-9).otherwise(F.lit(EVERY))
    nothing = F.array().cast("array<struct<low:double,high:double,value:double>>")
    leave = F.when(sell, nothing).otherwise(F.array(_piece(F.lit(SOME), F.lit(EVERY), F.lit(0.0))))
    return F.when(target.isNull(), leave).otherwise(F.array(_piece(low, high, target)))


def weight_after(pieces: Column, old: Column) -> Column:
    """The value of the first piece that holds the old weight, else the old weight."""
    return F.coalesce(F.get(F.filter(pieces, lambda p: (p["low"] <= old) & (old <= p["high"])), 0)["value"], old)


def then(first: Column, second: Column) -> Column:
    """First one map, then the other: the first one's constants go through the second, whose own pieces serve what is left.
    Pieces behind the whole line, and those that the piece before holds, are never reached and leave."""
    moved = F.transform(first, lambda p: _piece(p["low"], p["high"], weight_after(second, p["value"])))
    fresh = F.filter(second, lambda q: ~F.exists(first, lambda p: (p["low"] <= q["low"]) & (q["high"] <= p["high"])))
    whole = F.exists(second, lambda q: (q["low"] == -EVERY) & (q["high"] == EVERY)) & (F.size(second) == 1)
    return F.when(whole, second).otherwise(F.concat(moved, fresh))


def execute_with_limits(grid: DataFrame, flags: DataFrame, calendar: DataFrame) -> DataFrame:
    """Blocked sides keep the old weight. ``flags``: universe, asset, dt, cant_buy, cant_sell; missing = tradable.

    The old weight is path dependent; decisions are maps on it, composed by a running scan from weight 0.
    """
    fill_rows = rebalances(calendar).select("universe", "reb_no", (F.col("reb_row") + 1).alias("row_no"))
    fill_dates = fill_rows.join(calendar.select("universe", "row_no", "dt"), ["universe", "row_no"]).select(
        "universe", "reb_no", "dt")
    at_fill = flags.filter("cant_buy or cant_sell").join(fill_dates, ["universe", "dt"]).select(
        *ASSET, "reb_no", "cant_buy", "cant_sell")
    rows = grid.join(at_fill, [*ASSET, "reb_no"], "left").na.fill(False, ["cant_buy", "cant_sell"])
    done = running(rows, (*RUN, "asset"), "dec_no", decision_map(), then, "_map")
    return done.select(*RUN, "asset", "dec_no", "reb_no", weight_after(F.col("_map"), F.lit(0.0)).alias("weight"))


def with_periods(holdings: DataFrame, calendar: DataFrame) -> DataFrame:
    """Holdings after blocked trades in the form of `execute_all`: adds until, reb_row and trade."""
    path = Window.partitionBy(*RUN, "asset").orderBy("dec_no")
    steps = decisions_of(holdings).select(*RUN, "reb_no", (F.col("next_reb") - 1).alias("until"))
    df = (holdings.withColumn("trade", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(path), F.lit(0.0))))
          .join(steps, [*RUN, "reb_no"]))
    return df.join(rebalances(calendar).select("universe", "reb_no", "reb_row", "n_reb"), ["universe", "reb_no"]).withColumn(
        "until", F.coalesce("until", "n_reb")).select(*RUN, "asset", "weight", "reb_no", "until", "trade", "reb_row")


def portfolio_returns(periods: DataFrame, panel: Panel, runs: DataFrame, cost_rate: float = COST_RATE,
                      gap_policy: str = "pad") -> DataFrame:
    """returns(universe, run_id, dt, row_no, gross, turnover, cost, net) from row ``need`` of each run.

    ``runs``: universe, run_id, need. Daily returns meet holdings by equality on (universe, asset, ordinal in force),
    so the only per-day shuffle is the final sum.
    """
    served = periods.filter("weight <> 0").select(
        *RUN, "asset", "weight", F.explode(F.sequence("reb_no", "until")).alias("reb_earn"))
    rets = daily_returns(panel, gap_policy).filter("ret <> 0 and reb_earn > 0").select(*ASSET, "row_no", "reb_earn", "ret")
    zero = F.lit(0.0)
    earned = rets.join(served, [*ASSET, "reb_earn"]).select(
        *RUN, "row_no", (F.col("weight") * F.col("ret")).alias("gross"), zero.alias("turnover"))
    traded = periods.filter("trade > 0").select(
        *RUN, (F.col("reb_row") + 1).alias("row_no"), zero.alias("gross"), F.col("trade").alias("turnover"))
    flows = earned.unionByName(traded).groupBy(*RUN, "row_no").agg(
        F.sum("gross").alias("gross"), F.sum("turnover").alias("turnover"))
    days = panel.calendar.select("universe", "dt", "row_no").join(runs, "universe").filter("row_no >= need")
    out = days.join(flows, [*RUN, "row_no"], "left").na.fill(0.0, ["gross", "turnover"]).withColumn(
        "cost", F.col("turnover") * cost_rate)
    return out.select(*RUN, "dt", "row_no", "gross", "turnover", "cost", (F.col("gross") - F.col("cost")).alias("net"))


def runs_of(panel: Panel, needs: list[tuple[str, int]]) -> DataFrame:
    """runs(universe, run_id, need): every listed run on every universe of the panel."""
    runs = F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(n).alias("need")) for r, n in needs])
    return panel.calendar.filter("row_no = 0").select("universe", F.inline(runs))


def backtest_targets(targets: DataFrame, panel: Panel, runs: DataFrame, flags: DataFrame | None = None,
                     cost_rate: float = COST_RATE, gap_policy: str = "pad") -> DataFrame:
    """Targets to daily returns, with or without blocked trades."""
    periods = (execute_all(targets, panel.calendar) if flags is None else
               with_periods(execute_with_limits(decision_grid(targets), flags, panel.calendar), panel.calendar))
    return portfolio_returns(periods, panel, runs, cost_rate, gap_policy)


def single_asset_timing(panel: Panel, signals: DataFrame, min_row: int, cost_rate: float = COST_RATE) -> DataFrame:
    """Each asset timed by its own 0/1 signal sampled at its own month ends.

    ``signals``: universe, asset, row_no, signal. Months and rows are those of the asset itself; ``min_row`` is the
    first usable row (0-based). Output: universe, asset, dt, pos, net, is_rebalance, from the first rebalance on.
    """
    w = Window.partitionBy(*ASSET).orderBy("row_no")
    df = daily_returns(panel).select(*ASSET, "dt", "row_no", "ret").join(
        signals.select(*ASSET, "row_no", "signal"), [*ASSET, "row_no"])
    following = F.lead("dt").over(w)
    df = df.withColumn("own_row", F.row_number().over(w) - 1).withColumn(
        "is_rebalance", (following.isNull() | (F.trunc(following, "month") != F.trunc("dt", "month")))
        & (F.col("own_row") >= min_row))
    df = hold_between_rebalances(df, "signal", "is_rebalance")
    before = F.coalesce(F.lag("pos").over(w), F.lit(0.0))
    df = df.withColumn("net", F.col("pos_lag") * F.col("ret") - F.abs(F.col("pos") - before) * cost_rate)
    started = F.max(F.col("is_rebalance").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_on", started).filter("_on = 1").select(
        *ASSET, "dt", "row_no", "signal", "pos", "net", "is_rebalance")


def slot_book(panel: Panel, signals: DataFrame, min_row: int, run_id: str, slots: int | None = None) -> DataFrame:
    """Every asset timed on its own and worth one of ``slots`` parts of the book (by default one per asset of the
    universe); days without a row add nothing."""
    timed = single_asset_timing(panel, signals, min_row).groupBy("universe", "dt").agg(F.sum("net").alias("net"))
    if slots is None:
        n = panel.obs.groupBy("universe").agg(F.count_distinct("asset").alias("_n"))
        timed = timed.join(n, "universe")
    share = F.col("_n") if slots is None else F.lit(slots)
    return timed.select("universe", "dt", (F.col("net") / share).alias("net"), F.lit(run_id).alias("run_id"))


def daily_weights_backtest(weights: DataFrame, panel: Panel, run_id: str, cost_rate: float = COST_RATE,
                           gap_policy: str = "pad") -> DataFrame:
    """Signals that trade every day: fill a row later, earn a row after that, pay for every change."""
    w = Window.partitionBy(*ASSET).orderBy("row_no")
    grid = (panel.calendar.select("universe", "row_no", "dt")
            .join(weights.select("universe", "asset").distinct(), "universe")
            .join(weights, [*ASSET, "row_no"], "left")
            .join(daily_returns(panel, gap_policy).select(*ASSET, "row_no", "ret"), [*ASSET, "row_no"], "left"))
    lag = lambda c, k: F.coalesce(F.lag(c, k).over(w), F.lit(0.0))
    legs = (grid.withColumn("_w1", lag("weight", 1)).withColumn("_w2", lag("weight", 2))
            .withColumn("gross", F.col("_w2") * F.coalesce("ret", F.lit(0.0)))
            .withColumn("turnover", F.abs(F.col("_w1") - F.col("_w2"))))
    out = legs.groupBy("universe", "dt", "row_no").agg(
        F.sum("gross").alias("gross"), F.sum("turnover").alias("turnover"))
    cost = F.col("turnover") * cost_rate
    return out.select("universe", F.lit(run_id).alias("run_id"), "dt", "row_no", "gross", "turnover",
                      cost.alias("cost"), (F.col("gross") - cost).alias("net"))


def buy_and_hold(panel: Panel, asset: str, run_id: str, min_row: int = 126) -> DataFrame:
    """Daily returns of one asset from ``min_row``."""
    return fixed_mix(panel, [(asset, 1.0)], run_id, min_row)


def fixed_mix(panel: Panel, weights: list[tuple[str, float]], run_id: str, min_row: int = 126) -> DataFrame:
    """Daily rebalanced fixed weights without cost (60/40, equal hold). The first row is the base and earns nothing."""
    dim = panel.obs.sparkSession.createDataFrame(weights, "asset string, weight double")
    sums = (daily_returns(panel).select(*ASSET, "row_no", "ret").join(F.broadcast(dim), "asset")
            .groupBy("universe", "row_no").agg(F.sum(F.col("weight") * F.col("ret")).alias("_r")))
    return (panel.calendar.select("universe", "dt", "row_no").filter(F.col("row_no") >= min_row)
            .join(sums, ["universe", "row_no"], "left")
            .select("universe", F.lit(run_id).alias("run_id"), "dt", "row_no",
                    F.when(F.col("row_no") == min_row, 0.0).otherwise(F.coalesce("_r", F.lit(0.0))).alias("net")))


def annual_turnover(returns: DataFrame, cost_rate: float = COST_RATE) -> DataFrame:
    """Turnover per year and the cost drag it implies."""
    out = returns.groupBy(*RUN).agg(F.sum("turnover").alias("total"), F.min("dt").alias("a"), F.max("dt").alias("b"))
    per_year = F.col("total") / (F.datediff("b", "a") / 365.25)
    return out.select(*RUN, per_year.alias("turnover_per_year"), (per_year * cost_rate).alias("cost_per_year"))


def turnover_attribution(rows: DataFrame) -> DataFrame:
    """Month-to-month changes of final weights and of each overlay's offset, with the main cause.

    ``rows`` come from `weights.decision_rows` of a hold-all run. Per asset the stages are w0, w0*s_vol and
    w0*s_vol*s_trend; what leaves the asset enters the bond leg.
    """
    w0, vol = F.col("w0"), F.col("w0") * (F.col("s_vol") - 1)
    trend = F.col("w0") * F.col("s_vol") * (F.col("s_trend") - 1)
    leg = lambda asset, a, b, c: F.struct(asset.alias("asset"), a.alias("cand"), b.alias("vol"), c.alias("trend"))
    legs = (rows.select(*RUN, "reb_no", "signal_dt", F.explode(F.array(
        leg(F.col("asset"), w0, vol, trend), leg(F.col("bond_asset"), F.lit(0.0), -vol, -trend))).alias("leg"))
        .groupBy(*RUN, "reb_no", "signal_dt", F.col("leg.asset").alias("asset"))
        .agg(F.sum("leg.cand").alias("cand"), F.sum("leg.vol").alias("vol"), F.sum("leg.trend").alias("trend")))
    legs = legs.join(decisions_of(legs).select(*RUN, "reb_no", "dec_no"), [*RUN, "reb_no"])
    path = Window.partitionBy(*RUN, "asset").orderBy("dec_no")
    # A pool only grows as histories fill, so an asset's previous row is the previous decision or it is new (zero).
    change = lambda c: F.abs(F.col(c) - F.coalesce(F.lag(c).over(path), F.lit(0.0)))
    legs = legs.withColumn("final", F.col("cand") + F.col("vol") + F.col("trend"))
    moves = legs.select(*RUN, "dec_no", "signal_dt", change("final").alias("d_final"), change("cand").alias("d_cand"),
                        change("vol").alias("d_vol"), change("trend").alias("d_trend")).filter("dec_no > 1")
    out = moves.groupBy(*RUN, "signal_dt").agg(
        F.sum("d_final").alias("turnover"), F.sum("d_cand").alias("candidates"), F.sum("d_vol").alias("vol_target"),
        F.sum("d_trend").alias("trend"))
    top = F.greatest("candidates", "vol_target", "trend")
    return out.withColumn("main_cause", F.when(F.col("candidates") == top, "candidates")
                          .when(F.col("vol_target") == top, "vol_target").otherwise("trend"))


def turnover_causes(attribution: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Main cause counts of the months above the threshold."""
    return attribution.filter(F.col("turnover") > threshold).groupBy(*RUN, "main_cause").agg(F.count(F.lit(1)).alias("months"))


def return_mix(series: DataFrame, weights: list[tuple[str, float]], run_id: str, common_only: bool = True) -> DataFrame:
    """Fixed-weight mix of named series on their common dates; ``common_only=False`` averages what exists."""
    dim = series.sparkSession.createDataFrame(weights, "run_id string, mix double")
    rows = series.join(F.broadcast(dim), "run_id")
    keys = ["universe", "dt"] + (["row_no"] if "row_no" in series.columns else [])
    agg = rows.groupBy(*keys).agg(F.sum(F.col("mix") * F.col("net")).alias("net"), F.avg("net").alias("_avg"),
                                  F.count(F.lit(1)).alias("_k"))
    agg = agg.filter(F.col("_k") == len(weights)) if common_only else agg.withColumn("net", F.col("_avg"))
    return agg.withColumn("run_id", F.lit(run_id)).drop("_avg", "_k")
