"""Pairs of assets: spreads, cointegration screen, entry/exit states and returns.

Pairs are an explicit list or all unordered pairs of a short asset list; the join is by date.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.functions import scalars as S
from panelfolio.operators.panel import Panel
from panelfolio.operators.scan import running
from panelfolio.operators.signals import with_rolling
from panelfolio.params import COST_RATE
from panelfolio.session import stage

PAIR = ("universe", "a", "b")


def pair_prices(panel: Panel, assets: list[str], min_rows: int = 300, pairs: DataFrame | None = None) -> DataFrame:
    """(universe, a, b, dt, pa, pb, t) on dates where both have a price; short pairs drop out.

    ``pairs`` (a, b and perhaps universe) are the caller's; without them all pairs a < b of ``assets`` that the universe lists.
    """
    if pairs is None:
        listed = panel.obs.filter(F.col("asset").isin(*assets)).select("universe", "asset").distinct()
        spec = listed.select("universe", F.col("asset").alias("a")).join(listed.select("universe", F.col("asset").alias("b")), "universe").filter("a < b")
    else:
        spec = pairs.select(*[c for c in ("universe", "a", "b") if c in pairs.columns])
    left = panel.obs.select("universe", F.col("asset").alias("a"), "dt", F.col("close").alias("pa")).join(spec, [c for c in ("universe", "a") if c in spec.columns])
    right = panel.obs.select("universe", F.col("asset").alias("b"), "dt", F.col("close").alias("pb"))
    both = left.join(right, ["universe", "b", "dt"])
    size = F.count(F.lit(1)).over(Window.partitionBy(*PAIR))
    return both.withColumn("t", size).filter(F.col("t") >= min_rows)


def spread_z(prices: DataFrame, window: int = 60) -> DataFrame:
    """beta of ln a on ln b over the full sample, the spread and its rolling z-score."""
    la, lb = F.ln("pa"), F.ln("pb")
    df = prices.withColumn("beta", F.regr_slope(la, lb).over(Window.partitionBy(*PAIR)))
    df = with_rolling(df.withColumn("spread", la - F.col("beta") * lb), "spread", window, "_s", order="dt", keys=PAIR)
    return df.withColumn("z", (F.col("spread") - F.col("_s_mean")) / (F.col("_s_std") + S.EPS)).drop("_s_mean", "_s_std")


def _next_state(state: Column, z: Column, entry: float, exit_: float) -> Column:
    enter = F.when(z < -entry, F.lit(1)).when(z > entry, F.lit(-1)).otherwise(F.lit(0))
    return (F.when(z.isNull(), state).when(state == 0, enter)
            .when((state == 1) & (z > -exit_), F.lit(0)).when((state == -1) & (z < exit_), F.lit(0)).otherwise(state))


def _state_map(z: Column, entry: float, exit_: float) -> Column:
    """What a day does to each state: the states after it for short, flat and long before it."""
    return F.struct(*[_next_state(F.lit(before), z, entry, exit_).alias(name) for name, before in (("short", -1), ("flat", 0), ("long", 1))])


def _then(first: Column, second: Column) -> Column:
    after = lambda s: F.when(s == -1, second["short"]).when(s == 0, second["flat"]).otherwise(second["long"])
    return F.struct(*[after(first[name]).alias(name) for name in ("short", "flat", "long")])


def hysteresis_state(df: DataFrame, entry: float = 2.0, exit_: float = 0.5) -> DataFrame:
    """``pos`` in {1, -1, 0}: enter beyond ``entry``, leave inside ``exit_``, never flip directly.

    A day without z shows 0 while the state carries on. Days are maps on the three states, composed by a running scan from flat.
    """
    out = running(df, PAIR, "dt", _state_map(F.col("z"), entry, exit_), _then, "_map")
    return out.withColumn("pos", F.when(F.col("z").isNull(), F.lit(0)).otherwise(F.col("_map.flat"))).drop("_map")


def pair_returns(states: DataFrame, cost_rate: float = COST_RATE) -> DataFrame:
    """Dollar-neutral hedged returns: fill a day later, earn a day after that."""
    w = Window.partitionBy(*PAIR).orderBy("dt")
    zero = lambda c: F.coalesce(c, F.lit(0))
    move = lambda p: F.coalesce(F.col(p) / F.lag(p).over(w) - 1, F.lit(0.0))
    df = states.withColumns({"_ra": move("pa"), "_rb": move("pb"), "_p1": zero(F.lag("pos", 1).over(w)), "_p2": zero(F.lag("pos", 2).over(w)),
                             "_changed": F.coalesce(F.col("pos") != F.lag("pos").over(w), F.lit(False))})
    gross = F.col("_p2") * (0.5 * F.col("_ra") - 0.5 * F.col("beta") * F.col("_rb"))
    turnover = F.abs(F.col("_p1") - F.col("_p2")) * 0.5 * (1 + F.abs("beta"))
    return df.select("universe", F.concat_ws("/", "a", "b").alias("run_id"), "dt", (gross - turnover * cost_rate).alias("net"),
                     F.col("_changed").alias("changed"))


def longest_lag(t: Column) -> Column:
    """The longest lag tried on ``t`` rows: 12 (t / 100)^(1/4), rounded up, and no more than half the rows allow."""
    return F.least(F.ceil(12 * F.pow(t / 100, F.lit(0.25))), F.floor(t / 2) - 1).cast("int")


def _residuals(prices: DataFrame) -> DataFrame:
    """(pair, t_obs, at, e, x, d, r2): residuals e of the level regression in order, the one before and the change."""
    along, whole = Window.partitionBy(*PAIR).orderBy("dt"), Window.partitionBy(*PAIR)
    fitted = F.regr_slope("pa", "pb").over(whole) * F.col("pb") + F.regr_intercept("pa", "pb").over(whole)
    e = prices.select(*PAIR, F.col("t").alias("t_obs"), (F.row_number().over(along) - 1).alias("at"), "dt", (F.col("pa") - fitted).alias("e"), F.regr_r2("pa", "pb").over(whole).alias("r2"))
    e = e.withColumn("x", F.lag("e").over(along)).withColumn("d", F.col("e") - F.col("x"))
    return e.select(*PAIR, "t_obs", "at", "x", "d", "r2").filter("at > 0")


def _lagged_products(e: DataFrame) -> DataFrame:
    """(pair, t_obs, at, k, dd, xd, xx): the change and the level before it, times the change k rows earlier, for every lag."""
    ahead = e.select(*PAIR, "t_obs", "at", "x", "d", F.explode(F.sequence(F.lit(0), longest_lag(F.col("t_obs")))).alias("k"))
    earlier = e.select(*PAIR, (F.col("at")).alias("_at"), F.col("d").alias("_d"))
    both = ahead.withColumn("_at", F.col("at") - F.col("k")).join(earlier, [*PAIR, "_at"])
    return both.select(*PAIR, "t_obs", "at", "k", (F.col("d") * F.col("_d")).alias("dd"), (F.col("x") * F.col("_d")).alias("xd"),
                       F.when(F.col("k") == 0, F.col("x") * F.col("x")).alias("xx"))


def _moments(products: DataFrame) -> DataFrame:
    """(pair, t_obs, lags, m): cross sums of level, change and ``lags`` lagged changes over the rows that have all of them.

    ``products`` has a column ``lags``. The cross sum of lags i and i + k is the sum of products at distance k, shifted by i rows: all
    rows count for every i but for some at either end. So each product enters where its first i begins and leaves behind
    its last one, and running sums over i give all cross sums of a distance from one set of products.
    """
    df = products.filter("k <= lags")
    top = F.col("lags") - F.col("k")
    first = F.greatest(F.lit(0), F.col("lags") + 1 - F.col("at")).cast("int")
    last = F.least(top, F.col("t_obs") - 1 - F.col("at")).cast("int")
    inside = F.col("at") > F.col("lags")
    cell = lambda kind, i, v, use: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), v.alias("v"), use.alias("use"))
    cells = F.filter(F.array(cell("dd", first, F.col("dd"), first <= last), cell("dd", last + 1, -F.col("dd"), (first <= last) & (last < top)),
                             cell("xd", F.lit(0), F.col("xd"), inside), cell("xx", F.lit(0), F.col("xx"), inside & (F.col("k") == 0))), lambda c: c["use"])
    df = df.select(*PAIR, "t_obs", "lags", "k", F.explode(cells).alias("c"))
    df = df.groupBy(*PAIR, "t_obs", "lags", "k", "c.kind", "c.i").agg(F.sum("c.v").alias("v"))
    steps = F.collect_list(F.struct("i", "v"))
    df = df.groupBy(*PAIR, "t_obs", "lags", "k", "kind").agg(steps.alias("steps"))
    upto = lambda i: F.reduce(F.filter("steps", lambda s: s["i"] <= i), F.lit(0.0), lambda a, s: a + s["v"])
    entry = lambda r, c, v: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), v.alias("v"))
    rows = (F.when(F.col("kind") == "dd", F.transform(F.sequence(F.lit(0), top), lambda i: entry(i + 1, i + 1 + F.col("k"), upto(i))))
            .when(F.col("kind") == "xd", F.array(entry(F.lit(0), F.col("k") + 1, upto(F.lit(0))))).otherwise(F.array(entry(F.lit(0), F.lit(0), upto(F.lit(0))))))
    df = df.select(*PAIR, "t_obs", "lags", F.inline(rows))
    both = F.when(F.col("r") == F.col("c"), F.array(entry(F.col("r"), F.col("c"), F.col("v")))).otherwise(
        F.array(entry(F.col("r"), F.col("c"), F.col("v")), entry(F.col("c"), F.col("r"), F.col("v"))))
    df = df.select(*PAIR, "t_obs", "lags", F.inline(both))
    return df.groupBy(*PAIR, "t_obs", "lags").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "v"))), lambda e: e["v"]).alias("m"))


def _nested(moments: DataFrame) -> DataFrame:
    """(pair, t_obs, best_lag, tstat): the lag of least Akaike criterion among nested regressions, and the statistic at the longest.

    ``m`` is the square of cross sums of level, change and lags, row by row. Lags are eliminated one after the other; what is left
    in the corner of level and change is the regression with as many lags, so one pass serves all of them.
    """
    n, rows = F.col("lags") + 2, F.col("t_obs") - 1 - F.col("lags")

    def regress(acc: Column, p: Column) -> Column:
        m = acc["m"]
        sxx, sxy, syy = F.get(m, F.lit(0)), F.get(m, F.lit(1)), F.get(m, n + 1)
        rho = S.ratio(sxy, sxx)
        rss = syy - rho * sxy
        aic = rows * F.ln(S.ratio(rss, rows.cast("double"))) + 2 * (p + 1)
        better = aic < acc["aic"]
        at = p + 2
        pivot = F.get(m, at * n + at)
        out = F.transform(m, lambda v, i: v - F.get(m, F.floor(i / n).cast("int") * n + at) * S.ratio(F.get(m, at * n + i % n), pivot))
        t = S.ratio(rho, F.sqrt(S.ratio(rss / (rows - p - 1), sxx)))
        return F.struct(F.when(p < F.col("lags"), out).otherwise(m).alias("m"), F.when(better, aic).otherwise(acc["aic"]).alias("aic"),
                        F.when(better, p).otherwise(acc["lag"]).alias("lag"), t.alias("t"))

    start = F.struct("m", F.lit(float("inf")).alias("aic"), F.lit(0).alias("lag"), F.lit(None).cast("double").alias("t"))
    done = moments.withColumn("_r", F.reduce(F.sequence(F.lit(0), F.col("lags")), start, regress))
    return done.select(*PAIR, "t_obs", F.col("_r.lag").alias("best_lag"), F.col("_r.t").alias("tstat"))


def cointegration(prices: DataFrame) -> DataFrame:
    """(pair, n, lag, tstat, p): residual unit-root test of each pair on its n rows.

    Level regression with a constant, then the change of the residual on its level and lagged changes. The lag is that of least
    Akaike criterion among all up to ``longest_lag``, compared on the rows that the longest has; the statistic is that of
    its regression on all rows it has, and p comes from the response surface. A pair that fits without residuals has
    a statistic of minus infinity.
    """
    e = stage(_residuals(prices), "residuals")
    products = stage(_lagged_products(e), "lagged-products")
    chosen = _nested(_moments(products.withColumn("lags", longest_lag(F.col("t_obs"))))).select(*PAIR, F.col("best_lag").alias("lags"))
    tested = _nested(_moments(products.join(chosen, list(PAIR)))).select(*PAIR, "tstat").join(chosen, list(PAIR))
    exact = F.col("r2") >= 1 - 100 * math.sqrt(2.0**-52)
    sizes = e.filter("at = 1").select(*PAIR, F.col("t_obs").alias("n"), exact.alias("exact"))
    out = sizes.join(tested, list(PAIR)).withColumn("tstat", F.when(F.col("exact"), F.lit(float("-inf"))).otherwise(F.col("tstat")))
    return out.select(*PAIR, "n", F.col("lags").cast("int").alias("lag"), "tstat", S.residual_test_p(F.col("tstat")).alias("p"))


def pair_screen(tests: DataFrame, threshold: float = 0.10, fallback: int = 2) -> DataFrame:
    """Pairs with p below the threshold; where a universe has none, its best ``fallback`` by p. The count is a partial aggregate."""
    passing = F.coalesce(F.col("p") < threshold, F.lit(False))
    counts = tests.groupBy("universe").agg(F.count_if(passing).alias("_n"))
    best = F.row_number().over(Window.partitionBy("universe").orderBy(F.asc_nulls_last("p"), "a", "b"))
    df = tests.join(counts, "universe")
    found = df.filter(passing).drop("_n")
    return found.unionByName(df.filter("_n = 0").drop("_n").withColumn("_k", best).filter(F.col("_k") <= fallback).drop("_k"))
