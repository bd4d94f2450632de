"""Performance, risk and factor metrics: one row per group of daily returns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.functions import scalars as S
from panelfolio.session import stage
from panelfolio.operators import signals as G

RUN = ("universe", "run_id")


def perf(returns: DataFrame, keys: tuple[str, ...] = RUN, ret: str = "net", order: str = "dt") -> DataFrame:
    """The 13-field metric record. NAV is rebased on the first row of each group.

    ``order`` differs from the date only where a date may repeat (stitched test windows).

    All windows and the final aggregate share one partitioning, so each group moves once.
    """
    group = Window.partitionBy(*keys)
    df = G.underwater(G.nav(returns, ret, keys, order), keys, order)
    r = F.col(ret)
    df = df.withColumn("_v95", F.percentile(r, F.lit(0.05)).over(group)).withColumn(
        "_v99", F.percentile(r, F.lit(0.01)).over(group))
    out = df.groupBy(*keys).agg(
        F.max_by("nav", order).alias("_end"), F.datediff(F.max("dt"), F.min("dt")).alias("_days"),
        F.stddev_samp(r).alias("_sd"), F.avg(r).alias("_mean"),
        F.avg(F.when(r < 0, r * r).otherwise(F.lit(0.0))).alias("_down"), F.min("underwater").alias("mdd"),
        F.sum(F.when(r > 0, r).otherwise(F.lit(0.0))).alias("_gain"),
        F.sum(F.when(r < 0, -r).otherwise(F.lit(0.0))).alias("_loss"),
        F.max("_v95").alias("var95"), F.max("_v99").alias("var99"),
        F.avg(F.when(r <= F.col("_v95"), r)).alias("cvar95"), F.avg(F.when(r <= F.col("_v99"), r)).alias("cvar99"))
    years = F.col("_days") / 365.25
    cagr = F.when(F.col("_days") > 0, F.pow(F.col("_end"), 1 / F.nullif(years, F.lit(0.0))) - 1)
    root = F.sqrt(F.lit(252.0))
    return out.select(
        *keys, (F.col("_end") - 1).alias("total_return"), cagr.alias("cagr"), (F.col("_sd") * root).alias("vol"),
        S.sharpe(F.col("_mean"), F.col("_sd")).alias("sharpe"),
        (F.col("_mean") * 252 / (F.sqrt("_down") * root + S.EPS)).alias("sortino"),
        (cagr / (F.abs("mdd") + S.EPS)).alias("calmar"), (F.col("_gain") / (F.col("_loss") + S.EPS)).alias("omega"),
        "mdd", years.alias("years"), "var95", "cvar95", "var99", "cvar99")


def segment_rows(returns: DataFrame, segments: DataFrame | list[tuple[str, str | None, str | None]]) -> DataFrame:
    """Every row of ``returns`` once per segment that holds its date (column ``segment``).

    ``segments`` is a table (segment, lo, hi; perhaps universe and run_id, then for those only) or a short list of the same; both
    ends are included and null ends are open. A range join by quarters: a segment is laid out over the quarters it
    touches, meets the rows of each by equality, and the ends are checked exactly, so any number of segments of any length spreads.
    """
    spark = returns.sparkSession
    if not isinstance(segments, DataFrame):
        segments = spark.createDataFrame([tuple(s) for s in segments], "segment string, lo string, hi string")
    keys = [c for c in ("universe", "run_id") if c in segments.columns]
    quarter = lambda c: (F.year(c) * 4 + F.quarter(c)).cast("int")
    spec = segments.select(*keys, "segment", F.col("lo").cast("date").alias("_lo"), F.col("hi").cast("date").alias("_hi"))
    if spec.filter("_lo is null or _hi is null").isEmpty():
        closed = spec
    else:  # open ends reach as far as there are rows
        span = returns.agg(F.min("dt").alias("_first"), F.max("dt").alias("_last"))
        closed = spec.crossJoin(F.broadcast(span)).select(*keys, "segment", F.coalesce("_lo", "_first").alias("_lo"), F.coalesce("_hi", "_last").alias("_hi"))
    laid = closed.filter("_lo <= _hi").withColumn("_q", F.explode(F.sequence(quarter("_lo"), quarter("_hi"))))
    rows = returns.withColumn("_q", quarter("dt")).join(laid, [*keys, "_q"])
    return rows.filter(F.col("dt").between(F.col("_lo"), F.col("_hi"))).drop("_q", "_lo", "_hi")


def segment_perf(returns: DataFrame, segments: DataFrame | list[tuple[str, str | None, str | None]], min_rows: int = 60) -> DataFrame:
    """perf per (run, segment), see `segment_rows`; short ones drop out."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*RUN, "segment"))
    return perf(segment_rows(returns, segments).withColumn("_n", size).filter(F.col("_n") >= min_rows), (*RUN, "segment"))


def segment_cumulative_return(returns: DataFrame, segments: DataFrame | list[tuple[str, str, str]], min_rows: int = 5) -> DataFrame:
    """Days and compounded return per (run, segment), see `segment_rows`."""
    return (segment_rows(returns, segments).groupBy(*RUN, "segment")
            .agg(F.count(F.lit(1)).alias("n_days"), (F.product(1 + F.col("net")) - 1).alias("cum_return")).filter(F.col("n_days") >= min_rows))


def trailing_slice(returns: DataFrame, years: int) -> DataFrame:
    """Last ``years`` of each run, after the full-history computation."""
    last = F.max("dt").over(Window.partitionBy(*RUN))
    return returns.withColumn("_cut", F.add_months(last, -12 * years)).filter("dt >= _cut").drop("_cut")


def recent_vs_full(returns: DataFrame, years: int) -> DataFrame:
    both = returns.withColumn("span", F.lit("full")).unionByName(
        trailing_slice(returns, years).withColumn("span", F.lit("recent")))
    p = perf(both, (*RUN, "span"))
    at = lambda c, s: F.max(F.when(F.col("span") == s, F.col(c)))
    return p.groupBy(*RUN).agg(*[at(c, s).alias(f"{s}_{c}") for c in ("cagr", "sharpe", "mdd") for s in ("full", "recent")])


def capm(returns: DataFrame, bench: DataFrame) -> DataFrame:
    """Single-factor regression of each run on the benchmark series (universe, dt, bench)."""
    span = returns.groupBy(*RUN).agg(F.datediff(F.max("dt"), F.min("dt")).alias("_days"))
    both = returns.join(bench.select("universe", "dt", "bench"), ["universe", "dt"]).withColumn(
        "active", F.col("net") - F.col("bench"))
    s = both.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("bench").alias("_vb"), F.regr_slope("net", "bench").alias("beta"),
        F.regr_intercept("net", "bench").alias("_a"), F.corr("net", "bench").alias("corr"),
        F.stddev_samp("active").alias("_te"), F.avg("active").alias("_act"),
        F.product(1 + F.col("net")).alias("_gp"), F.product(1 + F.col("bench")).alias("_gb"))
    s = s.join(span, list(RUN)).filter("n >= 2 and _vb > 1e-12")
    years = F.col("_days") / 365.25
    annual = lambda g: F.when(years > 0, F.pow(F.col(g), 1 / F.nullif(years, F.lit(0.0))) - 1).otherwise(F.lit(0.0))
    root = F.sqrt(F.lit(252.0))
    ir = F.when(F.col("_te") > 0, F.col("_act") / (F.col("_te") + S.EPS) * root).otherwise(F.lit(0.0))
    out = s.select(*RUN, "n", "beta", (F.col("_a") * 252).alias("alpha"), ir.alias("ir"),
                   (F.col("corr") * F.col("corr")).alias("r2"), (F.col("_te") * root).alias("tracking_error"), "corr",
                   annual("_gp").alias("run_annual"), annual("_gb").alias("bench_annual"))
    excess = F.col("run_annual") - F.col("bench_annual")
    return out.withColumn("excess_annual", excess).withColumn("beta_drag", (F.col("beta") - 1) * F.col("bench_annual"))


def multi_factor_ols(returns: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """OLS of each run on k factors: long rows (run, factor, beta, tstat, contribution) plus run-level fields.

    Cross-products are plain distributed sums; only the (k+1)x(k+1) system per run goes to a Python task.
    """
    k = len(names)
    wide = factors.groupBy("universe", "dt").agg(
        *[F.max(F.when(F.col("factor") == n, F.col("f_ret"))).alias(f"x{i + 1}") for i, n in enumerate(names)])
    rows = returns.join(wide, ["universe", "dt"]).withColumn("x0", F.lit(1.0))
    xs = [f"x{i}" for i in range(k + 1)]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j]
    sums += [F.sum(F.col(a) * F.col("net")).alias(f"y_{i}") for i, a in enumerate(xs)]
    moments = rows.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("net") * F.col("net")).alias("yy"), *sums)
    moments = moments.filter(F.col("n") >= k + 5)

    def solve(batches):
        upper = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        for pdf in batches:
            xtx = np.zeros((len(pdf), k + 1, k + 1))
            for i, j in upper:
                xtx[:, i, j] = xtx[:, j, i] = pdf[f"s_{i}_{j}"]
            xty = pdf[[f"y_{i}" for i in range(k + 1)]].to_numpy(float)
            n = pdf["n"].to_numpy(float)
            inverse = np.linalg.pinv(xtx) if len(pdf) else xtx
            beta = np.einsum("rij,rj->ri", inverse, xty)
            ss_res = np.maximum(pdf["yy"].to_numpy(float) - (beta * xty).sum(1), 0.0)
            ss_tot = pdf["yy"].to_numpy(float) - xty[:, 0] ** 2 / n
            dof = n - k - 1
            sigma2 = ss_res / dof
            se = np.sqrt(np.maximum(np.einsum("rii->ri", inverse) * sigma2[:, None], 0.0))
            r2 = np.where(ss_tot > 0, 1 - ss_res / np.where(ss_tot > 0, ss_tot, 1), 0.0)
            tstat = np.where(se > 0, beta / np.where(se > 0, se, 1), np.nan)
            run = np.repeat(np.arange(len(pdf)), k + 1)
            yield pd.DataFrame({
                "universe": pdf["universe"].to_numpy()[run], "run_id": pdf["run_id"].to_numpy()[run], "factor": ["alpha", *names] * len(pdf),
                "n": pdf["n"].to_numpy()[run], "beta": beta.ravel(), "tstat": pd.array(tstat.ravel()).astype("Float64"),
                "contribution": (beta * xtx[:, 0, :] / n[:, None] * 252).ravel(), "r2": r2[run], "r2_adj": (1 - (1 - r2) * (n - 1) / dof)[run],
                "resid_vol": np.sqrt(sigma2 * 252)[run]})

    return moments.mapInPandas(solve, "universe string, run_id string, factor string, n long, beta double, tstat double, "
                                      "contribution double, r2 double, r2_adj double, resid_vol double")


def corr_matrix(series: DataFrame, name: str, value: str, keys: tuple[str, ...] = ("universe",)) -> DataFrame:
    """Upper triangle of the correlation matrix of a few named series (factors, sector assets), long form."""
    a = series.select(*keys, "dt", F.col(name).alias("a"), F.col(value).alias("_x"))
    b = series.select(*keys, "dt", F.col(name).alias("b"), F.col(value).alias("_y"))
    return (a.join(b, [*keys, "dt"]).filter("a < b").groupBy(*keys, "a", "b")
            .agg(F.corr("_x", "_y").alias("corr"), F.count(F.lit(1)).alias("n")))


def high_correlations(series: DataFrame, name: str, value: str, bound: float, keys: tuple[str, ...] = ("universe",), parts: int = 4) -> DataFrame:
    """(keys, a, b, corr, n) of the pairs a < b with a correlation of ``bound`` or more; each pair once, no all-pairs output.

    Series with a value on every date become unit vectors. Their products are summed over one random part of the dates after the
    other, and a pair leaves as soon as what is left of its two vectors could not lift it to the bound (Cauchy-Schwarz), so most
    pairs are summed over a part of the dates only. Pairs with a gap in either series are summed whole, on their common dates. A flat series correlates with none.
    """
    rows = series.select(*keys, "dt", F.col(name).alias("a"), F.col(value).alias("x")).filter("x is not null")
    own = rows.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), (F.stddev_pop("x") * F.sqrt(F.count(F.lit(1)).cast("double"))).alias("norm"))
    dates = rows.select(*keys, "dt").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("dates"))
    own = own.join(dates, list(keys)).withColumn("whole", F.col("n") == F.col("dates"))
    marked = stage(rows.join(own, [*keys, "a"]).select(*keys, "dt", "a", "x", "whole", "n", S.ratio(F.col("x") - F.col("m"), F.col("norm")).alias("z"),
                                                       F.pmod(F.xxhash64("dt"), F.lit(parts)).cast("int").alias("part")), "unit-series")
    unit = marked.filter("whole and z is not null").select(*keys, "dt", "a", "n", "z", "part")
    used = unit.groupBy(*keys, "a").agg(*[F.sum(F.when(F.col("part") <= p, F.col("z") * F.col("z")).otherwise(0.0)).alias(f"u{p}") for p in range(parts)])
    left = lambda p, side: F.sqrt(F.greatest(F.lit(0.0), 1 - F.col(f"{side}{p}")))
    norms = {side: used.select(*keys, F.col("a").alias(side), *[F.col(f"u{p}").alias(f"_{side}{p}") for p in range(parts)]) for side in ("a", "b")}
    pairs = None
    for p in range(parts):
        here = unit.filter(F.col("part") == p)
        first = here.select(*keys, "dt", "a", "n", F.col("z").alias("_x"))
        second = here.select(*keys, "dt", F.col("a").alias("b"), F.col("z").alias("_y"))
        if pairs is None:
            both = first.join(second, [*keys, "dt"]).filter("a < b").withColumn("corr", F.lit(0.0))
        else:
            both = pairs.join(first.drop("n"), [*keys, "a"]).join(second, [*keys, "b", "dt"])
        summed = both.groupBy(*keys, "a", "b").agg(F.first("n").alias("n"), (F.first("corr") + F.sum(F.col("_x") * F.col("_y"))).alias("corr"))
        reach = F.col("corr") + (left(p, "_a") * left(p, "_b") if p < parts - 1 else F.lit(0.0))
        pairs = summed.join(norms["a"], [*keys, "a"]).join(norms["b"], [*keys, "b"]).filter(reach >= bound - S.EPS).select(*keys, "a", "b", "n", "corr")
        pairs = stage(pairs, "high-pairs")
    gaps = marked.select(*keys, "dt", "a", "x", "whole")
    other = gaps.select(*keys, "dt", F.col("a").alias("b"), F.col("x").alias("_y"), F.col("whole").alias("_w"))
    direct = (gaps.join(other, [*keys, "dt"]).filter("a < b and not (whole and _w)").groupBy(*keys, "a", "b")
              .agg(F.count(F.lit(1)).alias("n"), S.ratio(F.covar_pop("x", "_y"), F.stddev_pop("x") * F.stddev_pop("_y")).alias("corr")).filter(F.col("corr") >= bound))
    return pairs.unionByName(direct).select(*keys, "a", "b", "corr", "n")


def corr_summary(matrix: DataFrame, high: float = 0.7, keys: tuple[str, ...] = ("universe",)) -> DataFrame:
    return matrix.groupBy(*keys).agg(F.avg("corr").alias("mean_corr"), F.count_if(F.col("corr") > high).alias("n_high"))


def corr_by_regime(a: DataFrame, b: DataFrame, regimes: DataFrame, min_rows: int = 5) -> DataFrame:
    """Correlation of two return series per regime plus the all-sample row (one rollup)."""
    rows = (a.select("universe", "dt", F.col("net").alias("x")).join(b.select("universe", "dt", F.col("net").alias("y")), ["universe", "dt"])
            .join(regimes, ["universe", "dt"], "left").withColumn("regime", F.coalesce("regime", F.lit("sideways")))
            .select("universe", "x", "y", "regime"))
    out = rows.rollup("universe", "regime").agg(
        F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("_c"), F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy"))
    ok = (F.col("n") >= min_rows) & (F.col("_sx") >= 1e-9) & (F.col("_sy") >= 1e-9)
    return out.filter("universe is not null").select(
        "universe", F.coalesce("regime", F.lit("all")).alias("regime"), "n", F.when(ok, F.col("_c")).alias("corr"))


def regime_report(returns: DataFrame, regimes: DataFrame, min_rows: int = 2) -> DataFrame:
    """Days, share and metrics of each run inside each regime."""
    rows = returns.join(regimes, ["universe", "dt"], "left").withColumn("regime", F.coalesce("regime", F.lit("sideways")))
    share = rows.groupBy(*RUN, "regime").agg(F.count(F.lit(1)).alias("n_days")).withColumn(
        "share", F.col("n_days") / F.sum("n_days").over(Window.partitionBy(*RUN)))
    return share.filter(F.col("n_days") >= min_rows).join(perf(rows, (*RUN, "regime")), [*RUN, "regime"])


def rolling_summary(rolled: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    r = F.col("roll_sharpe")
    return rolled.filter("roll_sharpe is not null").groupBy(*keys).agg(
        F.avg(r).alias("mean_sharpe"), F.min(r).alias("min_sharpe"), F.avg((r > 0).cast("double")).alias("share_positive"))


def annual_sharpe(returns: DataFrame, keys: tuple[str, ...] = RUN, ret: str = "net") -> DataFrame:
    return returns.groupBy(*keys).agg(S.flat_safe_sharpe(F.avg(ret), F.stddev_samp(ret)).alias("sharpe"))


def monthly_returns(returns: DataFrame, keys: tuple[str, ...] = RUN, ret: str = "net") -> DataFrame:
    """Compounded month-end changes; the first month has no base and drops out."""
    ends = (G.nav(returns, ret, keys, rebase=False).groupBy(*keys, F.trunc("dt", "month").alias("month"))
            .agg(F.max_by("nav", "dt").alias("_nav"), F.max("dt").alias("dt")))
    change = F.col("_nav") / F.lag("_nav").over(Window.partitionBy(*keys).orderBy("month")) - 1
    return ends.withColumn(ret, change).filter(F.col(ret).isNotNull()).drop("_nav")


# Fixed value: the Euler-Mascheroni constant.
EULER = 0.5772156649015329


def deflated_sharpe(returns: DataFrame, trials: list[int], periods: int = 252, keys: tuple[str, ...] = RUN,
                    ret: str = "net") -> DataFrame:
    """Deflated and probabilistic Sharpe ratio for several numbers of trials.

    Skewness and kurtosis divide by n - 1 and use the sample deviation, so they come from central sums.
    """
    group = Window.partitionBy(*keys)
    d = F.col(ret) - F.avg(ret).over(group)
    m = returns.withColumn("_d", d).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ret).alias("_mean"), F.sum(F.col("_d") ** 2).alias("_m2"),
        F.sum(F.col("_d") ** 3).alias("_m3"), F.sum(F.col("_d") ** 4).alias("_m4"))
    sd = F.sqrt(F.col("_m2") / (F.col("n") - 1))
    m = m.withColumn("_sd", sd).withColumn("sr", F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd")).otherwise(F.lit(0.0)))
    m = m.withColumn("skew", S.ratio(F.col("_m3") / (F.col("n") - 1), F.col("_sd") ** 3)).withColumn(
        "kurt", S.ratio(F.col("_m4") / (F.col("n") - 1), F.col("_sd") ** 4))
    var = (1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") ** 2) / (F.col("n") - 1)
    m = m.withColumn("_var", var).withColumn("_sig", F.when(F.col("_var") > 0, F.sqrt("_var")).otherwise(F.lit(1e-12)))
    m = m.withColumn("trials", F.explode(F.array(*[F.lit(t) for t in trials])))
    best = (1 - EULER) * S.norm_ppf(1 - 1 / F.col("trials")) + EULER * S.norm_ppf(
        1 - 1 / (F.col("trials") * float(np.e)))
    m = m.withColumn("_max", F.col("_sig") * best)
    root = F.sqrt(F.lit(float(periods)))
    return m.select(*keys, "trials", "n", "skew", "kurt", (F.col("sr") * root).alias("sharpe"),
                    (F.col("_max") * root).alias("max_sharpe"), S.norm_cdf(F.col("sr") / F.col("_sig")).alias("psr"),
                    S.norm_cdf((F.col("sr") - F.col("_max")) / F.col("_sig")).alias("dsr"))


def three_gates(candidates: DataFrame, base: DataFrame, max_corr: float = 0.3, min_sharpe: float = 0.5) -> DataFrame:
    """Low correlation, own Sharpe, and a 50/50 mix better than both. All candidates in one aggregate.

    The candidate's own Sharpe is over its whole series; the others are over the common dates.
    """
    own = annual_sharpe(candidates).withColumnRenamed("sharpe", "own_sharpe")
    both = candidates.join(base.select("universe", "dt", F.col("net").alias("_b")), ["universe", "dt"])
    mix = 0.5 * F.col("_b") + 0.5 * F.col("net")
    s = both.groupBy(*RUN).agg(
        F.corr("_b", "net").alias("corr"), F.count(F.lit(1)).alias("n"),
        S.flat_safe_sharpe(F.avg("_b"), F.stddev_samp("_b")).alias("base_sharpe"),
        S.flat_safe_sharpe(F.avg(mix), F.stddev_samp(mix)).alias("mix_sharpe"))
    s = s.join(own, list(RUN)).withColumn("corr", F.when(F.col("n") > 5, F.col("corr")))
    gates = {"gate_corr": F.coalesce(F.abs("corr") < max_corr, F.lit(False)), "gate_own": F.col("own_sharpe") > min_sharpe,
             "gate_mix": F.col("mix_sharpe") > F.greatest("own_sharpe", "base_sharpe")}
    s = s.withColumns(gates)
    return s.withColumn("passed", F.col("gate_corr") & F.col("gate_own") & F.col("gate_mix"))


def beats_reference(candidates: DataFrame, reference: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Sharpe against a reference series (equal weight), with their correlation."""
    ref = annual_sharpe(reference, ("universe",)).withColumnRenamed("sharpe", "ref_sharpe")
    corr = (candidates.join(reference.select("universe", "dt", F.col("net").alias("_r")), ["universe", "dt"])
            .groupBy(*RUN).agg(F.corr("_r", "net").alias("_c"), F.count(F.lit(1)).alias("_n")))
    return (annual_sharpe(candidates).join(corr, list(RUN)).join(ref, "universe")
            .select(*RUN, "sharpe", "ref_sharpe", F.when(F.col("_n") > 5, F.col("_c")).alias("corr"),
                    (F.col("sharpe") > F.col("ref_sharpe") + tolerance).alias("beats")))


def conditional_forward_mean(rows: DataFrame, signal: str, forward: str, keys: tuple[str, ...], min_common: int = 100,
                             min_valid: int = 50) -> DataFrame:
    """Correlation of a signal with the forward return, and its mean on either side of zero."""
    s, f = F.col(signal), F.col(forward)
    valid = s.isNotNull() & f.isNotNull()
    return (rows.groupBy(*keys).agg(
        F.count(s).alias("_common"), F.count_if(valid).alias("n"), F.corr(s, f).alias("corr"),
        F.avg(F.when(s > 0, f)).alias("mean_long"), F.avg(F.when(s <= 0, f)).alias("mean_flat"),
        F.count_if(valid & (s > 0)).alias("n_long"))
        .filter((F.col("_common") >= min_common) & (F.col("n") >= min_valid)).drop("_common"))


def long_share(rows: DataFrame, signal: str, keys: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.col(signal).cast("double")).alias("long_share"), F.count(F.lit(1)).alias("n"))
