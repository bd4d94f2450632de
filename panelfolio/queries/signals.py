"""Signals over price rows, and rolling views of return series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfolio import testpanel as T
from panelfolio.operators import accounting as B
from panelfolio.operators import covariance as C
from panelfolio.operators import metrics as M
from panelfolio.operators import panel as P
from panelfolio.operators import signals as G
from panelfolio.operators import weights as A
from panelfolio.params import ParamSet, universe_dim
from panelfolio.queries.common import market, prices, query, rounded

BENCH, BOND = T.TYPES.benchmark, T.TYPES.bond

MOMENTUM_RUNS = [ParamSet("plain"), ParamSet("skip", skip=21), ParamSet("weighted", lookback_weights=(1, 2, 3)),
                 ParamSet("risk_adj", risk_adj=True), ParamSet("long", lookbacks=(63, 126, 252), skip=5, risk_adj=True)]


@query
def blended_momentum(spark: SparkSession, sf: str) -> DataFrame:
    sig = A.rebalance_signals(market(spark, sf), universe_dim(spark, [T.TYPES]), MOMENTUM_RUNS)
    return rounded(sig.select("universe", "run_id", "signal_dt", "asset", "momentum"))


@query
def asset_vols(spark: SparkSession, sf: str) -> DataFrame:
    df = G.with_observations(market(spark, sf).obs)
    df = G.with_asset_vol(G.with_asset_vol(df, 63), 126, 21)
    return rounded(df.select("universe", "asset", "dt", "vol_63_0", "vol_126_21"))


@query
def basket_vol(spark: SparkSession, sf: str) -> DataFrame:
    """Recent volatility of the held basket for the equal and the inverse-volatility weighting."""
    runs = [ParamSet("all"), ParamSet("top3", hold_all=False), ParamSet("inv", hold_all=False, weighting="inv_vol")]
    rows = A.decision_rows(market(spark, sf), universe_dim(spark, [T.TYPES]), runs)
    return rounded(rows.groupBy("universe", "run_id", "signal_dt").agg(
        F.max("basket_vol").alias("basket_vol"), F.min("s_vol").alias("s_vol"), F.count_if("held").alias("n_held")).filter("n_held > 0"))


@query
def trend_flags(spark: SparkSession, sf: str) -> DataFrame:
    df = G.with_past_closes(G.with_observations(market(spark, sf).obs), {21})
    df = G.with_peak(G.with_trend(df, 200), 126)
    return df.select("universe", "asset", "dt", "below_200", F.expr(G.rebound_sql(21, 0.10)).alias("rebound"),
                     F.expr(G.drawdown_sql(126, -0.10)).alias("fallen"))


@query
def ts_momentum(spark: SparkSession, sf: str) -> DataFrame:
    """Both forms of the time-series signal: with and without the trend filter."""
    panel = market(spark, sf)
    pick = lambda trend, name: G.ts_momentum(panel.obs, trend).select("universe", "asset", "dt", F.col("signal").alias(name))
    return pick(True, "with_trend").join(pick(False, "plain"), ["universe", "asset", "dt"])


@query
def zscore_weights(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    w = G.zscore_weights(panel, list(T.TYPES.pool), BOND, BENCH, 20, 200)
    return rounded(w)


def zscore_book(panel: P.Panel, name: str, gate: int | None = None) -> DataFrame:
    """Returns of the z-score weights from the first day on which all assets of the pool have one."""
    w = G.zscore_weights(panel, list(T.TYPES.pool), BOND, BENCH, 20, gate)
    first = w.filter(F.col("asset") != BOND).groupBy("universe", "row_no").count().filter(F.col("count") == len(T.TYPES.pool))
    first = first.groupBy("universe").agg(F.min("row_no").alias("first"))
    return B.daily_weights_backtest(w, panel, name).join(first, "universe").filter("row_no >= first").drop("first")


@query
def zscore_reversion(spark: SparkSession, sf: str) -> DataFrame:
    """Daily backtest of the z-score weights, open and gated, each from its first valid weights."""
    return zscore_reversion_whole(spark, sf)


@query
def zscore_reversion_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Both books from their first day with valid weights of all assets; a gate without its average is shut, which is valid."""
    panel = market(spark, sf)
    open_book, gated = (zscore_book(panel, name, gate) for name, gate in (("open", None), ("gated", 200)))
    return rounded(M.perf(open_book.unionByName(gated)))



@query
def rolling_ols(spark: SparkSession, sf: str) -> DataFrame:
    fits = G.rolling_ols(T.test_prices(spark, sf), 18)
    return rounded(fits.select("universe", "asset", "dt", "slope", "r2"))


@query
def modified_score(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised slope times fit, and its agreement with the long trend."""
    px = prices(spark, sf)
    scored = G.modified_score(G.rolling_ols(px, 18), 600, 0.7)
    trend = G.with_rolling(px, "close", 200, "t", std=False, order="dt").withColumn(
        "above", F.coalesce(F.col("close") > F.col("t_mean"), F.lit(False))).select("universe", "asset", "dt", "above")
    both = scored.join(trend, ["universe", "asset", "dt"]).withColumn("agree", G.signal_and("signal", "above"))
    return rounded(both.select("universe", "asset", "dt", "score", "signal", "agree"))


@query
def ols_timing(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark timed by the modified score, sampled at month ends: metrics and share of long days."""
    px = prices(spark, sf).filter(F.col("asset") == BENCH)
    panel = P.prepare_panel(px, limit=0, staged=True)
    bars = panel.obs.join(px.select("universe", "asset", "dt", "high", "low"), ["universe", "asset", "dt"])
    scored = G.modified_score(G.rolling_ols(bars, 18), 600, 0.7)
    sig = scored.withColumn("signal", F.col("signal").cast("double"))
    run = B.single_asset_timing(panel, sig, 600).withColumn("run_id", F.lit("ols_timing"))
    share = M.long_share(scored, "signal", ("universe",))
    return rounded(M.perf(run).join(share, "universe"))


@query
def ols_timing_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative return of the benchmark and the bond leg over named spans."""
    panel = market(spark, sf)
    runs = B.buy_and_hold(panel, BENCH, "bench", 0).unionByName(B.buy_and_hold(panel, BOND, "bond", 0))
    return rounded(M.segment_cumulative_return(runs, SPANS))


SPANS = [("first", "1995-06-01", "1996-06-30"), ("second", "1997-01-01", "1998-12-31"), ("late", "2000-01-01", "2001-12-31"),
         ("short", "1996-01-01", "1996-01-03")]


def settles(spark: SparkSession, sf: str) -> DataFrame:
    """Brands of a type stand in for its delivery months: ym = brand number."""
    days = T.asset_days(spark, sf, asset="p_brand", universe=F.col("p_type"))
    return days.select(F.col("universe").alias("product"), "dt", F.regexp_extract("asset", r"(\d+)$", 1).cast("int").alias("ym"),
                       (F.col("cents").cast("double") / F.col("qty").cast("double") / 100.0).alias("settle"))


@query
def term_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.term_structure(settles(spark, sf)).select("product", "dt", "curve"))


@query
def curve_forward_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Does the curve of a product say anything about its next 21 rows?"""
    curve = G.term_structure(settles(spark, sf)).select(F.col("product").alias("asset"), "dt", "curve")
    fwd = T.test_prices(spark, sf).join(curve, ["asset", "dt"]).withColumn("fwd", G.forward_return(21))
    return rounded(M.conditional_forward_mean(fwd, "curve", "fwd", ("universe", "asset")))


@query
def curve_timing(spark: SparkSession, sf: str) -> DataFrame:
    """Hold a product while its curve is inverted at month end; each product fills 1/N of the book."""
    px = prices(spark, sf)
    curve = G.term_structure(settles(spark, sf)).select(F.lit("types").alias("universe"), F.col("product").alias("asset"), "dt", "curve")
    panel = P.prepare_panel(px, limit=0, staged=True)
    return rounded(M.perf(B.slot_book(panel, G.curve_signal(panel.obs, curve), 200, "curve_timing")))


def two_series(panel: P.Panel) -> DataFrame:
    return B.buy_and_hold(panel, BENCH, "bench", 1).unionByName(B.buy_and_hold(panel, BOND, "bond", 1))


@query
def rolling_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rolled = G.rolling_metrics(two_series(market(spark, sf)))
    return rounded(rolled.select("universe", "run_id", "dt", "roll_sharpe", "roll_vol", "underwater"))


@query
def rolling_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.rolling_summary(G.rolling_metrics(two_series(market(spark, sf)))))


@query
def regimes(spark: SparkSession, sf: str) -> DataFrame:
    return G.regime_labels(market(spark, sf), BENCH)


@query
def rolling_inverse_vol(spark: SparkSession, sf: str) -> DataFrame:
    series = two_series(market(spark, sf)).withColumnRenamed("run_id", "name")
    return rounded(G.rolling_inverse_vol_weights(series, 63).select("universe", "name", "dt", "weight"))


@query
def inverse_vol_static(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.inverse_vol_static(two_series(market(spark, sf)).withColumnRenamed("run_id", "name")))


def pair_frame(panel: P.Panel) -> DataFrame:
    s = two_series(panel)
    pick = lambda name, col: s.filter(F.col("run_id") == name).select("universe", "dt", F.col("net").alias(col))
    return pick("bench", "x").join(pick("bond", "y"), ["universe", "dt"])


@query
def rolling_min_variance(spark: SparkSession, sf: str) -> DataFrame:
    out = C.rolling_min_variance(pair_frame(market(spark, sf)), 63)
    return rounded(out.select("universe", "dt", "w_x"))


@query
def min_variance_yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Shrunk covariance of all six assets and its minimum-variance weights, per calendar year."""
    rets = P.daily_returns(market(spark, sf)).select("universe", F.year("dt").alias("year"), F.col("row_no").alias("k"), F.col("asset").alias("name"), F.col("ret").alias("x"))
    cov = C.shrunk_covariance(rets, ("universe", "year"))
    pairs = cov.filter("i < j").groupBy("universe", "year").agg(F.max("delta").alias("delta"), F.avg("sigma").alias("mean_cov"))
    w = C.min_variance_weights(cov, ("universe", "year"))
    return rounded(w.join(pairs, ["universe", "year"]))
