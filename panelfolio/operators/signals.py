"""Window signals over the price rows of one asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.functions import scalars as S
from panelfolio.operators.panel import ASSET, Panel, asset_window


def frame(rows: int, order: str = "row_no", keys: tuple[str, ...] = ASSET):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)


def running(order: str = "row_no", keys: tuple[str, ...] = ASSET):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def with_rolling(df: DataFrame, value: str, rows: int, prefix: str, std: bool = True, order: str = "row_no",
                 keys: tuple[str, ...] = ASSET) -> DataFrame:
    """Add ``<prefix>_mean`` (and ``<prefix>_std``, sample) over the last ``rows`` rows; null until all are present.

    Nulls and NaNs in ``value`` leave the frame incomplete, hence null. One algorithm serves all lengths: the partition
    is cut into blocks of ``rows`` rows, so a frame is the end of one block and the start of the next. Both are expanding
    aggregates, linear in the rows, and their moments combine; a frame of equal values has deviation exactly 0.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    out = (df.withColumn("_x", F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")))
           .withColumn("_p", F.row_number().over(w) - 1).withColumn("_b", F.floor(F.col("_p") / rows)))
    head = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tail = Window.partitionBy(*keys, "_b").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    moments = lambda over: F.struct(F.count("_x").over(over).alias("n"), F.avg("_x").over(over).alias("m"), F.var_pop("_x").over(over).alias("v"),
                                    F.min("_x").over(over).alias("lo"), F.max("_x").over(over).alias("hi"))
    out = out.withColumn("_e", moments(tail)).withColumn("_h", moments(head))
    out = out.withColumn("_e", F.when(F.col("_p") % rows != rows - 1, F.lag("_e", rows - 1).over(w)) if rows > 1 else F.lit(None).cast(out.schema["_e"].dataType))
    n1, n2 = F.coalesce(F.col("_e.n"), F.lit(0)), F.col("_h.n")
    m1, m2 = F.coalesce(F.col("_e.m"), F.lit(0.0)), F.coalesce(F.col("_h.m"), F.lit(0.0))
    full = n1 + n2 == rows
    flat = F.least("_e.lo", "_h.lo") == F.greatest("_e.hi", "_h.hi")
    out = out.withColumn(f"{prefix}_mean", F.when(full, F.when(flat, F.col("_h.lo")).otherwise((n1 * m1 + n2 * m2) / rows)))
    if std:
        gap = m1 - m2
        square = n1 * F.coalesce(F.col("_e.v"), F.lit(0.0)) + n2 * F.col("_h.v") + gap * gap * n1 * n2 / rows
        deviation = F.sqrt(square / (rows - 1)) if rows > 1 else F.lit(None).cast("double")
        out = out.withColumn(f"{prefix}_std", F.when(full, F.when(flat, F.lit(0.0)).otherwise(deviation)))
    return out.drop("_x", "_p", "_b", "_e", "_h")


def with_observations(obs: DataFrame) -> DataFrame:
    """obs_no (1-based count of the asset's price rows) and ret (null on the first row)."""
    w = asset_window("row_no")
    return (obs.withColumn("obs_no", F.row_number().over(w))
            .withColumn("ret", S.ratio(F.col("close"), F.lag("close").over(w)) - 1))


def past(k: int) -> str:
    return f"close_{k}"


def with_past_closes(df: DataFrame, offsets: set[int]) -> DataFrame:
    w = asset_window("row_no")
    return df.withColumns({past(k): F.lag("close", k).over(w) for k in sorted(offsets) if k})


def momentum_sql(lookbacks: tuple[int, ...], skip: int = 0, weights: tuple[float, ...] | None = None) -> str:
    """Weighted mean of trailing returns over `with_past_closes` columns; null unless every window is complete."""
    at = lambda k: past(k) if k else "close"
    w = [max(float(x), 0.0) for x in weights] if weights and len(weights) == len(lookbacks) else []
    w = w if sum(w) > 0 else [1.0] * len(lookbacks)
    terms = [f"{wi}D * ({at(skip)} / nullif({at(skip + lb)}, 0D) - 1)" for wi, lb in zip(w, lookbacks)]
    return f"({' + '.join(terms)}) / {sum(w)}D"


def blended_momentum(lookbacks: tuple[int, ...], skip: int = 0, weights: tuple[float, ...] | None = None) -> Column:
    return F.expr(momentum_sql(lookbacks, skip, weights))


def momentum_offsets(lookbacks: tuple[int, ...], skip: int = 0) -> set[int]:
    return {skip} | {skip + lb for lb in lookbacks}


def with_asset_vol(df: DataFrame, window: int, skip: int = 0) -> DataFrame:
    """``vol_<window>_<skip>``: population deviation of the last ``window`` returns, ending ``skip`` rows back.

    Needs obs_no and ret. Null when fewer than window + 1 prices exist.
    """
    name = f"vol_{window}_{skip}"
    n = F.col("obs_no")
    tmp = with_rolling(df, "ret", window, "_v")
    pop = F.col("_v_std") * F.sqrt(F.lit((window - 1.0) / window))
    tmp = tmp.withColumn(name, F.when(n > window, pop)).drop("_v_mean", "_v_std")
    return tmp.withColumn(name, F.lag(name, skip).over(asset_window("row_no"))) if skip else tmp


def with_tail(df: DataFrame, window: int) -> DataFrame:
    """``tail_<window>``: the last returns of the asset, oldest first, at most ``window`` of them."""
    return df.withColumn(f"tail_{window}", F.collect_list("ret").over(frame(window)))


def with_trend(df: DataFrame, ma: int) -> DataFrame:
    """``ma_<n>`` and ``below_<n>`` (close strictly under its mean; false while the mean is undefined)."""
    out = with_rolling(df, "close", ma, "_t", std=False).withColumnRenamed("_t_mean", f"ma_{ma}")
    return out.withColumn(f"below_{ma}", F.coalesce(F.col("close") < F.col(f"ma_{ma}"), F.lit(False)))


def rebound_sql(lookback: int, threshold: float) -> str:
    """Sharp short-term rise. Needs obs_no and the lagged close."""
    move = f"close / nullif({past(lookback)}, 0D) - 1"
    return f"coalesce(obs_no > {lookback + 1} and {move} >= {float(threshold)}D, false)"


def with_peak(df: DataFrame, window: int) -> DataFrame:
    return df.withColumn(f"peak_{window}", F.max("close").over(frame(window)))


def drawdown_sql(window: int, threshold: float) -> str:
    """Deep fall from the peak of the window, which includes today. Needs obs_no and `with_peak`."""
    peak = f"peak_{window}"
    return f"coalesce(obs_no > {window} and (close - {peak}) / nullif({peak}, 0D) <= {float(threshold)}D, false)"


def ts_momentum(obs: DataFrame, with_trend_filter: bool = True, lookbacks: tuple[int, ...] = (21, 63, 126),
                ma: int = 200) -> DataFrame:
    """Column ``signal`` in {0, 1}: positive blended momentum and, optionally, a close above its long mean."""
    df = with_past_closes(with_observations(obs), momentum_offsets(lookbacks))
    need = F.col("obs_no") >= (ma + 1 if with_trend_filter else max(lookbacks) + 1)
    up = blended_momentum(lookbacks) > 0
    if with_trend_filter:
        df = with_trend(df, ma)
        up = up & (F.col("close") > F.col(f"ma_{ma}"))
    return df.withColumn("momentum", blended_momentum(lookbacks)).withColumn(
        "signal", F.when(need & up, 1.0).otherwise(0.0))


def zscore_weights(panel: Panel, assets: list[str], defence: str, benchmark: str, window: int = 20,
                   gate_ma: int | None = None) -> DataFrame:
    """Daily weights (universe, asset, row_no, weight): oversold assets get up to 1/k each, the rest goes to defence.

    Rows mode: a price gap inside the window leaves no weight for that asset on that row.
    """
    mine = panel.obs.filter(F.col("asset").isin(*assets, benchmark))
    df = with_rolling(mine, "close", window, "z")
    in_rows = F.col("row_no") - F.lag("row_no", window - 1).over(asset_window("row_no")) == window - 1
    z = F.when(in_rows, (F.col("close") - F.col("z_mean")) / (F.col("z_std") + S.EPS))
    df = df.withColumn("z", z)
    slot = S.clip(F.lit(0.5) - F.col("z") * 0.5, 0.0, 1.0) / len(assets)
    if gate_ma:
        bench = with_trend(panel.obs.filter(F.col("asset") == benchmark), gate_ma)
        span = F.col("row_no") - F.lag("row_no", gate_ma - 1).over(asset_window("row_no")) == gate_ma - 1
        gate = bench.withColumn("open", span & (F.col("close") > F.col(f"ma_{gate_ma}"))).select(
            "universe", "row_no", F.coalesce(F.col("open"), F.lit(False)).cast("double").alias("gate"))
        df = df.join(gate, ["universe", "row_no"], "left")
        slot = slot * F.coalesce(F.col("gate"), F.lit(0.0))
    risky = (df.filter(F.col("asset").isin(*assets)).filter("z is not null")
             .select("universe", "asset", "row_no", slot.alias("weight")))
    used = risky.groupBy("universe", "row_no").agg(F.sum("weight").alias("used"))
    rest = (panel.calendar.select("universe", "row_no").join(used, ["universe", "row_no"], "left")
            .select("universe", F.lit(defence).alias("asset"), "row_no",
                    S.clip(1 - F.coalesce(F.col("used"), F.lit(0.0)), 0.0, 1.0).alias("weight")))
    return risky.unionByName(rest)


def rolling_ols(bars: DataFrame, window: int = 18, keys: tuple[str, ...] = ASSET, order: str = "dt") -> DataFrame:
    """``slope`` and ``r2`` of high on low over the last rows; flat high gives r2 0, flat low gives null."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    pair = F.col("high").isNotNull() & F.col("low").isNotNull()
    full = F.count(F.when(pair, 1)).over(w) == window
    x_moves = F.var_pop("low").over(w) * window > S.EPS
    y_moves = F.var_pop("high").over(w) * window > S.EPS
    fit = bars.withColumn("_ok", full & x_moves).withColumn("_y", y_moves)
    return (fit.withColumn("slope", F.when(F.col("_ok"), F.regr_slope("high", "low").over(w)))
            .withColumn("r2", F.when(F.col("_ok") & F.col("_y"), F.regr_r2("high", "low").over(w))
                        .when(F.col("_ok"), F.lit(0.0))).drop("_ok", "_y"))


def modified_score(fits: DataFrame, window: int = 600, threshold: float = 0.7, keys: tuple[str, ...] = ASSET,
                   order: str = "dt") -> DataFrame:
    """z-score of the slope over its own history, times r2; ``signal`` when above the threshold."""
    df = with_rolling(fits, "slope", window, "h", order=order, keys=keys)
    score = S.ratio(F.col("slope") - F.col("h_mean"), F.col("h_std")) * F.col("r2")
    return (df.withColumn("score", score).drop("h_mean", "h_std")
            .withColumn("signal", F.coalesce(F.col("score") > threshold, F.lit(False))))


def signal_and(a: str, b: str) -> Column:
    return F.col(a) & F.col(b)


def term_structure(settles: DataFrame) -> DataFrame:
    """Nearest over next delivery, minus 1, per product and date; dates with one contract drop out."""
    w = Window.partitionBy("product", "dt").orderBy("ym")
    two = settles.filter("settle is not null").withColumn("k", F.row_number().over(w)).filter("k <= 2")
    return (two.groupBy("product", "dt").agg(F.max(F.when(F.col("k") == 1, F.col("settle"))).alias("near"),
                                             F.max(F.when(F.col("k") == 2, F.col("settle"))).alias("next"))
            .filter("next is not null").withColumn("curve", F.col("near") / F.col("next") - 1))


def curve_signal(obs: DataFrame, curve: DataFrame) -> DataFrame:
    """``signal`` 1 while the asset's curve in force is inverted. ``curve``: universe, asset, dt, curve.

    A curve value stays in force until the next one: both time lines of the asset are united and carry the last value.
    """
    line = obs.select(*ASSET, "dt", "row_no", F.lit(None).cast("double").alias("curve"), F.lit(1).alias("kind")).unionByName(
        curve.select(*ASSET, "dt", F.lit(None).cast("int").alias("row_no"), "curve", F.lit(0).alias("kind")))
    w = Window.partitionBy(*ASSET).orderBy("dt", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("curve", ignorenulls=True).over(w)
    return line.withColumn("last_curve", last).filter("kind = 1").withColumn("signal", F.when(F.col("last_curve") > 0, 1.0).otherwise(0.0))


def forward_return(h: int, order: str = "dt", keys: tuple[str, ...] = ASSET) -> Column:
    w = Window.partitionBy(*keys).orderBy(order)
    return F.lead("close", h).over(w) / F.col("close") - 1


def low_vol_score(filled: DataFrame, window: int = 126) -> DataFrame:
    """Minus the annual deviation of the last ``window`` row returns. Needs a panel without gaps (unbounded fill)."""
    w = asset_window("row_no")
    df = with_rolling(filled.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1), "ret", window, "_l")
    return df.withColumn("score", -F.col("_l_std") * F.sqrt(F.lit(252.0))).drop("_l_mean", "_l_std", "ret")


def reversal_score(filled: DataFrame, lookback: int = 21) -> DataFrame:
    """Minus the trailing return between two rows that both carry a real price. Needs a panel without gaps."""
    w = asset_window("row_no")
    real = ~F.col("is_filled") & ~F.lag("is_filled", lookback).over(w)
    return filled.withColumn("score", F.when(real, -(F.col("close") / F.lag("close", lookback).over(w) - 1)))


def momentum_score(obs: DataFrame, lookbacks: tuple[int, ...] = (21, 63, 126)) -> DataFrame:
    return with_past_closes(obs, momentum_offsets(lookbacks)).withColumn("score", blended_momentum(lookbacks))


def nav(df: DataFrame, ret: str = "net", keys: tuple[str, ...] = ("universe", "run_id"), order: str = "dt",
        rebase: bool = True) -> DataFrame:
    """``nav``: running product of 1 + ret; rebased to 1 on the first row by default."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    growth = F.product(1 + F.col(ret)).over(w)
    return df.withColumn("nav", growth / F.first(1 + F.col(ret)).over(w) if rebase else growth)


def underwater(df: DataFrame, keys: tuple[str, ...] = ("universe", "run_id"), order: str = "dt") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("underwater", F.col("nav") / F.max("nav").over(w) - 1)


def rolling_metrics(returns: DataFrame, window: int = 252, ret: str = "net",
                    keys: tuple[str, ...] = ("universe", "run_id"), order: str = "dt") -> DataFrame:
    """roll_sharpe, roll_vol over ``window`` rows plus the underwater curve of the unrebased growth."""
    df = with_rolling(returns, ret, window, "_r", order=order, keys=keys)
    df = (df.withColumn("roll_sharpe", S.sharpe(F.col("_r_mean"), F.col("_r_std")))
          .withColumn("roll_vol", F.col("_r_std") * F.sqrt(F.lit(252.0))).drop("_r_mean", "_r_std"))
    return underwater(nav(df, ret, keys, order, rebase=False), keys, order)


def regime_labels(panel: Panel, benchmark: str, bear_drawdown: float = -0.20, ma: int = 200) -> DataFrame:
    """(universe, dt, regime): bear on deep drawdown, bull above the long mean, else sideways."""
    bench = panel.obs.filter(F.col("asset") == benchmark)
    w = asset_window("row_no")
    df = bench.withColumn("ret", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))
    df = underwater(nav(df, "ret", ASSET, "row_no"), ASSET, "row_no")
    df = with_rolling(df, "nav", ma, "_m", std=False, order="row_no")
    bear = F.col("underwater") < bear_drawdown
    return df.select("universe", "dt", F.when(bear, F.lit("bear"))
                     .when(F.col("nav") > F.col("_m_mean"), F.lit("bull")).otherwise(F.lit("sideways")).alias("regime"))


def rolling_inverse_vol_weights(series: DataFrame, window: int = 63, keys: tuple[str, ...] = ("universe",)) -> DataFrame:
    """Long (keys, name, dt, net) -> weight of each series: 1/sigma normalised per date, lagged a day, default 1/k."""
    by_name = (*keys, "name")
    df = with_rolling(series, "net", window, "_v", order="dt", keys=by_name)
    same_day = Window.partitionBy(*keys, "dt")
    inverse = F.when(F.col("_v_std") > 0, 1 / F.col("_v_std"))
    df = df.withColumn("_inv", inverse).withColumn("_k", F.count(F.lit(1)).over(same_day))
    whole = F.count("_inv").over(same_day) == F.col("_k")
    df = df.withColumn("_w", F.when(whole, F.col("_inv") / F.sum("_inv").over(same_day)))
    lagged = F.lag("_w").over(Window.partitionBy(*by_name).orderBy("dt"))
    return df.withColumn("weight", F.coalesce(lagged, 1 / F.col("_k"))).drop("_v_mean", "_v_std", "_inv", "_w", "_k")


def hold_between_rebalances(df: DataFrame, signal: str, is_rebalance: str, keys: tuple[str, ...] = ASSET,
                            order: str = "row_no") -> DataFrame:
    """Sample on rebalance rows, hold, fill one row later (``pos``), earn one row after that (``pos_lag``)."""
    w = Window.partitionBy(*keys).orderBy(order)
    held = F.last(F.when(F.col(is_rebalance), F.col(signal)), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_held", F.coalesce(held, F.lit(0.0)))
    df = df.withColumn("pos", F.coalesce(F.lag("_held").over(w), F.lit(0.0)))
    return df.withColumn("pos_lag", F.coalesce(F.lag("pos").over(w), F.lit(0.0))).drop("_held")
