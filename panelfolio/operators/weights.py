"""Target weights: selection, weighting and the stacked overlays, for all parameter sets at once.

Only rows that are in force at a rebalance look back on their closes, once for the union of all windows the parameter sets
need, and only then is each row multiplied by the parameter sets.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.functions import scalars as S
from panelfolio.operators.panel import ASSET, Panel, asset_window, rebalances
from panelfolio.params import ParamSet

DECISION = ("universe", "run_id", "reb_no")


def in_force_at_rebalances(df: DataFrame) -> DataFrame:
    """Rows that are the asset's latest price at some rebalance, once per such rebalance (column reb_no).

    A price is in force from its own calendar row until the asset's next price, so the ordinals it serves are known
    from the next row's count of earlier month ends; no as-of join is needed.
    """
    upto = F.coalesce(F.lead("reb_before").over(asset_window("row_no")), F.col("n_reb"))
    return (df.withColumn("_upto", upto).filter("_upto > reb_before")
            .withColumn("reb_no", F.explode(F.sequence(F.col("reb_before") + 1, F.col("_upto")))).drop("_upto"))


def closes_at_rebalances(obs: DataFrame, rows: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(universe, asset, reb_no, obs_no, *keep, closes): the last ``rows`` closes, oldest first, of every asset at every rebalance.

    Prices are gathered once into blocks of ``rows``; a block and the one before it hold whatever a row of it looks back
    on, so only rows in force at a rebalance carry an array. ``keep`` are columns that an asset has one value of.
    """
    along = asset_window("row_no")
    df = obs.select(*ASSET, *keep, F.row_number().over(along).alias("obs_no"), "close", (F.col("reb_before") + 1).alias("first_reb"),
                    F.coalesce(F.lead("reb_before").over(along), F.col("n_reb")).alias("last_reb"))
    df = df.withColumn("_block", F.floor((F.col("obs_no") - 1) / rows))
    blocks = df.groupBy(*ASSET, *keep, "_block").agg(F.array_sort(F.collect_list(F.struct("obs_no", "close", "first_reb", "last_reb"))).alias("_rows"))
    closes = F.transform("_rows", lambda r: r["close"])
    older = F.coalesce(F.lag(closes).over(asset_window("_block")), F.array().cast("array<double>"))
    serving = F.filter("_rows", lambda r: r["last_reb"] >= r["first_reb"])
    out = blocks.withColumn("_older", older).select(*ASSET, *keep, "_block", F.concat("_older", closes).alias("_closes"), F.size("_older").alias("_n"), F.explode(serving).alias("_at"))
    last = F.col("_n") + F.col("_at.obs_no") - F.col("_block") * rows
    first = F.greatest(last - rows + 1, F.lit(1))
    window = F.slice("_closes", first.cast("int"), (last - first + 1).cast("int"))
    return out.select(*ASSET, *keep, "_at.obs_no", window.alias("closes"), F.explode(F.sequence("_at.first_reb", "_at.last_reb")).alias("reb_no"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_rows(x: Column, rows: Column | int, skip: Column | int = 0) -> Column:
    """The last ``rows`` elements that end ``skip`` before the end; null where there are fewer."""
    n = F.size(x) - skip
    return F.when(n >= rows, F.slice(x, (n - rows + 1).cast("int"), F.lit(rows) if isinstance(rows, int) else rows))


def mean_of(x: Column) -> Column:
    """Mean; of equal values exactly that value."""
    return _let(x, lambda v: F.when(F.array_min(v) == F.array_max(v), F.array_min(v)).otherwise(F.reduce(v, F.lit(0.0), lambda a, e: a + e) / F.size(v)))


def deviation_of(x: Column) -> Column:
    """Population deviation; of equal values exactly 0, null where a value is."""
    whole = lambda v: ~F.exists(v, lambda e: e.isNull())
    spread = lambda v: F.sqrt(_let(mean_of(v), lambda m: F.reduce(v, F.lit(0.0), lambda a, e: a + (e - m) * (e - m))) / F.size(v))
    return _let(x, lambda v: F.when(whole(v), F.when(F.array_min(v) == F.array_max(v), F.lit(0.0)).otherwise(spread(v))))


def returns_of(closes: Column) -> Column:
    """Returns from each close to the next: one fewer."""
    return F.zip_with(F.slice(closes, 2, F.greatest(F.size(closes) - 1, F.lit(0))), F.slice(closes, 1, F.greatest(F.size(closes) - 1, F.lit(0))), lambda now, before: S.ratio(now, before) - 1)


# One parameter set as a row: every set has the same fields, and what it reads is named by keys.
PARAM_FIELDS = """run_id string, need int, skip int, lookbacks array<struct<rows:int,weight:double>>, risk_key string, vol_key string, below_key string, peak_key string,
 crash_lookback int, crash_thr double, dd_window int, dd_thr double, top_n int, buffer double, hold_all boolean, inv_vol boolean, vol_window int, vol_target double,
 trend_cut double, crash_cut double, dd_cut double, max_weight double"""


def param_rows(params: list[ParamSet]) -> tuple[list[dict], list[dict], int]:
    """The grid as rows, the windows (key, kind, rows, skip) it reads, and how many closes these look back on."""
    windows: dict[str, dict] = {}

    def read(kind: str, rows: int, skip: int = 0) -> str:
        key = f"{kind}_{rows}_{skip}"
        windows[key] = {"key": key, "kind": kind, "rows": rows, "skip": skip}
        return key

    out = []
    for p in params:
        w = [max(float(x), 0.0) for x in p.lookback_weights] if p.lookback_weights and len(p.lookback_weights) == len(p.lookbacks) else []
        w = w if sum(w) > 0 else [1.0] * len(p.lookbacks)
        number = lambda v: None if v is None else float(v)
        out.append({
            "run_id": p.run_id, "need": p.need, "skip": p.skip, "lookbacks": [{"rows": lb, "weight": x} for lb, x in zip(p.lookbacks, w)],
            "risk_key": read("vol", max(p.lookbacks), p.skip) if p.risk_adj else None, "vol_key": read("vol", p.inv_vol_window) if p.weighting == "inv_vol" else None,
            "below_key": read("mean", p.trend_ma) if p.trend_ma else None, "peak_key": read("peak", p.dd_window) if p.drawdown_prot else None,
            "crash_lookback": p.crash_lookback if p.crash_prot else None, "crash_thr": float(p.crash_thr), "dd_window": p.dd_window, "dd_thr": float(p.dd_thr),
            "top_n": p.top_n, "buffer": number(p.cash_buffer), "hold_all": p.hold_all, "inv_vol": p.weighting == "inv_vol", "vol_window": p.vol_window,
            "vol_target": number(p.vol_target), "trend_cut": number(p.trend_cut), "crash_cut": number(p.crash_cut), "dd_cut": number(p.dd_cut), "max_weight": number(p.max_weight)})
    back = [w["rows"] + w["skip"] for w in windows.values()] + [p.skip + max(p.lookbacks) for p in params] + [p.crash_lookback for p in params if p.crash_prot]
    back += [p.vol_window for p in params if p.vol_target]
    return out, list(windows.values()), max(back) + 1


def rebalance_signals(panel: Panel, dim: DataFrame, params: list[ParamSet]) -> DataFrame:
    """One row per (universe, run_id, reb_no, pool asset) with the signals that parameter set reads.

    The grid is data: its windows are rows that the closes at a rebalance are read through, its sets are rows that these
    are multiplied by. The plan is the same for any number of sets and windows.
    """
    pool = dim.filter("pool_order is not null").select(
        "universe", "asset", "pool_order", "bond_asset", "cash_asset", "bench_asset")
    keep = ("pool_order", "bond_asset", "cash_asset", "bench_asset")
    rows, windows, back = param_rows(params)
    obs = panel.obs.select(*ASSET, "row_no", "reb_before", "n_reb", "close").join(pool, list(ASSET))
    df = closes_at_rebalances(obs, back, keep)

    read = F.from_json(F.lit(json.dumps(windows)), "array<struct<key:string,kind:string,rows:int,skip:int>>")
    value = lambda w: (F.when(w["kind"] == "mean", mean_of(last_rows(F.col("closes"), w["rows"], w["skip"])))
                       .when(w["kind"] == "peak", F.array_max(last_rows(F.col("closes"), w["rows"], w["skip"])))
                       .otherwise(deviation_of(returns_of(last_rows(F.col("closes"), w["rows"] + 1, w["skip"])))))
    df = df.withColumn("windows", F.map_from_entries(F.transform(read, lambda w: F.struct(w["key"].alias("key"), value(w).alias("value")))))
    widest = max([p.vol_window for p in params if p.vol_target], default=0)
    recent = F.slice("closes", F.greatest(F.size("closes") - widest, F.lit(1)), widest + 1)
    df = df.withColumn("tail", F.filter(returns_of(recent), lambda r: r.isNotNull()) if widest else F.lit(None).cast("array<double>"))
    df = df.join(rebalances(panel.calendar).drop("n_reb"), ["universe", "reb_no"])
    grid = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in map(str.strip, PARAM_FIELDS.split(', ')))}>>")
    df = df.select("universe", "reb_no", "reb_row", "signal_dt", "asset", "obs_no", "closes", "windows", "tail", *keep, F.inline(grid)).filter("reb_row >= need")

    back_by = lambda k: F.get("closes", F.size("closes") - 1 - k)
    move = lambda lb: lb["weight"] * (S.ratio(back_by(F.col("skip")), back_by(F.col("skip") + lb["rows"])) - 1)
    total = F.reduce("lookbacks", F.lit(0.0), lambda a, lb: a + lb["weight"])
    momentum = F.reduce("lookbacks", F.lit(0.0), lambda a, lb: a + move(lb)) / total
    at = lambda key: F.try_element_at("windows", F.col(key))
    now = back_by(F.lit(0))
    rise = S.ratio(now, back_by(F.col("crash_lookback"))) - 1
    fall = S.ratio(now - at("peak_key"), at("peak_key"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    signals = {"momentum": F.when(F.col("risk_key").isNull(), momentum).otherwise(S.ratio(momentum, at("risk_key"))), "vol": at("vol_key"), "below": flag(now < at("below_key")),
               "rebound": flag((F.col("obs_no") > F.col("crash_lookback") + 1) & (rise >= F.col("crash_thr"))),
               "fallen": flag((F.col("obs_no") > F.col("dd_window")) & (fall <= F.col("dd_thr")))}
    return df.withColumns(signals).drop("closes", "windows", "obs_no", "lookbacks", "risk_key", "vol_key", "below_key", "peak_key", "crash_lookback", "crash_thr", "dd_window", "dd_thr")


OVER = f"over (partition by {', '.join(DECISION)})"


def select_candidates(sig: DataFrame) -> DataFrame:
    """Candidates have a momentum; fewer than top_n means no decision. Ranking breaks ties by pool order."""
    ranked = f"over (partition by {', '.join(DECISION)} order by momentum desc nulls last, pool_order)"
    market = [f"coalesce(max(case when asset = bench_asset then {f} end) {OVER}, false) as mkt_{f}"
              for f in ("below", "rebound", "fallen")]
    out = sig.selectExpr("*", f"count(momentum) {OVER} as n_cand", f"row_number() {ranked} as rank", *market)
    return out.filter("momentum is not null and n_cand >= top_n and (hold_all or rank <= top_n)")


def base_weights(sel: DataFrame) -> DataFrame:
    """Equal or inverse-volatility weights, the absolute momentum gate and the single-asset cap."""
    df = sel.selectExpr("*", "coalesce(case when vol > 0 then 1 / vol end, 1D) as _raw", "hold_all or momentum > 0 as held",
                        "inv_vol and not hold_all as _uses_vol")
    df = df.selectExpr("*", f"""case when _uses_vol then buffer * _raw / sum(_raw) {OVER}
                                     when hold_all then buffer / n_cand else buffer / top_n end as w_sel""")
    df = df.selectExpr("*", """case when not held then 0D when hold_all then w_sel
                                    else least(w_sel, coalesce(max_weight, w_sel)) end as w0""")
    return df.selectExpr("*", "w_sel - w0 as cash0",
                         "case when held then case when _uses_vol then w_sel else 1D end end as _risk_w").drop("_raw", "_uses_vol")


def with_basket_vol(df: DataFrame) -> DataFrame:
    """``basket_vol``: annual population deviation of the held basket over its last ``vol_window`` returns.

    A decision is one row of its selected assets while the basket is summed: no window per return, no row per return.
    """
    rest = [c for c in df.columns if c not in DECISION]
    one = df.groupBy(*DECISION).agg(F.collect_list(F.struct(*rest)).alias("_rows"), F.first("vol_window").alias("_k"))
    held = F.filter("_rows", lambda r: r["held"])
    total = F.reduce(held, F.lit(0.0), lambda a, r: a + r["_risk_w"])
    basket = lambda k: F.reduce(held, F.lit(0.0), lambda a, r: a + r["_risk_w"] * F.get(r["tail"], F.size(r["tail"]) - F.col("_k") + k))
    returns = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda k: S.ratio(basket(k), total))
    deviation = _let(returns, lambda x: _let(F.reduce(x, F.lit(0.0), lambda a, e: a + e) / F.size(x), lambda m: F.sqrt(
        F.reduce(x, F.lit(0.0), lambda a, e: a + (e - m) * (e - m)) / F.size(x))))
    short = F.exists(held, lambda r: F.size(r["tail"]) < F.col("_k"))
    return one.select(*DECISION, F.when(~short, deviation * F.sqrt(F.lit(252.0))).alias("basket_vol"), F.inline("_rows")).drop("tail")


def overlay_scales(df: DataFrame) -> DataFrame:
    """s_vol, s_trend, s_crash, s_dd: the share of the risky weight each overlay keeps."""
    return df.selectExpr(
        "*", "case when basket_vol > 0 and basket_vol > vol_target then vol_target / basket_vol else 1D end as s_vol",
        "case when mkt_below then trend_cut else 1D end as s_trend",
        "case when mkt_rebound then crash_cut else 1D end as s_crash", "case when mkt_fallen then dd_cut else 1D end as s_dd")


def decision_rows(panel: Panel, dim: DataFrame, params: list[ParamSet]) -> DataFrame:
    """The whole chain before legs are summed: one row per selected asset with w0 and all overlay scales."""
    df = base_weights(select_candidates(rebalance_signals(panel, dim, params)))
    scaled = any(p.vol_target for p in params)
    df = with_basket_vol(df) if scaled else df.withColumn("basket_vol", F.lit(None).cast("double"))
    return overlay_scales(df)


def legs_to_targets(rows: DataFrame) -> DataFrame:
    """Closed form of the overlay chain: risky weight, cash-like leg and bond leg, summed per asset."""
    df = rows.selectExpr(*DECISION, "asset", "held", "cash_asset", "bond_asset", "w0 * s_vol as risky",
                         "s_trend * s_crash * s_dd as kept", "cash0 + w0 * (1 - s_vol) as cash")
    legs = """inline(array(struct(asset as asset, risky * kept as weight, held as active),
                           struct(cash_asset as asset, cash as weight, cash > 0 as active),
                           struct(bond_asset as asset, risky * (1 - kept) as weight, risky * (1 - kept) > 0 as active)))"""
    return (df.selectExpr(*DECISION, legs).filter("active")
            .groupBy(*DECISION, "asset").agg(F.sum("weight").alias("weight")))


def decide_targets(panel: Panel, dim: DataFrame, params: list[ParamSet]) -> DataFrame:
    """targets(universe, run_id, reb_no, asset, weight) for every rebalance and parameter set."""
    return legs_to_targets(decision_rows(panel, dim, params))


def picks(panel: Panel, dim: DataFrame, params: list[ParamSet]) -> DataFrame:
    """Selected assets per decision with rank and whether momentum kept the slot."""
    rows = select_candidates(rebalance_signals(panel, dim, params))
    return rows.select("universe", "run_id", "signal_dt", "asset", "rank", "momentum",
                       (F.col("hold_all") | (F.col("momentum") > 0)).alias("held"))


def equal_weight_targets(panel: Panel, run_id: str, min_row: int = 0) -> DataFrame:
    """1/n of all assets of the panel, set again at every rebalance from ``min_row`` on."""
    held = panel.obs.select(*ASSET).distinct()
    held = held.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("universe")))
    at = rebalances(panel.calendar).filter(F.col("reb_row") >= min_row).select("universe", "reb_no")
    return held.join(at, "universe").select("universe", F.lit(run_id).alias("run_id"), "reb_no", "asset", "weight")


def cross_section_targets(scored: DataFrame, panel: Panel, run_id: str, n: int, min_row: int) -> DataFrame:
    """Top n of any score on the rebalance row itself, equal weights; too few scores carry the previous targets."""
    at = panel.calendar.filter((F.col("is_month_end")) & (F.col("row_no") >= min_row)).select("universe", "row_no", "reb_no")
    group = Window.partitionBy("universe", "reb_no")
    rows = scored.filter("score is not null").select(*ASSET, "row_no", "score").join(at, ["universe", "row_no"])
    ranked = (rows.withColumn("rank", F.row_number().over(group.orderBy(F.desc("score"), "asset")))
              .withColumn("n_scored", F.count(F.lit(1)).over(group)))
    return (ranked.filter((F.col("n_scored") >= n) & (F.col("rank") <= n))
            .select("universe", F.lit(run_id).alias("run_id"), "reb_no", "asset", F.lit(1.0 / n).alias("weight")))


def inverse_vol_static(series: DataFrame, keys: tuple[str, ...] = ("universe",)) -> DataFrame:
    """Full-sample 1/sigma weights per named return series."""
    vol = series.groupBy(*keys, "name").agg(F.stddev_pop("net").alias("vol"))
    inverse = 1 / F.greatest(F.col("vol"), F.lit(S.EPS))
    return vol.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy(*keys)))
