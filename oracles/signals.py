from __future__ import annotations

from oracles import sql as Q
from panelfolio import testpanel as T
from panelfolio.params import ParamSet

S: dict[str, str] = {}
U = T.TYPES
MOMENTUM_RUNS = [ParamSet("plain"), ParamSet("skip", skip=21), ParamSet("weighted", lookback_weights=(1, 2, 3)),
                 ParamSet("risk_adj", risk_adj=True), ParamSet("long", lookbacks=(63, 126, 252), skip=5, risk_adj=True)]


def union(parts: list[str], name: str) -> str:
    return f"{name} as (" + " union all ".join(parts) + ")"


ctes = Q.base()
for i, p in enumerate(MOMENTUM_RUNS):
    ctes += Q.signals(p, U, i)
S["blended_momentum"] = Q.with_(ctes + [union([f"select universe, '{p.run_id}' run_id, signal_dt, asset, mom momentum from sr{i}" for i, p in enumerate(MOMENTUM_RUNS)], "o")],
                                Q.final("o", ["universe", "run_id", "signal_dt", "asset"], ["momentum"]))

S["asset_vols"] = Q.with_(Q.base() + ["""v as (select universe, asset, dt, case when n > 63 then stddev_pop(ret) over (w rows between 62 preceding and current row) end vol_63_0,
 n, case when n > 126 then stddev_pop(ret) over (w rows between 125 preceding and current row) end v126 from obs window w as (partition by universe, asset order by n))""",
    "v2 as (select *, lag(v126, 21) over (partition by universe, asset order by n) vol_126_21 from v)"],
    Q.final("v2", ["universe", "asset", "dt"], ["vol_63_0", "vol_126_21"]))

BASKET = [ParamSet("all"), ParamSet("top3", hold_all=False), ParamSet("inv", hold_all=False, weighting="inv_vol")]
ctes = Q.base()
for i, p in enumerate(BASKET):
    ctes += Q.targets(p, U, i)
S["basket_vol"] = Q.with_(ctes + [union([f"""select universe, '{p.run_id}' run_id, signal_dt, max(rv) basket_vol, min(sv) s_vol, count(*) filter (held) n_held
 from (select s.*, r.rv from s2{i} s left join rv{i} r using (universe, reb_no)) group by 1, 2, 3 having count(*) filter (held) > 0""" for i, p in enumerate(BASKET)], "o")],
    Q.final("o", ["universe", "run_id", "signal_dt", "n_held"], ["basket_vol", "s_vol"]))

S["trend_flags"] = Q.with_(Q.base() + ["""f as (select universe, asset, dt,
 n >= 200 and close < avg(close) over (w rows between 199 preceding and current row) below_200,
 coalesce(n > 22 and close / lag(close, 21) over w - 1 >= 0.10, false) rebound,
 n > 126 and close / max(close) over (w rows between 125 preceding and current row) - 1 <= -0.10 fallen
 from obs window w as (partition by universe, asset order by n))"""], "select * from f")

TSM = """ts as (select universe, asset, dt, n, row_no, close, (close / lag(close, 21) over w + close / lag(close, 63) over w + close / lag(close, 126) over w - 3) / 3 mom,
 avg(close) over (w rows between 199 preceding and current row) ma from obs window w as (partition by universe, asset order by n))"""
S["ts_momentum"] = Q.with_(Q.base() + [TSM], """select universe, asset, dt, case when n >= 201 and mom > 0 and close > ma then 1.0::double else 0.0::double end with_trend,
 case when n >= 127 and mom > 0 then 1.0::double else 0.0::double end plain from ts""")


def zscore(i: str, gate: bool) -> list[str]:
    return [f"""z{i} as (select universe, asset, row_no, greatest(0, least(1, 0.5 - 0.5 * z)) / 5 {'* g' if gate else ''} weight from (
 select o.universe, o.asset, o.row_no, (o.close - avg(o.close) over w) / (stddev_samp(o.close) over w + 1e-12) z,
 o.row_no - lag(o.row_no, 19) over (partition by o.universe, o.asset order by o.row_no) span, coalesce(b.g, 0) g
 from obs o left join (select universe, row_no, case when row_no - lag(row_no, 199) over (order by row_no) = 199
 and close > avg(close) over (order by row_no rows between 199 preceding and current row) then 1.0 else 0.0 end g from obs where asset = 'ECONOMY') b using (universe, row_no)
 where o.asset <> 'STANDARD' window w as (partition by o.universe, o.asset order by o.row_no rows between 19 preceding and current row)) where span = 19)""",
            f"""zw{i} as (select * from z{i} union all select c.universe, 'STANDARD', c.row_no, greatest(0, least(1, 1 - coalesce(sum(weight), 0)))
 from cal c left join z{i} using (universe, row_no) group by 1, 2, 3)""",
            f"""zd{i} as (select c.universe, c.row_no, c.dt, a.asset, coalesce(w.weight, 0) weight, coalesce(o.ret, 0) ret from cal c cross join (select distinct asset from obs) a
 left join zw{i} w using (universe, row_no, asset) left join obs o using (universe, row_no, asset))""",
            f"""zr{i} as (select universe, '{i}' run_id, dt, row_no, sum(w2 * ret) - sum(abs(w1 - w2)) * 0.00075 net from (
 select *, coalesce(lag(weight, 1) over w, 0) w1, coalesce(lag(weight, 2) over w, 0) w2 from zd{i} window w as (partition by asset order by row_no)) group by 1, 2, 3, 4)"""]


S["zscore_weights"] = Q.with_(Q.base() + zscore("gated", True), Q.final("zwgated", ["universe", "asset", "row_no"], ["weight"]))
S["zscore_reversion_whole"] = Q.with_(Q.base() + zscore("open", False) + zscore("gated", True) + [
    "zf as (select universe, min(row_no) f from (select universe, row_no from zopen group by 1, 2 having count(*) = 5) group by 1)",
    "za as (select r.* from (select * from zropen union all select * from zrgated) r join zf using (universe) where row_no >= f)"] + Q.perf("za"), Q.final("pf", ["universe", "run_id"], Q.PERF))
S["zscore_reversion"] = S["zscore_reversion_whole"]

OLS = """ols as (select universe, asset, dt, close, case when k = 18 then regr_slope(high, low) over w end slope, case when k = 18 then regr_r2(high, low) over w end r2 from
 (select *, count(*) over (partition by universe, asset order by dt rows between 17 preceding and current row) k from {src})
 window w as (partition by universe, asset order by dt rows between 17 preceding and current row))"""
SCORE = """sc as (select *, coalesce(score > 0.7, false) "signal" from (select *, case when count(slope) over w = 600 then (slope - avg(slope) over w) / stddev_samp(slope) over w * r2 end score
 from ols window w as (partition by universe, asset order by dt rows between 599 preceding and current row)))"""
S["rolling_ols"] = Q.with_(Q.prices() + [OLS.format(src="px")], Q.final("ols", ["universe", "asset", "dt"], ["slope", "r2"]))
S["modified_score"] = Q.with_(Q.prices() + [OLS.format(src="px"), SCORE, """ag as (select universe, asset, dt, score, "signal", "signal" and n >= 200 and close > ma agree from
 (select *, row_number() over (partition by universe, asset order by dt) n, avg(close) over (partition by universe, asset order by dt rows between 199 preceding and current row) ma from sc))"""],
    Q.final("ag", ["universe", "asset", "dt", '"signal"', "agree"], ["score"]))


def timing(src: str, name: str, min_row: int) -> list[str]:
    """src(universe, asset, dt, close, sig 0/1): one row per price of the asset."""
    return [f"""{name}_a as (select *, coalesce(close / lag(close) over w - 1, 0) ret, row_number() over w - 1 rn,
 coalesce(date_trunc('month', lead(dt) over w) <> date_trunc('month', dt), true) me from {src} window w as (partition by universe, asset order by dt))""",
            f"""{name}_b as (select *, coalesce(last_value(case when me and rn >= {min_row} then sig end ignore nulls) over (partition by universe, asset order by dt rows between unbounded preceding and current row), 0) held,
 min(case when me and rn >= {min_row} then rn end) over (partition by universe, asset) first_rn from {name}_a)""",
            f"""{name} as (select universe, asset, dt, first_rn, rn, p2 * ret - abs(p1 - p2) * 0.00075 net from (select *, coalesce(lag(held, 1) over w, 0) p1, coalesce(lag(held, 2) over w, 0) p2
 from {name}_b window w as (partition by universe, asset order by dt)) where rn >= first_rn)"""]


S["ols_timing"] = Q.with_(Q.prices() + [OLS.format(src="(select * from px where asset = 'ECONOMY')"), SCORE,
    "sg as (select universe, asset, dt, close, cast(\"signal\" as double) sig from sc)"] + timing("sg", "tm", 600) + [
    "tr as (select *, 'ols_timing' run_id from tm)", "sh as (select universe, avg(sig) long_share, count(*) n from sg group by 1)"] + Q.perf("tr")
    + ["fin as (select * from pf join sh using (universe))"], Q.final("fin", ["universe", "run_id", "n"], Q.PERF + ["long_share"]))

S["ols_timing_segments"] = Q.with_(Q.base() + Q.hold_asset([("ECONOMY", 1.0)], "bench", "b1", 0) + Q.hold_asset([("STANDARD", 1.0)], "bond", "b2", 0) + [
    """sg as (select universe, run_id, segment, count(*) n_days, product(1 + net) - 1 cum_return from (select * from b1 union all select * from b2) join
 (values ('first', date '1995-06-01', date '1996-06-30'), ('second', date '1997-01-01', date '1998-12-31'), ('late', date '2000-01-01', date '2001-12-31'),
 ('short', date '1996-01-01', date '1996-01-03')) s(segment, lo, hi) on dt between lo and hi group by 1, 2, 3 having count(*) >= 5)"""],
    Q.final("sg", ["universe", "run_id", "segment", "n_days"], ["cum_return"]))

CURVE = """st as (select p_type product, cast(l_shipdate as date) dt, cast(regexp_extract(p_brand, '([0-9]+)$', 1) as int) ym,
 cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / cast(sum(cast(l_quantity as bigint)) as double) / 100.0 settle
 from lineitem join part on l_partkey = p_partkey where l_quantity > 0 group by 1, 2, 3),
cv as (select product, dt, max(settle) filter (k = 1) near, max(settle) filter (k = 2) "next", max(settle) filter (k = 1) / max(settle) filter (k = 2) - 1 curve
 from (select *, row_number() over (partition by product, dt order by ym) k from st) group by 1, 2 having count(*) >= 2)"""
S["term_curve"] = "with " + CURVE + """ select product, dt, round(curve, 6) + 0.0 curve from cv"""
S["curve_forward_mean"] = Q.with_(Q.prices() + [CURVE, """fw as (select *, lead(close, 21) over (partition by universe, asset order by dt) / close - 1 fwd
 from px join (select product asset, dt, curve from cv) using (asset, dt))""",
    """cm as (select universe, asset, count(*) filter (fwd is not null) n, corr(curve, fwd) corr, avg(fwd) filter (curve > 0) mean_long,
 avg(fwd) filter (curve <= 0) mean_flat, count(*) filter (curve > 0 and fwd is not null) n_long from fw group by 1, 2 having count(*) >= 100 and count(fwd) >= 50)"""],
    Q.final("cm", ["universe", "asset", "n", "n_long"], ["corr", "mean_long", "mean_flat"]))
S["curve_timing"] = Q.with_(Q.prices() + [CURVE, """sg as (select p.universe, p.asset, p.dt, p.close, case when c.curve > 0 then 1.0 else 0.0 end sig
 from px p asof left join (select product asset, dt, curve from cv) c on p.asset = c.asset and p.dt >= c.dt)"""] + timing("sg", "tm", 200) + [
    "bk as (select universe, 'curve_timing' run_id, dt, sum(net) / 6 net from tm group by 1, 2, 3)"] + Q.perf("bk"), Q.final("pf", ["universe", "run_id"], Q.PERF))

TWO = Q.hold_asset([("ECONOMY", 1.0)], "bench", "b1", 1) + Q.hold_asset([("STANDARD", 1.0)], "bond", "b2", 1) + [
    "two as (select * from b1 union all select * from b2)"]
ROLL = """rl as (select universe, run_id, dt, case when k = 252 then m * 252 / (sd * sqrt(252) + 1e-12) end roll_sharpe, case when k = 252 then sd * sqrt(252) end roll_vol,
 nav / max(nav) over (partition by universe, run_id order by dt) - 1 underwater from (select universe, run_id, dt, count(*) over w k, avg(net) over w m, stddev_samp(net) over w sd,
 product(1 + net) over (partition by universe, run_id order by dt) nav from two window w as (partition by universe, run_id order by dt rows between 251 preceding and current row)))"""
S["rolling_metrics"] = Q.with_(Q.base() + TWO + [ROLL], Q.final("rl", ["universe", "run_id", "dt"], ["roll_sharpe", "roll_vol", "underwater"]))
S["rolling_summary"] = Q.with_(Q.base() + TWO + [ROLL, """rs as (select universe, run_id, avg(roll_sharpe) mean_sharpe, min(roll_sharpe) min_sharpe,
 avg(cast(roll_sharpe > 0 as double)) share_positive from rl where roll_sharpe is not null group by 1, 2)"""],
    Q.final("rs", ["universe", "run_id"], ["mean_sharpe", "min_sharpe", "share_positive"]))
REG = """rg as (select universe, dt, case when nav / pk - 1 < -0.20 then 'bear' when k = 200 and nav > ma then 'bull' else 'sideways' end regime from (
 select *, max(nav) over (partition by universe order by dt) pk, count(*) over w k, avg(nav) over w ma from
 (select universe, dt, product(1 + coalesce(ret, 0)) over (partition by universe order by dt) nav from obs where asset = 'ECONOMY')
 window w as (partition by universe order by dt rows between 199 preceding and current row)))"""
S["regimes"] = Q.with_(Q.base() + [REG], "select * from rg")
S["rolling_inverse_vol"] = Q.with_(Q.base() + TWO + ["""iv as (select universe, run_id, dt, case when count(net) over w = 63 and stddev_samp(net) over w > 0 then 1 / stddev_samp(net) over w end inv
 from two window w as (partition by universe, run_id order by dt rows between 62 preceding and current row))""",
    """iw as (select universe, run_id "name", dt, coalesce(lag(w0) over (partition by universe, run_id order by dt), 0.5) weight from
 (select *, case when count(inv) over (partition by universe, dt) = 2 then inv / sum(inv) over (partition by universe, dt) end w0 from iv))"""],
    Q.final("iw", ["universe", '"name"', "dt"], ["weight"]))
S["inverse_vol_static"] = Q.with_(Q.base() + TWO + ["""sv as (select universe, run_id "name", stddev_pop(net) vol from two group by 1, 2)""",
    """sw as (select *, (1 / vol) / sum(1 / vol) over (partition by universe) weight from sv)"""], Q.final("sw", ["universe", '"name"'], ["vol", "weight"]))
S["rolling_min_variance"] = Q.with_(Q.base() + TWO + ["""xy as (select universe, dt, b1.net x, b2.net y, row_number() over (order by dt) i from b1 join b2 using (universe, dt))""",
    """mm as (select a.i, avg(b.x) mx, avg(b.y) my from xy a join xy b on b.i between a.i - 63 and a.i - 1 where a.i > 63 group by 1)""",
    """cc as (select m.i, avg((x - mx) ** 2) sxx, avg((y - my) ** 2) syy, avg((x - mx) * (y - my)) sxy, avg((x - mx) ** 4) qxx, avg((y - my) ** 4) qyy,
 avg(((x - mx) * (y - my)) ** 2) qxy from mm m join xy b on b.i between m.i - 63 and m.i - 1 group by 1)""",
    """dl as (select *, greatest(0, least(1, (qxx - sxx * sxx + qyy - syy * syy + 2 * (qxy - sxy * sxy)) / ((mu - sxx) ** 2 + (mu - syy) ** 2 + 2 * sxy ** 2) / 63)) d
 from (select *, (sxx + syy) / 2 mu from cc))""",
    """ww as (select i, greatest(d * mu + (1 - d) * syy - (1 - d) * sxy, 0) a, greatest(d * mu + (1 - d) * sxx - (1 - d) * sxy, 0) b from dl)""",
    "ou as (select universe, dt, coalesce(lag(a / (a + b)) over (order by xy.i), 0.5) w_x from xy left join ww on xy.i = ww.i)"],
    Q.final("ou", ["universe", "dt"], ["w_x"]))

# Six assets: shrunk covariance from centred products, then Gauss-Jordan elimination on the rows (i, j), j = 7 the right side.
_YEARS = Q.base() + ["dr as (select universe, year(dt) y, row_no k, asset, coalesce(ret, 0) x from obs)",
    "ce as (select universe, y, k, asset, x - avg(x) over (partition by universe, y, asset) x from dr)",
    "nm as (select universe, y, asset, row_number() over (partition by universe, y order by asset) i from (select distinct universe, y, asset from dr))",
    "cn as (select c.universe, c.y, c.k, n.i, c.x from ce c join nm n using (universe, y, asset))",
    """cv as (select a.universe, a.y, a.i, b.i j, avg(a.x * b.x) s, avg(a.x * b.x * a.x * b.x) q, count(*) t from cn a join cn b on a.universe = b.universe and a.y = b.y and a.k = b.k
 group by 1, 2, 3, 4)""",
    "mu as (select universe, y, avg(s) m from cv where i = j group by 1, 2)",
    """sh as (select universe, y, i, j, s, case when i = j then m else 0 end f, t, sum(q - s * s) over g p, sum((case when i = j then m else 0 end - s) * (case when i = j then m else 0 end - s)) over g c
 from cv join mu using (universe, y) window g as (partition by universe, y))""",
    "de as (select *, greatest(0.0, least(1.0, case when c > 1e-12 then p / c else 0 end / t)) delta from sh)",
    "sg as (select universe, y, i, j, delta * f + (1 - delta) * s v, delta from de)",
    "e0 as (select universe, y, i, j, v from sg union all select universe, y, i, 7, 1.0 from nm)"]
_YEARS += [f"""e{k} as (select a.universe, a.y, a.i, a.j, case when a.i = {k} then a.v / d.v else a.v - c.v * p.v / d.v end v from e{k - 1} a
 join e{k - 1} p on p.universe = a.universe and p.y = a.y and p.i = {k} and p.j = a.j join e{k - 1} c on c.universe = a.universe and c.y = a.y and c.i = a.i and c.j = {k}
 join e{k - 1} d on d.universe = a.universe and d.y = a.y and d.i = {k} and d.j = {k})""" for k in range(1, 7)]
_YEARS += ["sw as (select universe, y, i, greatest(v, 0) w, sum(greatest(v, 0)) over (partition by universe, y) t, count(*) over (partition by universe, y) n from e6 where j = 7)",
    "pr as (select universe, y, max(delta) delta, avg(v) filter (i < j) mean_cov from sg group by 1, 2)",
    "mv as (select n.universe, n.y as year, n.asset as name, case when t > 0 then w / t else 1.0 / sw.n end weight, delta, mean_cov from sw join nm n on n.universe = sw.universe and n.y = sw.y and n.i = sw.i join pr on pr.universe = n.universe and pr.y = n.y)"]
S["min_variance_yearly"] = Q.with_(_YEARS, Q.final("mv", ["universe", "year", "name"], ["weight", "delta", "mean_cov"]))
