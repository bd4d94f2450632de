from __future__ import annotations

from oracles import sql as Q
from oracles.market import FACTOR_CTE, FLAG, LIM, PRE
from oracles.signals import REG, TSM, timing, union, zscore
from panelfolio import testpanel as T
from panelfolio.functions import scalars as N
from panelfolio.params import ParamSet, overlay_ladder

S: dict[str, str] = {}
U = T.TYPES
UR = ["universe", "run_id"]
FULL = ParamSet("full", trend_ma=200)
VARIANTS = [FULL, ParamSet("top3", trend_ma=200, hold_all=False), ParamSet("inv_vol", hold_all=False, weighting="inv_vol"),
            ParamSet("capped", hold_all=False, top_n=2, max_weight=0.3, vol_target=None),
            ParamSet("crash", crash_prot=True, crash_thr=0.05, trend_ma=120, trend_cut=0.0),
            ParamSet("skip_risk", skip=21, risk_adj=True, hold_all=False, top_n=4)]


def all_targets(params: list[ParamSet], u=U) -> list[str]:
    out: list[str] = []
    for i, p in enumerate(params):
        out += Q.targets(p, u, i)
    return out + [union([f"select universe, '{p.run_id}' run_id, reb_no, asset, weight from tg{i}" for i, p in enumerate(params)], "tgs")]


TG = ["universe", "run_id", "reb_no", "asset"]
S["targets_variants"] = Q.with_(Q.base() + all_targets(VARIANTS), Q.final("tgs", TG, ["weight"]))
S["targets_two_tier"] = Q.with_(Q.base() + all_targets([FULL, ParamSet("top2", hold_all=False, top_n=2, trend_ma=200, max_weight=0.4)], T.TYPES_TWO_TIER),
                                Q.final("tgs", TG, ["weight"]))
TOP = ParamSet("top3", hold_all=False)
S["holdings_log"] = Q.with_(Q.base() + Q.targets(TOP, U, 0), """select universe, 'top3' run_id, signal_dt, string_agg(asset, ',' order by rk) assets, count(*) n_held
 from ws0 where held group by 1, 2, 3""")

BH = Q.hold_asset([(U.benchmark, 1.0)], "0_benchmark", "bh")
S["backtest_ladder"] = Q.with_(Q.base() + Q.runs(overlay_ladder(), U) + BH + [
    "allr as (select universe, run_id, dt, net from rets union all select universe, run_id, dt, net from bh)"] + Q.perf("allr"), Q.final("pf", UR, Q.PERF))
S["backtest_variants"] = Q.with_(Q.base() + Q.runs(VARIANTS, U) + Q.perf("rets"), Q.final("pf", UR, Q.PERF))
S["daily_book"] = Q.with_(Q.base() + Q.runs([FULL], U) + ["""nv as (select *, g / first_value(g) over (order by dt) nav from
 (select *, product(1 + net) over (order by dt) g from rets))""", "uw as (select *, nav / max(nav) over (order by dt) - 1 underwater from nv)"],
    Q.final("uw", UR + ["dt", "row_no"], ["gross", "turnover", "cost", "net", "nav", "underwater"]))


def limited(i: int, run_id: str) -> list[str]:
    """ex{i}: actual weights after each decision, one decision at a time."""
    return [f"""dc{i} as (select universe, reb_no, row_number() over (partition by universe order by reb_no) d, c2.dt fill_dt from
 (select distinct universe, reb_no from tg{i}) join cal using (universe, reb_no) left join cal c2 on c2.universe = cal.universe and c2.row_no = cal.row_no + 1)""",
            f"""gr{i} as (select d.universe, d.d, d.reb_no, a.asset, t.weight target, coalesce(f.cant_buy, false) cb, coalesce(f.cant_sell, false) cs from dc{i} d
 join (select distinct universe, asset from tg{i}) a using (universe) left join tg{i} t on t.universe = d.universe and t.reb_no = d.reb_no and t.asset = a.asset
 left join fl f on f.universe = d.universe and f.asset = a.asset and f.dt = d.fill_dt)""",
            f"""ex{i} as (select universe, asset, d, reb_no, {_step('0.0::double')} weight from gr{i} g where d = 1
 union all select g.universe, g.asset, g.d, g.reb_no, {_step('e.weight')} from ex{i} e join gr{i} g on g.universe = e.universe and g.asset = e.asset and g.d = e.d + 1)"""]


def _step(old: str) -> str:
    return f"""cast(case when g.target is null then case when {old} > 1e-12 and not g.cs then 0.0 else {old} end
 when g.target > {old} + 1e-9 and g.cb then {old} when g.target < {old} - 1e-9 and g.cs then {old} else g.target end as double)"""


FLAGS = [PRE, LIM.format(src="pre"), FLAG]
lim_ctes = Q.base() + FLAGS
for i, p in enumerate(VARIANTS[:3]):
    lim_ctes += Q.targets(p, U, i) + limited(i, p.run_id)
S["executed_with_limits"] = Q.with_(lim_ctes + [union([f"""select universe, '{p.run_id}' run_id, asset, reb_no, weight from (select *,
 max(case when t.reb_no is not null then 1 else 0 end) over (partition by asset order by d) seen from ex{i} left join (select reb_no, asset from tg{i}) t using (reb_no, asset)) where seen = 1"""
    for i, p in enumerate(VARIANTS[:3])], "o")], Q.final("o", UR + ["asset", "reb_no"], ["weight"]))


def limited_hold(i: int) -> str:
    return f"""hd{i} as (select c.universe, c.row_no, c.dt, a.asset, coalesce(t.weight, 0.0) weight from cal c
 join (select distinct universe, asset from tg{i}) a using (universe)
 asof left join (select universe, reb_no, cal.row_no + 1 fill_row from (select distinct universe, reb_no from tg{i}) join cal using (universe, reb_no)) d
 on c.universe = d.universe and c.row_no >= d.fill_row
 left join ex{i} t on t.universe = c.universe and t.reb_no = d.reb_no and t.asset = a.asset)"""


lim2 = list(lim_ctes)
for i, p in enumerate(VARIANTS[:3]):
    lim2 += Q.daily(i, p.need, p.run_id, holdings=limited_hold(i))
S["backtest_limits"] = Q.with_(lim2 + [union([f"select * from dr{i}" for i in range(3)], "rets")] + Q.perf("rets"), Q.final("pf", UR, Q.PERF))
S["bench_perf"] = Q.with_(Q.base() + Q.hold_asset([("ECONOMY", 1.0)], "bench", "bh") + Q.perf("bh"), Q.final("pf", UR, Q.PERF))
S["bench_60_40"] = Q.with_(Q.base() + Q.hold_asset([("ECONOMY", 0.6), ("STANDARD", 0.4)], "60_40", "bh") + Q.perf("bh"), Q.final("pf", UR, Q.PERF))
S["static_equal_hold"] = Q.with_(Q.base() + [f"""bh as (select c.universe, 'static' run_id, c.dt, sum(coalesce(o.ret, 0)) / 6 net from cal c
 cross join (select distinct asset from obs) a left join obs o on o.dt = c.dt and o.asset = a.asset group by 1, 2, 3)"""] + Q.perf("bh"), Q.final("pf", UR, Q.PERF))
S["turnover"] = Q.with_(Q.base() + Q.runs(VARIANTS, U) + ["""tt as (select universe, run_id, sum(turnover) / (date_diff('day', min(dt), max(dt)) / 365.25) turnover_per_year,
 sum(turnover) / (date_diff('day', min(dt), max(dt)) / 365.25) * 0.00075 cost_per_year from rets group by 1, 2)"""], Q.final("tt", UR, ["turnover_per_year", "cost_per_year"]))
ATTR = Q.base() + Q.targets(FULL.but("attribution", drawdown_prot=False), U, 0) + ["""lg as (select universe, reb_no, signal_dt, asset, sum(a) cand, sum(b) vol, sum(c) trend from (
 select universe, reb_no, signal_dt, asset, w0 a, w1 - w0 b, w2 - w1 c from s20 union all
 select universe, reb_no, signal_dt, 'STANDARD', 0, w0 - w1, w1 - w2 from s20) group by 1, 2, 3, 4)""",
    """lw as (select *, cand + vol + trend fin from lg)""",
    """ds as (select reb_no, signal_dt, row_number() over (order by reb_no) d from (select distinct reb_no, signal_dt from lw))""",
    """df as (select ds.signal_dt, abs(coalesce(n.fin, 0) - coalesce(o.fin, 0)) f, abs(coalesce(n.cand, 0) - coalesce(o.cand, 0)) c,
 abs(coalesce(n.vol, 0) - coalesce(o.vol, 0)) v, abs(coalesce(n.trend, 0) - coalesce(o.trend, 0)) t from ds join ds dp on dp.d = ds.d - 1 cross join (select distinct asset from lw) a
 left join lw n on n.reb_no = ds.reb_no and n.asset = a.asset left join lw o on o.reb_no = dp.reb_no and o.asset = a.asset)""",
    """att as (select *, case when candidates >= vol_target and candidates >= trend then 'candidates' when vol_target >= trend then 'vol_target' else 'trend' end main_cause from (
 select 'types' universe, 'attribution' run_id, signal_dt, sum(f) turnover, sum(c) candidates, sum(v) vol_target, sum(t) trend from df group by 3))"""]
AT = Q.final("att", UR + ["signal_dt", "main_cause"], ["turnover", "candidates", "vol_target", "trend"])
S["turnover_attribution"] = Q.with_(ATTR, AT)
S["turnover_top_months"] = Q.with_(ATTR + ["tp as (select * from att order by turnover desc, signal_dt limit 10)"], AT.replace("from att", "from tp"))
S["turnover_causes"] = Q.with_(ATTR, "select universe, run_id, main_cause, count(*) as months from att where turnover > 0.30 group by 1, 2, 3")
S["cost_sensitivity"] = Q.with_(Q.base() + Q.runs([FULL], U, 0.0) + ["""cs as (select universe, run_id, cost_rate, dt, gross - turnover * cost_rate net from rets
 cross join (values (0.0::double), (0.00075::double), (0.003::double)) c(cost_rate))"""] + Q.perf("cs", "universe, run_id, cost_rate"),
    "select universe, run_id, cost_rate, round(total_return, 6) + 0.0 total_return, round(cagr, 6) + 0.0 cagr, round(sharpe, 6) + 0.0 sharpe, round(mdd, 6) + 0.0 mdd from pf")
S["asset_timing"] = Q.with_(Q.base() + [TSM, "s1 as (select universe, asset, dt, close, case when n >= 127 and mom > 0 then 1.0 else 0.0 end sig from ts)",
    "s2 as (select universe, asset, dt, close, case when n >= 201 and mom > 0 and close > ma then 1.0 else 0.0 end sig from ts)"] + timing("s1", "t1", 126) + timing("s2", "t2", 200) + [
    "ta as (select universe, 'plain_' || asset run_id, dt, net from t1 union all select universe, 'trend_' || asset, dt, net from t2)"] + Q.perf("ta"), Q.final("pf", UR, Q.PERF))

# Strategy members: tg0 = overlay, tgb = bond momentum.
BONDT = [TSM, """tgb as (select r.universe, r.reb_no, 'STANDARD' asset, case when s.n >= 201 and s.mom > 0 and s.close > s.ma then 1.0::double else 0.0::double end weight
 from (select * from cal where is_month_end and row_no >= 126) r asof join (select * from ts where asset = 'STANDARD') s on r.universe = s.universe and r.dt >= s.dt)"""]
MEMBERS = Q.base() + Q.targets(FULL, U, 0) + BONDT + ["mb as (select 0 member, * from tg0 union all select 1, * from tgb)"]
S["blend_targets"] = Q.with_(MEMBERS + ["bl as (select universe, 'blend' run_id, reb_no, asset, sum(case member when 0 then 0.375 else 0.625 end * weight) weight from mb group by 1, 2, 3, 4)"],
                             Q.final("bl", TG, ["weight"]))
PAST = ["""tl as (select r.universe, r.reb_no, r.asset, s.n nl from (select c.universe, c.reb_no, c.dt, a.asset from cal c cross join (select distinct asset from obs) a where is_month_end) r
 asof join obs s on r.universe = s.universe and r.asset = s.asset and r.dt >= s.dt)""",
        """pv as (select m.universe, m.member, t.reb_no, m.asset, m.weight, t.nl, min(least(t.nl - 1, 63)) over (partition by t.reb_no) len
 from mb m join tl t on t.universe = m.universe and t.asset = m.asset and t.reb_no = m.reb_no + 1)""",
        """mr as (select p.universe, p.reb_no, p.member, p.len, p.nl - o.n k, sum(p.weight * o.ret) x from pv p join obs o on o.universe = p.universe and o.asset = p.asset
 and o.n > p.nl - p.len and o.n <= p.nl group by 1, 2, 3, 4, 5)"""]
RP = ["vo as (select universe, reb_no, member, max(len) len, stddev_samp(x) * sqrt(252) vol from mr group by 1, 2, 3)",
      """ra as (select *, a / sum(a) over (partition by reb_no) alloc from (select *, greatest((1 / vol) / sum(1 / vol) over (partition by reb_no), 0.05) a from
 (select *, count(*) filter (len >= 31 and vol >= 1e-9) over (partition by reb_no) ok from vo) where ok = 2))""",
      """rp as (select m.universe, m.reb_no, m.asset, sum(coalesce(alloc, 0.5) * weight) weight from mb m left join ra using (universe, reb_no, member) group by 1, 2, 3)"""]
S["risk_parity_targets"] = Q.with_(MEMBERS + PAST + RP + ["rq as (select 'risk_parity' run_id, * from rp)"], Q.final("rq", TG, ["weight"]))
MV = ["ce as (select *, x - avg(x) over (partition by reb_no, member) c from mr)",
      """pr as (select a.universe, a.reb_no, count(*) t, avg(a.c * a.c) s11, avg(b.c * b.c) s22, avg(a.c * b.c) s12, avg(a.c ** 4) q11, avg(b.c ** 4) q22, avg((a.c * b.c) ** 2) q12
 from ce a join ce b on a.reb_no = b.reb_no and a.k = b.k and a.member = 0 and b.member = 1 group by 1, 2)""",
      """sh as (select *, (s11 + s22) / 2 mu, (q11 - s11 ** 2) + (q22 - s22 ** 2) + 2 * (q12 - s12 ** 2) pi_, ((s11 + s22) / 2 - s11) ** 2 + ((s11 + s22) / 2 - s22) ** 2 + 2 * s12 ** 2 gm from pr)""",
      "sd as (select *, greatest(0, least(1, case when gm > 1e-12 then pi_ / gm else 0 end / t)) d from sh)",
      """wv as (select universe, reb_no, greatest(d * mu + (1 - d) * s22 - (1 - d) * s12, 0) a, greatest(d * mu + (1 - d) * s11 - (1 - d) * s12, 0) b from sd)""",
      "wn as (select universe, reb_no, greatest(case when a + b > 0 then a / (a + b) else 0.5 end, 0.05) x, greatest(case when a + b > 0 then b / (a + b) else 0.5 end, 0.05) y from wv)",
      "ma as (select universe, reb_no, 0 member, x / (x + y) alloc from wn union all select universe, reb_no, 1, y / (x + y) from wn)",
      "mv as (select m.universe, 'min_variance' run_id, m.reb_no, m.asset, sum(coalesce(alloc, 0.5) * weight) weight from mb m left join ma using (universe, reb_no, member) group by 1, 2, 3, 4)"]
S["min_variance_targets"] = Q.with_(MEMBERS + PAST + MV, Q.final("mv", TG, ["weight"]))
STRAT = MEMBERS + PAST + RP + ["tgrp as (select * from rp)", "tgbl as (select universe, reb_no, asset, sum(weight) / 2 weight from mb group by 1, 2, 3)"]
for key, run in (("0", "overlay"), ("b", "asset_momentum"), ("bl", "blend"), ("rp", "risk_parity")):
    STRAT = STRAT + Q.daily(key, 126, run)
S["multi_strategy_report"] = Q.with_(STRAT + [union([f"select * from dr{k}" for k in ("0", "b", "bl", "rp")], "sr")] + Q.perf("sr") + [
    "co as (select corr(a.net, b.net) corr from dr0 a join drb b using (dt))", "pc as (select * from pf cross join co)"], Q.final("pc", UR, Q.PERF + ["corr"]))
SWEEP: list[str] = []
for k, s in enumerate((0.0, 0.25, 0.5, 0.75, 1.0)):
    SWEEP += [f"tgs{k} as (select universe, reb_no, asset, sum(case member when 1 then {s} else {1 - s} end * weight) weight from mb group by 1, 2, 3)"] + Q.daily(f"s{k}", 126, f"share_{s:.2f}")
S["alloc_sweep"] = Q.with_(MEMBERS + SWEEP + [union([f"select * from drs{k}" for k in range(5)], "sw")] + Q.perf("sw"), Q.final("pf", UR, Q.PERF))
S["path_equality"] = Q.with_(Q.base(), "select universe, 0.0::double max_abs_diff, 0 n_unmatched, count(*) n_days from cal where row_no >= 126 group by 1")

RUNS = Q.base() + Q.runs(VARIANTS[:2], U, name="r2") + Q.hold_asset([("ECONOMY", 1.0)], "bench", "bh") + [
    "rets as (select universe, run_id, dt, row_no, net from r2 union all select universe, run_id, dt, row_no, net from bh)"]
S["return_mix"] = Q.with_(RUNS + ["""mx as (select universe, 'half' run_id, dt, sum(net) / 2 net from rets where run_id in ('full', 'bench') group by 1, 2, 3 having count(*) = 2
 union all select universe, 'mean', dt, avg(net) from rets group by 1, 2, 3)"""] + Q.perf("mx"), Q.final("pf", UR, Q.PERF))
MONTHLY = """mo as (select universe, run_id, dt, nv / lag(nv) over (partition by universe, run_id order by dt) - 1 net from (select universe, run_id, max(dt) dt, arg_max(g, dt) nv from
 (select *, product(1 + net) over (partition by universe, run_id order by dt) g from rets) group by universe, run_id, date_trunc('month', dt)))"""
S["monthly_returns"] = Q.with_(RUNS + [MONTHLY], Q.final("mo", UR + ["dt"], ["net"], where="net is not null"))
S["annual_sharpe"] = Q.with_(RUNS + ["an as (select universe, run_id, avg(net) / (stddev_samp(net) + 1e-12) * sqrt(252) sharpe from rets group by 1, 2)"], Q.final("an", UR, ["sharpe"]))
S["segment_perf"] = Q.with_(RUNS + ["""sg as (select r.*, segment, count(*) over (partition by universe, run_id, segment) c from rets r join (values ('all', date '1900-01-01', date '2100-01-01'),
 ('early', date '1900-01-01', date '1998-06-30'), ('late', date '1998-07-01', date '2100-01-01'), ('short', date '1997-01-01', date '1997-01-31')) s(segment, lo, hi) on dt between lo and hi)""",
    "sh as (select * from sg where c >= 60)"] + Q.perf("sh", "universe, run_id, segment"), Q.final("pf", UR + ["segment"], Q.PERF))
S["segment_table"] = Q.with_(RUNS + ["sp as (select cast(o_custkey as varchar) segment, cast(min(o_orderdate) as date) lo, cast(max(o_orderdate) as date) hi from orders group by 1)",
    "sg as (select universe, run_id, segment, count(*) n_days, product(1 + net) - 1 cum_return from rets join sp on dt between lo and hi where run_id = 'bench' group by 1, 2, 3)"],
    Q.final("sg", UR + ["segment", "n_days"], ["cum_return"]))
S["recent_vs_full"] = Q.with_(RUNS + ["""sp as (select *, 'full' span from rets union all select r.*, 'recent' from rets r where dt >= (select max(dt) - interval 3 year from rets))"""]
    + Q.perf("sp", "universe, run_id, span") + ["""rf as (select universe, run_id, """ + ", ".join(
        f"max({c}) filter (span = '{s}') {s}_{c}" for c in ("cagr", "sharpe", "mdd") for s in ("full", "recent")) + " from pf group by 1, 2)"],
    Q.final("rf", UR, [f"{s}_{c}" for c in ("cagr", "sharpe", "mdd") for s in ("full", "recent")]))
CAPM = ["""cp as (select r.universe, r.run_id, count(*) n, regr_slope(r.net, b.net) beta, regr_intercept(r.net, b.net) * 252 alpha,
 avg(r.net - b.net) / (stddev_samp(r.net - b.net) + 1e-12) * sqrt(252) ir, corr(r.net, b.net) ** 2 r2, stddev_samp(r.net - b.net) * sqrt(252) tracking_error, corr(r.net, b.net) corr,
 product(1 + r.net) ** (1 / (date_diff('day', min(r.dt), max(r.dt)) / 365.25)) - 1 run_annual, product(1 + b.net) ** (1 / (date_diff('day', min(r.dt), max(r.dt)) / 365.25)) - 1 bench_annual
 from rets r join bh b using (universe, dt) group by 1, 2)""", "cq as (select *, run_annual - bench_annual excess_annual, (beta - 1) * bench_annual beta_drag from cp)"]
S["capm"] = Q.with_(RUNS + CAPM, Q.final("cq", UR + ["n"], ["beta", "alpha", "ir", "r2", "tracking_error", "corr", "run_annual", "bench_annual", "excess_annual", "beta_drag"], where="run_id <> 'bench'"))
S["multi_factor"] = Q.with_(RUNS + [FACTOR_CTE, """fx as (select r.universe, r.run_id, r.net y, a.f_ret x1, b.f_ret x2 from rets r join fs a on a.dt = r.dt and a.factor = 'MKT'
 join fs b on b.dt = r.dt and b.factor = 'BOND' where r.run_id <> 'bench')""",
    """sm as (select universe, run_id, count(*) n, avg(y) my, avg(x1) m1, avg(x2) m2, var_pop(x1) * count(*) s11, var_pop(x2) * count(*) s22, covar_pop(x1, x2) * count(*) s12,
 covar_pop(x1, y) * count(*) s1y, covar_pop(x2, y) * count(*) s2y, var_pop(y) * count(*) syy from fx group by 1, 2)""",
    "sb as (select *, s11 * s22 - s12 * s12 det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) b2 from sm)",
    "sr as (select *, my - b1 * m1 - b2 * m2 b0, syy - b1 * s1y - b2 * s2y rss from sb)", "st as (select *, rss / (n - 3) sg, 1 - rss / syy r2 from sr)",
    """ou as (select universe, run_id, f.factor, n, case f.factor when 'alpha' then b0 when 'MKT' then b1 else b2 end beta,
 case f.factor when 'alpha' then b0 / sqrt(sg * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) when 'MKT' then b1 / sqrt(sg * s22 / det) else b2 / sqrt(sg * s11 / det) end tstat,
 case f.factor when 'alpha' then b0 when 'MKT' then b1 * m1 else b2 * m2 end * 252 contribution, r2, 1 - (1 - r2) * (n - 1) / (n - 3) r2_adj, sqrt(sg * 252) resid_vol
 from st cross join (values ('alpha'), ('MKT'), ('BOND')) f(factor))"""],
    Q.final("ou", UR + ["factor", "n"], ["beta", "tstat", "contribution", "r2", "r2_adj", "resid_vol"]))
S["corr_matrix"] = Q.with_(Q.base() + [FACTOR_CTE, """cm as (select a.universe, a.factor a, b.factor b, corr(a.f_ret, b.f_ret) corr, count(*) n from fs a join fs b on a.dt = b.dt and a.factor < b.factor
 where a.factor <> 'GONE' and b.factor <> 'GONE' group by 1, 2, 3)"""], Q.final("cm", ["universe", "a", "b", "n"], ["corr"]))
S["asset_corr_summary"] = Q.with_(Q.base() + ["""cm as (select a.universe, corr(coalesce(a.ret, 0), coalesce(b.ret, 0)) c from obs a join obs b on a.dt = b.dt and a.asset < b.asset group by a.universe, a.asset, b.asset)""",
    "cs as (select universe, avg(c) mean_corr, count(*) filter (c > 0.05) n_high from cm group by 1)"], Q.final("cs", ["universe", "n_high"], ["mean_corr"]))
S["corr_by_regime"] = Q.with_(RUNS + [REG, """cr as (select f.universe, case when grouping(regime) = 1 then 'all' else regime end regime, count(*) n, corr(f.net, b.net) corr
 from (select * from rets where run_id = 'full') f join bh b using (dt) join rg using (dt) group by grouping sets ((f.universe, regime), (f.universe)))"""], Q.final("cr", ["universe", "regime", "n"], ["corr"]))
S["regime_report"] = Q.with_(RUNS + [REG, "rr as (select rets.*, regime from rets join rg using (universe, dt))"] + Q.perf("rr", "universe, run_id, regime") + [
    """rc as (select universe, run_id, regime, count(*) n_days, count(*) / sum(count(*)) over (partition by universe, run_id) as share from rr group by 1, 2, 3)""",
    "ro as (select * from pf join rc using (universe, run_id, regime))"], Q.final("ro", UR + ["regime", "n_days"], Q.PERF + ["share"]))


def horner(x: str, cs: tuple[float, ...]) -> str:
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * ({x}) + {c!r})"
    return out


def cdf(z: str) -> str:
    a = f"abs({z})"
    e = f"exp(-({a}) * ({a}) / 2)"
    frac = f"({a} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = f"({a} + {k} / {frac})"
    tail = f"(case when {a} > 37 then 0.0 when {a} < 7.07106781186547 then {e} * {horner(a, N.CDF_NUM)} / {horner(a, N.CDF_DEN)} else {e} / {frac} / 2.506628274631 end)"
    return f"(case when {z} > 0 then 1 - {tail} else {tail} end)"


def ppf(p: str) -> str:
    q = f"(({p}) - 0.5)"
    r0 = f"(0.180625 - {q} * {q})"
    r = f"sqrt(-ln(least({p}, 1 - ({p}))))"
    tail = f"(case when {r} <= 5 then {horner(f'{r} - 1.6', N.PPF_TAIL_NUM)} / {horner(f'{r} - 1.6', N.PPF_TAIL_DEN)} else {horner(f'{r} - 5', N.PPF_FAR_NUM)} / {horner(f'{r} - 5', N.PPF_FAR_DEN)} end)"
    return f"(case when abs({q}) <= 0.425 then {q} * {horner(r0, N.PPF_CENTRE_NUM)} / {horner(r0, N.PPF_CENTRE_DEN)} when {q} < 0 then -{tail} else {tail} end)"


def dsr(src: str, name: str, periods: int) -> list[str]:
    return [f"""{name}0 as (select universe, run_id, count(*) n, any_value(m) m, sqrt(sum((net - m) ** 2) / (count(*) - 1)) sd, sum((net - m) ** 3) / (count(*) - 1) m3, sum((net - m) ** 4) / (count(*) - 1) m4
 from (select *, avg(net) over (partition by universe, run_id) m from {src} where net is not null) group by 1, 2)""",
            f"{name}1 as (select *, m / sd sr, m3 / sd ** 3 skew, m4 / sd ** 4 kurt from {name}0)",
            f"{name}2 as (select *, sqrt((1 - skew * sr + (kurt - 1) / 4 * sr ** 2) / (n - 1)) sig from {name}1 cross join (values (10), (50), (100), (200), (500), (1000)) t(trials))",
            f"{name}3 as (select *, 1 - 1.0::double / trials p1, 1 - 1 / (trials * 2.718281828459045::double) p2 from {name}2)",
            f"{name}4 as (select *, sig * ((1 - 0.5772156649015329) * {ppf('p1')} + 0.5772156649015329 * {ppf('p2')}) mx from {name}3)",
            f"""{name} as (select universe, run_id, trials, n, skew, kurt, sr * sqrt({periods}) sharpe, mx * sqrt({periods}) max_sharpe, sr / sig z0, (sr - mx) / sig z1 from {name}4)""",
            f"{name}z as (select universe, run_id, trials, n, skew, kurt, sharpe, max_sharpe, {cdf('z0')} psr, {cdf('z1')} dsr from {name})"]


S["deflated_sharpe"] = Q.with_(RUNS + [MONTHLY] + dsr("rets", "dd", 252) + dsr("mo", "dm", 12) + ["da as (select 'daily' freq, * from ddz union all select 'monthly', * from dmz)"],
                               Q.final("da", UR + ["freq", "trials", "n"], ["skew", "kurt", "sharpe", "max_sharpe", "psr", "dsr"]))


def cdf_series(z: str, terms: int = 70) -> str:
    """0.5 + density * (z + z^3 / 3 + z^5 / 15 + ...), exact for the moderate z of the check and without any table."""
    inner = "1.0"
    for k in range(terms, 0, -1):
        inner = f"(1.0 + ({z}) * ({z}) / {2 * k + 1} * {inner})"
    return f"(0.5 + exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * ({z}) * {inner})"


# The quantile is the root of the series, by Newton steps from 0, which stay on one side of it.
S["normal_functions"] = f"""with recursive c as (select c_custkey, c_acctbal / 2000 - 2 z from customer), p as (select c_custkey, {cdf_series('z')} p from c),
 q as (select *, least(greatest(p, 1e-6), 1 - 1e-6) q from p),
 n as (select c_custkey, q, cast(0 as double) x, 0 step from q
 union all select c_custkey, q, x - ({cdf_series('x')} - q) / (exp(-x * x / 2) / sqrt(2 * pi())), step + 1 from n where step < 40)
 select p.c_custkey, round(p, 7) + 0.0 cdf, round(x, 7) + 0.0 ppf from p join n on n.c_custkey = p.c_custkey and step = 40"""

S["candidate_report"] = Q.with_(Q.base() + Q.runs([FULL], U, name="base_r") + [TSM, REG,
    "s2 as (select universe, asset, dt, close, case when n >= 201 and mom > 0 and close > ma then 1.0 else 0.0 end sig from ts where asset = 'STANDARD')"] + timing("s2", "t2", 200)
    + zscore("zscore", False) + Q.hold_asset([("ECONOMY", 0.6), ("STANDARD", 0.4)], "60_40", "bh") + [
    """ca as (select universe, 'bond' run_id, dt, net from t2 union all select universe, 'zscore', dt, net from zrzscore where row_no >= (select min(row_no) from (select row_no from zzscore group by 1 having count(*) = 5)) union all select universe, run_id, dt, net from bh)""",
    "bo as (select c.universe, c.run_id, c.dt, c.net, b.net b from ca c join base_r b using (universe, dt))", "mi as (select universe, run_id, dt, 0.5 * net + 0.5 * b net from bo)"]
    + Q.perf("ca", name="pf") + Q.perf("mi", name="pm") + [
    "an as (select universe, run_id, avg(net) / (stddev_samp(net) + 1e-12) * sqrt(252) own_sharpe from ca group by 1, 2)",
    """bs as (select universe, run_id, corr(net, b) corr, avg(b) / (stddev_samp(b) + 1e-12) * sqrt(252) base_sharpe,
 avg(0.5 * net + 0.5 * b) / (stddev_samp(0.5 * net + 0.5 * b) + 1e-12) * sqrt(252) mix_sharpe from bo group by 1, 2)""",
    "be as (select bo.universe, run_id, corr(net, b) bear_corr from bo join rg using (dt) where regime = 'bear' group by 1, 2)",
    """cx as (select pf.universe, pf.run_id, pf.cagr, pf.sharpe, pf.mdd, pf.sortino, pm.cagr mix_cagr, pm.mdd mix_mdd, corr, own_sharpe, mix_sharpe,
 abs(corr) < 0.3 and own_sharpe > 0.5 and mix_sharpe > greatest(own_sharpe, base_sharpe) passed, bear_corr
 from pf join pm using (universe, run_id) join an using (universe, run_id) join bs using (universe, run_id) left join be using (universe, run_id))"""],
    Q.final("cx", UR + ["passed"], ["cagr", "sharpe", "mdd", "sortino", "mix_cagr", "mix_mdd", "corr", "own_sharpe", "mix_sharpe", "bear_corr"]))

S["stripped_alpha"] = Q.with_(RUNS + CAPM + [FACTOR_CTE, """f3 as (select r.universe, r.run_id, r.net - avg(r.net) over g y, a.f_ret - avg(a.f_ret) over g x1, b.f_ret - avg(b.f_ret) over g x2, c.f_ret - avg(c.f_ret) over g x3,
 avg(r.net) over g my, avg(a.f_ret) over g m1, avg(b.f_ret) over g m2, avg(c.f_ret) over g m3 from rets r join fs a on a.dt = r.dt and a.factor = 'MKT'
 join fs b on b.dt = r.dt and b.factor = 'SIZE' join fs c on c.dt = r.dt and c.factor = 'BOND' window g as (partition by r.universe, r.run_id))""",
    "o2 as (select *, x2 - x1 * sum(x1 * x2) over g / sum(x1 * x1) over g z2 from f3 window g as (partition by run_id))",
    "o3 as (select *, x3 - x1 * sum(x1 * x3) over g / sum(x1 * x1) over g - z2 * sum(z2 * x3) over g / sum(z2 * z2) over g z3 from o2 window g as (partition by run_id))",
    "k3 as (select *, sum(z3 * y) over g / sum(z3 * z3) over g b3 from o3 window g as (partition by run_id))",
    "k2 as (select *, sum(z2 * (y - b3 * x3)) over g / sum(z2 * z2) over g b2 from k3 window g as (partition by run_id))",
    "k1 as (select *, sum(x1 * (y - b3 * x3 - b2 * x2)) over g / sum(x1 * x1) over g b1 from k2 window g as (partition by run_id))",
    "fa as (select universe, run_id, (max(my) - max(b1) * max(m1) - max(b2) * max(m2) - max(b3) * max(m3)) * 252 factor_alpha from k1 group by 1, 2)",
    "sa as (select universe, run_id, alpha, factor_alpha, alpha - factor_alpha stripped from cq join fa using (universe, run_id))"],
    Q.final("sa", UR, ["alpha", "factor_alpha", "stripped"]))

# Six factors and a constant: the inverse of the 7 x 7 cross products by Gauss-Jordan elimination, identity in columns 8 to 14.
_SIX = RUNS + ["""pv as (select dt, coalesce(max(ret) filter (asset = 'ECONOMY'), 0) a, coalesce(max(ret) filter (asset = 'SMALL'), 0) b, coalesce(max(ret) filter (asset = 'STANDARD'), 0) c,
 coalesce(max(ret) filter (asset = 'MEDIUM'), 0) d, coalesce(max(ret) filter (asset = 'PROMO'), 0) e, coalesce(max(ret) filter (asset = 'LARGE'), 0) f from obs group by 1)""",
    "f6 as (select r.universe, r.run_id, r.net y, [1.0, a, b - a, c, d, e - f, f - c] x from rets r join pv using (dt) where r.run_id <> 'bench')",
    "ix as (select unnest(range(1, 8)) i)",
    "e0 as (select universe, run_id, i.i, j.i j, sum(x[i.i] * x[j.i]) v from f6, ix i, ix j group by 1, 2, 3, 4 union all select universe, run_id, i.i, 7 + j.i, case when i.i = j.i then 1.0 else 0.0 end from (select distinct universe, run_id from f6), ix i, ix j)"]
_SIX += [f"""e{k} as (select a.universe, a.run_id, a.i, a.j, case when a.i = {k} then a.v / d.v else a.v - c.v * p.v / d.v end v from e{k - 1} a
 join e{k - 1} p on p.universe = a.universe and p.run_id = a.run_id and p.i = {k} and p.j = a.j join e{k - 1} c on c.universe = a.universe and c.run_id = a.run_id and c.i = a.i and c.j = {k}
 join e{k - 1} d on d.universe = a.universe and d.run_id = a.run_id and d.i = {k} and d.j = {k})""" for k in range(1, 8)]
_SIX += ["xy as (select universe, run_id, i, sum(x[i] * y) xty, avg(x[i]) m, count(*) n from f6, ix group by 1, 2, 3)",
    "be6 as (select v.universe, v.run_id, v.i, sum(v.v * xy.xty) beta, max(case when v.j = 7 + v.i then v.v end) dg from e7 v join xy on xy.universe = v.universe and xy.run_id = v.run_id and v.j = 7 + xy.i group by 1, 2, 3)",
    "fit as (select f6.universe, f6.run_id, count(*) n, sum((y - (select sum(beta * x[i]) from be6 where be6.run_id = f6.run_id)) ** 2) rss, var_pop(y) * count(*) tss from f6 group by 1, 2)",
    """ou6 as (select b.universe, b.run_id, ['alpha', 'MKT', 'SIZE', 'BOND', 'MID', 'PROMO', 'TERM'][b.i] factor, f.n, beta, beta / sqrt(dg * rss / (f.n - 7)) tstat, beta * xy.m * 252 contribution,
 1 - rss / tss r2, 1 - rss / tss * (f.n - 1) / (f.n - 7) r2_adj, sqrt(rss / (f.n - 7) * 252) resid_vol
 from be6 b join fit f using (universe, run_id) join xy on xy.universe = b.universe and xy.run_id = b.run_id and xy.i = b.i)"""]
S["multi_factor_six"] = Q.with_(_SIX, Q.final("ou6", UR + ["factor", "n"], ["beta", "tstat", "contribution", "r2", "r2_adj", "resid_vol"]))
