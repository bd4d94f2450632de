from __future__ import annotations

from oracles import sql as Q
from oracles.portfolios import FULL, RUNS, UR
from panelfolio import testpanel as T
from panelfolio.params import ParamSet, Universe, momentum_weight_grid, robust_grid, selection_grid, sweep_grid

S: dict[str, str] = {}
U = T.TYPES
SELECT, HOLD = FULL.but("select", hold_all=False), FULL.but("hold")
GRID = Q.base() + Q.runs(selection_grid(), U)


def walk(years: int) -> list[str]:
    """Windows of ``years`` to train and one year to test."""
    return ["""sp as (select min(dt) filter (row_no = 126) s, max(dt) e from cal)""",
            f"""wd as (select k window_id, t0, (select max(dt) from cal where dt <= t0 + interval {years} year) tr_e,
 (select max(dt) from cal where dt <= t0 + interval {years} year + interval 1 day) te_s,
 (select max(dt) from cal where dt <= t0 + interval {years + 1} year) te_e from (select k, cast(s + to_years(cast(k as int)) as date) t0 from sp, range(0, 20) r(k)))""",
            "ww as (select * from wd where te_s < (select e from sp))",
            """wr as (select r.*, window_id, 'train' part from rets r join ww on dt between t0 and tr_e union all select r.*, window_id, 'test' from rets r join ww on dt between te_s and te_e)"""]


WF = walk(3)
PCV = ["""sp as (select cast(min(dt) filter (row_no = 126) as timestamp) s, cast(max(dt) as timestamp) e from cal)""",
       """ww as (select k window_id, to_timestamp(epoch(s) + k * (epoch(e) - epoch(s)) / 6)::timestamp te_s, to_timestamp(epoch(s) + (k + 1) * (epoch(e) - epoch(s)) / 6)::timestamp te_e from sp, range(0, 6) r(k))""",
       """wr as (select r.*, window_id, 'test' part from rets r join ww on dt between te_s and te_e union all
 select r.*, window_id, 'train' from rets r join ww on dt < te_s - interval 21 day or dt > te_e + interval 21 day)"""]
SCORES = ["""sc as (select universe, run_id, window_id, part, avg(net) * 252 / (stddev_samp(net) * sqrt(252) + 1e-12) score, min(dt) lo, max(dt) hi from wr group by 1, 2, 3, 4)""",
          """be as (select * from (select *, row_number() over (partition by window_id order by round(score, 10) desc, run_id) k from sc where part = 'train') where k = 1)""",
          """rep as (select b.universe, b.window_id, b.run_id, b.score train_score, t.score test_score, t.lo test_start, t.hi test_end from be b join sc t on t.part = 'test' and t.window_id = b.window_id and t.run_id = b.run_id)""",
          """st as (select w.universe, w.dt, w.net, row_number() over (order by w.window_id, w.dt) seq from wr w join be b using (window_id, run_id) where w.part = 'test')"""]
SUMMARY = Q.perf("rets", name="pa") + [
    "bs as (select run_id best_run, sharpe best_sharpe from pa order by sharpe desc, run_id limit 1)",
    "sn as (select *, growth / first_value(growth) over (order by seq) nav from (select *, product(1 + net) over (order by seq) growth from st))",
    "sg as (select universe, dt, net, seq, nav from sn)"]


def stitched_perf() -> list[str]:
    """perf with the stitched order instead of the date."""
    return [c.replace("order by dt", "order by seq").replace("arg_max(nav, dt)", "arg_max(nav, seq)") for c in Q.perf("st", "universe", "po")]


REPORT = Q.final("rep", ["universe", "window_id", "run_id", "test_start", "test_end"], ["train_score", "test_score"])
SUM = ["universe", "best_run"]
for name, w in (("walk_forward", WF), ("purged_cv", PCV)):
    S[name] = Q.with_(GRID + w + SCORES, REPORT)
    S[f"{name}_summary"] = Q.with_(GRID + w + SCORES + SUMMARY + stitched_perf() + [
        "su as (select po.*, best_run, best_sharpe, case when best_sharpe > 0 then sharpe / best_sharpe end decay from po cross join bs)"],
        Q.final("su", SUM, Q.PERF + ["best_sharpe", "decay"]))
S["walk_forward_five_years"] = Q.with_(GRID + walk(5) + SCORES, REPORT)
RANK = """rk as (select b.universe, b.window_id, b.run_id, b.score train_score, t.test_rank, t.n_runs from be b join
 (select *, row_number() over (partition by window_id order by round(score, 10) desc, run_id) - 1 test_rank, count(*) over (partition by window_id) n_runs from sc where part = 'test') t
 on t.window_id = b.window_id and t.run_id = b.run_id)"""
S["overfit_ranks"] = Q.with_(GRID + PCV + SCORES + [RANK], Q.final("rk", ["universe", "window_id", "run_id", "test_rank", "n_runs"], ["train_score"]))
S["overfit_probability"] = Q.with_(GRID + PCV + SCORES + [RANK, "pb as (select universe, avg(cast(test_rank >= n_runs // 2 as double)) pbo, count(*) n_folds from rk group by 1)"],
                                   Q.final("pb", ["universe", "n_folds"], ["pbo"]))


def grid_perf(params: list[ParamSet]) -> str:
    return Q.with_(Q.base() + Q.runs(params, U) + Q.perf("rets"), Q.final("pf", UR, Q.PERF))


S["sweep"] = grid_perf(sweep_grid(FULL.but("s", hold_all=False)))
S["robust"] = grid_perf(robust_grid())
MOM = [p.but(p.run_id, hold_all=False) for p in momentum_weight_grid()]
S["momentum_weights"] = grid_perf(MOM)
S["overlay_review"] = grid_perf([FULL.but("dd_on"), FULL.but("dd_off", drawdown_prot=False)] + [
    FULL.but(f"vt{vt}_{w}", vol_target=vt, weighting=w, hold_all=False) for vt in (None, 0.10, 0.15) for w in ("equal", "inv_vol")])


def bootstrap(pairs: list[tuple[str, str]], n_boot: int = 2000, block: int = 21, seed: int = 7) -> list[str]:
    sel = " union all ".join(f"""select a.universe, '{a}-{b}' pair_id, row_number() over (partition by a.universe order by a.dt) - 1 i, a.net a, b.net b
 from rets a join rets b using (universe, dt) where a.run_id = '{a}' and b.run_id = '{b}'""" for a, b in pairs)
    return [f"pr as ({sel})", "ln as (select universe, pair_id, count(*) t, avg(a) / (stddev_samp(a) + 1e-12) * sqrt(252) - avg(b) / (stddev_samp(b) + 1e-12) * sqrt(252) delta_obs from pr group by 1, 2)",
            f"""dw as (select universe, pair_id, t, rep, bl, case when bl = ceil(t / {block}.0) - 1 then t - (ceil(t / {block}.0) - 1) * {block} else {block} end len,
 cast('0x' || substr(md5('{seed}|' || rep || '|' || bl), 1, 15) as bigint) % t s from ln, range(0, {n_boot}) r(rep), range(0, 1000) q(bl) where bl < ceil(t / {block}.0))""",
            f"""px2 as (select universe, pair_id, i, sum(a) over w pa, sum(a * a) over w paa, sum(b) over w pb, sum(b * b) over w pbb from (
 select universe, pair_id, i, a, b from pr union all select universe, pair_id, i + t, a, b from pr join ln using (universe, pair_id) where i < {block})
 window w as (partition by universe, pair_id order by i))""",
            """rs as (select d.universe, d.pair_id, rep, t, sum(h.pa - coalesce(l.pa, 0)) a, sum(h.paa - coalesce(l.paa, 0)) aa, sum(h.pb - coalesce(l.pb, 0)) b, sum(h.pbb - coalesce(l.pbb, 0)) bb from dw d
 join px2 h on h.universe = d.universe and h.pair_id = d.pair_id and h.i = d.s + d.len - 1 left join px2 l on l.universe = d.universe and l.pair_id = d.pair_id and l.i = d.s - 1 group by 1, 2, 3, 4)""",
            """dl as (select universe, pair_id, a / t / (sqrt((aa - a * a / t) / (t - 1)) + 1e-12) * sqrt(252) - b / t / (sqrt((bb - b * b / t) / (t - 1)) + 1e-12) * sqrt(252) delta from rs)""",
            """bt as (select universe, pair_id, avg(delta) boot_mean, quantile_cont(delta, 0.025) ci_lo, quantile_cont(delta, 0.975) ci_hi, avg(cast(delta <= 0 as double)) p_value from dl group by 1, 2)""",
            """bv as (select bt.*, delta_obs, case when ci_lo > 0 then 'better' when ci_hi < 0 then 'worse' else 'not significant' end verdict from bt join ln using (universe, pair_id))"""]


BOOT = Q.final("bv", ["universe", "pair_id", "verdict"], ["delta_obs", "boot_mean", "ci_lo", "ci_hi", "p_value"])
S["momentum_weights_bootstrap"] = Q.with_(Q.base() + Q.runs([p for p in MOM if p.run_id in ("equal", "by_length")], U) + bootstrap([("by_length", "equal")]), BOOT)
S["selection_margin"] = Q.with_(Q.base() + Q.runs([SELECT, HOLD], U) + bootstrap([("select", "hold"), ("hold", "select")]), BOOT)
S["freeze_test"] = Q.with_(Q.base() + Q.runs([SELECT, HOLD], U, name="r2") + Q.hold_asset([("ECONOMY", 1.0)], "bench", "bh") + [
    """sg as (select r.universe, r.run_id, r.dt, r.net, segment, count(*) over (partition by universe, run_id, segment) c from
 (select universe, run_id, dt, net from r2 union all select universe, run_id, dt, net from bh) r join (values ('all', date '1900-01-01', date '2100-01-01'),
 ('tuning', date '1900-01-01', date '1999-01-01'), ('frozen', date '1999-01-01', date '2100-01-01')) s(segment, lo, hi) on dt between lo and hi)""", "sh as (select * from sg where c >= 60)"]
    + Q.perf("sh", "universe, run_id, segment"), Q.final("pf", UR + ["segment"], Q.PERF))

RED = Universe("types_reduced", ("ECONOMY", "LARGE", "MEDIUM"), bond="STANDARD", benchmark="ECONOMY")
S["universe_ablation"] = Q.with_(Q.base() + Q.targets(SELECT, U, 0) + Q.daily(0, 126, "select") + Q.targets(SELECT, RED, 1) + Q.daily(1, 126, "select") + [
    "ab as (select * from dr0 union all select * replace ('types_reduced' as universe) from dr1)"] + Q.perf("ab"), Q.final("pf", UR, Q.PERF))


def stressed(name: str, annual: float) -> list[str]:
    daily = (1 + annual) ** (1 / 252)
    return [f"""zz as (select 1)""", f"""obs_b as (select * from obs where asset <> 'STANDARD' union all select c.universe, 'STANDARD', c.dt, c.row_no, p0 * {daily!r} ** c.row_no,
 case when c.row_no > 0 then {daily!r} - 1 end, c.row_no + 1 from cal c cross join (select arg_min(close, dt) p0 from obs where asset = 'STANDARD'))"""]


def stress_part(i: int, name: str, annual: float) -> list[str]:
    """The whole chain again on a panel whose bond leg is replaced."""
    chain = Q.targets(FULL, U, i) + Q.daily(i, 126, "full")
    return [stressed(name, annual)[1].replace("obs_b as", f"obs_{i} as")] + [c.replace("from obs where", f"from obs_{i} where").replace("left join obs o", f"left join obs_{i} o") for c in chain]


S["bond_stress"] = Q.with_(Q.base() + Q.targets(FULL, U, 0) + Q.daily(0, 126, "full") + stress_part(1, "bond_flat", 0.0) + stress_part(2, "bond_falling", -0.02) + [
    "ab as (select * from dr0 union all select * replace ('bond_flat' as universe) from dr1 union all select * replace ('bond_falling' as universe) from dr2)"] + Q.perf("ab"), Q.final("pf", UR, Q.PERF))
TWO = Q.prices(universe="case when l_returnflag = 'R' then 'returned' else 'kept' end") + Q.panel()
CROSS = [SELECT, HOLD, ParamSet("bare", vol_target=None)]
S["cross_market"] = Q.with_(TWO + Q.runs(CROSS, U, name="r2") + Q.hold_asset([("ECONOMY", 1.0)], "bench", "bh") + [
    "allr as (select universe, run_id, dt, net from r2 union all select universe, run_id, dt, net from bh)"] + Q.perf("allr"), Q.final("pf", UR, Q.PERF))
S["cross_market_bootstrap"] = Q.with_(TWO + Q.runs(CROSS[:2], U) + bootstrap([("select", "hold")]), BOOT)

S["calendar_windows"] = Q.with_(Q.base() + [c.replace("sp as", "sw as").replace("from sp", "from sw") for c in walk(3)[:3]] + [PCV[0], PCV[1].replace("ww as", "pw as")] + [
    """rg as (select 'walk_forward' kind, window_id, 'train' part, t0::timestamp a, tr_e::timestamp b from ww union all select 'walk_forward', window_id, 'test', te_s, te_e from ww
 union all select 'purged', window_id, 'test', te_s, te_e from pw union all select 'purged', window_id, 'train', timestamp '1900-01-01', te_s - interval 21 day - interval 1 microsecond from pw
 union all select 'purged', window_id, 'train', te_e + interval 21 day + interval 1 microsecond, timestamp '2100-01-01' from pw)"""],
    """select kind, universe, cast(window_id as int) window_id, part, cast(min(row_no) as int) lo, cast(max(row_no) as int) hi from rg join cal on dt between a and b group by kind, universe, window_id, part, a""")
