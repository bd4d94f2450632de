"""DuckDB statements that re-derive the registered queries in a dense, step-by-step form.

Panels are full dates x assets grids, the rebalance lookups are as-of joins and the overlay chain is applied leg by leg, so
an agreement checks the sparse and closed forms of the Spark side. Parameter grids, universes and the coefficient tables of
the normal distribution come from the library; ``normal_functions`` checks these tables against a series and its root.
"""

from __future__ import annotations

from panelfolio.params import COST_RATE, ParamSet, Universe

EPS = 1e-12


def rnd(expr: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0"


def final(src: str, keys: list[str], doubles: list[str], places: int = 6, where: str = "") -> str:
    cols = keys + [f"{rnd(d, places)} as {d}" for d in doubles]
    return f"select {', '.join(cols)} from {src}" + (f" where {where}" if where else "")


def with_(ctes: list[str], tail: str) -> str:
    return "with recursive " + ",\n".join(c for c in ctes if c) + "\n" + tail


def prices(asset: str = "p_type", universe: str = "'types'", smooth: int = 20) -> list[str]:
    return [f"""ad as (select {universe} universe, {asset} asset, cast(l_shipdate as date) dt,
 sum(cast(round(l_extendedprice * 100) as bigint)) cents, sum(cast(l_quantity as bigint)) qty,
 max(l_extendedprice / l_quantity) high, min(l_extendedprice / l_quantity) low
 from lineitem join part on l_partkey = p_partkey where l_quantity > 0 group by 1, 2, 3)""",
            f"""px as (select universe, asset, dt,
 cast(sum(cents) over w as double) / cast(sum(qty) over w as double) / 100.0 as close, high, low, qty volume
 from ad window w as (partition by universe, asset order by dt rows between {smooth - 1} preceding and current row))"""]


CAL = """{name} as (select *, case when is_month_end then cast(sum(cast(is_month_end as int)) over (partition by universe order by dt) as int) end reb_no
 from (select universe, dt, row_number() over (partition by universe order by dt) - 1 row_no,
 coalesce(date_trunc('month', lead(dt) over (partition by universe order by dt)) <> date_trunc('month', dt), true) is_month_end
 from (select distinct universe, dt from {src})))"""


def panel(anchors: tuple[str, ...] | None = ("ECONOMY", "STANDARD"), limit: int | None = 3, src: str = "px") -> list[str]:
    """obs(universe, asset, dt, row_no, close, ret) and cal."""
    back = f"{limit} preceding" if limit is not None else "unbounded preceding"
    out = [CAL.format(name="cal0", src=src),
           f"""filled as (select universe, asset, dt, row_no, is_raw, last_value(raw ignore nulls) over
 (partition by universe, asset order by row_no rows between {back} and current row) as close from
 (select c.universe, a.asset, c.dt, c.row_no, p.close raw, p.close is not null is_raw from cal0 c
 join (select distinct universe, asset from {src}) a using (universe) left join {src} p using (universe, asset, dt)))"""]
    if anchors:
        names = ", ".join(f"'{a}'" for a in anchors)
        out.append(f"""start as (select universe, min(dt) s from (select universe, dt from filled where close is not null
 and asset in ({names}) group by 1, 2 having count(*) = {len(anchors)}) group by 1)""")
        out.append("""obs0 as (select f.universe, asset, dt, close from filled f join start using (universe)
 where dt >= s and close is not null)""")
    else:
        out.append("obs0 as (select universe, asset, dt, close from filled where close is not null)")
    out.append(CAL.format(name="cal", src="obs0"))
    out.append("""obs as (select o.universe, o.asset, o.dt, c.row_no, o.close,
 o.close / lag(o.close) over (partition by o.universe, o.asset order by o.dt) - 1 ret,
 row_number() over (partition by o.universe, o.asset order by o.dt) n
 from obs0 o join cal c using (universe, dt))""")
    return out


def base(anchors: tuple[str, ...] | None = ("ECONOMY", "STANDARD")) -> list[str]:
    return prices() + panel(anchors)


def _list(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def signals(p: ParamSet, u: Universe, i: int) -> list[str]:
    lbs, skip = p.lookbacks, p.skip
    w = [max(float(x), 0.0) for x in p.lookback_weights] if p.lookback_weights else [1.0] * len(lbs)
    at = lambda k: f"lag(close, {k}) over w" if k else "close"
    mom = " + ".join(f"{wi} * ({at(skip)} / ({at(skip + lb)}) - 1)" for wi, lb in zip(w, lbs))
    mom = f"({mom}) / {sum(w)}"
    long = max(lbs)
    vol_rows = p.inv_vol_window
    return [f"""sg{i} as (select *, {f"mom0 / nullif(lag(case when n > {long} then vlong end, {skip}) over (partition by universe, asset order by n), 0)" if p.risk_adj else "mom0"} mom from (
 select universe, asset, dt, n, close, {mom} mom0,
 stddev_pop(ret) over (w rows between {long - 1} preceding and current row) vlong,
 case when n > {vol_rows} then stddev_pop(ret) over (w rows between {vol_rows - 1} preceding and current row) end vol,
 {f"n >= {p.trend_ma} and close < avg(close) over (w rows between {p.trend_ma - 1} preceding and current row)" if p.trend_ma else "false"} below,
 {f"n > {p.crash_lookback + 1} and close / lag(close, {p.crash_lookback}) over w - 1 >= {p.crash_thr}" if p.crash_prot else "false"} rebound,
 {f"n > {p.dd_window} and close / max(close) over (w rows between {p.dd_window - 1} preceding and current row) - 1 <= {p.dd_thr}" if p.drawdown_prot else "false"} fallen,
 list(ret) over (w rows between {p.vol_window - 1} preceding and current row) tail
 from obs where asset in ({_list(u.pool)}) window w as (partition by universe, asset order by n)))""",
            f"""rb{i} as (select universe, reb_no, dt, row_no from cal where is_month_end and row_no >= {p.need})""",
            f"""sr{i} as (select r.universe, r.reb_no, r.dt signal_dt, r.asset, r.ord, s.close, s.mom, s.vol, s.below, s.rebound, s.fallen, s.tail
 from (select rb{i}.*, a.asset, a.ord from rb{i} cross join (values {', '.join(f"('{a}', {k})" for k, a in enumerate(u.pool))}) a(asset, ord)) r
 asof join sg{i} s on r.universe = s.universe and r.asset = s.asset and r.dt >= s.dt)"""]


def targets(p: ParamSet, u: Universe, i: int) -> list[str]:
    """tg{i}(universe, reb_no, asset, weight) by applying every step in turn."""
    uses_vol = p.weighting == "inv_vol" and not p.hold_all
    if p.hold_all:
        w_sel = f"{p.cash_buffer} / n_cand"
    elif uses_vol:
        w_sel = f"{p.cash_buffer} * raw / sum(raw) over (partition by universe, reb_no)"
    else:
        w_sel = f"{p.cash_buffer} / {p.top_n}"
    held = "true" if p.hold_all else "mom > 0"
    cap = f"least(w_sel, {p.max_weight})" if p.max_weight and not p.hold_all else "w_sel"
    out = signals(p, u, i) + [
        f"""cd{i} as (select *, coalesce(case when vol > 0 then 1 / vol end, 1.0) raw from (select *,
 count(mom) over (partition by universe, reb_no) n_cand,
 row_number() over (partition by universe, reb_no order by mom desc nulls last, ord) rk from sr{i})
 where mom is not null and n_cand >= {p.top_n}{'' if p.hold_all else f' and rk <= {p.top_n}'})""",
        f"""mk{i} as (select universe, reb_no, coalesce(below, false) below, coalesce(rebound, false) rebound,
 coalesce(fallen, false) fallen from sr{i} where asset = '{u.benchmark}')""",
        f"""ws{i} as (select *, case when held then {cap} else 0.0 end w0 from
 (select *, {held} held, {w_sel} w_sel from cd{i}))"""]
    if p.vol_target:
        weight = "w_sel" if uses_vol else "1.0"
        out += [f"""bk{i} as (select universe, reb_no, k, sum(w * r) / sum(w) pr from
 (select universe, reb_no, {weight} w, unnest(tail) r, generate_subscripts(tail, 1) k from ws{i} where held) group by 1, 2, 3)""",
                f"""rv{i} as (select b.universe, b.reb_no, case when short then null else rv end rv from
 (select universe, reb_no, stddev_pop(pr) * sqrt(252) rv from bk{i} group by 1, 2) b join
 (select universe, reb_no, bool_or(len(tail) < {p.vol_window} or list_contains(tail, null)) short from ws{i} where held group by 1, 2) using (universe, reb_no))"""]
        sv = f"coalesce(case when rv > {p.vol_target} and rv > 0 then {p.vol_target} / rv end, 1.0)"
        vj = f"left join rv{i} using (universe, reb_no)"
    else:
        sv, vj = "1.0", ""
    out += [
        f"""st{i} as (select x.*, w1 * case when mkt_below then {float(p.trend_cut)} else 1.0 end w2 from (select s.*, {sv} sv, w0 * {sv} w1, coalesce(m.below, false) mkt_below,
 coalesce(m.rebound, false) mkt_rebound, coalesce(m.fallen, false) mkt_fallen
 from ws{i} s {vj} left join mk{i} m using (universe, reb_no)) x)""",
        f"""s2{i} as (select *, w3 * case when mkt_fallen then {float(p.dd_cut)} else 1.0 end w4 from (select *, w2 * case when mkt_rebound then {float(p.crash_cut)} else 1.0 end w3 from st{i}))""",
        f"""tg{i} as (select universe, reb_no, asset, sum(weight) weight from (
 select universe, reb_no, asset, w4 weight from s2{i} where held
 union all select universe, reb_no, '{u.cash_leg}', (w_sel - w0) + (w0 - w1) from s2{i} where (w_sel - w0) + (w0 - w1) > 0
 union all select universe, reb_no, '{u.bond}', (w1 - w2) + (w2 - w3) + (w3 - w4) from s2{i} where w1 > w4) group by 1, 2, 3)"""]
    return out


def daily(i, need: int, run_id: str, cost: float = COST_RATE, holdings: str | None = None) -> list[str]:
    """dr{i}(universe, run_id, dt, row_no, gross, turnover, cost, net) from tg{i} on a dense grid."""
    if holdings is None:
        hold = f"""hd{i} as (select c.universe, c.row_no, c.dt, a.asset, coalesce(t.weight, 0.0) weight from cal c
 join (select distinct universe, asset from tg{i}) a using (universe)
 asof left join (select universe, reb_no, cal.row_no + 1 fill_row from (select distinct universe, reb_no from tg{i}) join cal using (universe, reb_no)) d
 on c.universe = d.universe and c.row_no >= d.fill_row
 left join tg{i} t on t.universe = c.universe and t.reb_no = d.reb_no and t.asset = a.asset)"""
    else:
        hold = holdings
    return [hold,
            f"""dr{i} as (select universe, '{run_id}' run_id, dt, row_no, gross, turnover, turnover * {cost} as cost, gross - turnover * {cost} net from (
 select universe, dt, row_no, sum(wl * coalesce(ret, 0)) gross, sum(abs(weight - wp)) turnover from (
 select h.universe, h.dt, h.row_no, h.weight, coalesce(lag(weight) over w, 0) wp, coalesce(lag(weight) over w, 0) wl, o.ret
 from hd{i} h left join obs o on o.universe = h.universe and o.asset = h.asset and o.row_no = h.row_no
 window w as (partition by h.universe, h.asset order by h.row_no)) group by 1, 2, 3) where row_no >= {need})"""]


def runs(params: list[ParamSet], u: Universe, cost: float = COST_RATE, name: str = "rets") -> list[str]:
    out: list[str] = []
    for i, p in enumerate(params):
        out += targets(p, u, i) + daily(i, p.need, p.run_id, cost)
    return out + [f"{name} as (" + " union all ".join(f"select * from dr{i}" for i in range(len(params))) + ")"]


PERF = ["total_return", "cagr", "vol", "sharpe", "sortino", "calmar", "omega", "mdd", "years", "var95", "cvar95", "var99", "cvar99"]


def perf(src: str, keys: str = "universe, run_id", name: str = "pf", ret: str = "net") -> list[str]:
    return [f"""{name}_n as (select *, growth / first_value(growth) over (partition by {keys} order by dt) nav from
 (select *, product(1 + {ret}) over (partition by {keys} order by dt) growth from {src}))""",
            f"""{name}_v as (select {keys}, quantile_cont({ret}, 0.05) v95, quantile_cont({ret}, 0.01) v99 from {src} group by {keys})""",
            f"""{name}_g as (select {keys}, arg_max(nav, dt) nav_end, date_diff('day', min(dt), max(dt)) / 365.25 as years,
 avg({ret}) m, stddev_samp({ret}) sd, sqrt(avg(least({ret}, 0) * least({ret}, 0))) * sqrt(252) down, min(uw) mdd,
 sum(greatest({ret}, 0)) gain, -sum(least({ret}, 0)) loss, max(v95) var95, max(v99) var99,
 avg({ret}) filter ({ret} <= v95) cvar95, avg({ret}) filter ({ret} <= v99) cvar99
 from (select *, nav / max(nav) over (partition by {keys} order by dt) - 1 uw from {name}_n) join {name}_v using ({keys}) group by {keys})""",
            f"""{name} as (select {keys}, nav_end - 1 total_return, nav_end ** (1 / years) - 1 cagr, sd * sqrt(252) vol,
 m * 252 / (sd * sqrt(252) + 1e-12) sharpe, m * 252 / (down + 1e-12) sortino,
 (nav_end ** (1 / years) - 1) / (abs(mdd) + 1e-12) calmar, gain / (loss + 1e-12) omega, mdd, years, var95, cvar95, var99, cvar99 from {name}_g)"""]


def hold_asset(asset_weights: list[tuple[str, float]], run_id: str, name: str, need: int = 126) -> list[str]:
    vals = ", ".join(f"('{a}', {w})" for a, w in asset_weights)
    return [f"""{name} as (select c.universe, '{run_id}' run_id, c.dt, c.row_no, case when c.row_no = {need} then 0 else coalesce(sum(v.w * coalesce(o.ret, 0)), 0) end net from cal c
 cross join (values {vals}) v(asset, w) left join obs o on o.universe = c.universe and o.asset = v.asset and o.row_no = c.row_no
 where c.row_no >= {need} group by 1, 2, 3, 4)"""]
