from __future__ import annotations

from oracles import sql as Q
from oracles.portfolios import FULL, UR, cdf
from oracles.signals import timing
from panelfolio import testpanel as T
from panelfolio.functions import scalars as SC

S: dict[str, str] = {}
U = T.TYPES


def basket(src: str = "px", sfx: str = "") -> list[str]:
    """den: dense carried panel; obs-style returns; rbd: union of the assets' own month ends."""
    return [f"""cal{sfx} as (select universe, dt, row_number() over (partition by universe order by dt) - 1 row_no from (select distinct universe, dt from {src}))""",
            f"""den{sfx} as (select *, close / lag(close) over (partition by universe, asset order by row_no) - 1 ret from (select c.universe, a.asset, c.dt, c.row_no, p.close raw,
 last_value(p.close ignore nulls) over (partition by c.universe, a.asset order by c.row_no rows between unbounded preceding and current row) as close
 from cal{sfx} c join (select distinct universe, asset from {src}) a using (universe) left join {src} p using (universe, asset, dt)))""",
            f"""rbd{sfx} as (select distinct universe, dt, row_no from (select *, row_number() over w - 1 own, coalesce(date_trunc('month', lead(dt) over w) <> date_trunc('month', dt), true) me
 from {src} join cal{sfx} using (universe, dt) window w as (partition by universe, asset order by dt)) where own >= 200 and me)""",
            f"""rbn{sfx} as (select *, row_number() over (partition by universe order by dt) reb_no from rbd{sfx})""",
            f"""scr{sfx} as (select universe, 'momentum' run_id, asset, dt, (close / lag(close, 21) over w + close / lag(close, 63) over w + close / lag(close, 126) over w - 3) / 3 score
 from {src} window w as (partition by universe, asset order by dt)
 union all select universe, 'low_vol', asset, dt, case when count(ret) over w = 126 then -stddev_samp(ret) over w * sqrt(252) end from den{sfx}
 window w as (partition by universe, asset order by row_no rows between 125 preceding and current row)
 union all select universe, 'reversal', asset, dt, -(raw / lag(raw, 21) over w - 1) from den{sfx} window w as (partition by universe, asset order by row_no))"""]


def chosen(n: int, sfx: str = "") -> list[str]:
    return [f"""sel{sfx} as (select universe, run_id, reb_no, asset, 1.0::double / {n} weight from (select s.*, r.reb_no, row_number() over (partition by s.universe, s.run_id, reb_no order by score desc, asset) k,
 count(*) over (partition by s.universe, s.run_id, reb_no) c from scr{sfx} s join rbn{sfx} r using (universe, dt) where score is not null) where c >= {n} and k <= {n})"""]


def books(sfx: str = "") -> list[str]:
    return [f"""tgt{sfx} as (select * from sel{sfx} union all select r.universe, 'equal', r.reb_no, a.asset, 1.0::double / count(*) over (partition by r.universe, r.reb_no) from rbn{sfx} r
 join (select distinct universe, asset from den{sfx}) a using (universe))""",
            f"""dec{sfx} as (select distinct t.universe, run_id, reb_no, row_no + 1 fill_row from tgt{sfx} t join rbn{sfx} using (universe, reb_no))""",
            f"""hw{sfx} as (select d.universe, g.run_id, d.asset, d.dt, d.row_no, d.ret, coalesce(t.weight, 0) weight from den{sfx} d join (select distinct universe, run_id from tgt{sfx}) g using (universe)
 asof left join dec{sfx} x on x.universe = d.universe and x.run_id = g.run_id and d.row_no >= x.fill_row
 left join tgt{sfx} t on t.universe = d.universe and t.run_id = g.run_id and t.reb_no = x.reb_no and t.asset = d.asset)""",
            f"""bk{sfx} as (select universe, run_id, dt, sum(wp * coalesce(ret, 0)) - sum(abs(weight - wp)) * 0.00075 net from (
 select *, coalesce(lag(weight) over (partition by universe, run_id, asset order by row_no), 0) wp from hw{sfx}) where row_no >= (select min(row_no) from rbn{sfx}) group by 1, 2, 3)"""]


BR = Q.prices("p_brand", "'brands'")
BASK = BR + basket() + chosen(3)
S["cross_section_targets"] = Q.with_(BASK, Q.final("sel", ["universe", "run_id", "reb_no", "asset"], ["weight"]))
S["basket_methods"] = Q.with_(BASK + books() + Q.perf("bk"), Q.final("pf", UR, Q.PERF))
SLOT = ["""sl0 as (select universe, asset, dt, close, case when n >= 201 and mom > 0 and close > ma then 1.0 else 0.0 end sig from (select universe, asset, dt, close, row_number() over w n, count(*) over (partition by universe, asset) c,
 (close / lag(close, 21) over w + close / lag(close, 63) over w + close / lag(close, 126) over w - 3) / 3 mom, avg(close) over (w rows between 199 preceding and current row) ma
 from px window w as (partition by universe, asset order by dt)) where c >= 326)"""] + timing("sl0", "sl1", 200) + [
    "slots as (select universe, 'slots' run_id, dt, sum(net) / 25 net from sl1 group by 1, 2, 3)"]
S["slot_timing_perf"] = Q.with_(BR + SLOT + Q.perf("slots"), Q.final("pf", UR, Q.PERF))


def renamed(ctes: list[str]) -> list[str]:
    """The types chain next to the brands chain: its price tables get other names."""
    out = []
    for c in ctes:
        for n in ("ad", "px", "cal"):
            for before in (" ", "\n", "("):
                for after in (" ", "\n", ")", ".", ","):
                    c = c.replace(f"{before}{n}{after}", f"{before}{n}_t{after}")
            if c.startswith(f"{n} as"):
                c = f"{n}_t" + c[len(n):]
        out.append(c)
    return out


S["basket_gates"] = Q.with_(renamed(Q.base() + Q.runs([FULL], U, name="base_r")) + BASK + books() + SLOT + [
    "ca as (select universe, run_id, dt, net from bk union all select universe, run_id, dt, net from slots)",
    "an as (select universe, run_id, avg(net) / (stddev_samp(net) + 1e-12) * sqrt(252) own_sharpe from ca group by 1, 2)",
    """bo as (select c.universe, c.run_id, count(*) n, corr(c.net, b.net) corr, avg(b.net) / (stddev_samp(b.net) + 1e-12) * sqrt(252) base_sharpe,
 avg(0.5 * c.net + 0.5 * b.net) / (stddev_samp(0.5 * c.net + 0.5 * b.net) + 1e-12) * sqrt(252) mix_sharpe from ca c join base_r b using (dt) group by 1, 2)""",
    """ga as (select *, gate_corr and gate_own and gate_mix passed from (select *, abs(corr) < 0.3 gate_corr, own_sharpe > 0.5 gate_own, mix_sharpe > greatest(own_sharpe, base_sharpe) gate_mix from bo join an using (universe, run_id)))"""],
    Q.final("ga", UR + ["n", "gate_corr", "gate_own", "gate_mix", "passed"], ["corr", "base_sharpe", "mix_sharpe", "own_sharpe"]))
S["basket_vs_equal"] = Q.with_(BASK + books() + ["an as (select universe, run_id, avg(net) / (stddev_samp(net) + 1e-12) * sqrt(252) sharpe from bk group by 1, 2)",
    "co as (select a.universe, a.run_id, corr(a.net, b.net) corr from bk a join bk b on a.dt = b.dt and b.run_id = 'equal' group by 1, 2)",
    "vs as (select a.universe, a.run_id, a.sharpe, r.sharpe ref_sharpe, corr, a.sharpe > r.sharpe + 0.02 beats from an a join co using (universe, run_id) join an r on r.run_id = 'equal')"],
    Q.final("vs", UR + ["beats"], ["sharpe", "ref_sharpe", "corr"]))
PANELS: list[str] = list(BR)
for name, (cutoff, n) in {"long": ("1995-01-04", 3), "full": ("1996-01-01", 4)}.items():
    PANELS += [f"""p_{name} as (select '{name}' universe, asset, dt, close from px where dt >= date '{cutoff}' and asset in
 (select asset from px group by 1 having count(*) >= 750 and min(dt) <= date '{cutoff}'))"""] + basket(f"p_{name}", f"_{name}") + chosen(n, f"_{name}") + books(f"_{name}")
S["two_panels"] = Q.with_(PANELS + ["bb as (select * from bk_long union all select * from bk_full)"] + Q.perf("bb"), Q.final("pf", UR, Q.PERF))

S["high_correlations"] = Q.with_(BR + basket() + ["""hc as (select x.universe, x.asset a, y.asset b, corr(x.close, y.close) corr, count(*) n from den x join den y
 on x.universe = y.universe and x.dt = y.dt and x.asset < y.asset where x.close is not null and y.close is not null group by 1, 2, 3)"""],
    Q.final("hc", ["universe", "a", "b", "n"], ["corr"], where="corr >= 0.2"))

PAIRS = Q.base() + ["""pp as (select * from (select a.universe, a.asset a, b.asset b, a.dt, a.close pa, b.close pb, count(*) over (partition by a.universe, a.asset, b.asset) t
 from obs a join obs b on a.universe = b.universe and a.dt = b.dt and a.asset < b.asset) where t >= 300)""",
    "pb as (select a, b, regr_slope(ln(pa), ln(pb)) beta from pp group by 1, 2)",
    """pz as (select *, case when count(*) over w = 60 then (spread - avg(spread) over w) / (stddev_samp(spread) over w + 1e-12) end z, row_number() over (partition by a, b order by dt) k from
 (select pp.*, beta, ln(pa) - beta * ln(pp.pb) spread from pp join pb using (a, b)) window w as (partition by a, b order by dt rows between 59 preceding and current row))"""]
STATE = ["""hs as (select a, b, k, case when z is null then 0 when z < -2.0 then 1 when z > 2.0 then -1 else 0 end state from pz where k = 1
 union all select p.a, p.b, p.k, case when z is null then state when state = 0 then case when z < -2.0 then 1 when z > 2.0 then -1 else 0 end
 when state = 1 and z > -0.5 then 0 when state = -1 and z < 0.5 then 0 else state end from hs join pz p on p.a = hs.a and p.b = hs.b and p.k = hs.k + 1)""",
         "po as (select pz.*, case when z is null then 0 else state end pos from pz join hs using (a, b, k))"]
S["pair_spread_z"] = Q.with_(PAIRS, Q.final("pz", ["universe", "a", "b", "dt"], ["beta", "z"]))
S["pair_states"] = Q.with_(PAIRS + STATE, "select universe, a, b, dt, pos from po")
S["pair_perf"] = Q.with_(PAIRS + STATE + ["""pn as (select universe, a || '/' || b run_id, dt, p2 * (0.5 * ra - 0.5 * beta * rb) - abs(p1 - p2) * 0.5 * (1 + abs(beta)) * 0.00075 net, ch from (
 select *, coalesce(pa / lag(pa) over w - 1, 0) ra, coalesce(pb / lag(pb) over w - 1, 0) rb, coalesce(lag(pos, 1) over w, 0) p1, coalesce(lag(pos, 2) over w, 0) p2, coalesce(pos <> lag(pos) over w, false) ch
 from po window w as (partition by a, b order by dt)))""",
    "pa2 as (select universe, run_id, dt, net from pn union all select universe, 'mean', dt, avg(net) from pn group by 1, 2, 3)"] + Q.perf("pa2") + [
    "pt as (select pf.*, coalesce(n_trades, 0) n_trades from pf left join (select run_id, count(*) filter (ch) n_trades from pn group by 1) using (run_id))"],
    Q.final("pt", UR + ["n_trades"], Q.PERF))


def _tested(name: str, lags: str) -> list[str]:
    """Regressions by definition: every row's variables as a list (level, change, lagged changes), all cross products summed, lags eliminated in turn."""
    return [f"""{name}v as (select a, b, k, t, lags, [e0, d] || ds v from (select r.a, r.b, r.k, r.t, l.lags, r.x e0, r.d, list(q.d order by q.k desc) ds
 from ed r join {lags} l on l.a = r.a and l.b = r.b join ed q on q.a = r.a and q.b = r.b and q.k between r.k - l.lags and r.k - 1 where r.k > l.lags group by all
 union all select r.a, r.b, r.k, r.t, 0, r.x, r.d, [] from ed r join {lags} l on l.a = r.a and l.b = r.b where l.lags = 0))""",
            f"""{name}c as (select a, b, t, lags, i, j, sum(v[i] * v[j]) s from {name}v, range(1, lags + 3) g(i), range(1, lags + 3) h(j) group by all)""",
            f"""{name}m as (select a, b, t, lags, 0 p, list(s order by i, j) m from {name}c group by all
 union all select a, b, t, lags, p + 1, list_transform(m, lambda v, i: v - m[(i - 1) // (lags + 2) * (lags + 2) + p + 3] * m[(p + 2) * (lags + 2) + (i - 1) % (lags + 2) + 1] / m[(p + 2) * (lags + 2) + p + 3])
 from {name}m where p < lags)""",
            f"""{name}r as (select a, b, t, lags, p, m[2] / m[1] rho, m[1] sxx, m[lags + 4] - m[2] * m[2] / m[1] rss, t - 1 - lags nobs from {name}m)""",
            f"""{name} as (select *, rho / sqrt(rss / (nobs - p - 1) / sxx) tstat, nobs * ln(rss / nobs) + 2 * (p + 1) aic from {name}r)"""]


def _polynomial(coefficients: tuple[float, ...], x: str) -> str:
    return " + ".join(f"({c}) * {x} ** {i}" for i, c in enumerate(coefficients))


TESTS = PAIRS + ["""er as (select p.a, p.b, p.dt, p.t, pa - s * p.pb - i e from pp p join (select a, b, regr_slope(pa, pb) s, regr_intercept(pa, pb) i from pp group by 1, 2) using (a, b))""",
    "ed as (select * from (select a, b, t, row_number() over w - 1 k, lag(e) over w x, e - lag(e) over w d from er window w as (partition by a, b order by dt)) where k > 0)",
    "lg as (select distinct a, b, cast(ceil(12 * (t / 100) ** 0.25) as int) lags from ed)"] + _tested("ea", "lg") + [
    "cl as (select a, b, arg_min(p, (aic, p)) lags from ea group by 1, 2)"] + _tested("eb", "cl") + [
    f"""ep as (select a, b, t n, cast(lags as int) lag, tstat, case when tstat <= {SC.RESIDUAL_TURN} then {_polynomial(SC.RESIDUAL_SMALL, "tstat")} else {_polynomial(SC.RESIDUAL_LARGE, "tstat")} end z from eb where p = lags)""",
    f"""ez as (select 'types' universe, a, b, n, lag, tstat, case when tstat < {SC.RESIDUAL_LEAST} then 0.0 when tstat > {SC.RESIDUAL_MOST} then 1.0 else {cdf("z")} end p from ep)""",
    "es as (select *, count(*) filter (p < 0.1) over () c, row_number() over (order by p, a, b) k from ez)"]
S["pair_tests"] = Q.with_(TESTS, Q.final("es", ["universe", "a", "b", "n", "lag"], ["tstat", "p"]))
S["pair_screen"] = Q.with_(TESTS, Q.final("es", ["universe", "a", "b", "n", "lag"], ["tstat", "p"], where="(c > 0 and p < 0.1) or (c = 0 and k <= 2)"))
