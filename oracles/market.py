from __future__ import annotations

from oracles import sql as Q

S: dict[str, str] = {}
PX = Q.prices()

S["vendor_decode"] = Q.with_(PX + ["""d as (select universe, asset, dt, close,
 lag(close) over (partition by universe, asset order by dt) pre_close from px)"""], Q.final("d", ["universe", "asset", "dt"], ["close", "pre_close"]))

S["coalesced_sources"] = Q.with_(Q.prices(universe="case when l_returnflag = 'R' then 'primary' else 'backup' end") + [
    """m as (select * from px where universe = 'primary' and asset not in ('STANDARD', 'SMALL')
 union all select * from px where universe = 'backup' and asset = 'STANDARD')""",
    "o as (select 'types' universe, asset, count(*) n, min(dt) first_dt, avg(close) mean_close from m group by asset)"],
    Q.final("o", ["universe", "asset", "n", "first_dt"], ["mean_close"]))

S["merged_sources"] = Q.with_(Q.prices(universe="l_returnflag") + [
    """m as (select * from px where (universe = 'A' and asset in ('ECONOMY', 'PROMO', 'SMALL')) or (universe = 'N' and asset = 'LARGE')
 or (universe = 'R' and asset in ('MEDIUM', 'STANDARD')))""",
    "o as (select 'types' universe, asset, count(*) n, max(dt) last_dt, avg(close) mean_close from m group by asset)"],
    Q.final("o", ["universe", "asset", "n", "last_dt"], ["mean_close"]))

S["topped_up_closes"] = Q.with_(Q.prices(universe="l_returnflag") + [
    """m as (select 'types' universe, asset, dt, close, row_number() over (partition by asset order by dt desc) k from px
 where (universe = 'A' and asset <> 'STANDARD') or (universe = 'N' and asset = 'STANDARD'))"""],
    Q.final("m", ["universe", "asset", "dt"], ["close"], where="k <= 127"))

S["config_flags"] = """select o_orderstatus, case when o_orderstatus = 'F' then o_totalprice > 100000 else true end hold_all, count(*) n
 from orders group by 1, 2"""

S["month_gate"] = """with o as (select o_custkey acct, cast(o_orderdate as date) dt, strftime(o_orderdate, '%Y-%m') "month", o_orderstatus from orders)
 select "month", count(*) n_days, count(distinct acct) n_accts from o
 where not exists (select 1 from o d where d.o_orderstatus = 'F' and d.acct = o.acct and d."month" = o."month") group by 1"""

S["filled_panel"] = Q.with_(PX + Q.panel(None), "select universe, asset, dt, round(close, 6) as close, not is_raw is_filled from filled where close is not null")
S["filled_unbounded"] = Q.with_(PX + Q.panel(None, None), """select universe, asset, count(*) n, count(*) filter (not is_raw) n_filled,
 round(avg(close), 6) mean_close from filled where close is not null group by 1, 2""")
S["aligned_panel"] = Q.with_(PX + Q.panel(None, 0), "select universe, asset, dt, row_no, round(close, 6) as close from filled")
S["anchored_panel"] = Q.with_(Q.base(), """select o.universe, o.asset, count(*) n_obs, min(o.dt) first_dt, max(o.dt) last_dt,
 max(c.n_rows) n_rows, max(c.n_reb) n_reb, round(avg(close), 6) mean_close from obs o join
 (select universe, count(*) n_rows, max(reb_no) n_reb from cal group by 1) c using (universe) group by 1, 2""")
S["not_listed_by_start"] = Q.with_(Q.prices("p_brand") + ["""s as (select min(dt) s from (select dt from px
 where asset in ('Brand#1', 'Brand#2') group by 1 having count(*) = 2))"""],
    "select universe, asset from px group by 1, 2 having min(dt) > (select s from s)")

PRE = """pre as (select *, case when date_trunc('quarter', dt) <> date_trunc('quarter', lag(dt) over w) then lag(close) over w * 0.8 else lag(close) over w end pre_close
 from px window w as (partition by universe, asset order by dt))"""
ADJ = """adj as (select *, close * coalesce(product(factor) over (partition by universe, asset order by dt rows between 1 following and unbounded following), 1) adj_close
 from (select *, coalesce(pre_close / lag(close) over (partition by universe, asset order by dt), 1) factor from pre))"""
S["adjusted_prices"] = Q.with_(PX + [PRE, ADJ], Q.final("adj", ["universe", "asset", "dt"], ["factor", "adj_close"]))
S["adjustment_audit"] = Q.with_(PX + [PRE, ADJ, """g as (select universe, asset, min(dt) first_dt, count(close) n_days, count(*) filter (close is null) n_null,
 max(mv) max_move, count(*) filter (abs(factor - 1) > 0.001) n_ex_dates, arg_max(close, dt) / arg_min(close, dt) - 1 price_return,
 arg_max(adj_close, dt) / arg_min(adj_close, dt) - 1 adj_return, date_diff('day', min(dt), max(dt)) / 365.25 yrs
 from (select *, abs(close / lag(close) over (partition by universe, asset order by dt) - 1) mv from adj) group by 1, 2)""",
    "h as (select *, adj_return - price_return income, (adj_return - price_return) / yrs income_per_year from g)"],
    Q.final("h", ["universe", "asset", "first_dt", "n_days", "n_null", "n_ex_dates"], ["max_move", "price_return", "adj_return", "income", "income_per_year"]))
LIM = """lim as (select *, case asset when 'PROMO' then 0.02::double when 'SMALL' then 0.03::double else 0.10::double end limit_pct from {src})"""
FLAG = """fl as (select *, coalesce(close >= round(pre_close * (1 + limit_pct), 2), false) cant_buy,
 coalesce(close <= round(pre_close * (1 - limit_pct), 2), false) cant_sell from lim)"""
S["limit_flags"] = Q.with_(PX + [PRE, LIM.format(src="pre"), FLAG], Q.final("fl", ["universe", "asset", "dt", "cant_buy", "cant_sell"],
                                                                           ["close", "pre_close", "limit_pct"]))
LAGGED = "lg as (select *, lag(close) over (partition by universe, asset order by dt) pre_close from px)"
S["limit_flags_derived"] = Q.with_(PX + [LAGGED, LIM.format(src="lg"), FLAG], """select universe, asset,
 count(*) filter (cant_buy) n_buy, count(*) filter (cant_sell) n_sell from fl group by 1, 2""")
S["limit_flags_approx"] = Q.with_(PX + [LAGGED, LIM.format(src="lg"), """ap as (select *, coalesce(move >= limit_pct - 1e-4, false) cant_buy,
 coalesce(move <= -limit_pct + 1e-4 and not coalesce(move >= limit_pct - 1e-4, false), false) cant_sell
 from (select *, close / pre_close - 1 move from lim))"""],
    Q.final("ap", ["universe", "asset", "dt", "cant_buy", "cant_sell"], ["move"]))
S["quality_guard"] = Q.with_(PX + [LAGGED, LIM.format(src="lg"), "qg as (select *, close / pre_close - 1 move from lim)"],
                             Q.final("qg", ["universe", "asset", "dt"], ["move"], where="abs(move) > limit_pct * 1.5"))
S["daily_returns"] = Q.with_(PX + Q.panel(None, 0) + ["""r as (select universe, asset, dt, coalesce(ret, 0) ret_pad,
 coalesce(case when row_no - lag(row_no) over (partition by universe, asset order by dt) = 1 then ret end, 0) ret_drop from obs)"""],
    Q.final("r", ["universe", "asset", "dt"], ["ret_pad", "ret_drop"]))
S["month_ends"] = Q.with_(PX + Q.panel(None), """select universe, reb_no, row_no reb_row, dt signal_dt from cal where is_month_end and row_no >= 126""")
S["month_end_days"] = """with o as (select distinct cast(o_orderdate as date) dt from orders),
 c as (select date_trunc('month', l_shipdate) m, cast(max(l_shipdate) as date) dt from lineitem join part on l_partkey = p_partkey where l_quantity > 0 group by 1)
 select 'types' universe, o.dt, c.dt is not null is_month_end from o left join c using (dt)"""
S["near_trading_days"] = Q.with_(PX + Q.panel(None), """select 'types' universe, cast(d as varchar) target_id, c.dt as_of_dt, coalesce(c.row_no, -1) as_of_row
 from (select distinct cast(o_orderdate as date) d from orders) o asof left join cal c on o.d >= c.dt""")
S["long_history_assets"] = Q.with_(Q.prices("p_brand"), """select universe, asset, count(*) n_obs, min(dt) first_dt, round(avg(close), 6) mean_close
 from px group by 1, 2 having count(*) >= 750 and min(dt) <= date '1995-01-06'""")
S["symbol_rules"] = """select p_partkey, code || case when code[1] in ('5', '6') then '.SH' else '.SZ' end symbol,
 case when code = '159915' then 0.2::double when code like '588%' then 0.2::double else 0.1::double end limit_pct
 from (select p_partkey, cast(p_partkey * 7919 % 700000 + 100000 as varchar) code from part)"""
S["asset_labels"] = """select p_type asset, case p_type when 'ECONOMY' then 'benchmark basket' when 'STANDARD' then 'bond leg' else p_type end "label", count(*) n
 from part group by 1, 2"""
FACTOR_CTE = """fs as (select c.universe, c.dt, c.row_no, f.factor, coalesce((select sum(sgn * coalesce(o.ret, 0)) from obs o join
 (values ('MKT', 'ECONOMY', 1.0), ('SIZE', 'SMALL', 1.0), ('SIZE', 'ECONOMY', -1.0), ('BOND', 'STANDARD', 1.0)) v(fac, asset, sgn) using (asset)
 where v.fac = f.factor and o.universe = c.universe and o.dt = c.dt), 0) f_ret
 from cal c cross join (values ('MKT'), ('SIZE'), ('BOND'), ('GONE')) f(factor))"""
S["factor_series"] = Q.with_(Q.base() + [FACTOR_CTE], Q.final("fs", ["universe", "dt", "factor"], ["f_ret"]))
S["contract_codes"] = """select prefix || lpad(cast(y % 100 as varchar), 2, '0') || lpad(cast(m as varchar), 2, '0') || '.XCH' contract,
 y * 100 + m ym, (y % 100) * 100 + m yymm from (select distinct upper(substr(p_type, 1, 2)) prefix from part)
 cross join range(1995, 2002) a(y) cross join range(1, 13) b(m)"""
