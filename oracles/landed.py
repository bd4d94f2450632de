from __future__ import annotations

from oracles import sql as Q
from oracles.portfolios import FULL, TG, U, UR, all_targets
from oracles.signals import REG, TSM, timing, zscore
from oracles.validation import BOOT, bootstrap
from panelfolio import testpanel as T
from panelfolio.queries.landed import RISK

PX = Q.prices()
S: dict[str, str] = {}
S["vendor_files"] = Q.with_(PX + ["l as (select *, lag(close) over (partition by universe, asset order by dt) before, lag(dt) over (partition by universe, asset order by dt) bd from px)",
    "v as (select *, case when date_trunc('quarter', dt) <> date_trunc('quarter', bd) then before * 0.8 else before end pre_close from l)"],
    Q.final("v", ["universe", "asset", "dt"], ["close", "pre_close"]))
S["price_csv_files"] = Q.with_(PX, Q.final("px", ["universe", "asset", "dt"], ["close"]))
S["localized_bar_files"] = Q.with_(PX, "select asset, dt, round(low, 8) as open, round(close, 8) as close, round(high, 8) as high, round(low, 8) as low, cast(volume as double) as volume from px "
                                   "where day(dt) % 7 <> 0")
S["settle_files"] = Q.with_(PX + ["""c as (select substr(asset, 1, 2) as product, strftime(dt + interval 1 month, '%y%m') as ym4, dt, close as settle from px)"""],
    "select product || ym4 || '.SHF' as contract, product, cast(200000 + cast(ym4 as int) as int) as ym, dt, round(settle, 6) + 0.0 as settle from c")
S["report_files"] = Q.with_(PX, "select universe, asset as run_id, count(*) as days, round(avg(close), 6) + 0.0 as mean_close from px group by 1, 2")
S["curve_files"] = Q.with_(PX + ["n as (select universe, asset run_id, dt, close / first_value(close) over w nav from px window w as (partition by universe, asset order by dt))",
    "u as (select *, nav / max(nav) over w - 1 underwater, nav / lag(nav) over w - 1 ret from n window w as (partition by universe, run_id order by dt rows unbounded preceding))",
    "r as (select *, case when count(ret) over w = 20 then avg(ret) over w end roll_sharpe from u window w as (partition by universe, run_id order by dt rows 19 preceding))",
    """l as (select universe, run_id, dt, 'nav' curve, nav as value from r union all select universe, run_id, dt, 'underwater', underwater from r
 union all select universe, run_id, dt, 'roll_sharpe', roll_sharpe from r where roll_sharpe is not null)"""], Q.final("l", ["universe", "run_id", "dt", "curve"], ["value"]))
S["account_state_files"] = """with g as (select cast(o_custkey as varchar) acct, year(o_orderdate) y, l_returnflag asset,
 cast(sum(case when l_linestatus = 'O' then l_quantity else 0 end) as bigint) shares, sum(cast(round(l_extendedprice * 100) as bigint)) cents
 from orders join lineitem on o_orderkey = l_orderkey group by 1, 2, 3),
 last as (select acct, max(y) y from g group by 1),
 cash as (select acct, y, round(sum(cents) / 100.0, 2) cash from g group by 1, 2)
 select l.acct, make_date(l.y, 12, 31) as as_of, c.cash, g.asset, coalesce(g.shares, 0) as shares from last l join cash c on c.acct = l.acct and c.y = l.y
 left join g on g.acct = l.acct and g.y = l.y and g.shares > 0"""
S["python_strategy"] = Q.with_(Q.base() + [f"""m as (select universe, asset, dt, close, avg(close) over (partition by universe, asset order by dt rows unbounded preceding) past
 from obs where asset in ({', '.join(f"'{a}'" for a in T.TYPES.pool)}))""",
    "e as (select universe, reb_no, dt from cal where is_month_end and row_no >= 126)",
    """h as (select e.universe, e.reb_no, m.asset from e cross join (select distinct asset from m) a asof join m on m.universe = e.universe and m.asset = a.asset and e.dt >= m.dt where m.close > m.past)"""],
    "select universe, 'python' as run_id, reb_no, asset, round(1.0 / count(*) over (partition by universe, reb_no), 6) as weight from h")
FLAT = [PX[0], PX[1].replace("px as (", "px_raw as (", 1),
        "px as (select * replace (case when asset = 'SMALL' and dt >= date '1997-01-01' then 100.0 else close end as close) from px_raw)"]
S["suspended_asset"] = Q.with_(FLAT + Q.panel() + all_targets(RISK), Q.final("tgs", TG, ["weight"]))
CANDIDATES = Q.base() + Q.runs([FULL], U, name="base_r") + [TSM, REG,
    "s2 as (select universe, asset, dt, close, case when n >= 201 and mom > 0 and close > ma then 1.0 else 0.0 end sig from ts where asset = 'STANDARD')"] + timing("s2", "t2", 200) + zscore(
    "zscore", False) + Q.hold_asset([("ECONOMY", 0.6), ("STANDARD", 0.4)], "60_40", "bh") + [
    """ca as (select universe, 'bond' run_id, dt, net from t2 union all select universe, 'zscore', dt, net from zrzscore where row_no >= 19 union all select universe, run_id, dt, net from bh)"""]
S["candidate_regimes"] = Q.with_(CANDIDATES + ["rr as (select ca.*, regime from ca join rg using (universe, dt))"] + Q.perf("rr", "universe, run_id, regime") + [
    "rc as (select universe, run_id, regime, count(*) n_days, count(*) / sum(count(*)) over (partition by universe, run_id) as share from rr group by 1, 2, 3)",
    "ro as (select * from pf join rc using (universe, run_id, regime))"], Q.final("ro", UR + ["regime", "n_days"], Q.PERF + ["share"]))
S["candidate_bootstrap"] = Q.with_(CANDIDATES + ["rets as (select universe, run_id, dt, net from ca union all select universe, run_id, dt, net from base_r)"]
                                   + bootstrap([(c, FULL.run_id) for c in ("bond", "zscore", "60_40")]), BOOT)
S["month_close"] = """with o as (select o_custkey acct, cast(o_orderdate as date) dt, strftime(o_orderdate, '%Y-%m') "month", o_orderstatus from orders)
 select acct, dt, "month" from o where "month" >= '1997-01' and not exists (select 1 from o d where d.o_orderstatus = 'F' and d.acct = o.acct and d."month" = o."month")"""
