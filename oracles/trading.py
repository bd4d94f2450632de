from __future__ import annotations

from oracles import sql as Q

S: dict[str, str] = {}

FILLS = """fi as (select o_custkey acct, p_type asset, cast(l_shipdate as date) dt, l_orderkey * 100 + l_linenumber line_no, l_partkey part,
 case when l_returnflag = 'R' then 'SELL' else 'BUY' end side, cast(l_quantity * 100 as bigint) shares, l_extendedprice / l_quantity / 100 price
 from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey)"""
BOOK = Q.prices() + [FILLS, "pr as (select asset, arg_max(close, dt) / 100 price from px group by 1)",
    "cu as (select c_custkey acct, c_acctbal + 1000 cash from customer where c_acctbal + 1000 > 0)",
    "p0 as (select acct, asset, sum(case side when 'BUY' then shares else -shares end) shares from fi group by 1, 2 having sum(case side when 'BUY' then shares else -shares end) > 0)",
    "po as (select p0.* from p0 join cu using (acct))",
    "ac as (select cu.acct, cash, cash + coalesce(mv, 0) total from cu left join (select acct, sum(shares * price) mv from po join pr using (asset) group by 1) using (acct))",
    """tg as (select acct, asset, weight from ac cross join (values ('ECONOMY', 0.30::double), ('MEDIUM', 0.25::double), ('PROMO', 0.10::double), ('SMALL', 0.15::double),
 ('STANDARD', 0.15::double), ('GHOST', 0.05::double)) m(asset, weight))"""]
S["account_value"] = Q.with_(BOOK, "select acct, round(cash, 6) + 0.0 cash, round(least(total, 2000000), 6) + 0.0 total from ac")
ORD = ["""ob as (select acct, asset, coalesce(po.shares, 0) held, coalesce(pr.price, 0) price, ac.total, case when pr.price > 0 and tg.weight is not null
 then cast(floor(ac.total * tg.weight / pr.price / 100 + 0.5) * 100 as bigint) else 0 end want from tg full join po using (acct, asset) left join pr using (asset) join ac using (acct))""",
       """od as (select *, case when want < held then 'SELL' else 'BUY' end side, abs(want - held) shares, abs(want - held) * price notional from ob where want <> held
 and not (held > 0 and want > 0 and price > 0 and abs(want - held) * price < 0.05 * total) and not (asset = 'PROMO' and want > held) and not (asset = 'LARGE' and want < held))"""]
S["orders"] = Q.with_(BOOK + ORD, """select acct, asset, side, shares, row_number() over (partition by acct order by side desc, case side when 'BUY' then -notional else 0 end, asset) seq from od""")
CAP = ["bu as (select *, row_number() over (partition by acct order by -notional, asset) k from od where side = 'BUY' and price > 0)",
       """ca as (select ac.acct, total - coalesce((select sum(shares * price) from po join pr using (asset) where po.acct = ac.acct), 0)
 + coalesce((select sum(notional * (1 - 0.0005)) from od where side = 'SELL' and od.acct = ac.acct), 0) cash from ac)""",
       """fo as (select acct, cast(0 as bigint) k, cash::double cash, cast(0 as bigint) got from ca union all
 select f.acct, b.k, cast(f.cash - n * b.price * 1.0005 as double), n from fo f join (select * from bu) b on b.acct = f.acct and b.k = f.k + 1,
 lateral (select least(b.shares, cast(greatest(floor(f.cash / (b.price * (1 + 0.0005) * 100)) * 100, 0) as bigint)) n))"""]
S["orders_cash_cap"] = Q.with_(BOOK + ORD + CAP, """select b.acct, b.asset, b.side, b.shares, f.got filled, f.got < b.shares cut from bu b join fo f using (acct, k)
 union all select acct, asset, side, shares, shares, false from od where side = 'SELL'""")
REC = ["tw as (select * from tg union all select acct, '__cash__', greatest(1 - sum(weight), 0) from tg group by acct)",
       "aw0 as (select acct, asset, shares * price / total weight from po join pr using (asset) join ac using (acct))",
       "aw as (select * from aw0 union all select acct, '__cash__', greatest(1 - coalesce(sum(weight), 0), 0) from ac left join aw0 using (acct) group by acct)",
       "re as (select acct, asset, coalesce(tw.weight, 0) target, coalesce(aw.weight, 0) actual, coalesce(aw.weight, 0) - coalesce(tw.weight, 0) deviation from tw full join aw using (acct, asset))",
       "rf as (select *, abs(deviation) >= 0.10 flagged from re)"]
S["reconcile"] = Q.with_(BOOK + REC, Q.final("rf", ["acct", "asset", "flagged"], ["target", "actual", "deviation"]))
S["month_done"] = Q.with_(BOOK + REC, """select acct, round(max(abs(deviation)), 6) max_deviation, count(*) filter (flagged) n_flagged, arg_max(asset, (abs(deviation), asset)) worst_asset, max(abs(deviation)) < 0.45 "done" from rf group by 1""")
S["price_drift"] = """with c as (select l_partkey asset, arg_max(l_extendedprice / l_quantity, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_extendedprice, 'e': l_quantity}) close
 from lineitem where l_quantity > 0 group by 1),
 d as (select c.asset, c.close, coalesce(p_retailprice, c.close) price from c left join part p on p_partkey = c.asset)
 select asset, round(price, 6) price, round((price - close) / close, 6) + 0.0 drift, abs((price - close) / close) >= 0.0005 acts from d where close <> 0"""
LED = [FILLS, """fn as (select *, case side when 'BUY' then shares else -shares end delta, row_number() over (partition by acct, asset order by dt, line_no, part, shares, price, side) k
 from fi where price > 0 and shares > 0)""",
       """pa as (select acct, asset, k, dt, cast(0 as bigint) bef, greatest(delta, 0) aft, delta, price, line_no, part, side, shares from fn where k = 1 union all
 select n.acct, n.asset, n.k, n.dt, p.aft, greatest(p.aft + n.delta, 0), n.delta, n.price, n.line_no, n.part, n.side, n.shares from pa p join fn n on n.acct = p.acct and n.asset = p.asset and n.k = p.k + 1)""",
       """bo as (select *, case when delta > 0 then -(aft - bef) * price * (1 + 0.0005) * (1 + 0.00025) else (bef - aft) * price * (1 - 0.0005) * (1 - 0.00025) end cash_flow from pa)"""]
S["ledger"] = Q.with_(LED, "select acct, asset, dt, line_no, part, side, shares, bef as before, aft as after, round(cash_flow, 3) + 0.0 cash_flow from bo")
S["ledger_balances"] = Q.with_(LED, """select c_custkey acct, round(10000000 + coalesce(f, 0), 2) cash, coalesce(n_positions, 0) n_positions, coalesce(sh, 0) shares from customer
 left join (select acct, sum(cash_flow) f from bo group by 1) x on x.acct = c_custkey
 left join (select acct, count(*) n_positions, cast(sum(aft) as bigint) sh from (select acct, asset, arg_max(aft, k) aft from bo group by 1, 2) where aft > 0 group by 1) y on y.acct = c_custkey""")
S["fill_check"] = """with o as (select user_id acct, cast(sum(ceil(value)) as bigint) ordered from events where event_type = 'purchase' group by 1),
 f as (select user_id acct, cast(sum(ceil(value * 2)) as bigint) filled from events where event_type = 'click' and ts >= timestamp '2024-01-05' group by 1)
 select acct, 'EV' asset, ordered, coalesce(filled, 0) filled, coalesce(filled, 0) >= ordered complete from o left join f using (acct)"""
S["fill_stream"] = """with o as (select event_id order_id, user_id acct, ts, cast(ceil(value) as bigint) ordered from events where event_type = 'purchase'),
 f as (select user_id acct, ts, cast(ceil(value * 2) as bigint) shares from events where event_type = 'click')
 select order_id, o.acct, ordered, cast(coalesce(sum(shares), 0) as bigint) filled, coalesce(sum(shares), 0) >= ordered complete
 from o left join f on f.acct = o.acct and f.ts between o.ts and o.ts + interval 2 hour group by 1, 2, 3"""
S["fill_stream_joined"] = S["fill_stream"]
S["drift_stream"] = """with l as (select user_id asset, arg_max(value, (ts, value)) as quote, avg(value) as close from events group by 1)
 select asset, round(close, 6) as close, round(quote, 6) as quote, round((quote - close) / close, 6) + 0.0 drift from l where abs((quote - close) / close) >= 0.0005"""
