import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfolio.operators import tradeops as O
from panelfolio.params import COMMISSION, SLIPPAGE
from panelfolio.queries import trading as Q
from panelfolio.streaming import monitors as SM

T, POS, PX, ACC = "acct string, asset string, weight double", "acct string, asset string, shares long", "asset string, price double", "acct string, total double"


def frames(spark, weights, positions, prices, total):
    return (spark.createDataFrame([("x", a, w) for a, w in weights.items()], T), spark.createDataFrame([("x", a, s) for a, s in positions.items()], POS),
            spark.createDataFrame(list(prices.items()), PX), spark.createDataFrame([("x", float(total))], ACC))


def test_lots_round_half_up(spark):
    f = frames(spark, {"a": 0.5}, {}, {"a": 4.0}, 10000)
    assert O.build_orders(*f).first().shares == 1300


def test_band_and_blocked_sides(spark):
    f = frames(spark, {"a": 0.5, "b": 0.2, "c": 0.2}, {"a": 4900, "d": 300}, {"a": 10.0, "b": 10.0, "c": 10.0, "d": 10.0}, 100000)
    flags = spark.createDataFrame([("b", True, False), ("d", False, True)], "asset string, cant_buy boolean, cant_sell boolean")
    assert {(r.asset, r.side, r.shares) for r in O.build_orders(*f, flags=flags).collect()} == {("c", "BUY", 2000)}
    assert {r.asset for r in O.build_orders(*f).collect()} == {"b", "c", "d"}


def test_cash_cap_never_overspends(spark):
    px = {f"a{i}": 76.15 for i in range(5)}
    f = frames(spark, {a: 0.198 for a in px}, {}, px, 100000)
    out = O.cash_cap(O.build_orders(*f), f[1], f[2], f[3]).collect()
    assert sum(r.filled * 76.15 * (1 + SLIPPAGE) for r in out) <= 100000 and any(r.cut for r in out)
    assert len(out) == 5 and all(r.filled % 100 == 0 for r in out)


def test_reconcile_and_month_done(spark):
    near = frames(spark, {"a": 0.6, "b": 0.39}, {"a": 6000, "b": 4000}, {"a": 10.0, "b": 9.7}, 100000)
    far = frames(spark, {"a": 0.6, "b": 0.39}, {"a": 6000, "b": 2000}, {"a": 10.0, "b": 9.7}, 100000)
    assert O.max_deviation(O.reconcile(*near)).first().max_deviation < 0.05
    r = O.reconcile(*far)
    assert O.max_deviation(r).first().max_deviation > 0.10
    assert O.month_done(r, "2024-01").count() == 0 and O.month_done(O.reconcile(*near), "2024-01").count() == 1


def test_ledger_matches_a_sequential_book(spark):
    """One account holds most fills; its scan still equals the one-by-one book."""
    rng = np.random.default_rng(2)
    data = []
    for i in range(600):
        acct = "hot" if rng.random() < 0.7 else f"c{rng.integers(5)}"
        data.append((acct, f"s{rng.integers(2)}", dt.date(2024, 1, 1) + dt.timedelta(int(rng.integers(200))), i,
                     "SELL" if rng.random() < 0.55 else "BUY", int(rng.integers(-1, 6)) * 100, float(rng.choice([0.0, 9.5, 10.25]))))
    df = spark.createDataFrame(data, "acct string, asset string, dt date, fill_no long, side string, shares long, price double")
    booked = O.ledger(df)
    cash, held = O.balances(booked, spark.createDataFrame([(a, 1e6) for a in ["hot"] + [f"c{i}" for i in range(5)]], "acct string, cash double"))
    pos, money = {}, {a: 1e6 for a in ["hot"] + [f"c{i}" for i in range(5)]}
    for acct, asset, d, n, side, sh, px in sorted(data, key=lambda r: (r[2], r[3])):
        if px <= 0 or sh <= 0:
            continue
        have = pos.get((acct, asset), 0)
        if side == "BUY":
            money[acct] -= sh * px * (1 + SLIPPAGE) * (1 + COMMISSION)
            pos[(acct, asset)] = have + sh
        else:
            sold = min(sh, have)
            money[acct] += sold * px * (1 - SLIPPAGE) * (1 - COMMISSION)
            pos[(acct, asset)] = have - sold
    assert {(r.acct, r.asset): r.shares for r in held.collect()} == {k: v for k, v in pos.items() if v > 0}
    got = {r.acct: r.cash for r in cash.collect()}
    assert all(abs(got[a] - money[a]) < 1e-4 for a in money)


def test_price_drift_falls_back_to_the_close(spark):
    closes = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 10.0)], "asset string, close double")
    quotes = spark.createDataFrame([("a", 10.004), ("b", 10.2)], "asset string, quote double")
    assert [r.asset for r in O.price_drift(quotes, closes).collect()] == ["b"]


def test_fill_completeness_filters_tag_and_time(spark):
    orders = spark.createDataFrame([("x", "a", 500), ("x", "b", 100)], POS)
    t = lambda h: dt.datetime(2024, 1, 1, h)
    fills = spark.createDataFrame([("x", "a", t(10), "rot", 300), ("x", "a", t(11), "rot", 200), ("x", "b", t(8), "rot", 100), ("x", "b", t(11), "other", 100)],
                                  "acct string, asset string, ts timestamp, tag string, shares long")
    got = {r.asset: (r.filled, r.complete) for r in O.fill_completeness(orders, fills, "rot", "2024-01-01 09:00:00").collect()}
    assert got == {"a": (500, True), "b": (0, False)}


def test_drift_monitor_keeps_the_latest_over_restarts(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "asset string, quote double, ts timestamp"
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = ([("a", 10.0, at(1)), ("a", 11.0, at(3)), ("b", 5.0, at(1))], [("a", 9.0, at(2)), ("b", 6.0, at(5)), ("b", 5.5, at(5))], [], [("c", 1.0, at(0))])
    for batch in batches:  # the third start finds no new data
        if batch:
            spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        SM.drift_monitor(spark.readStream.schema(schema).parquet(src), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    latest = SM.latest_quotes(spark, str(tmp_path / "state"))
    assert {(r.asset, r.quote) for r in latest.collect()} == {("a", 11.0), ("b", 6.0), ("c", 1.0)}
    held = list((tmp_path / "state" / "data").glob("version=*/bucket=*"))
    assert len(held) <= 5 and {p.parent.name for p in held} == {"version=1", "version=2"}  # what batch 1 replaced is gone
    closes = spark.createDataFrame([("a", 11.0), ("b", 5.0)], "asset string, close double")
    assert [r.asset for r in SM.drift_alerts(latest, closes).collect()] == ["b"]


def test_unfilled_orders_stream(spark, tmp_path):
    o, f = str(tmp_path / "o"), str(tmp_path / "f")
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    os_, fs = "order_id long, acct long, ts timestamp, shares long", "acct long, ts timestamp, shares long"
    spark.createDataFrame([(1, 7, at(0), 100), (2, 8, at(0), 100), (3, 7, at(5000), 1)], os_).write.parquet(o)
    spark.createDataFrame([(7, at(10), 60), (7, at(20), 40), (8, at(45), 100), (9, at(5000), 1)], fs).write.parquet(f)
    m = SM.unfilled_orders(spark.readStream.schema(os_).parquet(o), spark.readStream.schema(fs).parquet(f))
    SM.run_to_table(m, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.order_id: (r.filled, r.complete) for r in SM.completeness(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got[1] == (100, True) and got[2] == (0, False) and 3 not in got  # still waiting
    whole = SM.completeness(SM.with_waiting(spark.read.parquet(str(tmp_path / "out")), spark.read.parquet(o)))
    assert {r.order_id: (r.filled, r.complete) for r in whole.collect()} == {1: (100, True), 2: (0, False), 3: (0, False)}


@pytest.fixture()
def unbroadcast(spark):
    """Joins as on tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def order_tables(spark, path) -> str:
    """Two accounts; every order has two lines of one number, one of them returned; no stock of account 2 is left."""
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(k)
    lines = [(k, 1 + k % 2, 1, 10.0, 5000.0, "N", day(k)) for k in range(6)] + [(k, 1 + k % 2, 1, 4.0 if k < 3 else 20.0, 2000.0, "R", day(k)) for k in range(6)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, 1 if k < 3 else 2) for k in range(6)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(1, "SMALL"), (2, "LARGE")], "p_partkey long, p_type string").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(1, 100.0), (2, 50.0), (3, -2000.0)], "c_custkey long, c_acctbal double").write.parquet(f"{path}/customer.parquet")
    return str(path)


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_fills_meet_orders_without_sorting_lines(spark, tmp_path, unbroadcast):
    sf = order_tables(spark, tmp_path)
    found = plan(Q.fills(spark, sf).select("acct", "asset", "shares"))
    assert found.count("ShuffledHashJoin") == 1 and "l_orderkey" not in "".join(x for x in found.split("\n") if " Sort " in x)
    assert {(r.acct, r.asset, r.shares) for r in Q.book(spark, sf)[1].collect()} == {(1, "SMALL", 1200), (1, "LARGE", 600)}


def test_month_done_over_small_tables(spark, tmp_path, unbroadcast):
    """Account 1 holds more than its model in LARGE, account 2 nothing but cash, account 3 has no value."""
    got = {r.acct: r for r in Q.month_done(spark, order_tables(spark, tmp_path)).collect()}
    prices = {"SMALL": 5200 / 1000, "LARGE": 0.0}
    assert set(got) == {1, 2} and got[2].worst_asset == "__cash__" and got[2].max_deviation == 1.0 and not got[2].done
    rows = Q.reconcile(spark, str(tmp_path)).collect()
    for a in got:
        worst = max((abs(r.deviation), r.asset) for r in rows if r.acct == a)
        assert (got[a].max_deviation, got[a].worst_asset) == worst and got[a].n_flagged == sum(r.flagged for r in rows if r.acct == a)


def test_month_done_joins_weights_once(spark, tmp_path, unbroadcast):
    """Summary and gate read staged deviations; neither computes the full join of targets and positions again."""
    df = Q.month_done(spark, order_tables(spark, tmp_path))
    assert "FullOuter" not in plan(df) and all("/deviations-" in f for f in df.inputFiles())


def dealt(found: str) -> list[str]:
    """Exchanges of fills to chunks."""
    return [x for x in found.split("\n") if "Exchange hashpartitioning(" in x and "_c#" in x and "ReusedExchange" not in x]


def test_ledger_deals_fills_once(spark, tmp_path, unbroadcast):
    """One exchange of fills and one of totals; the second reader of the fills reuses the first."""
    found = plan(Q.ledger(spark, order_tables(spark, tmp_path)))
    assert len(dealt(found)) == 2 and "ReusedExchange" in found


def test_ledger_sorts_fills_once_a_reader(spark, tmp_path, unbroadcast):
    """Chunk totals are the last fills of sorted chunks, so nothing is hashed, and no sort follows the join of the totals."""
    found = plan(Q.ledger(spark, order_tables(spark, tmp_path)))
    assert "HashAggregate" not in found and sum(" Sort [" in x and "line_no#" in x for x in found.split("\n")) == 2


def test_ledger_of_one_chunk_and_of_many_agree(spark):
    """Chunks of one fill and one chunk of all; equal fills, fills of one day and sales of nothing."""
    rng = np.random.default_rng(7)
    data = [("x", "st"[i % 2], dt.date(2020, 1, 1) + dt.timedelta(int(rng.integers(400))), int(rng.integers(4)), "SELL" if rng.random() < 0.6 else "BUY", int(rng.integers(1, 4)), 10.0)
            for i in range(120)]
    df = spark.createDataFrame(data + data[:10], "acct string, asset string, dt date, line long, side string, shares long, price double")
    paths = [sorted(tuple(r) for r in O.ledger(df, chunk, ("line", "shares", "side")).select("asset", "dt", "line", "side", "shares", "before", "after").collect())
             for chunk in ("week", "month", "year")]
    assert paths[0] == paths[1] == paths[2] and len(paths[0]) == 130
    by_hand, have = [], {}
    for r in sorted(data + data[:10], key=lambda r: (r[1], r[2], r[3], r[5], r[4])):
        before = have.get(r[1], 0)
        have[r[1]] = max(before + (r[5] if r[4] == "BUY" else -r[5]), 0)
        by_hand.append((*r[1:6], before, have[r[1]]))
    assert paths[0] == sorted(by_hand)


def test_ledger_orders_by_columns_and_keeps_undated_fills_first(spark):
    data = [("x", "s", None, 1, 1, "BUY", 300, 10.0), ("x", "s", dt.date(2024, 1, 5), 1, 2, "SELL", 200, 10.0), ("x", "s", dt.date(2024, 1, 5), 1, 1, "BUY", 50, 10.0),
            ("x", "s", dt.date(2024, 3, 5), 2, 1, "SELL", 500, 10.0), (None, "s", dt.date(2024, 1, 5), 1, 1, "BUY", 7, 10.0)]
    booked = O.ledger(spark.createDataFrame(data, "acct string, asset string, dt date, line long, part long, side string, shares long, price double"), order=("line", "part"))
    assert sorted((r.dt, r.part, r.before, r.after) for r in booked.collect()) == [
        (dt.date(2024, 1, 5), 1, 300, 350), (dt.date(2024, 1, 5), 2, 350, 150), (dt.date(2024, 3, 5), 1, 150, 0)]


def test_balances_stage_one_row_a_line(spark):
    booked = spark.createDataFrame([("x", "s", dt.date(2024, 1, d), d, 10 * d, 1.0) for d in (1, 2, 3)] + [("x", "t", dt.date(2024, 1, 1), 1, 0, 2.0)],
                                   "acct string, asset string, dt date, fill_no long, after long, cash_flow double")
    cash, held = O.balances(booked, spark.createDataFrame([("x", 1.0), ("y", 1.0)], "acct string, cash double"))
    assert {(r.acct, r.cash) for r in cash.collect()} == {("x", 6.0), ("y", 1.0)}
    assert [tuple(r) for r in held.collect()] == [("x", "s", 30)] and held.inputFiles() == cash.inputFiles() and "fill_no" not in plan(held)
