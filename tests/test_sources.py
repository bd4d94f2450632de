import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelfolio.operators import panel as P
from panelfolio.sources import config, files, futures, merge, sinks, vendor

PRICES = "universe string, asset string, dt date, close double"
D = [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]


def px(spark, rows):
    return spark.createDataFrame([("u", a, d, float(c)) for a, d, c in rows], PRICES)


def test_vendor_payload(spark, tmp_path):
    path = tmp_path / "p.json"
    docs = [{"universe": "u", "asset": "a", "fields": ["trade_date", "close"], "items": [["20240103", "11"], ["20240102", "10"]]},
            {"universe": "u", "asset": "b", "fields": ["close", "pre_close", "trade_date"], "items": [["5.5", "5", "20240102"], ["bad", "5", "20240103"]]}]
    path.write_text("\n".join(json.dumps(d) for d in docs))
    got = {(r.asset, r.dt): (r.close, r.pre_close) for r in vendor.read_vendor_json(spark, str(path)).collect()}
    assert got == {("a", D[0]): (10.0, None), ("a", D[1]): (11.0, 10.0), ("b", D[0]): (5.5, 5.0), ("b", D[1]): (None, 5.0)}


def test_price_csv_headers_vary(spark, tmp_path):
    (tmp_path / "SPY.csv").write_text("Date,Open,Adj Close\n2024-01-02,1,10\n2024-01-03,1,11\n")
    (tmp_path / "TLT.csv").write_text("CLOSE,date\n90,2024-01-02\n")
    (tmp_path / "BAD.csv").write_text("when,price\n2024-01-02,1\n")
    got = {(r.asset, r.dt, r.close) for r in files.read_price_csv(spark, str(tmp_path), "us").collect()}
    assert got == {("SPY", D[0], 10.0), ("SPY", D[1], 11.0), ("TLT", D[0], 90.0)}


def test_localized_bars(spark, tmp_path):
    p = tmp_path / "bars.csv"
    p.write_text("日期,开盘,收盘,最高,最低,成交量\n2024-01-02,1,2,3,0.5,100\n2024-01-03,1,,3,0.5,100\n", encoding="utf-8")
    got = files.read_bars_localized(spark, str(p)).collect()
    assert len(got) == 1 and (got[0].asset, got[0].open, got[0].close, got[0].high, got[0].low) == ("bars", 1.0, 2.0, 3.0, 0.5)


def test_localized_bars_are_mapped_by_their_own_headers(spark, tmp_path):
    (tmp_path / "A.csv").write_text("日期,开盘,收盘,最高,最低,成交量\n2024-01-02,1,2,3,0.5,100\n", encoding="utf-8")
    (tmp_path / "B.csv").write_text("x,成交量,最低,最高,收盘,开盘,日期\n\"a,b\",200,0.4,4,3,2,2024-01-03\n", encoding="utf-8")
    (tmp_path / "C.csv").write_text("日期,开盘,收盘\n2024-01-02,1,2\n", encoding="utf-8")
    got = {r.asset: (r.open, r.close, r.high, r.low, r.volume) for r in files.read_bars_localized(spark, str(tmp_path)).collect()}
    assert got == {"A": (1.0, 2.0, 3.0, 0.5, 100.0), "B": (2.0, 3.0, 4.0, 0.4, 200.0)}


def test_contracts_and_settles(spark, tmp_path):
    codes = futures.futures_contracts(spark.createDataFrame([("CU", "SHF")], "prefix string, exchange string"), 2023, 2024).collect()
    assert len(codes) == 24 and ("CU2401.SHF", 202401) in {(r.contract, r.ym) for r in codes}
    (tmp_path / "CU2402.SHF.csv").write_text("trade_date,settle\n20240102,70000\n20240103,\n")
    (tmp_path / "CU2401.SHF.csv").write_text("trade_date,settle\n20240102,70100\n")
    got = {(r.contract, r.product, r.ym, r.settle) for r in futures.read_settles(spark, str(tmp_path)).collect()}
    assert got == {("CU2402.SHF", "CU", 202402, 70000.0), ("CU2401.SHF", "CU", 202401, 70100.0)}


def test_switch_is_a_strict_boolean(spark):
    docs = ['{"hold_all": true}', '{"hold_all": false}', "{}", '{"hold_all": "false"}', '{"hold_all": 0}', '{"hold_all": "yes"}', "broken"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string")
    got = [r.v for r in df.select("i", config.strict_flag(F.col("doc"), "hold_all", True).alias("v")).orderBy("i").collect()]
    assert got == [True, False, True, True, True, True, True]


def test_coalesce_sources(spark):
    primary = px(spark, [("a", D[0], 1), ("x", D[0], 2)])
    backup = px(spark, [("a", D[0], 9), ("b", D[0], 3), ("x", D[0], 8)])
    got = {(r.asset, r.close) for r in merge.coalesce_sources(primary, backup, ["a", "b"]).collect()}
    assert got == {("a", 1.0), ("x", 2.0), ("b", 3.0)}
    got = {(r.asset, r.close) for r in merge.coalesce_sources(primary, backup, ["a", "gone"]).collect()}
    assert got == {("a", 9.0), ("b", 3.0), ("x", 8.0)}


def test_later_source_wins_and_required_symbols(spark):
    first, second = px(spark, [("a", D[0], 1), ("a", D[1], 2), ("b", D[0], 3)]), px(spark, [("a", D[0], 7)])
    out = merge.merge_sources([first, second])
    assert {(r.asset, r.close) for r in out.collect()} == {("a", 7.0), ("b", 3.0)}
    assert merge.require_symbols(out, ["a", "b"]) is out
    with pytest.raises(ValueError, match="u/c"):
        merge.require_symbols(out, ["a", "c"])
    got = {(r.asset, r.close) for r in merge.top_up(first, px(spark, [("a", D[0], 50), ("c", D[0], 4)]), 0).collect()}
    assert got == {("a", 2.0), ("b", 3.0), ("c", 4.0)}


def test_backup_preclose(spark):
    got = [r.pre_close for r in P.derive_preclose(px(spark, [("a", D[0], 1), ("a", D[1], 2)])).orderBy("dt").collect()]
    assert got == [None, 1.0]


def test_sinks_round_trip(spark, tmp_path):
    rep = spark.createDataFrame([("u", "r1", 1.5), ("u", "r2", 2.5)], "universe string, run_id string, sharpe double")
    sinks.write_report(rep, str(tmp_path / "rep"))
    assert spark.read.parquet(str(tmp_path / "rep")).filter("run_id = 'r2'").first().sharpe == 2.5
    rolled = spark.createDataFrame([("u", "r", D[0], 1.0, 0.0, None)], "universe string, run_id string, dt date, nav double, underwater double, roll_sharpe double")
    sinks.write_curves(rolled, str(tmp_path / "curves"))
    assert {r.curve for r in spark.read.parquet(str(tmp_path / "curves")).collect()} == {"nav", "underwater"}
    state = spark.createDataFrame([("x", D[0], 5.0, {"a": 100}), ("x", D[1], 7.0, {"a": 0, "b": 200})], sinks.STATE_SCHEMA)
    sinks.write_account_state(state, str(tmp_path / "state"))
    cash, held = sinks.read_account_state(spark, str(tmp_path / "state"))
    assert cash.first().cash == 7.0 and [(r.asset, r.shares) for r in held.collect()] == [("b", 200)]


def test_month_gate(spark):
    days = spark.createDataFrame([("x", D[0]), ("y", D[0])], "acct string, dt date")
    done = spark.createDataFrame([("x", "2024-01")], "acct string, month string")
    assert [r.acct for r in sinks.month_gate(days, done).collect()] == ["y"]


def test_price_csv_of_any_width(spark, tmp_path):
    filler = ",".join(f"c{i}" for i in range(40))
    (tmp_path / "WIDE.csv").write_text(f"{filler},Date,Close\n" + '"x,""y"""' + ",0" * 39 + ",2024-01-02,7.5\n")
    (tmp_path / "SLIM.csv").write_text("date,close\r\n2024-01-02,1\r\n")
    got = {(r.asset, r.dt, r.close) for r in files.read_price_csv(spark, str(tmp_path), "us").collect()}
    assert got == {("WIDE", D[0], 7.5), ("SLIM", D[0], 1.0)}


def test_months_close_once_whatever_is_replayed(spark, tmp_path):
    from panelfolio.sources import sinks
    control = str(tmp_path / "control")
    done = lambda *rows: spark.createDataFrame(list(rows), "acct long, month string")
    closed = lambda: sorted((r.acct, r.month, r.attempt) for r in sinks.closed_months(spark, control).collect())
    sinks.close_months(done((1, "2024-01"), (1, "2024-01"), (2, "2024-01")), control, "a")
    first = closed()
    sinks.close_months(done((1, "2024-01"), (2, "2024-01")), control, "a")
    assert closed() == first == [(1, "2024-01", "a"), (2, "2024-01", "a")]
    sinks.close_months(done((1, "2024-01"), (1, "2024-02")), control, "b")
    want = [(1, "2024-01", "a"), (1, "2024-02", "b"), (2, "2024-01", "a")]
    assert closed() == want
    days = spark.sql("select 1L as acct, date '2024-02-03' as dt union all select 1L, date '2024-03-01'")
    for _ in range(2):  # what is left to close comes from the gate, which sees the first try of the same attempt
        sinks.close_months(sinks.month_gate(days, sinks.closed_months(spark, control)).select("acct", "month"), control, "c")
        assert closed() == sorted([*want, (1, "2024-03", "c")])
