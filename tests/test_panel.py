import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import long_prices, make_panel, random_walk
from pyspark.sql import functions as F

from panelfolio.functions import scalars as S
from panelfolio.operators import panel as P
from panelfolio.operators import signals as G

D = [dt.date(2024, 1, d) for d in (2, 3, 4, 5, 8)]


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_adjusted_price_has_no_ex_date_jump(spark):
    close, pre = [10, 10, 8, 8.4, 8.82], [10, 10, 8, 8, 8.4]
    df = rows(spark, [("u", "a", d, float(c), float(p)) for d, c, p in zip(D, close, pre)], "universe string, asset string, dt date, close double, pre_close double")
    got = [r.adj_close for r in P.adjust_prices(df).orderBy("dt").collect()]
    assert np.allclose(got, [8, 8, 8, 8.4, 8.82])


def test_limit_flags_and_half_up_cents(spark):
    data = [("u", "a", D[0], 10.0, 10.0), ("u", "a", D[1], 11.0, 10.0), ("u", "a", D[2], 9.9, 11.0), ("u", "a", D[3], 1.04, 0.95), ("u", "a", D[4], 5.0, None)]
    df = rows(spark, data, "universe string, asset string, dt date, close double, pre_close double")
    got = P.limit_flags(P.with_limit_pct(df)).orderBy("dt").collect()
    assert [(r.cant_buy, r.cant_sell) for r in got] == [(False, False), (True, False), (False, True), (False, False), (False, False)]


def test_limit_pct_and_suffix(spark):
    codes = {"159915": 0.2, "588000": 0.2, "588050": 0.2, "510300": 0.1, "159941": 0.1, "513100": 0.1}
    df = rows(spark, [(c,) for c in codes], "asset string")
    got = {r.asset: (r.limit_pct, r.s) for r in P.with_limit_pct(df).withColumn("s", S.market_suffix(F.col("asset"))).collect()}
    assert {k: v[0] for k, v in got.items()} == codes
    assert got["159915"][1] == "159915.SZ" and got["510300"][1] == "510300.SH"


def test_bounded_fill_and_fill_that_reaches_past_the_anchor(spark):
    idx = pd.bdate_range("2024-01-01", periods=12)
    wide = pd.DataFrame({"a": [np.nan] * 3 + [1.0] * 9, "b": np.arange(12.0) + 1, "c": [5.0, 6, np.nan, np.nan, np.nan, np.nan, np.nan] + [7.0] * 5}, index=idx)
    df = spark.createDataFrame(long_prices(wide), "universe string, asset string, dt date, close double")
    for staged in (False, True):
        panel = P.prepare_panel(df, anchors=["a", "b"], staged=staged)
        got = panel.obs.toPandas().pivot(index="dt", columns="asset", values="close")
        want = wide.ffill(limit=3).iloc[3:]
        assert np.allclose(got.to_numpy(), want.to_numpy(), equal_nan=True)
        cal = panel.calendar.orderBy("dt").toPandas()
        assert list(cal.row_no) == list(range(9)) and set(cal.n_rows) == {9}


def test_empty_dates_before_or_after_the_fill(spark):
    data = [("u", "a", D[0], 1.0), ("u", "a", D[1], None), ("u", "a", D[2], None), ("u", "a", D[3], None), ("u", "a", D[4], None), ("u", "a", dt.date(2024, 1, 9), 2.0)]
    df = rows(spark, data, "universe string, asset string, dt date, close double")
    after = P.prepare_panel(df, drop_first=False).obs.count()
    before = P.prepare_panel(df, drop_first=True).obs.count()
    assert (after, before) == (5, 2)


def test_month_ends_and_as_of(spark):
    panel = make_panel(spark, random_walk(70, ["a"], start="2024-01-02"))
    ends = [r.signal_dt for r in P.month_end_calendar(panel.calendar).orderBy("reb_no").collect()]
    days = [r.dt for r in panel.calendar.orderBy("dt").collect()]
    assert ends == [max(d for d in days if (d.year, d.month) == (2024, m)) for m in (1, 2, 3, 4)]
    t = rows(spark, [("u", "x", dt.datetime(2024, 1, 6)), ("u", "y", dt.datetime(2024, 1, 8)), ("u", "z", dt.datetime(2020, 1, 1))],
             "universe string, target_id string, target_ts timestamp")
    got = {r.target_id: r.as_of_dt for r in P.as_of_dates(t, panel.calendar).collect()}
    assert got == {"x": dt.date(2024, 1, 5), "y": dt.date(2024, 1, 8), "z": None}


def test_month_end_flag_without_calendar_is_true(spark):
    cal = rows(spark, [("u", D[0]), ("u", D[4])], "universe string, dt date")
    days = rows(spark, [("u", D[0]), ("u", D[4]), ("v", D[0])], "universe string, dt date")
    got = {(r.universe, r.dt): r.is_month_end for r in P.is_month_end_trading_day(days, cal).collect()}
    assert got == {("u", D[0]): False, ("u", D[4]): True, ("v", D[0]): True}


def test_gap_policies(spark):
    idx = pd.bdate_range("2024-01-01", periods=5)
    panel = P.prepare_panel(spark.createDataFrame(long_prices(pd.DataFrame({"a": [1.0, 2, np.nan, 4, 8], "b": [1.0] * 5}, index=idx)),
                                                  "universe string, asset string, dt date, close double"), limit=0)
    pick = lambda p: [r.ret for r in P.daily_returns(panel, p).filter("asset = 'a'").orderBy("dt").collect()]
    assert pick("pad") == [0, 1, 1, 1] and pick("drop") == [0, 1, 0, 1]


def test_long_frames_match_direct_frames(spark):
    wide = random_walk(400, ["a", "b"])
    panel = make_panel(spark, wide)
    got = G.with_rolling(panel.obs, "close", 150, "m").toPandas().pivot(index="dt", columns="asset")
    assert np.allclose(got["m_mean"].to_numpy(), wide.rolling(150).mean().to_numpy(), equal_nan=True)
    assert np.allclose(got["m_std"].to_numpy(), wide.rolling(150).std().to_numpy(), rtol=1e-8, equal_nan=True)


def test_rolling_ols_degenerate_windows(spark):
    n = 20
    data = [("u", "a", dt.date(2024, 1, 1) + dt.timedelta(i), 2.0, float(i)) for i in range(n)] + [
        ("u", "b", dt.date(2024, 1, 1) + dt.timedelta(i), float(i), 3.0) for i in range(n)]
    df = rows(spark, data, "universe string, asset string, dt date, high double, low double")
    got = G.rolling_ols(df, 18).filter("slope is not null").collect()
    assert {r.asset for r in got} == {"a"} and all(abs(r.slope) < 1e-12 and r.r2 == 0 for r in got)


def test_term_structure_needs_two_contracts(spark):
    df = rows(spark, [("CU", D[0], 202402, 10.0), ("CU", D[0], 202401, 11.0), ("CU", D[0], 202403, 1.0), ("CU", D[1], 202401, 9.0)],
              "product string, dt date, ym int, settle double")
    got = G.term_structure(df).collect()
    assert len(got) == 1 and abs(got[0].curve - 0.1) < 1e-12


def test_regimes_match_pandas(spark):
    wide = random_walk(500, ["bm"], seed=2, vol=0.02)
    got = {r.dt: r.regime for r in G.regime_labels(make_panel(spark, wide), "bm").collect()}
    nav = (1 + wide["bm"].pct_change().fillna(0)).cumprod()
    bear, ma = nav / nav.cummax() - 1 < -0.2, nav.rolling(200).mean()
    want = {d.date(): "bear" if bear[d] else "bull" if nav[d] > ma[d] else "sideways" for d in nav.index}
    assert got == want and len(set(got.values())) == 3


@pytest.mark.parametrize("rows", [5, 60, 99, 100, 126, 252])
def test_rolling_frames_of_all_lengths(spark, rows):
    rng = np.random.default_rng(2)
    x = rng.normal(50, 1, 700)
    x[200:560] = 0.1 + 0.2  # flat for longer than any frame
    x[30], x[600] = np.nan, np.nan
    df = spark.createDataFrame(pd.DataFrame({"universe": "u", "asset": "a", "row_no": range(700), "x": x}))
    got = G.with_rolling(df, "x", rows, "r").orderBy("row_no").toPandas()
    s = pd.Series(x).rolling(rows)
    want_mean, want_std = s.mean(), s.std()
    full = s.count() == rows
    assert (got["r_mean"].notna() == full).all() and (got["r_std"].notna() == full).all()
    assert np.allclose(got["r_mean"][full], want_mean[full], rtol=1e-12) and np.allclose(got["r_std"][full], want_std[full], atol=1e-7)
    inside = [i for i in range(200 + rows - 1, 560)]
    assert (got["r_std"][inside] == 0).all() and (got["r_mean"][inside] == 0.1 + 0.2).all()
    assert {"x", "r_mean", "r_std"} <= set(got.columns) and not [c for c in got.columns if c.startswith("_")]


def test_as_of_over_empty_months_and_beyond_both_ends(spark):
    import datetime as dt
    days = [dt.date(2020, 1, 10), dt.date(2020, 1, 31), dt.date(2020, 5, 4), dt.date(2021, 2, 1)]
    calendar = spark.createDataFrame([("u", d, i) for i, d in enumerate(days)] + [("v", dt.date(2020, 3, 1), 0)], "universe string, dt date, row_no int")
    ask = [dt.datetime(2019, 6, 1), dt.datetime(2020, 1, 9, 23, 59), dt.datetime(2020, 1, 10), dt.datetime(2020, 3, 3), dt.datetime(2020, 5, 3), dt.datetime(2020, 5, 4, 12),
           dt.datetime(2021, 1, 31), dt.datetime(2021, 2, 1), dt.datetime(2030, 1, 1)]
    rows = [(u, f"{i}", t) for u in "uvw" for i, t in enumerate(ask)]
    targets = spark.createDataFrame(rows, "universe string, target_id string, target_ts timestamp_ntz")
    got = {(r.universe, int(r.target_id)): (r.as_of_dt, r.as_of_row) for r in P.as_of_dates(targets, calendar).collect()}
    known = {"u": days, "v": [dt.date(2020, 3, 1)], "w": []}
    for u in "uvw":
        for i, t in enumerate(ask):
            before = [(d, k) for k, d in enumerate(known[u]) if d <= t.date()]
            assert got[u, i] == (before[-1] if before else (None, None))
