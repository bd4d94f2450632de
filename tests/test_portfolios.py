import numpy as np
import pandas as pd
import pytest
from conftest import make_panel, random_walk
from pyspark.sql import functions as F

from panelfolio.operators import accounting as B
from panelfolio.operators import covariance as C
from panelfolio.operators import panel as P
from panelfolio.operators import weights as A
from panelfolio.params import COST_RATE, ParamSet, Universe, universe_dim
from panelfolio.plans import reports as R
from panelfolio.plans import strategies as X
from panelfolio.plans.backtest import backtest

POOL = tuple("abcdefg")
U = Universe("u", POOL, bond="bond", benchmark="a")


def weights_of(df, **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    return {r.asset: r.weight for r in df.collect()}


def ramp(n=200):
    idx = pd.bdate_range("2020-01-01", periods=n)
    wide = pd.DataFrame({c: 100 + (i + 1) * 0.1 * np.arange(n) for i, c in enumerate(POOL)}, index=idx)
    return wide.assign(bond=100.0)


def test_hold_all_and_top_n(spark):
    panel, dim = make_panel(spark, ramp()), universe_dim(spark, [U])
    plain = ParamSet("all", vol_target=None, drawdown_prot=False)
    t = A.decide_targets(panel, dim, [plain, plain.but("top", hold_all=False)])
    last = t.agg(F.max("reb_no")).first()[0]
    w = weights_of(t, run_id="all", reb_no=last)
    assert set(w) == set(POOL) and np.allclose(list(w.values()), 0.99 / 7)
    w = weights_of(t, run_id="top", reb_no=last)
    assert set(w) == {"e", "f", "g"} and np.allclose(list(w.values()), 0.33)


def test_ties_follow_pool_order(spark):
    wide = ramp()
    for c in POOL:
        wide[c] = wide["a"]
    t = A.decide_targets(make_panel(spark, wide), universe_dim(spark, [U]), [ParamSet("top", hold_all=False, vol_target=None, drawdown_prot=False)])
    assert {r.asset for r in t.collect()} == {"a", "b", "c"}


def test_two_tier_defence(spark):
    n = 260
    idx = pd.bdate_range("2020-01-01", periods=n)
    up_down = np.concatenate([100 + 0.5 * np.arange(200), 199.5 - 1.2 * np.arange(1, 61)])
    wide = pd.DataFrame({"bm": up_down, "x": 100 + 0.2 * np.arange(n), "y": 100 + 0.3 * np.arange(n), "bond": 100.0, "cash": 100.0}, index=idx)
    u = Universe("u", ("bm", "x", "y"), bond="bond", benchmark="bm", cash="cash")
    p = ParamSet("t", hold_all=False, vol_target=None, trend_ma=200, drawdown_prot=False)
    t = A.decide_targets(make_panel(spark, wide), universe_dim(spark, [u]), [p])
    w = weights_of(t, reb_no=t.agg(F.max("reb_no")).first()[0])
    assert np.allclose([w["cash"], w["bond"], w["x"], w["y"]], [0.33, 0.33, 0.165, 0.165])


def test_too_few_candidates_means_no_decision(spark):
    wide = ramp()[["a", "b", "bond"]]
    t = A.decide_targets(make_panel(spark, wide), universe_dim(spark, [Universe("u", ("a", "b"), bond="bond", benchmark="a")]), [ParamSet("p")])
    assert t.count() == 0


def test_blocked_trades(spark):
    panel = make_panel(spark, random_walk(70, ["a", "b"], start="2024-01-02"))
    targets = spark.createDataFrame([("u", "r", 1, "a", 0.6), ("u", "r", 1, "b", 0.4), ("u", "r", 2, "b", 0.9), ("u", "r", 3, "b", 0.9)],
                                    "universe string, run_id string, reb_no int, asset string, weight double")
    fill = {r.reb_no: r.dt for r in panel.calendar.join(
        P.rebalances(panel.calendar).select(F.col("reb_no").alias("n"), (F.col("reb_row") + 1).alias("row_no")), "row_no").select(F.col("n").alias("reb_no"), "dt").collect()}
    flags = spark.createDataFrame([("u", "b", fill[1], True, False), ("u", "a", fill[2], False, True)], "universe string, asset string, dt date, cant_buy boolean, cant_sell boolean")
    out = B.execute_with_limits(B.decision_grid(targets), flags, panel.calendar)
    got = {(r.asset, r.reb_no): r.weight for r in out.collect()}
    # b could not be bought at 1; a could not be sold at 2 and goes at 3.
    assert got[("b", 1)] == 0.0 and got[("a", 2)] == 0.6 and got[("a", 3)] == 0.0 and got[("b", 2)] == 0.9


def brute_daily(wide, targets, cost=COST_RATE):
    """Day-by-day accounting of {signal date: {asset: weight}}."""
    rets = wide.pct_change().fillna(0.0)
    held = pd.DataFrame(0.0, index=wide.index, columns=wide.columns)
    cur, pending = pd.Series(0.0, index=wide.columns), None
    for d in wide.index:
        if pending is not None:
            cur, pending = pd.Series(pending).reindex(wide.columns).fillna(0.0), None
        pending = targets.get(d.date(), pending)
        held.loc[d] = cur
    lag = held.shift(1).fillna(0.0)
    return (lag * rets).sum(axis=1) - (held - lag).abs().sum(axis=1) * cost


def test_accounting_matches_a_daily_loop(spark):
    wide = random_walk(300, list(POOL) + ["bond"])
    panel, dim = make_panel(spark, wide), universe_dim(spark, [U])
    p = ParamSet("p", hold_all=False, trend_ma=120)
    signal = {r.reb_no: r.signal_dt for r in P.rebalances(panel.calendar).collect()}
    targets: dict = {}
    for r in A.decide_targets(panel, dim, [p]).collect():
        targets.setdefault(signal[r.reb_no], {})[r.asset] = r.weight
    want = brute_daily(wide, targets).iloc[126:]
    got = backtest(panel, dim, [p]).orderBy("dt").toPandas()["net"]
    assert np.allclose(got.to_numpy(), want.to_numpy(), atol=1e-12)


def test_limits_without_flags_change_nothing(spark):
    panel, dim = make_panel(spark, random_walk(300, list(POOL) + ["bond"])), universe_dim(spark, [U])
    none = spark.createDataFrame([], "universe string, asset string, dt date, cant_buy boolean, cant_sell boolean")
    p = ParamSet("p", hold_all=False)
    a, b = backtest(panel, dim, [p]), backtest(panel, dim, [p], none)
    assert R.path_equality(a, b).first().max_abs_diff < 1e-12


def test_blends_of_one_and_of_copies(spark):
    panel, dim = make_panel(spark, random_walk(600, list(POOL) + ["bond"])), universe_dim(spark, [U])
    p = ParamSet("p", trend_ma=200)
    one = X.OverlayStrategy(p)
    direct = backtest(panel, dim, [p])
    for s in (X.Blend((one,)), X.Blend((one, one)), X.RiskParityBlend((one,))):
        assert R.path_equality(direct, R.strategy_returns([s], panel, dim)).first().max_abs_diff < 1e-9


def test_asset_momentum_matches_vectorised_form(spark):
    rng = np.random.default_rng(3)
    steps = np.concatenate([rng.normal(m, 0.004, n) for m, n in ((0.0008, 300), (-0.0015, 150), (0.001, 150))])
    p = pd.Series(100 * np.exp(np.cumsum(steps)), index=pd.bdate_range("2018-01-01", periods=600), name="bond")
    panel = make_panel(spark, p.to_frame())
    u = Universe("u", ("bond",), bond="bond", benchmark="bond")
    got = R.strategy_returns([X.AssetMomentum("bond")], panel, universe_dim(spark, [u])).orderBy("dt").toPandas()["net"].to_numpy()
    mom = sum(p / p.shift(k) - 1 for k in (21, 63, 126)) / 3
    sig = ((mom > 0) & (p > p.rolling(200).mean())).astype(float)
    ends = p.groupby([p.index.year, p.index.month]).apply(lambda s: s.index[-1])
    ends = [d for d in ends if d >= p.index[126]]
    pos = sig.where(sig.index.isin(ends)).ffill().fillna(0.0).shift(1).fillna(0.0)
    net = pos.shift(1).fillna(0.0) * p.pct_change().fillna(0.0) - pos.diff().abs().fillna(0.0) * COST_RATE
    assert np.allclose(got, net.iloc[126:].to_numpy(), atol=1e-9) and pos.nunique() == 2


def test_risk_parity_calms_the_blend(spark):
    rng = np.random.default_rng(9)
    n = 700
    wide = random_walk(n, list(POOL), start="2016-01-01", vol=0.02, drift=0.0004)
    wide["bond"] = 100 * np.exp(np.cumsum(rng.normal(0.0004, 0.001, n)))
    panel, dim = make_panel(spark, wide), universe_dim(spark, [U])
    one, bond = X.OverlayStrategy(ParamSet("p", vol_target=None)), X.AssetMomentum("bond", with_trend=False)
    runs = R.strategy_returns([one, X.Blend((one, bond)), X.RiskParityBlend((one, bond)), X.MinVarianceBlend((one, bond))], panel, dim)
    vol = {r.run_id: r.v for r in runs.groupBy("run_id").agg(F.stddev("net").alias("v")).collect()}
    assert vol["risk_parity"] < vol["blend"] < vol["overlay"] and vol["min_variance"] < vol["blend"]


def test_python_strategy_matches_builtin(spark):
    panel, dim = make_panel(spark, random_walk(250, ["bond", "a"])), universe_dim(spark, [U])

    def decide(closes):
        c = closes[closes.asset == "bond"].sort_values("k").close.to_numpy()
        ok = len(c) >= 127 and sum(c[0] / c[k] - 1 for k in (21, 63, 126)) > 0
        return pd.DataFrame({"asset": ["bond"], "weight": [1.0 if ok else 0.0]})

    a = R.strategy_returns([X.PythonStrategy(decide, ("bond",))], panel, dim)
    b = R.strategy_returns([X.AssetMomentum("bond", with_trend=False)], panel, dim)
    assert R.path_equality(a, b).first().max_abs_diff < 1e-12


def test_blend_rejects_bad_allocations():
    with pytest.raises(ValueError):
        X.Blend(())
    with pytest.raises(ValueError):
        X.Blend((X.AssetMomentum("a"),), (0.0,))


def shrunk(x):
    t, n = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / t
    target = np.trace(s) / n * np.eye(n)
    pi = ((x ** 2).T @ (x ** 2) / t - s ** 2).sum()
    d = np.clip(pi / ((target - s) ** 2).sum() / t, 0, 1)
    return d * target + (1 - d) * s, d


def test_shrunk_covariance_and_weights(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, [0.01, 0.02, 0.005], (80, 3))
    x[:, 1] += 0.8 * x[:, 0]
    data = [("u", k, f"s{i}", float(x[k, i])) for k in range(80) for i in range(3)]
    cov = C.shrunk_covariance(spark.createDataFrame(data, "universe string, k int, name string, x double"), ("universe",))
    want, d = shrunk(x)
    got = cov.toPandas().pivot(index="i", columns="j", values="sigma").to_numpy()
    assert np.allclose(got, want) and abs(cov.first().delta - d) < 1e-12
    w = {r.name: r.weight for r in C.min_variance_weights(cov, ("universe",)).collect()}
    raw = np.maximum(np.linalg.solve(want, np.ones(3)), 0)
    assert np.allclose([w["s0"], w["s1"], w["s2"]], raw / raw.sum())


def test_pair_min_variance_singular_is_equal(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (4.0, 0.0, 1.0), (1.0, 1.5, 4.0)], "a double, b double, c double")
    got = [r.w for r in df.select(C.pair_min_variance(F.col("a"), F.col("b"), F.col("c")).alias("w")).collect()]
    assert np.allclose(got, [0.5, 0.2, 1.0])
