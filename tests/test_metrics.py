import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from conftest import make_panel, random_walk
from pyspark.sql import functions as F

from panelfolio.functions import scalars as S
from panelfolio.operators import bootstrap as BS
from panelfolio.operators import folds as W
from panelfolio.operators import metrics as M
from panelfolio.operators import pairs as PR
from panelfolio.operators import panel as P


def series(spark, net, run="r", start="2000-01-03"):
    idx = pd.bdate_range(start, periods=len(net))
    pdf = pd.DataFrame({"universe": "u", "run_id": run, "dt": idx.date, "row_no": range(len(net)), "net": net})
    return spark.createDataFrame(pdf, "universe string, run_id string, dt date, row_no int, net double")


def test_normal_functions(spark):
    zs = [-9.0, -7.5, -4.0, -1.3, -0.2, 0.0, 0.4, 2.2, 5.0, 8.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", S.norm_cdf(F.col("z")).alias("c"), S.norm_ppf(S.norm_cdf(F.col("z") / 2)).alias("p")).collect():
        assert math.isclose(r.c, 0.5 * math.erfc(-r.z / math.sqrt(2)), rel_tol=1e-11, abs_tol=1e-18)
        assert abs(r.p - r.z / 2) < 1e-9
    q = spark.range(1).select(S.norm_ppf(F.lit(0.0)).alias("a"), S.norm_ppf(F.lit(0.999)).alias("b")).first()
    assert q.a is None and abs(q.b - NormalDist().inv_cdf(0.999)) < 1e-12


def test_perf_against_pandas(spark):
    net = np.random.default_rng(0).normal(0.0005, 0.01, 2000)
    got = M.perf(series(spark, net)).first()
    s = pd.Series(net)
    nav = (1 + s).cumprod()
    nav /= nav.iloc[0]
    assert math.isclose(got.total_return, nav.iloc[-1] - 1, rel_tol=1e-9)
    assert math.isclose(got.mdd, (nav / nav.cummax() - 1).min(), rel_tol=1e-9)
    assert math.isclose(got.var95, s.quantile(0.05)) and math.isclose(got.cvar95, s[s <= s.quantile(0.05)].mean())
    assert got.cvar95 < got.var95 < 0 and got.var99 < got.var95
    assert math.isclose(got.sharpe, s.mean() * 252 / (s.std() * math.sqrt(252) + 1e-12), rel_tol=1e-9)


def test_sortino_of_constant_gain(spark):
    assert M.perf(series(spark, [0.001] * 200)).first().sortino > 100


def test_capm_recovers_parameters(spark):
    rng = np.random.default_rng(1)
    b = rng.normal(0.0003, 0.01, 5000)
    runs = series(spark, 0.0004 + 0.5 * b + rng.normal(0, 0.005, 5000))
    got = M.capm(runs, series(spark, b).select("universe", "dt", F.col("net").alias("bench"))).first()
    assert abs(got.beta - 0.5) < 0.03 and abs(got.alpha - 0.0004 * 252) < 0.04
    assert M.capm(runs, series(spark, [0.0] * 5000).select("universe", "dt", F.col("net").alias("bench"))).count() == 0


def factor_panel(spark, seed, alpha, betas):
    rng = np.random.default_rng(seed)
    f = rng.normal([0.0003, 0.0002, 0.0004], [0.012, 0.004, 0.009], (4000, 3))
    wide = pd.DataFrame(100 * np.cumprod(1 + f, axis=0), index=pd.bdate_range("2000-01-03", periods=4000), columns=["mkt", "bnd", "gld"])
    panel = make_panel(spark, wide)
    y = alpha + f @ np.array(betas) + rng.normal(0, 0.001, 4000)
    return panel, series(spark, y), f, y


def test_multi_factor_recovery_and_spurious_alpha(spark):
    panel, runs, f, y = factor_panel(spark, 2, 0.0, (0.1, 0.6, 0.3))
    spec = [("MKT", "mkt", None), ("BND", "bnd", None), ("GLD", "gld", None), ("GONE", "zzz", None)]
    fr = P.factor_returns(P.daily_returns(panel), panel.calendar, spec)
    got = {r.factor: r for r in M.multi_factor_ols(runs, fr, ["MKT", "BND", "GLD"]).collect()}
    x = f.copy()
    x[0] = 0.0
    x = np.column_stack([np.ones(4000), x])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert np.allclose([got[k].beta for k in ("alpha", "MKT", "BND", "GLD")], beta, atol=1e-9)
    res = y - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (res @ res) / (4000 - 4))
    assert np.allclose([got[k].tstat for k in ("alpha", "MKT", "BND", "GLD")], beta / se, rtol=1e-6)
    one = M.capm(runs, fr.filter("factor = 'MKT'").select("universe", "dt", F.col("f_ret").alias("bench"))).first()
    assert one.alpha > 0.025 and abs(got["alpha"].beta * 252) < 0.02
    flat = M.multi_factor_ols(runs, fr, ["MKT", "GONE"]).filter("factor = 'GONE'").first()
    assert abs(flat.beta) < 1e-9


def test_deflated_sharpe_against_python(spark):
    x = np.random.default_rng(4).normal(0.0006, 0.01, 1500)
    n, m, sd = len(x), x.mean(), x.std(ddof=1)
    sr, g3, g4 = m / sd, ((x - m) ** 3).sum() / (n - 1) / sd ** 3, ((x - m) ** 4).sum() / (n - 1) / sd ** 4
    sig = math.sqrt((1 - g3 * sr + (g4 - 1) / 4 * sr ** 2) / (n - 1))
    nd = NormalDist()
    top = sig * ((1 - M.EULER) * nd.inv_cdf(1 - 1 / 50) + M.EULER * nd.inv_cdf(1 - 1 / (50 * math.e)))
    got = M.deflated_sharpe(series(spark, x), [50]).first()
    assert math.isclose(got.dsr, nd.cdf((sr - top) / sig), rel_tol=1e-9) and math.isclose(got.psr, nd.cdf(sr / sig), rel_tol=1e-9)


def test_bootstrap_matches_index_resampling(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0.0006, 0.01, 100), rng.normal(0.0001, 0.01, 100)
    pairs = BS.pair_series(series(spark, a, "a").unionByName(series(spark, b, "b")), [("a", "b")])
    lengths = spark.createDataFrame([("u", "a-b", 100)], "universe string, pair_id string, t int")
    starts = BS.circular_starts(lengths, 40, 21, 7).toPandas()
    sharpe = lambda x: x.mean() / (x.std(ddof=1) + 1e-12) * math.sqrt(252)
    deltas = []
    for _, g in starts.groupby("rep"):
        idx = np.concatenate([(s + np.arange(21)) % 100 for s in g.sort_values("block_no").start])[:100]
        deltas.append(sharpe(a[idx]) - sharpe(b[idx]))
    got = BS.paired_bootstrap(pairs, 40, 21, 7).first()
    assert math.isclose(got.boot_mean, np.mean(deltas), rel_tol=1e-9) and math.isclose(got.delta_obs, sharpe(a) - sharpe(b), rel_tol=1e-9)
    assert np.allclose([got.ci_lo, got.ci_hi], np.percentile(deltas, [2.5, 97.5])) and math.isclose(got.p_value, np.mean(np.array(deltas) <= 0))


def test_walk_forward_windows_snap_back(spark):
    panel = make_panel(spark, random_walk(2600, ["a"], start="2008-02-29"))
    days = pd.DatetimeIndex([r.dt for r in panel.calendar.orderBy("dt").collect()])
    near = lambda t: days[days <= t][-1]
    want, t0 = [], days[0]
    while True:
        ts = near(t0 + pd.DateOffset(years=5) + pd.Timedelta(days=1))
        if ts >= days[-1]:
            break
        lo = days[days >= t0][0]
        want.append((lo, near(t0 + pd.DateOffset(years=5)), ts, near(t0 + pd.DateOffset(years=6))))
        t0 = t0 + pd.DateOffset(years=1)
    got = W.walk_forward_windows(panel.calendar, 0).toPandas().pivot(index="window_id", columns="part").sort_index()
    rows = [(days[r[("lo", "train")]], days[r[("hi", "train")]], days[r[("lo", "test")]], days[r[("hi", "test")]]) for _, r in got.iterrows()]
    assert rows == want and len(want) >= 4


def test_purged_folds_leave_out_the_borders(spark):
    panel = make_panel(spark, random_walk(700, ["a"]))
    days = pd.DatetimeIndex([r.dt for r in panel.calendar.orderBy("dt").collect()])
    edges = pd.date_range(days[126], days[-1], periods=7)
    got = W.window_rows(W.purged_folds(panel.calendar)).toPandas()
    gap = pd.Timedelta(days=21)
    for i in range(6):
        g = got[got.window_id == i]
        assert sorted(g[g.part == "test"].row_no) == [k for k, d in enumerate(days) if edges[i] <= d <= edges[i + 1]]
        assert sorted(g[g.part == "train"].row_no) == [k for k, d in enumerate(days) if d < edges[i] - gap or d > edges[i + 1] + gap]


def test_best_takes_the_first_on_ties(spark):
    s = spark.createDataFrame([("u", r, 0, p, v) for r, p, v in (("b", "train", 1.0), ("a", "train", 1.0 + 1e-15), ("c", "train", 0.5),
                               ("a", "test", 0.1), ("b", "test", 0.3), ("c", "test", 0.2))], "universe string, run_id string, window_id int, part string, score double")
    got = W.rank_of_best(s).first()
    assert got.run_id == "a" and got.test_rank == 2 and got.n_runs == 3


def test_hysteresis_never_flips(spark):
    import datetime as dt
    z = [None, -2.5, -1.0, 2.5, 2.5, None, 1.0, 0.2, 3.0]
    data = [("u", "a", "b", dt.date(2024, 1, 1) + dt.timedelta(i), v, 1.0, 1.0, 1.0) for i, v in enumerate(z)]
    df = spark.createDataFrame(data, "universe string, a string, b string, dt date, z double, pa double, pb double, beta double")
    got = [r.pos for r in PR.hysteresis_state(df).orderBy("dt").collect()]
    assert got == [0, 1, 1, 0, -1, 0, -1, 0, -1]


def test_cointegration_finds_the_linked_pair(spark):
    rng = np.random.default_rng(8)
    wide = random_walk(900, ["a", "b"], seed=11)
    wide["c"] = 20 + 1.5 * wide["a"] + rng.normal(0, 1, 900)
    tests = {(r.a, r.b): r for r in PR.cointegration(PR.pair_prices(make_panel(spark, wide), ["a", "b", "c"])).collect()}
    assert tests[("a", "c")].p < 0.01 and tests[("a", "b")].tstat > tests[("a", "c")].tstat


def test_segments_from_a_table(spark):
    import datetime as dt
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(900)]
    rets = spark.createDataFrame([("u", r, d, 0.001 * (i % 7)) for r in "xy" for i, d in enumerate(days)], "universe string, run_id string, dt date, net double")
    rng = np.random.default_rng(2)
    spans = [(f"s{k}", days[0] + dt.timedelta(int(a)), days[0] + dt.timedelta(int(a + b))) for k, (a, b) in enumerate(zip(rng.integers(-50, 890, 300), rng.integers(0, 400, 300)))]
    spans += [("open", None, None), ("from", days[800], None), ("none", days[5], days[4])]
    table = spark.createDataFrame(spans, "segment string, lo date, hi date")
    got = {(r.run_id, r.segment): r.n_days for r in M.segment_cumulative_return(rets, table, 1).collect()}
    count = lambda lo, hi: sum((lo or days[0]) <= d <= (hi or days[-1]) for d in days)
    assert got == {(r, s): count(lo, hi) for r in "xy" for s, lo, hi in spans if count(lo, hi)}
    own = table.filter("segment = 's1'").selectExpr("'x' as run_id", "*")
    assert {r.run_id for r in M.segment_cumulative_return(rets, own, 0).collect()} <= {"x"}


def test_high_correlations_against_the_whole_matrix(spark):
    rng = np.random.default_rng(12)
    n, common = 300, rng.normal(0, 1, 300)
    wide = {f"a{i:02d}": rng.uniform(0, 1.2) * common + rng.normal(0, 1, n) for i in range(24)}
    wide["flat"] = np.ones(n)
    rows = [("u", d, a, float(x)) for a, xs in wide.items() for d, x in enumerate(xs) if not (a in ("a03", "a07") and d < 40) and not (a == "a05" and d % 9 == 0)]
    df = spark.createDataFrame(rows, "universe string, dt int, asset string, close double")
    got = {(r.a, r.b): (r.corr, r.n) for r in M.high_correlations(df, "asset", "close", 0.3).collect()}
    want = {(r.a, r.b): (r["corr"], r.n) for r in M.corr_matrix(df.filter("asset <> 'flat'"), "asset", "close").collect() if r["corr"] is not None and r["corr"] >= 0.3}
    assert set(got) == set(want) and 20 < len(got) < 200
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
