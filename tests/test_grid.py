"""The parameter grid as data: windows against numpy, a plan that does not follow the grid."""

import numpy as np
import pytest
from conftest import make_panel, random_walk
from pyspark.sql import functions as F

from panelfolio.operators import weights as A
from panelfolio.params import ParamSet, Universe, universe_dim

U = Universe("u", ("a", "b", "c"), "c", "a")


def test_plan_is_the_same_for_any_number_of_sets(spark):
    panel = make_panel(spark, random_walk(320, ["a", "b", "c"]))
    size = lambda n: len(A.decide_targets(panel, universe_dim(spark, [U]), [ParamSet(f"r{i}", trend_ma=100 + i, skip=i % 5, top_n=1) for i in range(n)])
                         ._jdf.queryExecution().executedPlan().toString().split("\n"))
    assert size(4) == size(300)


def test_windows_of_every_set_against_numpy(spark):
    wide = random_walk(420, ["a", "b", "c"])
    wide.iloc[100:109, 1] = np.nan  # a gap: windows count the asset's own prices
    wide.iloc[200:260, 2] = 50.0  # flat
    panel = make_panel(spark, wide)
    sets = [ParamSet("x", lookbacks=(5, 40), lookback_weights=(1, 3), skip=2, risk_adj=True, weighting="inv_vol", inv_vol_window=30, trend_ma=25, crash_prot=True,
                     crash_lookback=7, crash_thr=0.01, dd_window=15, dd_thr=-0.02), ParamSet("y", lookbacks=(21,), trend_ma=60, dd_window=50, drawdown_prot=True)]
    got = {(r.run_id, r.asset, r.signal_dt): r for r in A.rebalance_signals(panel, universe_dim(spark, [U]), sets).collect()}
    seen = 0
    held = {a: [(r.dt, r.close) for r in panel.obs.filter(F.col("asset") == a).orderBy("row_no").collect()] for a in "abc"}
    for (run, asset, day), r in got.items():
        c = np.array([p for d, p in held[asset] if d <= day])
        p = next(s for s in sets if s.run_id == run)
        w = np.array(p.lookback_weights or [1] * len(p.lookbacks), float)
        m = sum(x * (c[-1 - p.skip] / c[-1 - p.skip - lb] - 1) for x, lb in zip(w, p.lookbacks)) / w.sum()
        ret = c[1:] / c[:-1] - 1
        if p.risk_adj:
            sd = ret[len(ret) - p.skip - 40 : len(ret) - p.skip].std()
            assert r.momentum is None if sd == 0 else r.momentum == pytest.approx(m / sd, rel=1e-9)
            assert r.vol == pytest.approx(ret[-30:].std(), abs=1e-15)
            assert r.rebound == (c[-1] / c[-8] - 1 >= 0.01)
        else:
            assert r.momentum == pytest.approx(m, rel=1e-9) and r.vol is None and not r.rebound
        mean = c[-p.trend_ma :]
        assert r.below == (False if mean.min() == mean.max() else c[-1] < mean.mean())
        top = c[-p.dd_window :].max()
        assert r.fallen == ((c[-1] - top) / top <= p.dd_thr)
        assert np.allclose(r.tail, ret[-20:])
        seen += 1
    assert seen > 50
