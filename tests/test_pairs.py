"""Pair tests and path-dependent states against direct loops."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import make_panel
from pyspark.sql import functions as F

from panelfolio.functions import scalars as S
from panelfolio.operators import accounting as B
from panelfolio.operators import pairs as PR
from panelfolio.operators.scan import running


def residual_test(a, b):
    """Lag and statistic by least squares on the matrices of every lag."""
    x = np.column_stack([b, np.ones(len(b))])
    e = a - x @ np.linalg.lstsq(x, a, rcond=None)[0]
    d = np.diff(e)
    longest = min(math.ceil(12 * (len(a) / 100) ** 0.25), len(a) // 2 - 1)

    def fit(lag, rows):
        at = np.arange(len(d) - rows, len(d))
        z = np.column_stack([e[at], *[d[at - j] for j in range(1, lag + 1)]])
        coef, *_ = np.linalg.lstsq(z, d[at], rcond=None)
        rss = float(((d[at] - z @ coef) ** 2).sum())
        t = coef[0] / math.sqrt(rss / (rows - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
        return rows * math.log(rss / rows) + 2 * (lag + 1), t

    lag = min(range(longest + 1), key=lambda k: (fit(k, len(d) - longest)[0], k))
    return lag, fit(lag, len(d) - lag)[1]


def test_lag_and_statistic_against_least_squares(spark):
    rng = np.random.default_rng(8)
    n = 400
    walk = np.cumsum(rng.normal(0, 1, n)) + 60
    noise = np.zeros(n)
    for i in range(4, n):  # residuals with long memory ask for lags
        noise[i] = 0.5 * noise[i - 1] - 0.4 * noise[i - 3] + 0.3 * noise[i - 4] + rng.normal(0, 0.5)
    wide = pd.DataFrame({"a": walk, "b": 0.7 * walk + noise + 5, "c": np.cumsum(rng.normal(0, 1, n)) + 80, "d": 2 * walk + 1}, index=pd.bdate_range("2015-01-01", periods=n))
    got = {(r.a, r.b): r for r in PR.cointegration(PR.pair_prices(make_panel(spark, wide), list("abcd"))).collect()}
    lags = set()
    for a, b in [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")]:
        lag, t = residual_test(wide[a].to_numpy(), wide[b].to_numpy())
        r = got[a, b]
        assert (r.n, r.lag) == (n, lag) and r.tstat == pytest.approx(t, rel=1e-7)
        lags.add(lag)
    assert len(lags) > 1 and max(lags) >= 3
    assert got["a", "d"].tstat == -math.inf and got["a", "d"].p == 0.0


def test_probabilities_at_published_critical_values(spark):
    at = spark.createDataFrame([(-3.90, 0.01), (-3.34, 0.05), (-3.05, 0.10)], "t double, p double")
    for r in at.select("p", S.residual_test_p(F.col("t")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, abs=0.002)
    edges = spark.createDataFrame([(-20.0,), (1.0,), (None,)], "t double").select(S.residual_test_p(F.col("t")).alias("p")).collect()
    assert [r.p for r in edges] == [0.0, 1.0, None]


def test_screen_falls_back_to_the_best(spark):
    rows = [("u", "a", "b", 0.03), ("u", "a", "c", 0.2), ("v", "a", "b", 0.5), ("v", "a", "c", 0.4), ("v", "b", "c", 0.4), ("w", "a", "b", None)]
    got = PR.pair_screen(spark.createDataFrame(rows, "universe string, a string, b string, p double")).collect()
    assert sorted((r.universe, r.a, r.b) for r in got) == [("u", "a", "b"), ("v", "a", "c"), ("v", "b", "c"), ("w", "a", "b")]


@pytest.mark.parametrize("entry,exit_", [(2.0, 0.5), (1.0, 0.0), (0.5, 1.0)])
def test_states_against_a_loop(spark, entry, exit_):
    rng = random.Random(3)
    rows = [("u", p, "z", i, rng.choice([None, *[rng.gauss(0, 2) for _ in range(6)]])) for p in "ab" for i in range(700)]
    df = spark.createDataFrame(rows, "universe string, a string, b string, dt int, z double").repartition(5)
    got = {(r.a, r.dt): r.pos for r in PR.hysteresis_state(df, entry, exit_).collect()}
    for p in "ab":
        state = 0
        for _, _, _, i, z in (r for r in rows if r[1] == p):
            if z is not None:
                if state == 0:
                    state = 1 if z < -entry else -1 if z > entry else 0
                elif (state == 1 and z > -exit_) or (state == -1 and z < exit_):
                    state = 0
            assert got[p, i] == (0 if z is None else state)


def test_blocked_decisions_against_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for asset in "abcdef":
        blocked = rng.choice([0.1, 0.5, 0.95])
        for i in range(150):
            target = rng.choice([None, 0.0, 0.1, 0.1 + 5e-10, 0.2, 0.2 - 5e-10, 0.3, 1e-13])
            rows.append((asset, i, target, rng.random() < blocked, rng.random() < blocked))
    df = spark.createDataFrame(rows, "asset string, i int, target double, cant_buy boolean, cant_sell boolean")
    done = running(df, ("asset",), "i", B.decision_map(), B.then, "_map").withColumn("w", B.weight_after(F.col("_map"), F.lit(0.0)))
    got = {(r.asset, r.i): r.w for r in done.collect()}
    for asset in "abcdef":
        old = 0.0
        for _, i, target, buy, sell in (r for r in rows if r[0] == asset):
            if target is None:
                old = 0.0 if old > 1e-12 and not sell else old
            elif not ((target > old + 1e-9 and buy) or (target < old - 1e-9 and sell)):
                old = target
            assert got[asset, i] == old, (asset, i)
