import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfolio.llm import spectrum, whitening

SCHEMA = "vec_id long, embedding array<double>"


def by_numpy(rows):
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = np.array(sorted({tuple(x) for _, x in good}), dtype=object)
    n, sums = len(distinct), distinct.sum(axis=0)
    y = ((n * distinct - sums) / n).astype(float)
    e, vectors = np.linalg.eigh(y.T @ y / n)
    return good, n, sums, e[::-1], vectors[:, ::-1].T


def test_against_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(0, 1, (20, 20)) * np.linspace(2, 0.1, 20)
    rows = [(i, [float(c) for c in rng.normal(0, 0.4, 20) @ mix]) for i in range(500)]
    rows += [(600, rows[0][1]), (600, rows[0][1]), (None, rows[1][1]), (601, None), (602, [None] * 20), (603, [math.nan] * 20), (604, [math.inf] * 20), (605, []),
             (606, [1.0] * 3)]
    good, n, sums, e, basis = by_numpy([r for r in rows if not r[1] or len(r[1]) == 20])
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).withColumn("row", F.lit(1)).withColumn("x", F.lit(2))
    got = whitening.whiten(df).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    assert len(got) == 16 * len(good)
    at = {}
    for r in got:
        at.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for i, x in good:
        exact = [n * a - int(s) for a, s in zip(x, sums)]
        y = np.array([d / n for d in exact])
        for c in range(1, 17):
            r = at[i, c][0]
            want = float(y @ basis[c - 1] / math.sqrt(e[c - 1]))
            sign = signs.setdefault(c, math.copysign(1, want * r["whitened"]))
            assert r["whitened"] == pytest.approx(sign * want, abs=1e-8)
            assert (r["n"], r["deviation"]) == (n, sum(d * d for d in exact))
            assert r["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9
    assert len(at[600, 1]) == 2 and len(at[None, 1]) == 1


def test_few_dimensions_flat_directions_and_no_rows(spark):
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [1.5, 1.0])], SCHEMA)).orderBy("vec_id", "component").collect()
    assert [(r["component"], r["whitened"] is None) for r in flat] == [(1, False), (2, True)] * 2
    assert [abs(r["whitened"]) for r in flat if r["component"] == 1] == [1.0, 1.0] and flat[0]["identity_error"] == 0.0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5]), (1, [0.5])], SCHEMA)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(1, 0, None, None)] * 2
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_entries(spark):
    rows = [(1, [1e14, 0.0]), (2, [-1e14, 1.0]), (3, [0.0, 2.0]), (4, [1e300, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and got[0]["n"] == 3 and got[0]["deviation"] is None
    assert got[0]["identity_error"] < 1e-4


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [3, 3, 3, 1, 0], [0, 0, 0], [7, 7 - 1e-9, 2, 2, 2], [1e-12, 1e-30, 0], list(range(1, 40))])
def test_eigenpairs(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.normal(0, 1, (len(values), len(values))))
    v = q @ np.diag(np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    got, vectors = spectrum.leading(v, 16)
    scale = max(values)
    want = np.linalg.eigvalsh(v)[::-1][:16]
    assert np.allclose(got, want, atol=1e-13 * scale + 1e-300, rtol=0)
    assert np.allclose(vectors @ vectors.T, np.eye(len(got)), atol=1e-12)
    assert np.abs(v @ vectors.T - vectors.T * got).max() <= 1e-13 * scale


def test_inertia_counts():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 8, 25):
        a = rng.normal(0, 1, (n, n))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for shift in [*((e[1:] + e[:-1]) / 2), e[0] - 1, e[-1] + 1, 0.0]:
            assert spectrum.above(a, shift) == int((e > shift).sum())
    assert spectrum.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
