"""Shrunk covariance and minimum-variance weights for a few return series per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shrunk_covariance(series: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Covariance shrunk towards a scaled identity: long rows (keys, i, j, sigma, delta).

    ``series``: keys, k (aligned observation), name, x. Everything is sums over the pairs of the few series of a group.
    """
    own = Window.partitionBy(*keys, "name")
    centred = series.select(*keys, "k", "name", (F.col("x") - F.avg("x").over(own)).alias("x"))
    left = centred.select(*keys, "k", F.col("name").alias("i"), F.col("x").alias("xi"))
    right = centred.select(*keys, "k", F.col("name").alias("j"), F.col("x").alias("xj"))
    pairs = (left.join(right, [*keys, "k"]).filter("i <= j").groupBy(*keys, "i", "j").agg(
        F.avg(F.col("xi") * F.col("xj")).alias("s"), F.avg((F.col("xi") * F.col("xj")) ** 2).alias("q"), F.count(F.lit(1)).alias("t")))
    # each pair is summed once and stands in both halves of the matrix
    pairs = pairs.select(*keys, "s", "q", "t", F.explode(F.array_distinct(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("_p")).select(
        *keys, "_p.i", "_p.j", "s", "q", "t")
    group = Window.partitionBy(*keys)
    diag = F.col("i") == F.col("j")
    df = pairs.withColumn("mu", F.avg(F.when(diag, F.col("s"))).over(group))
    target = F.when(diag, F.col("mu")).otherwise(F.lit(0.0))
    df = (df.withColumn("pi", F.sum(F.col("q") - F.col("s") ** 2).over(group))
          .withColumn("gamma", F.sum((target - F.col("s")) ** 2).over(group)))
    df = df.withColumn("delta", shrinkage(F.col("pi"), F.col("gamma"), F.col("t")))
    return df.select(*keys, "i", "j", (F.col("delta") * target + (1 - F.col("delta")) * F.col("s")).alias("sigma"), "delta")


def shrinkage(pi: Column, gamma: Column, t: Column) -> Column:
    raw = F.when(gamma > 1e-12, pi / gamma).otherwise(F.lit(0.0)) / t
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def pair_min_variance(s11: Column, s12: Column, s22: Column) -> Column:
    """Long-only minimum-variance weight of the first of two series, in closed form."""
    det = s11 * s22 - s12 * s12
    # A singular matrix gets a small diagonal; the ratio below is unchanged by the common determinant otherwise.
    jitter = F.when(det == 0, F.lit(1e-8)).otherwise(F.lit(0.0))
    sign = F.when((s11 + jitter) * (s22 + jitter) - s12 * s12 < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    a = F.greatest((s22 + jitter - s12) * sign, F.lit(0.0))
    b = F.greatest((s11 + jitter - s12) * sign, F.lit(0.0))
    return F.when(a + b > 0, a / F.nullif(a + b, F.lit(0.0))).otherwise(F.lit(0.5))


def pair_weights(cov: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Weights of groups of two series, in closed form: (keys, name, weight)."""
    own, cross = F.col("i") == F.col("j"), F.col("i") < F.col("j")
    both = cov.groupBy(*keys).agg(
        F.min("i").alias("a"), F.max("i").alias("b"), F.min_by(F.when(own, F.col("sigma")), F.when(own, F.col("i"))).alias("s11"),
        F.max_by(F.when(own, F.col("sigma")), F.when(own, F.col("i"))).alias("s22"), F.max(F.when(cross, F.col("sigma"))).alias("s12"))
    w = pair_min_variance(F.col("s11"), F.col("s12"), F.col("s22"))
    return both.withColumn("w", w).select(*keys, F.explode(F.array(
        F.struct(F.col("a").alias("name"), F.col("w").alias("weight")), F.struct(F.col("b").alias("name"), (1 - F.col("w")).alias("weight")))).alias("z")).select(*keys, "z.*")


def _long_only(m: np.ndarray) -> np.ndarray:
    """Clipped, rescaled solutions of a stack of systems with the vector of ones; a singular one gets a small diagonal."""
    ones, n = np.ones((len(m), m.shape[1])), m.shape[1]
    try:
        w = np.linalg.solve(m, ones[..., None])[..., 0]
    except np.linalg.LinAlgError:
        w = np.stack([_long_only_single(one) for one in m])
    w = np.where(np.isfinite(w).all(1, keepdims=True), w, 1.0)
    w = np.maximum(w, 0.0)
    total = w.sum(1, keepdims=True)
    return np.where(total > 0, w / np.where(total > 0, total, 1), 1.0 / n)


def _long_only_single(m: np.ndarray) -> np.ndarray:
    for extra in (0.0, 1e-8):
        try:
            return np.linalg.solve(m + extra * np.eye(len(m)), np.ones(len(m)))
        except np.linalg.LinAlgError:
            continue
    return np.ones(len(m))


def min_variance_weights(cov: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Long-only minimum-variance weights per group: (keys, name, weight). Small matrices, solved many at once."""
    cells = cov.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "j", "sigma"))).alias("cells"))
    cells = cells.select(*keys, F.array_distinct("cells.i").alias("names"), F.col("cells.sigma").alias("sigma"))

    def solve(batches):
        for pdf in batches:
            size = pdf["names"].map(len)
            for n, rows in pdf.groupby(size):
                w = _long_only(np.stack([np.asarray(v, float).reshape(n, n) for v in rows["sigma"]]))
                out = {k: np.repeat(rows[k].to_numpy(), n) for k in keys}
                yield pd.DataFrame({**out, "name": np.concatenate([np.asarray(v) for v in rows["names"]]), "weight": w.ravel()})

    types = dict(cov.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"name {types['i']}", "weight double"])
    return cells.mapInPandas(solve, schema)


def rolling_min_variance(pair: DataFrame, window: int = 63, keys: tuple[str, ...] = ("universe",)) -> DataFrame:
    """``w_x`` for two aligned series x, y: shrunk minimum variance over the previous ``window`` rows, used a day later.

    Central moments come from raw-moment frames, so no Python and no per-date loop.
    """
    w = Window.partitionBy(*keys).orderBy("dt")
    near = w.rowsBetween(-window, -1)
    powers = {"x": "x", "y": "y", "xx": "x*x", "yy": "y*y", "xy": "x*y", "xxx": "x*x*x", "yyy": "y*y*y", "xxy": "x*x*y",
              "xyy": "x*y*y", "x4": "x*x*x*x", "y4": "y*y*y*y", "xxyy": "x*x*y*y"}
    df = pair.withColumns({f"_{n}": F.avg(F.expr(e)).over(near) for n, e in powers.items()}).withColumn(
        "_full", F.count(F.lit(1)).over(near) == window)
    df = df.selectExpr("*", "_xx - _x*_x as _sxx", "_yy - _y*_y as _syy", "_xy - _x*_y as _sxy",
                       "_x4 - 4*_x*_xxx + 6*_x*_x*_xx - 3*_x*_x*_x*_x as _qxx",
                       "_y4 - 4*_y*_yyy + 6*_y*_y*_yy - 3*_y*_y*_y*_y as _qyy",
                       "_xxyy - 2*_y*_xxy - 2*_x*_xyy + _y*_y*_xx + _x*_x*_yy + 4*_x*_y*_xy - 3*_x*_x*_y*_y as _qxy")
    df = df.selectExpr("*", "(_sxx + _syy) / 2 as _mu", "(_qxx - _sxx*_sxx) + (_qyy - _syy*_syy) + 2*(_qxy - _sxy*_sxy) as _pi")
    df = df.selectExpr("*", "(_mu - _sxx)*(_mu - _sxx) + (_mu - _syy)*(_mu - _syy) + 2*_sxy*_sxy as _gamma")
    df = df.withColumn("delta", shrinkage(F.col("_pi"), F.col("_gamma"), F.lit(window)))
    mix = lambda s: F.col("delta") * F.col("_mu") + (1 - F.col("delta")) * F.col(s)
    weight = pair_min_variance(mix("_sxx"), (1 - F.col("delta")) * F.col("_sxy"), mix("_syy"))
    df = df.withColumn("_w", F.when(F.col("_full"), weight))
    return df.select(*pair.columns, "delta", F.coalesce(F.lag("_w").over(w), F.lit(0.5)).alias("w_x"))
