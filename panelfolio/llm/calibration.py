"""Calibration of scores by isotonic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd


def fit_isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of each block of pool-adjacent-violators on weighted points, and its share at either."""
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []  # first x, last x, sum of n * y, sum of n
    for xi, yi, ni in zip(x[order].tolist(), y[order].tolist(), n[order].tolist()):
        if blocks and xi == blocks[-1][1]:
            blocks[-1] = [xi, xi, blocks[-1][2] + ni * yi, blocks[-1][3] + ni]
        else:
            blocks.append([xi, xi, ni * yi, ni])
    out: list[list[float]] = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            right = out.pop()
            left = out.pop()
            out.append([left[0], right[1], left[2] + right[2], left[3] + right[3]])
    base = (y * n).sum() / n.sum()  # one pseudo-observation a block
    shares = np.maximum.accumulate([(b[2] + base) / (b[3] + 1) for b in out])
    return np.array([end for b in out for end in b[:2]]), np.repeat(shares, 2)


TILT = 0.01


@dataclass
class Curve:
    """Calibrated probabilities ``share`` at rising values ``at``; without points every value is 0.5."""

    at: np.ndarray | None = None
    share: np.ndarray | None = None

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The share of the value's block, on a line from block to block; a hundredth of the result keeps equal shares in order."""
        if self.at is None:
            return np.full(len(x), 0.5)
        return (1 - TILT) * np.interp(x, self.at, self.share) + TILT * (0.5 + 0.5 * x / (np.abs(x) + 0.1))


def curve_of(points: pd.DataFrame, width: float) -> Curve:
    """The curve through (kind, bin, count), ``bin`` being a rounded multiple of ``width``."""
    if not len(points):
        return Curve()
    return Curve(*fit_isotonic(points["bin"].to_numpy(float) * width, points["kind"].to_numpy(float), points["count"].to_numpy(float)))
