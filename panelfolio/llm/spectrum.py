"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

A factorisation P(V - shift I)P' = L D L' with blocks of one or two rows has as many positive, negative and zero
eigenvalues as its D, so it counts the eigenvalues above a shift. Bisection on these counts isolates each leading
eigenvalue, Rayleigh quotient iteration converges on it cubically, and two counts beside the result certify its number.
The matrix is dimension by dimension; the rows it was gathered from are never here.
"""

from __future__ import annotations

import numpy as np

ALPHA = (1 + 17**0.5) / 8  # the bound on growth of the pivoting rule
EPS = np.finfo(float).eps


def pivots(a: np.ndarray) -> list[np.ndarray]:
    """The blocks of D in L D L' of a symmetric matrix, by Bunch-Kaufman pivoting."""
    a = a.copy()
    blocks: list[np.ndarray] = []
    while len(a):
        column = np.abs(a[1:, 0])
        size = 1
        if len(column) and column.max() > 0:
            r = 1 + int(column.argmax())
            away = np.abs(a[r])
            away[r] = 0
            if abs(a[0, 0]) < ALPHA * column.max() and abs(a[0, 0]) * away.max() < ALPHA * column.max() ** 2:
                if abs(a[r, r]) >= ALPHA * away.max():
                    swap(a, 0, r)
                else:
                    swap(a, 1, r)
                    size = 2
        d, low = a[:size, :size].copy(), a[size:, :size]
        blocks.append(d)
        if size == 1:
            a = a[1:, 1:] - (np.outer(low, low) / d[0, 0] if d[0, 0] != 0 else 0)
        else:
            a = a[2:, 2:] - low @ np.linalg.solve(d, low.T)
        a = (a + a.T) / 2
    return blocks


def swap(a: np.ndarray, i: int, j: int) -> None:
    a[[i, j]] = a[[j, i]]
    a[:, [i, j]] = a[:, [j, i]]


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues are greater than ``shift``, by inertia."""
    n = 0
    for d in pivots(v - shift * np.eye(len(v))):
        if len(d) == 1:
            n += d[0, 0] > 0
        elif d[0, 0] * d[1, 1] - d[0, 1] ** 2 < 0:
            n += 1
        else:
            n += 2 * (d[0, 0] + d[1, 1] > 0)
    return int(n)


def _iterate(v: np.ndarray, start: np.ndarray, shift: float, found: np.ndarray, scale: float) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration in the complement of ``found``: two steps at the given shift, then at the quotient."""
    project = lambda x: x - found.T @ (found @ x)
    unit = lambda x: x / np.linalg.norm(x)
    x = unit(project(project(start)))
    value, rest = shift, np.inf
    for step in range(30):
        try:
            y = np.linalg.solve(v - value * np.eye(len(v)), x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            y = np.linalg.solve(v - (value + EPS * scale) * np.eye(len(v)), x)
        if not np.isfinite(y).all():
            break
        x = unit(project(project(unit(y))))
        quotient = float(x @ v @ x)
        before, rest = rest, float(np.linalg.norm(v @ x - quotient * x))
        if step >= 1:
            value = quotient
        if rest <= 4 * EPS * scale or (step > 4 and rest >= before):
            break
    return float(x @ v @ x), x, rest


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues, falling, and their unit eigenvectors as rows.

    The largest entry of each vector (the first of equals) is positive. Equal eigenvalues get orthogonal vectors of their
    space. A matrix without rows has none.
    """
    n = len(v)
    scale = float(np.abs(v).sum(axis=1).max()) if n else 0.0  # no eigenvalue is larger
    values, vectors = np.zeros(0), np.zeros((0, n))
    wide = 64 * n * EPS * scale
    for k in range(1, min(wanted, n) + 1):
        if scale == 0:  # all eigenvalues are 0 and every vector belongs to them
            values, vectors = np.append(values, 0.0), np.vstack([vectors, np.eye(n)[k - 1]])
            continue
        low, high = -scale * (1 + n * EPS), scale * (1 + n * EPS)  # above(low) >= k > above(high)
        n_low, n_high = n, 0
        while True:
            alone = n_low == k and n_high == k - 1
            narrow = high - low <= wide
            if (alone and high - low <= 0.05 * max(abs(low), abs(high))) or narrow:
                start = np.cos(np.arange(1, n + 1) * (1.0 + 0.37 * k))  # no special direction
                value, vector, rest = _iterate(v, start, (low + high) / 2, vectors, scale)
                certified = rest <= wide and above(v, value - wide) >= k and above(v, value + wide) <= k - 1
                if certified or high - low <= 4 * EPS * scale:
                    break
            middle = (low + high) / 2
            if not low < middle < high:
                break
            count = above(v, middle)
            if count >= k:
                low, n_low = middle, count
            else:
                high, n_high = middle, count
        vector = vector * np.sign(vector[np.abs(vector).argmax()])
        values, vectors = np.append(values, value), np.vstack([vectors, vector])
    return values, vectors
