"""Leading eigenvalues and eigenvectors of a symmetric matrix of a few thousand
rows at most: Householder tridiagonalisation, bisection on Sturm counts,
inverse iteration with reorthogonalisation inside clusters."""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
#: Eigenvalues nearer than this share of the norm are one cluster.
CLUSTER = 1e-3


def tridiagonal(matrix: np.ndarray):
    """Diagonal, off-diagonal and the reflectors ``v`` (one per column, of
    unit length) with ``Q = H(0) H(1) ...`` and ``matrix = Q T Q'``."""
    a = np.array(matrix, float)
    n = len(a)
    reflectors = np.zeros((n, n))
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        length = np.linalg.norm(x)
        if np.linalg.norm(x[1:]) == 0:
            continue  # already zero below the off-diagonal
        x[0] += np.copysign(length, x[0])
        v = x / np.linalg.norm(x)
        reflectors[k + 1:, k] = v
        block = a[k + 1:, k + 1:]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * (v @ a[k + 1:, k]) * v
        a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each ``x``: the negative terms of
    the Sturm sequence."""
    tiny = _EPS * max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), 1e-300) * _EPS
    q = np.ones_like(x)
    count = np.zeros(len(x), int)
    for i, d in enumerate(diagonal):
        q = d - x - (off[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its interval
    cannot be halved any more."""
    n = len(diagonal)
    radius = np.zeros(n)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    margin = 2 * _EPS * max(np.abs(diagonal).max(), radius.max(), 1e-300) * n
    low = np.full(k, (diagonal - radius).min() - margin)
    high = np.full(k, (diagonal + radius).max() + margin)
    rank = n - 1 - np.arange(k)  # eigenvalues below the wanted one
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        less = below(diagonal, off, middle) > rank
        high = np.where(less, middle, high)
        low = np.where(less, low, middle)
    return (low + high) / 2


def _solve(diagonal, off, shift, rhs):
    """(T - shift) x = rhs, by elimination with row exchanges."""
    n = len(diagonal)
    tiny = _EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300)
    d, up, up2, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), rhs.copy()
    for i in range(n - 1):
        low = off[i]
        if abs(d[i]) >= abs(low):
            if d[i] == 0:
                d[i] = tiny
            f = low / d[i]
            d[i + 1] -= f * up[i]
            x[i + 1] -= f * x[i]
        else:
            f = d[i] / low
            d[i], next_d = low, d[i + 1]
            d[i + 1], next_up = up[i] - f * next_d, up[i + 1]
            up[i], up2[i], up[i + 1] = next_d, next_up, -f * next_up
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    if abs(d[-1]) < tiny:
        d[-1] = tiny
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= up[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= up2[i] * x[i + 2]
        x[i] /= d[i] if abs(d[i]) >= tiny else tiny
        if abs(x[i]) > 1e150:  # only the direction counts
            x /= abs(x[i])
    return x


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one column per value
    (falling), orthogonal within each cluster of values."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300)
    out = np.zeros((n, len(values)))
    rng = np.random.default_rng(0)
    first, shift = 0, None
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # equal values get shifts of their own, else all would give one vector
        shift = value if j == first else min(value, shift - 10 * _EPS * norm)
        x = rng.uniform(-1, 1, n)
        mates = out[:, first:j]
        for _ in range(6):
            x = _solve(diagonal, off, shift, x / np.linalg.norm(x))
            x /= np.linalg.norm(x)
            for _ in range(2):
                x -= mates @ (mates.T @ x)
                x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading(matrix: np.ndarray, k: int):
    """The k largest eigenvalues (falling) and their unit eigenvectors as
    columns; the largest entry of each is positive, so reruns agree."""
    scale = np.abs(matrix).max(initial=0)
    n = len(matrix)
    k = min(k, n)
    if not scale or not k:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    out = vectors(diagonal, off, values)
    for j in range(n - 3, -1, -1):
        v = reflectors[:, j]
        out -= 2 * np.outer(v, v @ out)
    out *= np.sign(out[np.abs(out).argmax(0), np.arange(k)])
    return values * scale, out
