"""Largest eigenpairs of a real symmetric matrix by FEAST contour integration.

The spectrum is cut into intervals of a few eigenvalues each by inertia counts: the signs of the
pivots of a symmetric factorisation of V - s I tell how many eigenvalues lie above s. Per interval a
block of vectors is filtered by the contour integral of the resolvent around the interval, with
Gauss-Legendre nodes on the upper half circle (the lower half is its conjugate), so a filter step is
a few complex shifted solves. Rayleigh-Ritz on the filtered block gives the pairs; steps repeat until
the residuals of all pairs inside are at rounding level and there are as many as inertia counted.
"""

from __future__ import annotations

import numpy as np

NODES = 12
PER_INTERVAL = 8
STEPS = 40
# A gap this share of an interval's extent ends it well.
WIDE = 0.1
# Residual, and the width below which eigenvalues count as one, in units of the largest row sum.
RESIDUAL, SAME = 4e-15, 1e-13


class ConvergenceError(ArithmeticError):
    """An interval whose pairs did not reach the residual, or fewer than inertia counts."""


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the spectrum of ``v``, by Householder reflections."""
    a = np.array(v, np.float64)
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if not np.abs(x[1:]).max():
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ x, x)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy()


class Inertia:
    """Counts of eigenvalues above shifts, for one matrix.

    The factorisation L D L' of V - s I has as many positive pivots as V has eigenvalues above s. It
    is done on the tridiagonal form, where it is a recurrence over the diagonal, for many shifts at once.
    """

    def __init__(self, v: np.ndarray):
        self.diagonal, off = tridiagonal(v)
        self.squares = off * off
        self.least = np.finfo(np.float64).tiny / np.finfo(np.float64).eps

    def above(self, shifts: np.ndarray) -> np.ndarray:
        shifts = np.asarray(shifts, np.float64)
        positive = np.zeros(shifts.shape, np.int64)
        pivot = np.ones(shifts.shape)
        for k, value in enumerate(self.diagonal):
            pivot = value - shifts - (self.squares[k - 1] / pivot if k else 0.0)
            pivot = np.where(np.abs(pivot) < self.least, -self.least, pivot)
            positive += pivot > 0
        return positive

    def eigenvalue(self, rank: int, low: float, high: float) -> float:
        """The eigenvalue number ``rank`` from the top in [low, high], up to ``SAME`` of the interval."""
        bottom, top = low, high
        while top - bottom > SAME * (high - low):
            grid = np.linspace(bottom, top, 66)[1:-1]
            below = int((self.above(grid) >= rank).sum())
            step = (top - bottom) / 65
            bottom, top = max(bottom, bottom + (below - 0.01) * step), min(top, bottom + (below + 1.01) * step)
        return (bottom + top) / 2


def intervals(v: np.ndarray, wanted: int, most: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, count) from the top; together at least ``wanted`` eigenvalues.

    An interval ends in a gap that is wide for its extent, at the last one among its first ``most``
    eigenvalues, and reaches half way into the smaller of the gaps at its ends. It holds more only if
    so many agree that no gap is among them. The counts at both ends are inertia's.
    """
    d = len(v)
    size = float(np.abs(v).sum(1).max(initial=0.0)) or 1.0
    counts, edge, known = Inertia(v), size * (1 + 1e-9), {}

    def value(rank: int) -> float:
        if rank not in known:
            known[rank] = counts.eigenvalue(rank, -edge, edge) if 1 <= rank <= d else -np.inf
        return known[rank]

    got, gap_above, out = 0, np.inf, []
    while got < min(wanted, d):
        best, rank = 0.0, d
        for r in range(got + 1, d + 1):
            gap, extent = value(r) - value(r + 1), value(got + 1) - value(r)
            if gap > 8 * SAME * size:
                share = gap / max(extent, SAME * size)
                if share >= WIDE or share > best:
                    best, rank = min(share, WIDE), r
            if r - got >= most and best:
                break
        gap = value(rank) - value(rank + 1)
        margin = min(gap, gap_above) / 2
        if not np.isfinite(margin):
            margin = size
        low, high = value(rank) - margin, value(got + 1) + margin
        above_low, above_high = counts.above(np.array([low, high]))
        out.append((low, high, int(above_low - above_high)))
        got, gap_above = rank, gap
    return out


def _filter(v: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
    """The contour integral of the resolvent around [low, high] applied to ``y``."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    middle, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(y)
    for node, weight in zip(x, w, strict=True):
        turn = np.exp(1j * np.pi / 2 * (1 - node))
        z = middle + radius * turn
        out += 0.5 * weight * (radius * turn * np.linalg.solve(z * np.eye(len(v)) - v, y.astype(complex))).real
    return out


def _inside(v: np.ndarray, low: float, high: float, count: int, size: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs in (low, high]."""
    d = len(v)
    width = min(d, count + max(4, count // 2))
    y = np.random.default_rng(count).standard_normal((d, width))
    worst = np.inf
    for step in range(STEPS):
        q, _ = np.linalg.qr(_filter(v, y, low, high))
        values, small = np.linalg.eigh(q.T @ v @ q)
        y = q @ small
        residuals = np.linalg.norm(v @ y - y * values, axis=0)
        # a Ritz value inside without a small residual is a mixture of pairs outside
        own = (values > low) & (values <= high) & (residuals <= RESIDUAL * size * np.sqrt(d))
        residual = residuals[own].max(initial=0.0)
        if own.sum() == count:
            if residual >= worst / 2 or step == STEPS - 1:  # no step improves it any more
                return values[own], y[:, own]
            worst = residual
    raise ConvergenceError(f"{int(own.sum())} of {count} eigenpairs in [{low}, {high}], residual {residual}")


def largest(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors as columns (all, if there are fewer)."""
    d = len(v)
    if not d or not wanted:
        return np.zeros(0), np.zeros((d, 0))
    size = float(np.abs(v).sum(1).max())
    if not size:
        return np.zeros(min(wanted, d)), np.eye(d)[:, :wanted]
    v = v / size
    cuts = intervals(v, wanted)
    if sum(n for *_, n in cuts) != Inertia(v).above(np.array([cuts[-1][0]]))[0]:
        raise ConvergenceError("an eigenvalue lies between the intervals")
    pairs = [_inside(v, low, high, n, 1.0) for low, high, n in cuts]
    values, vectors = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs], 1)
    order = np.argsort(-values, kind="stable")[:wanted]
    # vectors of neighbouring intervals are orthogonal to rounding only; one pass takes that out
    q, r = np.linalg.qr(vectors[:, order])
    return values[order] * size, q * np.sign(np.diagonal(r))
