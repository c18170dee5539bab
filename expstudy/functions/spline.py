"""Natural cubic spline basis compiled to a Spark CASE expression (MOD-6).

The basis is the standard natural-spline construction without intercept:
cubic B-splines on the knots plus four-fold boundary knots, the first column
dropped, then projected onto the null space of the second-derivative
constraints at both boundary knots (the trailing columns of the complete
Householder QR of the constraint matrix).  Beyond the boundary the basis
continues linearly.

Evaluation happens once on the driver with numpy, only to turn the basis into
cubic polynomials per knot interval; rows are evaluated on executors by a
CASE with Horner polynomials, inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _bspline(knots: np.ndarray, x: np.ndarray, order: int = 4, deriv: int = 0) -> np.ndarray:
    """B-spline basis (or its derivative) of ``order`` at points ``x``.

    Intervals are closed on the left, except the last one, which is closed on
    both sides so that the right boundary knot is inside.
    """
    x = np.asarray(x, dtype=float)
    t = np.asarray(knots, dtype=float)
    n_basis = len(t) - order
    lo, hi = t[order - 1], t[n_basis]
    # order-1 (piecewise constant) basis
    b = np.zeros((len(x), len(t) - 1))
    for i in range(len(t) - 1):
        if t[i] < t[i + 1]:
            inside = (x >= t[i]) & (x < t[i + 1])
            if t[i + 1] == hi:
                inside = inside | (x == hi)
            b[:, i] = inside
    for k in range(2, order + 1):
        nb = np.zeros((len(x), len(t) - k))
        use_deriv = deriv > 0 and k > order - deriv
        for i in range(len(t) - k):
            d1 = t[i + k - 1] - t[i]
            d2 = t[i + k] - t[i + 1]
            if use_deriv:
                a = (k - 1) * b[:, i] / d1 if d1 > 0 else 0.0
                c = (k - 1) * b[:, i + 1] / d2 if d2 > 0 else 0.0
            else:
                a = (x - t[i]) / d1 * b[:, i] if d1 > 0 else 0.0
                c = (t[i + k] - x) / d2 * b[:, i + 1] if d2 > 0 else 0.0
            nb[:, i] = a - c if use_deriv else a + c
        b = nb
    del lo
    return b[:, :n_basis]


@dataclass(frozen=True)
class NaturalSpline:
    """Natural cubic spline basis with interior ``knots`` and ``boundary`` knots."""

    knots: tuple
    boundary: tuple

    def __post_init__(self):
        if len(self.boundary) != 2 or not self.boundary[0] < self.boundary[1]:
            raise ValueError("boundary needs two increasing knots")

    @property
    def n_columns(self) -> int:
        return len(self.knots) + 1

    def _all_knots(self) -> np.ndarray:
        b1, b2 = self.boundary
        return np.array([b1] * 4 + sorted(self.knots) + [b2] * 4, dtype=float)

    def _projection(self) -> np.ndarray:
        t = self._all_knots()
        const = _bspline(t, np.array(self.boundary, dtype=float), 4, deriv=2)[:, 1:]
        q, _ = np.linalg.qr(const.T, mode="complete")
        return q[:, 2:]

    def evaluate(self, x) -> np.ndarray:
        """Basis values at ``x`` (numpy), linear beyond the boundary knots."""
        x = np.asarray(x, dtype=float)
        t = self._all_knots()
        proj = self._projection()
        b1, b2 = self.boundary
        out = np.zeros((len(x), self.n_columns))
        inside = (x >= b1) & (x <= b2)
        if inside.any():
            out[inside] = _bspline(t, x[inside], 4)[:, 1:] @ proj
        for side, pivot in ((x < b1, b1), (x > b2, b2)):
            if side.any():
                v = _bspline(t, np.array([pivot]), 4)[:, 1:] @ proj
                d = _bspline(t, np.array([pivot]), 4, deriv=1)[:, 1:] @ proj
                out[side] = v + (x[side] - pivot)[:, None] * d
        return out

    def pieces(self):
        """Per column: left linear piece, cubic pieces per interval, right linear piece.

        Returns ``(breaks, cubic, left, right)`` where ``breaks`` are the interval
        starts, ``cubic[j][i]`` the 4 coefficients of column ``j`` on interval
        ``i`` in powers of ``x - breaks[i]``, and ``left``/``right`` the
        ``(value, slope)`` at the boundary knots.
        """
        b1, b2 = self.boundary
        edges = [b1] + sorted(k for k in self.knots if b1 < k < b2) + [b2]
        cubic = [[None] * (len(edges) - 1) for _ in range(self.n_columns)]
        for i in range(len(edges) - 1):
            lo, hi = edges[i], edges[i + 1]
            xs = lo + (hi - lo) * np.array([0.0, 1 / 3, 2 / 3, 1.0])
            vals = self.evaluate(xs)
            vander = np.vander(xs - lo, 4, increasing=True)
            coef = np.linalg.solve(vander, vals)
            for j in range(self.n_columns):
                cubic[j][i] = [float(c) for c in coef[:, j]]
        t = self._all_knots()
        proj = self._projection()
        ends = []
        for pivot in (b1, b2):
            v = (_bspline(t, np.array([pivot]), 4)[:, 1:] @ proj)[0]
            d = (_bspline(t, np.array([pivot]), 4, deriv=1)[:, 1:] @ proj)[0]
            ends.append([(float(v[j]), float(d[j])) for j in range(self.n_columns)])
        return edges[:-1], cubic, ends[0], ends[1]

    def columns(self, x: Column) -> list[Column]:
        """One Spark Column per basis column; NULL in, NULL out."""
        breaks, cubic, left, right = self.pieces()
        return [self._piecewise(x, breaks, *column) for column in zip(cubic, left, right, strict=True)]

    def weighted(self, x: Column, weights: Mapping[int, float]) -> Column:
        """The sum of the basis columns by ``weights`` (by column number) as one piecewise cubic; NULL in, NULL out."""
        breaks, *parts = self.pieces()
        at, w = list(weights), np.array(list(weights.values()))
        return self._piecewise(x, breaks, *((w @ np.array(part)[at].reshape(len(at), -1)).reshape(np.array(part[0]).shape).tolist()
                                            for part in parts))

    def _piecewise(self, x: Column, breaks, cubic, left, right) -> Column:
        """A cubic per interval and a linear piece on either side."""
        b1, b2 = self.boundary
        (v1, s1), (v2, s2) = left, right
        expr = F.when(x.isNull(), F.lit(None).cast("double")).when(x < F.lit(b1), F.lit(v1) + F.lit(s1) * (x - F.lit(b1)))
        for i, lo in enumerate(breaks):
            c0, c1, c2, c3 = cubic[i]
            d = x - F.lit(lo)
            poly = F.lit(c0) + d * (F.lit(c1) + d * (F.lit(c2) + d * F.lit(c3)))
            expr = expr.when(x < F.lit(breaks[i + 1]) if i + 1 < len(breaks) else x <= F.lit(b2), poly)
        return expr.otherwise(F.lit(v2) + F.lit(s2) * (x - F.lit(b2)))
