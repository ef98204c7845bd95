"""A small interior-point solver for convex quadratic programs (a linear one has no quadratic term)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEPS = 100


@dataclass
class Solution:
    """``x``; ``gap``: duality gap; ``residual``: largest violation of the optimality conditions, both over the size of the problem's numbers."""

    x: np.ndarray
    gap: float
    residual: float


def solve(q: np.ndarray, c: np.ndarray, g: np.ndarray, h: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None, tolerance: float = 1e-11) -> Solution:
    """The minimum of x'qx / 2 + c'x where g x <= h and a x = b.

    Predictor and corrector steps on the perturbed optimality conditions; q is positive
    semidefinite.  The best iterate is returned with its gap and residual, by which the
    caller can tell whether it is optimal.
    """
    n, m = len(c), len(h)
    a = np.zeros((0, n)) if a is None else np.atleast_2d(a)
    b = np.zeros(0) if b is None else np.atleast_1d(b)
    unit = max(np.abs(c).max(initial=0), np.abs(q).max(initial=0), 1e-300)
    q, c = q / unit, c / unit
    size = 1 + max(np.abs(c).max(initial=0), np.abs(h).max(initial=0), np.abs(b).max(initial=0))
    x, y = np.zeros(n), np.zeros(len(b))
    s, z = np.maximum(h - g @ x, 1.0), np.ones(m)
    best = Solution(x, np.inf, np.inf)
    for _ in range(STEPS):
        dual, primal, slack = q @ x + c + g.T @ z + a.T @ y, a @ x - b, g @ x + s - h
        gap = float(s @ z)
        residual = max(np.abs(dual).max(initial=0), np.abs(primal).max(initial=0), (g @ x - h).max(initial=0), float((s * z).max(initial=0))) / size
        if residual < best.residual:
            best = Solution(x.copy(), abs(gap) / size, residual)
        if max(residual, gap / size) < tolerance:
            break
        weight = z / s
        kkt = np.block([[q + (g.T * weight) @ g + 1e-14 * np.eye(n), a.T], [a, -1e-14 * np.eye(len(b))]])

        def step(target: np.ndarray) -> tuple[np.ndarray, ...]:
            """Newton step towards s z = target."""
            right = np.concatenate([-dual - g.T @ (weight * slack + (target - s * z) / s), -primal])
            d = np.linalg.solve(kkt, right)
            d += np.linalg.solve(kkt, right - kkt @ d)
            dx, dy = d[:n], d[n:]
            ds = -slack - g @ dx
            return dx, dy, ds, (target - s * z - z * ds) / s

        def room(v: np.ndarray, dv: np.ndarray) -> float:
            return min(1.0, float((-v[dv < 0] / dv[dv < 0]).min(initial=np.inf)))

        try:
            _, _, ds, dz = step(np.zeros(m))
            reach = min(room(s, ds), room(z, dz))
            after = float((s + reach * ds) @ (z + reach * dz))
            centre = (max(after, 0.0) / gap) ** 3 * gap / m if gap > 0 else 0.0
            dx, dy, ds, dz = step(centre - ds * dz)
        except np.linalg.LinAlgError:
            break
        reach = 0.995 * min(room(s, ds), room(z, dz)) if m else 1.0
        x, y, s, z = x + reach * dx, y + reach * dy, s + reach * ds, z + reach * dz
        if not np.isfinite(x).all() or s.min(initial=1) <= 0 or z.min(initial=1) <= 0:
            break
    return best


def box(n: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """g and h of low <= x <= high."""
    return np.vstack([-np.eye(n), np.eye(n)]), np.concatenate([np.full(n, -low), np.full(n, high)])
