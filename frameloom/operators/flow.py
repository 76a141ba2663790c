"""Dense optical flow by polynomial expansion: two frames are fitted with quadratics around each pixel, whose shift is solved for.

Around each pixel f(x) ~ c + b x + x' A x, by least squares under Gaussian weights. A shift d turns (A, b) to (A, b - 2 A d), so
d solves A d = -(b2 - b1) / 2; it is found from sums over a window, from a guess that coarser levels give (Farnebäck 2003).
"""

from __future__ import annotations

import numpy as np

#: Levels of a pyramid are no smaller than this.
SMALLEST = 32
DAMP = 1e-3
#: Pixels from the border within which fits count so little.
BORDER, FAINT = 3, 1e-3


def gaussian(radius: int, sigma: float) -> np.ndarray:
    g = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    return g / g.sum()


def along(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with a kernel along an axis, the border repeated."""
    r = len(kernel) // 2
    p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(a.ndim)], mode="edge")
    n = a.shape[axis]
    return sum(w * np.take(p, range(k, k + n), axis=axis) for k, w in enumerate(kernel) if w)


def expansion(picture: np.ndarray, radius: int = 5, sigma: float = 1.2) -> np.ndarray:
    """(height, width, 6): the fit's constant, x, y, x^2, y^2 and xy coefficients around each pixel."""
    f, g, x = picture.astype(float), gaussian(radius, sigma), np.arange(-radius, radius + 1)
    down = [along(f, g * x**k, 0) for k in range(3)]
    m = {(i, j): along(down[j], g * x**i, 1) for i, j in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))}
    m2, m4 = float(g @ x**2), float(g @ x**4)
    # the normal equations part into the odd terms and those of 1, x^2 and y^2
    even = np.linalg.inv(np.array([[1, m2, m2], [m2, m4, m2 * m2], [m2, m2 * m2, m4]]))
    c, xx, yy = (sum(w * m[k] for w, k in zip(row, ((0, 0), (2, 0), (0, 2)))) for row in even)
    return np.stack([c, m[1, 0] / m2, m[0, 1] / m2, xx, yy, m[1, 1] / (m2 * m2)], axis=-1)


def sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a at places between its pixels; beyond its border that is repeated."""
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[..., None], (x - x0)[..., None]
    a = a if a.ndim == 3 else a[..., None]
    out = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
    return out if out.shape[-1] > 1 else out[..., 0]


def scaled(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """a in another size, by its centres."""
    y, x = (np.arange(height) + 0.5) * a.shape[0] / height - 0.5, (np.arange(width) + 0.5) * a.shape[1] / width - 0.5
    return sampled(a, *np.meshgrid(y, x, indexing="ij"))


def averaged(a: np.ndarray, window: int) -> np.ndarray:
    k = np.full(window, 1 / window)
    return along(along(a, k, 0), k, 1)


def trust(y: np.ndarray, x: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """How much a fit around (y, x) counts: little where it leans on the repeated border, which doesn't move; nothing outside."""
    inside = np.minimum(np.minimum(y, shape[0] - 1 - y), np.minimum(x, shape[1] - 1 - x))
    return np.where(inside < 0, 0.0, np.where(inside < BORDER, FAINT, 1.0))


def refined(one: np.ndarray, two: np.ndarray, dy: np.ndarray, dx: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A better guess of the shift (dy, dx) between two expansions."""
    y, x = np.mgrid[: one.shape[0], : one.shape[1]].astype(float)
    to_y, to_x = y + dy, x + dx
    other = sampled(two, to_y, to_x)
    weight = trust(y, x, one.shape) * trust(to_y, to_x, one.shape)
    _, _, _, xx, yy, xy = np.moveaxis((one + other) / 2, -1, 0)
    xy = xy / 2
    bx, by = ((one[..., k] - other[..., k]) / 2 for k in (1, 2))
    bx, by = bx + xx * dx + xy * dy, by + xy * dx + yy * dy
    # A'A and A'b, averaged over the window
    mean = lambda v: averaged(v * weight, window)
    g11, g12, g22 = mean(xx * xx + xy * xy), mean(xy * (xx + yy)), mean(yy * yy + xy * xy)
    h1, h2 = mean(xx * bx + xy * by), mean(xy * bx + yy * by)
    det = g11 * g22 - g12 * g12 + DAMP
    return (g11 * h2 - g12 * h1) / det, (g22 * h1 - g12 * h2) / det


def polynomial_flow(before: np.ndarray, after: np.ndarray, levels: int = 3, window: int = 15, rounds: int = 3, radius: int = 5, sigma: float = 1.2) -> tuple[np.ndarray, np.ndarray]:
    """(dx, dy): where each pixel of before went, coarse to fine."""
    a, b = before.astype(float), after.astype(float)
    height, width = a.shape
    deepest = max([k for k in range(levels) if min(height, width) >> k >= SMALLEST], default=0)
    dy = dx = None
    for k in range(deepest, -1, -1):
        h, w = max(1, round(height / 2**k)), max(1, round(width / 2**k))
        spread = (2**k - 1) * 0.5
        blur = gaussian(max(1, round(spread * 2.5)), spread) if k else np.ones(1)
        one, two = (expansion(scaled(along(along(p, blur, 0), blur, 1), h, w), radius, sigma) for p in (a, b))
        dy, dx = (np.zeros((h, w)),) * 2 if dy is None else (scaled(dy, h, w) * 2, scaled(dx, h, w) * 2)
        for _ in range(rounds):
            dy, dx = refined(one, two, dy, dx, window)
    return dx, dy
