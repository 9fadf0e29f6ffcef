"""Point-spread-function fits and photometry of one star in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from .detection import madn, upper_median

WIDTH = 2.3548


def _solve(model: Callable, p: np.ndarray, z: np.ndarray, limits: Callable, rounds: int, tol: float) -> tuple[np.ndarray, float] | None:
    """Damped least squares with Nielsen's update; ``model`` gives values and Jacobian, a row a parameter."""
    f, j = model(p)
    r = z - f
    cost, lam, nu = float(r @ r), 1e-3, 2.0
    for _ in range(rounds):
        a, g = j @ j.T, j @ r
        try:
            step = np.linalg.solve(a + np.diag(lam * np.maximum(a.diagonal(), 1e-12)), g)
        except np.linalg.LinAlgError:
            lam *= 10
            continue
        trial = limits(p + step)
        ft, jt = model(trial)
        rt = z - ft
        new = float(rt @ rt)
        if np.isfinite(new) and new < cost:
            gain = (cost - new) / max(float(step @ (lam * a.diagonal() * step + g)), 1e-30)
            small = np.linalg.norm(step) < tol * max(np.linalg.norm(p), 1e-12) or cost - new < 1e-4 * tol * cost
            p, j, r, cost = trial, jt, rt, new
            lam, nu = lam * max(1 / 3, 1 - (2 * gain - 1) ** 3), 2.0
            if small:
                break
        else:
            lam, nu = lam * nu, nu * 2
            if lam > 1e12:
                break
    return p, cost


def _axes(p, x, y):
    dx, dy, c, s = x - p[2], y - p[3], math.cos(p[6]), math.sin(p[6])
    return dx, dy, c, s, c * dx + s * dy, c * dy - s * dx


def fit_gaussian(stamp: np.ndarray, rounds: int = 50, tol: float = 1e-6) -> dict[str, float] | None:
    """Rotated elliptical Gaussian with a background: widths, centre, angle and relative residual."""
    return _fit(stamp, None, False, rounds, tol)


def fit_moffat(stamp: np.ndarray, beta: float | None = None, rounds: int = 50, tol: float = 1e-6) -> dict[str, float] | None:
    """Rotated elliptical Moffat with a background; a given ``beta`` is held."""
    return _fit(stamp, beta, True, rounds, tol)


def _fit(stamp: np.ndarray, beta: float | None, moffat: bool, rounds: int, tol: float) -> dict[str, float] | None:
    yy, xx = np.indices(stamp.shape)
    x, y, z = xx.ravel().astype(float), yy.ravel().astype(float), stamp.ravel().astype(float)
    edge = np.concatenate([stamp[0], stamp[-1], stamp[:, 0], stamp[:, -1]])
    bg = upper_median(edge)
    v = np.maximum(z - bg - 0.1 * (z.max() - bg), 0)
    if v.sum() <= 0:
        return None
    cx, cy = (v * x).sum() / v.sum(), (v * y).sum() / v.sum()
    size = min(max(math.sqrt(max((v * ((x - cx) ** 2 + (y - cy) ** 2)).sum() / v.sum() / 2, 0.25)), 0.7), 12.0)
    free = moffat and beta is None
    b0 = 3.0 if free or not moffat else beta
    start = size * WIDTH / (2 * math.sqrt(2 ** (1 / b0) - 1)) if moffat else size
    p0 = np.array([bg, z.max() - bg, cx, cy, start, start * 0.95, 0.1, *([3.0] if free else [])])

    def model(p):
        dx, dy, c, s, u, w = _axes(p, x, y)
        qu, qw = (u / p[4]) ** 2, (w / p[5]) ** 2
        q = qu + qw
        if moffat:
            b = p[7] if free else beta
            base = 1 + q
            logs = np.log(base)
            e = np.exp(-b * logs)
            de = -b * e / base  # by q
        else:
            e = np.exp(-q / 2)
            de = -e / 2
        du, dw = 2 * u / p[4] ** 2, 2 * w / p[5] ** 2
        k = p[1] * de
        jac = np.empty((len(p), len(x)))
        jac[0], jac[1] = 1.0, e
        jac[2], jac[3] = k * (s * dw - c * du), k * (-s * du - c * dw)
        jac[4], jac[5], jac[6] = k * qu * (-2 / p[4]), k * qw * (-2 / p[5]), k * (du * w - dw * u)
        if free:
            jac[7] = e * logs * -p[1]
        return p[0] + p[1] * e, jac

    def limits(p):
        p = p.copy()
        p[4:6] = np.clip(np.abs(p[4:6]), 0.3, 5 * start + 5)
        if free:
            p[7] = min(max(p[7], 1.5), 20.0)
        return p

    got = _solve(model, p0, z, limits, rounds, tol)
    if got is None or got[0][1] <= 0:
        return None
    p, cost = got
    b = p[7] if free else beta
    full = 2 * math.sqrt(2 ** (1 / b) - 1) if moffat else WIDTH
    fx, fy, theta = abs(p[4]) * full, abs(p[5]) * full, p[6]
    if fy > fx:
        fx, fy, theta = fy, fx, theta + math.pi / 2
    theta = (theta + math.pi / 2) % math.pi - math.pi / 2
    return {"x": float(p[2]), "y": float(p[3]), "amplitude": float(p[1]), "background": float(p[0]), "fwhm_x": fx, "fwhm_y": fy, "theta": theta, "beta": float(b) if moffat else None, "ecc": math.sqrt(max(1 - (fy / fx) ** 2, 0.0)), "residual": math.sqrt(cost / len(z)) / float(p[1])}


def measure(stamp: np.ndarray, beta: float | None = None) -> dict[str, float] | None:
    """Moffat, else Gaussian, else moments."""
    from .detection import moments

    for kind, fit in (("moffat", lambda: fit_moffat(stamp, beta)), ("gaussian", lambda: fit_gaussian(stamp))):
        got = fit()
        side = stamp.shape[0]
        if got and 0 <= got["x"] < side and 0 <= got["y"] < side and (got["beta"] is None or 1 <= got["beta"] <= 20) and got["fwhm_x"] < 2 * side:
            return got | {"method": kind}
    m = moments(stamp - upper_median(np.concatenate([stamp[0], stamp[-1]])))
    return m and {"x": m["cx"], "y": m["cy"], "amplitude": m["peak"], "background": 0.0, "fwhm_x": m["fwhm"], "fwhm_y": m["fwhm"], "theta": m["theta"], "beta": None, "ecc": m["ecc"], "residual": 1.0, "method": "moments"}


def aperture_snr(img: np.ndarray, x: float, y: float, fwhm: float) -> float:
    """Flux over noise within 1.5 FWHM, on a clipped annulus of 3 to 5 FWHM; 0 where too little is left."""
    ap, inner, outer = max(1.5 * fwhm, 3.0), 3 * fwhm, 5 * fwhm
    if x - outer < 0 or y - outer < 0 or x + outer >= img.shape[1] or y + outer >= img.shape[0]:
        return 0.0
    reach = max(ap, outer)
    x0, y0 = max(math.floor(x - reach), 0), max(math.floor(y - reach), 0)
    win = img[y0 : math.ceil(y + reach) + 1, x0 : math.ceil(x + reach) + 1]
    yy, xx = np.indices(win.shape)
    d = np.hypot(xx + x0 - x, yy + y0 - y)
    inside, ring = win[d <= ap], win[(d >= inner) & (d <= outer)]
    for _ in range(2):
        if len(ring) < 5:
            return 0.0
        m = upper_median(ring)
        s = madn(ring, m)
        if s < 1e-6:
            break
        ring = ring[np.abs(ring - m) <= 3 * s]
    if len(ring) < 5 or not len(inside):
        return 0.0
    m = upper_median(ring)
    flux = float(np.maximum(inside - m, 0).sum())
    noise = flux + len(inside) * madn(ring, m) ** 2
    return flux / math.sqrt(noise) if flux > 0 and noise > 0 else 0.0


def half_flux_radius(stamp: np.ndarray, cx: float, cy: float, radius: float) -> float:
    yy, xx = np.indices(stamp.shape)
    d = np.hypot(xx - cx, yy - cy)
    v = np.where(d <= radius, np.maximum(stamp, 0), 0)
    return float((v * d).sum() / v.sum()) if v.sum() > 0 else 0.0
