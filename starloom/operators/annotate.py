"""Annotation rasters: ellipses with direction ticks as point sets on an RGBA layer, and debug renders."""

from __future__ import annotations

import math

import numpy as np

VERTICES = 64
TICK_ECC = 0.15
MARK = np.array([255, 64, 64], np.uint8)


def line(x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """Pixels of a straight line, one for each step along its longer side."""
    n = max(abs(x1 - x0), abs(y1 - y0))
    t = np.arange(n + 1) / max(n, 1)
    return np.stack([np.floor(x0 + t * (x1 - x0) + 0.5), np.floor(y0 + t * (y1 - y0) + 0.5)], 1).astype(int)


def ellipse(x: float, y: float, major: float, minor: float, theta: float) -> np.ndarray:
    """Pixels of a rotated ellipse drawn through its vertices."""
    a = 2 * math.pi * np.arange(VERTICES + 1) / VERTICES
    u, v = major * np.cos(a), minor * np.sin(a)
    px = np.floor(x + u * math.cos(theta) - v * math.sin(theta) + 0.5).astype(int).tolist()
    py = np.floor(y + u * math.sin(theta) + v * math.cos(theta) + 0.5).astype(int).tolist()
    return np.concatenate([line(*a, *b) for a, b in zip(list(zip(px, py)), list(zip(px, py))[1:], strict=False)])


def thick(points: np.ndarray, width: int) -> np.ndarray:
    """Width 2 adds a pixel on each side, width 3 two."""
    arms = [(0, 0)] + [d for k in range(1, min(width, 3)) for d in ((-k, 0), (k, 0), (0, -k), (0, k))]
    return np.concatenate([points + np.array(a) for a in arms])


def paint(image: np.ndarray, points: np.ndarray, colour) -> None:
    """Sets the points that lie on the image; a fourth channel becomes opaque."""
    h, w, c = image.shape
    p = points[(points[:, 0] >= 0) & (points[:, 0] < w) & (points[:, 1] >= 0) & (points[:, 1] < h)]
    image[p[:, 1], p[:, 0], :3] = colour
    if c == 4:
        image[p[:, 1], p[:, 0], 3] = 255


def outline(x: float, y: float, major: float, minor: float, theta: float, ecc: float, width: int = 1, ticks: bool = True) -> np.ndarray:
    """An ellipse's pixels, with ticks that extend the long axis on both ends of an elongated one."""
    parts = [ellipse(x, y, major, minor, theta)]
    if ticks and ecc > TICK_ECC:
        c, s = math.cos(theta), math.sin(theta)
        for sign in (1, -1):
            at = lambda r: (math.floor(x + sign * r * c + 0.5), math.floor(y + sign * r * s + 0.5))  # noqa: E731, B023
            parts.append(line(*at(major), *at(major * 1.3)))
    return thick(np.concatenate(parts), width)


def layer(annotations: list[dict], width: int, height: int, line_width: int = 1) -> np.ndarray:
    """A transparent (h, w, 4) layer with all annotations; later ones lie above."""
    out = np.zeros((height, width, 4), np.uint8)
    for a in annotations:
        paint(out, outline(a["x"], a["y"], a["semi_major"], a["semi_minor"], a["theta"], a["ecc"], line_width), np.array(a["rgb"], np.uint8))
    return out


def grayscale(img: np.ndarray) -> np.ndarray:
    """(h, w, 3) from the least to the greatest finite value; other pixels are black."""
    good = img[np.isfinite(img)]
    low, high = (good.min(), good.max()) if len(good) else (0.0, 1.0)
    v = np.where(np.isfinite(img), (img - low) / max(high - low, 1e-30) * 255, 0)
    return np.repeat(np.clip(v, 0, 255).astype(np.uint8)[..., None], 3, 2)


def with_markers(img: np.ndarray, points: list[tuple[float, float]], arm: int = 4) -> np.ndarray:
    """The grayscale render with a cross at every point."""
    out = grayscale(img)
    for x, y in points:
        cx, cy = math.floor(x + 0.5), math.floor(y + 0.5)
        paint(out, np.concatenate([line(cx - arm, cy, cx + arm, cy), line(cx, cy - arm, cx, cy + arm)]), MARK)
    return out


def fit_panels(stamp: np.ndarray, model: np.ndarray, zoom: int = 8) -> np.ndarray:
    """Stamp, model and residual side by side, each enlarged."""
    big = [np.kron(grayscale(p)[..., 0], np.ones((zoom, zoom), np.uint8)) for p in (stamp, model, stamp - model)]
    return np.repeat(np.hstack(big)[..., None], 3, 2)
