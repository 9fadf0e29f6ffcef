"""Plane transforms on columns, and what is checked or read from fitted ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKEW = (0.9, 1.1)
GREEN, YELLOW, RED = [0, 255, 0], [255, 255, 0], [255, 64, 64]


def affine(p: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Six coefficients, row by row."""
    return p[0] * x + p[1] * y + p[2], p[3] * x + p[4] * y + p[5]


def homography(p: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Eight coefficients; the ninth is 1."""
    w = p[6] * x + p[7] * y + 1.0
    return (p[0] * x + p[1] * y + p[2]) / w, (p[3] * x + p[4] * y + p[5]) / w


def pixel_transform(model: str, p: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A fitted model applied to pixels; distortion terms belong to sky solutions and leave pixels where they are."""
    return {"affine": affine, "projective": homography, "sip": lambda _, x, y: (x, y)}[model](p, x, y)


def scales(a1: Column, b1: Column, a2: Column, b2: Column) -> tuple[Column, Column, Column]:
    """(scale along x, scale along y, rotation in radians) of an affine transform."""
    return F.sqrt(a1 * a1 + b1 * b1), F.sqrt(a2 * a2 + b2 * b2), F.atan2(-b1, a1)


def sane(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """Whether the squared scales of both axes agree within the band that optics allow."""
    sx, sy = a1 * a1 + b1 * b1, a2 * a2 + b2 * b2
    return (sy >= 1e-30) & (sx / sy).between(*SKEW)


def wide(coefficients: DataFrame, names: str = "a1 b1 c1 a2 b2 c2") -> DataFrame:
    """One row of named coefficients from (pos, value); no row if there is none."""
    cols = [F.max(F.when(F.col("pos") == k, F.col("value"))).alias(n) for k, n in enumerate(names.split())]
    return coefficients.agg(*cols).where(F.col(names.split()[0]).isNotNull())


def first_of_each(points: DataFrame, order: list[str], epsilon: float) -> DataFrame:
    """Of points (cx, cy) whose rounded centres agree, the first in the given order."""
    at = [F.round(F.col(c) / epsilon).cast("long").alias(f"_{c}") for c in ("cx", "cy")]
    first = F.row_number().over(Window.partitionBy("_cx", "_cy").orderBy(*order))
    return points.select("*", *at).withColumn("_first", first).where("_first = 1").drop("_cx", "_cy", "_first")


def field_centre(sky: DataFrame) -> DataFrame:
    """One row (ra, dec): the upper medians, each on its own; right ascensions are not wrapped."""
    middle = lambda c: sky.groupBy(c).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(c)))
    total = sky.agg(F.count("*").alias("total"))
    one = lambda c: middle(c).crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min(c).alias(c))  # noqa: E731  one row
    return one("ra").crossJoin(one("dec"))


def _colour(*branches: tuple[Column, list[int]]) -> Column:
    out = F.lit(None).cast("array<int>")
    for test, rgb in reversed(branches):
        out = F.when(test, F.array(*map(F.lit, rgb))).otherwise(out)
    return out


def colour(scheme: str, ecc: Column, fwhm: Column, median_fwhm: Column, good: float, warn: float) -> Column:
    """RGB of a star: all green, by eccentricity, or by its width over the field's."""
    if scheme == "uniform":
        return _colour((F.lit(True), GREEN))
    if scheme == "eccentricity":
        return _colour((ecc <= good, GREEN), (ecc <= warn, YELLOW), (F.lit(True), RED))
    if scheme == "fwhm":
        ratio = fwhm / median_fwhm
        return _colour((median_fwhm <= 0, GREEN), (ratio < good, GREEN), (ratio < warn, YELLOW), (F.lit(True), RED))
    raise ValueError(f"no colour scheme {scheme!r}")


def moffat(amplitude: Column, cx: Column, cy: Column, ax: Column, ay: Column, theta: Column, beta: Column, background: Column, x: Column, y: Column) -> Column:
    """A rotated elliptical Moffat profile at a pixel."""
    return background + amplitude * F.pow(1 + _radius2(cx, cy, ax, ay, theta, x, y), -beta)


def gaussian(amplitude: Column, cx: Column, cy: Column, sx: Column, sy: Column, theta: Column, background: Column, x: Column, y: Column) -> Column:
    """A rotated elliptical Gaussian profile at a pixel."""
    return background + amplitude * F.exp(-0.5 * _radius2(cx, cy, sx, sy, theta, x, y))


def _radius2(cx: Column, cy: Column, ax: Column, ay: Column, theta: Column, x: Column, y: Column) -> Column:
    u = F.cos(theta) * (x - cx) + F.sin(theta) * (y - cy)
    w = F.cos(theta) * (y - cy) - F.sin(theta) * (x - cx)
    return (u / ax) * (u / ax) + (w / ay) * (w / ay)
