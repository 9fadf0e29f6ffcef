"""Robust statistics as column expressions.

Arrays hold one frame's or one cell's values, whose number the frame bounds;
medians of groups of any size use a mergeable aggregate instead (``median_of``),
those of whole images ``operators.pixels.whole_median``.
The median here is the upper one: element n div 2 of the sorted values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def median_of(column: str) -> Column:
    """Upper median as an aggregate of value counts, combined before the exchange; exact up to 5e8 rows a group."""
    return F.expr(f"percentile_disc(0.500000001D) WITHIN GROUP (ORDER BY {column})")


def values(column: str | Column) -> Column:
    """One group's sorted values as an array."""
    return F.sort_array(F.collect_list(column))


def upper_median(a: Column) -> Column:
    """Of a sorted array; 0 if it is empty."""
    return F.coalesce(F.get(a, F.floor(F.size(a) / 2).cast("int")), F.lit(0.0))


def deviations(a: Column, m: Column) -> Column:
    return F.sort_array(F.transform(a, lambda x: F.abs(x - m)))


def madn(a: Column, m: Column | None = None) -> Column:
    """1.4826 times the upper median of the distances from the upper median."""
    return MAD_SCALE * upper_median(deviations(a, upper_median(a) if m is None else m))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clipped(a: Column, kappa: float, count: int, least: int, floor: float) -> Column:
    """A sorted array after clipping rounds: keep within kappa deviations of the median, unless too few or too tight."""
    for _ in range(count):
        a = let(a, lambda v: let(upper_median(v), lambda m: let(madn(v, m), lambda s: F.when((F.size(v) < least) | (s < floor), v).otherwise(F.filter(v, lambda x: F.abs(x - m) <= kappa * s)))))
    return a


def mode_and_sigma(a: Column) -> Column:
    """(mode, sigma, kept): 2.5 median - 1.5 mean where they are near, else the median; sigma floored at 0.001."""

    def of(v: Column, m: Column, s: Column, avg: Column) -> Column:
        mode = F.when(F.abs(avg - m) < 0.3 * s, 2.5 * m - 1.5 * avg).otherwise(m)
        return F.struct(mode.alias("mode"), F.greatest(s, F.lit(0.001)).alias("sigma"), F.size(v).cast("long").alias("kept"))

    return let(a, lambda v: let(upper_median(v), lambda m: let(madn(v, m), lambda s: let(mean(v), lambda avg: of(v, m, s, avg)))))


def weighted_median(pairs: Column) -> Column:
    """Of an array of (v, w) sorted by v: the first value whose running weight reaches half; weights of 0 or less don't count."""
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("found"))

    def first_at(live: Column, half: Column) -> Column:
        walk = lambda acc, p: F.struct((acc["cum"] + p["w"]).alias("cum"), F.coalesce(acc["found"], F.when(acc["cum"] + p["w"] >= half, p["v"])).alias("found"))
        return F.coalesce(F.aggregate(live, start, walk)["found"], F.lit(0.0))

    return let(F.filter(pairs, lambda p: p["w"] > 0), lambda live: let(F.aggregate(live, F.lit(0.0), lambda s, p: s + p["w"]) / 2, lambda half: first_at(live, half)))
