"""Sky geometry as column expressions: gnomonic projection, proper motion, WCS, SIP."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | float


def _col(c: C) -> Column:
    return c if isinstance(c, Column) else F.lit(float(c))


def wrap(ra: Column) -> Column:
    """One turn into [0, 360)."""
    up = F.when(ra < 0, ra + 360.0).otherwise(ra)
    return F.when(up >= 360.0, up - 360.0).otherwise(up)


def cos_c(ra: C, dec: C, ra0: C, dec0: C) -> Column:
    """Cosine of the distance from the tangent point; a point projects only where it is positive."""
    d, d0, da = F.radians(_col(dec)), F.radians(_col(dec0)), F.radians(_col(ra)) - F.radians(_col(ra0))
    return F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(da)


def to_tangent(ra: C, dec: C, ra0: C, dec0: C) -> tuple[Column, Column]:
    """(xi, eta) in radians; null on the other hemisphere."""
    d, d0, da = F.radians(_col(dec)), F.radians(_col(dec0)), F.radians(_col(ra)) - F.radians(_col(ra0))
    c = cos_c(ra, dec, ra0, dec0)
    near = lambda v: F.when(c > 0, v / c)
    return near(F.cos(d) * F.sin(da)), near(F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(da))


def to_sky(xi: C, eta: C, ra0: C, dec0: C) -> tuple[Column, Column]:
    """(ra, dec) in degrees of a point of the tangent plane."""
    xi, eta, ra0, dec0 = map(_col, (xi, eta, ra0, dec0))
    rho = F.sqrt(xi * xi + eta * eta)
    c, d0 = F.atan(rho), F.radians(dec0)
    dec = F.degrees(F.asin(F.cos(c) * F.sin(d0) + eta * F.sin(c) * F.cos(d0) / rho))
    ra = wrap(F.degrees(F.radians(ra0) + F.atan2(xi * F.sin(c), rho * F.cos(d0) * F.cos(c) - eta * F.sin(d0) * F.sin(c))))
    return F.when(rho < 1e-15, ra0).otherwise(ra), F.when(rho < 1e-15, dec0).otherwise(dec)


def moved(ra: Column, dec: Column, pmra: Column, pmdec: Column, years: float) -> tuple[Column, Column]:
    """Position after linear proper motion, in mas a year; pmra holds the cosine of the declination."""
    if abs(years) < 1e-10:
        return ra, dec
    cosd = F.cos(F.radians(dec))
    shift = F.when(F.abs(cosd) > 1e-10, pmra * years / (cosd * 3_600_000.0)).otherwise(0.0)
    return wrap(ra + shift), F.least(F.greatest(dec + pmdec * years / 3_600_000.0, F.lit(-90.0)), F.lit(90.0))


def sip(terms: dict[tuple[int, int], float], u: Column, v: Column, order: int) -> Column:
    """Sum of c u**i v**j over 2 <= i + j <= order."""
    total = F.lit(0.0)
    for (i, j), c in sorted(terms.items()):
        if 2 <= i + j <= order:
            term = F.lit(float(c))
            for _ in range(i):
                term = term * u
            for _ in range(j):
                term = term * v
            total = total + term
    return total


@dataclass(frozen=True)
class Wcs:
    """A solution: reference pixel and sky point, matrix in degrees a pixel, distortion both ways."""

    crpix: tuple[float, float]
    crval: tuple[float, float]
    cd: tuple[tuple[float, float], tuple[float, float]]
    order: int = 0
    a: tuple[tuple[tuple[int, int], float], ...] = ()
    b: tuple[tuple[tuple[int, int], float], ...] = ()
    ap: tuple[tuple[tuple[int, int], float], ...] = ()
    bp: tuple[tuple[tuple[int, int], float], ...] = ()

    def pixel_to_sky(self, x: Column, y: Column) -> tuple[Column, Column]:
        u, v = x - self.crpix[0], y - self.crpix[1]
        if self.order:
            u, v = u + sip(dict(self.a), u, v, self.order), v + sip(dict(self.b), u, v, self.order)
        (p, q), (r, s) = self.cd
        return to_sky(F.radians(u * p + v * q), F.radians(u * r + v * s), *self.crval)

    def sky_to_pixel(self, ra: Column, dec: Column) -> tuple[Column, Column]:
        (p, q), (r, s) = self.cd
        det = p * s - q * r
        if abs(det) < 1e-30:
            return F.lit(float("nan")), F.lit(float("nan"))
        xi, eta = (F.degrees(c) for c in to_tangent(ra, dec, *self.crval))
        u, v = (xi * s - eta * q) * (1 / det), (eta * p - xi * r) * (1 / det)
        if self.order and self.ap:
            u, v = u + sip(dict(self.ap), u, v, self.order), v + sip(dict(self.bp), u, v, self.order)
        return u + self.crpix[0], v + self.crpix[1]

    def scale_arcsec(self) -> float:
        (p, q), (r, s) = self.cd
        return ((p * p + r * r) ** 0.5 * (q * q + s * s) ** 0.5) ** 0.5 * 3600

    def rotation_deg(self) -> float:
        import math

        return math.degrees(math.atan2(-self.cd[0][1], self.cd[1][1])) % 360

    def headers(self) -> list[tuple[str, str]]:
        """FITS keywords in order; exponents are written without padding."""
        e = lambda v: "{0}E{1}".format(*(lambda m, x: (m, int(x)))(*f"{v:.15e}".split("e")))
        kind = "-SIP" if self.order else ""
        out = [("WCSAXES", "2"), ("CTYPE1", f"'RA---TAN{kind}'"), ("CTYPE2", f"'DEC--TAN{kind}'"), ("CRPIX1", f"{self.crpix[0]:.6f}"), ("CRPIX2", f"{self.crpix[1]:.6f}"), ("CRVAL1", f"{self.crval[0]:.10f}"), ("CRVAL2", f"{self.crval[1]:.10f}")]
        out += [(f"CD{i + 1}_{j + 1}", e(self.cd[i][j])) for i in (0, 1) for j in (0, 1)]
        for names, pair, least in ((("A", "B"), (self.a, self.b), 2), (("AP", "BP"), (self.ap, self.bp), 1)):
            if self.order and pair[0]:
                out += [(f"{n}_ORDER", str(self.order)) for n in names]
                out += [(f"{n}_{i}_{j}", e(c)) for n, terms in zip(names, pair, strict=True) for (i, j), c in sorted(terms) if least <= i + j <= self.order and abs(c) > 1e-20]
        return out
