"""Sky queries on the catalogue view: projection, proper motion, WCS, SIP, least-squares fits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import sky as S
from ..operators import solve
from .registry import query
from .views import IMGSTAR, SKY, v_imgstar, v_sky

RA0, DEC0 = 180.0, 10.0
R, R0, D0 = "radians(ra)", f"radians({RA0}::DOUBLE)", f"radians({DEC0}::DOUBLE)"


def tan_sql(ra0: float = RA0, dec0: float = DEC0) -> str:
    a, d0 = f"(radians(ra) - radians({ra0}::DOUBLE))", f"radians({dec0}::DOUBLE)"
    return f"""tan AS (SELECT *, CASE WHEN c > 0 THEN cos(radians(dec)) * sin({a}) / c END AS xi, CASE WHEN c > 0 THEN (cos({d0}) * sin(radians(dec)) - sin({d0}) * cos(radians(dec)) * cos({a})) / c END AS eta
  FROM (SELECT *, sin({d0}) * sin(radians(dec)) + cos({d0}) * cos(radians(dec)) * cos({a}) AS c FROM sky))"""


def sky_sql(xi: str, eta: str, ra0: float, dec0: float, source: str) -> str:
    d0 = f"radians({dec0}::DOUBLE)"
    return f"""SELECT *, CASE WHEN r >= 360 THEN r - 360 ELSE r END AS sra FROM (SELECT *, CASE WHEN r0 < 0 THEN r0 + 360 ELSE r0 END AS r FROM (
  SELECT *, CASE WHEN rho < 1e-15 THEN {ra0}::DOUBLE ELSE degrees(radians({ra0}::DOUBLE) + atan2(xi_ * sin(atan(rho)), rho * cos({d0}) * cos(atan(rho)) - eta_ * sin({d0}) * sin(atan(rho)))) END AS r0,
    CASE WHEN rho < 1e-15 THEN {dec0}::DOUBLE ELSE degrees(asin(cos(atan(rho)) * sin({d0}) + eta_ * sin(atan(rho)) * cos({d0}) / rho)) END AS sdec FROM (SELECT *, sqrt(xi_ * xi_ + eta_ * eta_) AS rho FROM (SELECT *, {xi} AS xi_, {eta} AS eta_ FROM {source}))))"""


@query(f"WITH {SKY}, {tan_sql()} SELECT id, round(xi, 6) AS xi, round(eta, 6) AS eta FROM tan WHERE c > 0.1")
def tan_forward(spark, sf_dir):
    xi, eta = S.to_tangent(F.col("ra"), F.col("dec"), RA0, DEC0)
    return v_sky(spark, sf_dir).where(S.cos_c(F.col("ra"), F.col("dec"), RA0, DEC0) > 0.1).select("id", F.round(xi, 6).alias("xi"), F.round(eta, 6).alias("eta"))


@query(f"WITH {SKY}, {tan_sql()} SELECT id, round(sra, 6) AS ra, round(sdec, 6) AS dec FROM ({sky_sql('xi', 'eta', RA0, DEC0, '(SELECT id, xi, eta FROM tan WHERE c > 0.1)')})")
def tan_inverse(spark, sf_dir):
    xi, eta = S.to_tangent(F.col("ra"), F.col("dec"), RA0, DEC0)
    t = v_sky(spark, sf_dir).where(S.cos_c(F.col("ra"), F.col("dec"), RA0, DEC0) > 0.1).select("id", xi.alias("xi"), eta.alias("eta"))
    ra, dec = S.to_sky(F.col("xi"), F.col("eta"), RA0, DEC0)
    return t.select("id", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


@query(f"WITH {SKY}, pm AS (SELECT id, ra + CASE WHEN abs(cos(radians(dec))) > 1e-10 THEN pmra * 24.5::DOUBLE / (cos(radians(dec)) * 3600000) ELSE 0 END AS r, least(greatest(dec + pmdec * 24.5::DOUBLE / 3600000, -90), 90) AS d FROM sky) SELECT id, round(CASE WHEN r < 0 THEN r + 360 WHEN r >= 360 THEN r - 360 ELSE r END + 1e-10, 8) AS ra, round(d + 1e-10, 8) AS dec FROM pm")
def proper_motion(spark, sf_dir):
    ra, dec = S.moved(F.col("ra"), F.col("dec"), F.col("pmra"), F.col("pmdec"), 24.5)
    return v_sky(spark, sf_dir).select("id", F.round(ra + 1e-10, 8).alias("ra"), F.round(dec + 1e-10, 8).alias("dec"))  # off the ties


T = math.radians(30)
CD = ((1.5 / 3600 * math.cos(T), -1.5 / 3600 * math.sin(T)), (1.5 / 3600 * math.sin(T), 1.5 / 3600 * math.cos(T)))
WCS = S.Wcs((500.0, 500.0), (150.0, 25.0), CD, 3, (((2, 0), 2e-6), ((1, 1), -1e-6), ((0, 3), 3e-9)), (((0, 2), 1.5e-6), ((2, 1), -2e-9)), (((2, 0), -2e-6), ((1, 1), 1e-6)), (((0, 2), -1.5e-6),))
SIP_A = "(2e-6::DOUBLE * u * u - 1e-6::DOUBLE * u * v + 3e-9::DOUBLE * v * v * v)"
SIP_B = "(1.5e-6::DOUBLE * v * v - 2e-9::DOUBLE * u * u * v)"


@query(f"WITH {IMGSTAR}, uv AS (SELECT id, x - 500 AS u, y - 500 AS v FROM imgstar) SELECT id, round({SIP_A}, 9) AS du, round({SIP_B}, 9) AS dv FROM uv")
def sip_eval(spark, sf_dir):
    u, v = F.col("x") - 500, F.col("y") - 500
    return v_imgstar(spark, sf_dir).select("id", F.round(S.sip(dict(WCS.a), u, v, 3), 9).alias("du"), F.round(S.sip(dict(WCS.b), u, v, 3), 9).alias("dv"))


@query(f"WITH {IMGSTAR}, uv AS (SELECT id, x - 500 AS u, y - 500 AS v FROM imgstar), uw AS (SELECT id, u + {SIP_A} AS p, v + {SIP_B} AS q FROM uv) SELECT id, round(sra, 7) AS ra, round(sdec, 7) AS dec FROM ({sky_sql(f'radians({CD[0][0]!r}::DOUBLE * p + {CD[0][1]!r}::DOUBLE * q)', f'radians({CD[1][0]!r}::DOUBLE * p + {CD[1][1]!r}::DOUBLE * q)', 150.0, 25.0, 'uw')})")
def wcs_pix2sky(spark, sf_dir):
    ra, dec = WCS.pixel_to_sky(F.col("x"), F.col("y"))
    return v_imgstar(spark, sf_dir).select("id", F.round(ra, 7).alias("ra"), F.round(dec, 7).alias("dec"))


DET = CD[0][0] * CD[1][1] - CD[0][1] * CD[1][0]


@query(
    f"""WITH {SKY}, {tan_sql(150.0, 25.0)}, uv AS (SELECT id, (degrees(xi) * {CD[1][1]!r}::DOUBLE - degrees(eta) * {CD[0][1]!r}::DOUBLE) / {DET!r}::DOUBLE AS u, (degrees(eta) * {CD[0][0]!r}::DOUBLE - degrees(xi) * {CD[1][0]!r}::DOUBLE) / {DET!r}::DOUBLE AS v FROM tan WHERE c > 0.5)
SELECT id, round(u - 2e-6::DOUBLE * u * u + 1e-6::DOUBLE * u * v + 500, 1) AS x, round(v - 1.5e-6::DOUBLE * v * v + 500, 1) AS y FROM uv"""
)
def wcs_sky2pix(spark, sf_dir):
    s = v_sky(spark, sf_dir).where(S.cos_c(F.col("ra"), F.col("dec"), 150.0, 25.0) > 0.5)
    x, y = WCS.sky_to_pixel(F.col("ra"), F.col("dec"))
    return s.select("id", F.round(x, 1).alias("x"), F.round(y, 1).alias("y"))


@query(f"SELECT {round(1.5, 6)}::DOUBLE AS scale_arcsec, 30.0::DOUBLE AS rotation_deg")
def wcs_scale_rotation(spark, sf_dir):
    return spark.range(1).select(F.lit(round(WCS.scale_arcsec(), 6)).alias("scale_arcsec"), F.lit(round(WCS.rotation_deg(), 6)).alias("rotation_deg"))


HEADER_TEXTS = {0: ("WCSAXES", "2"), 1: ("CTYPE1", "'RA---TAN-SIP'"), 2: ("CTYPE2", "'DEC--TAN-SIP'"), 3: ("CRPIX1", "500.000000"), 4: ("CRPIX2", "500.000000"), 5: ("CRVAL1", "150.0000000000"), 6: ("CRVAL2", "25.0000000000"), 11: ("A_ORDER", "3"), 12: ("B_ORDER", "3"), 18: ("AP_ORDER", "3"), 19: ("BP_ORDER", "3")}
HEADER_NUMBERS = {7: ("CD1_1", CD[0][0]), 8: ("CD1_2", CD[0][1]), 9: ("CD2_1", CD[1][0]), 10: ("CD2_2", CD[1][1]), 13: ("A_0_3", 3e-9), 14: ("A_1_1", -1e-6), 15: ("A_2_0", 2e-6), 16: ("B_0_2", 1.5e-6), 17: ("B_2_1", -2e-9), 20: ("AP_1_1", 1e-6), 21: ("AP_2_0", -2e-6), 22: ("BP_0_2", -1.5e-6)}


def _headers_sql() -> str:
    """The solution's terms, formatted by the oracle; its exponents have two digits."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    texts = ", ".join(f"({k}, '{n}', {quoted(v)})" for k, (n, v) in HEADER_TEXTS.items())
    numbers = ", ".join(f"({k}, '{n}', {v!r}::DOUBLE)" for k, (n, v) in HEADER_NUMBERS.items())
    return f"SELECT pos::INT AS pos, keyword, value FROM (VALUES {texts}) t(pos, keyword, value) UNION ALL SELECT pos::INT, keyword, replace(format('{{:.15e}}', v), 'e-0', 'E-') FROM (VALUES {numbers}) n(pos, keyword, v)"


@query(_headers_sql())
def fits_headers(spark, sf_dir):
    """Keywords of the solution in order."""
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(WCS.headers())], "pos int, keyword string, value string")


MOVED = "mv AS (SELECT id, x, y, 2.0::DOUBLE * x + 0.1::DOUBLE * y + 10 AS p, -0.1::DOUBLE * x + 2.0::DOUBLE * y + 20 AS q FROM imgstar)"


def _moved(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return v_imgstar(spark, sf_dir).select("x", "y", (2.0 * x + 0.1 * y + 10).alias("p"), (-0.1 * x + 2.0 * y + 20).alias("q"))


@query("SELECT unnest([2.0, 0.1, 10.0, -0.1, 2.0, 20.0])::DOUBLE AS value, unnest(range(6))::INT AS pos")
def fit_affine_pixel(spark, sf_dir):
    """The oracle is the transform that made the pairs."""
    return solve.fit_affine(_moved(spark, sf_dir)).select("pos", F.round("value", 6).alias("value"))


@query("SELECT unnest([1.1, 0.02, 5.0, -0.03, 0.95, 8.0, 0.0001, -0.00005])::DOUBLE AS value, unnest(range(8))::INT AS pos")
def fit_homography(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    w = 1e-4 * x - 5e-5 * y + 1
    pairs = v_imgstar(spark, sf_dir).select("x", "y", ((1.1 * x + 0.02 * y + 5) / w).alias("p"), ((-0.03 * x + 0.95 * y + 8) / w).alias("q"))
    return solve.fit_homography(pairs).select("pos", F.round("value", 6).alias("value"))


@query("SELECT unnest([" + ", ".join(f"round({v!r} * 1e6, 4)" for v in (*CD[0], *CD[1])) + "])::DOUBLE AS value, unnest(range(4))::INT AS pos")
def fit_wcs_affine(spark, sf_dir):
    """CD matrix in micro-degrees a pixel, from pixels and their sky points."""
    flat = S.Wcs(WCS.crpix, WCS.crval, CD)
    ra, dec = flat.pixel_to_sky(F.col("x"), F.col("y"))
    pairs = v_imgstar(spark, sf_dir).select("x", "y", ra.alias("ra"), dec.alias("dec"))
    return solve.fit_wcs(pairs, WCS.crpix, WCS.crval).select("pos", F.round(F.col("value") * 1e6, 4).alias("value"))


@query("SELECT unnest([2.0, -1.0, 0.0, 0.0, 1.5, 0.0])::DOUBLE AS value, unnest(range(6))::INT AS pos")
def fit_sip(spark, sf_dir):
    """Second-order distortion, in micro-pixels, of pixels that were moved by a known one."""
    u, v = F.col("x") - 500, F.col("y") - 500
    pairs = v_imgstar(spark, sf_dir).select(u.alias("u"), v.alias("v"), (2e-6 * u * u - 1e-6 * u * v).alias("du"), (1.5e-6 * u * v).alias("dv"))
    return solve.fit_sip(pairs, 2).select("pos", F.round(F.col("value") * 1e6, 5).alias("value"))
