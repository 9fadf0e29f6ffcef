"""Queries of transforms, gates and classifications on columns."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import background, solve, transform
from .images import FILL, HEAD, MED3
from .registry import query
from .sky import _moved
from .views import IMGSTAR, PIX, SKY, STAR, v_imgstar, v_pix, v_sky, v_star

AFFINE = [1.2, -0.3, 15.0, 0.25, 1.1, -4.0]
PLANE = [1.01, 0.02, 3.0, -0.015, 0.99, -2.0, 1e-5, -2e-5]
_lits = lambda p: [F.lit(v) for v in p]
_sql = lambda v: f"{v!r}::DOUBLE"


@query(f"WITH {IMGSTAR} SELECT id, round({AFFINE[0]}::DOUBLE * x + {AFFINE[1]}::DOUBLE * y + {AFFINE[2]}, 6) AS px, round({AFFINE[3]}::DOUBLE * x + {AFFINE[4]}::DOUBLE * y + {AFFINE[5]}, 6) AS py FROM imgstar")
def affine_apply(spark, sf_dir):
    px, py = transform.affine(_lits(AFFINE), F.col("x"), F.col("y"))
    return v_imgstar(spark, sf_dir).select("id", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@query(f"SELECT round(sqrt(2.0::DOUBLE * 2 + 0.1::DOUBLE * 0.1), 6) AS scale_x, round(sqrt(2.0::DOUBLE * 2 + 0.1::DOUBLE * 0.1), 6) AS scale_y, round(atan2(-0.1::DOUBLE, 2.0::DOUBLE), 6) AS rotation")
def affine_scale_rotation(spark, sf_dir):
    """Scales and rotation of a transform fitted on all stars and let through by the gate."""
    one = transform.wide(solve.fit_affine(_moved(spark, sf_dir)))
    c = [F.col(n) for n in ("a1", "b1", "a2", "b2")]
    sx, sy, turn = transform.scales(*c)
    return one.where(transform.sane(*c)).select(F.round(sx, 6).alias("scale_x"), F.round(sy, 6).alias("scale_y"), F.round(turn, 6).alias("rotation"))


@query(f"WITH {IMGSTAR}, t AS (SELECT id, 1 + x / 5000 AS a1, y / 2000 AS b1, -y / 2000 AS a2, CASE WHEN id % 11 = 0 THEN 0 ELSE 1 END AS b2 FROM imgstar) SELECT id FROM t WHERE a2 * a2 + b2 * b2 >= 1e-30 AND (a1 * a1 + b1 * b1) / (a2 * a2 + b2 * b2) BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE")
def affine_gate(spark, sf_dir):
    """Candidate transforms whose axes have like scales."""
    x, y = F.col("x"), F.col("y")
    t = v_imgstar(spark, sf_dir).select("id", (1 + x / 5000).alias("a1"), (y / 2000).alias("b1"), (-y / 2000).alias("a2"), F.when(F.col("id") % 11 == 0, 0).otherwise(1).alias("b2"))
    return t.where(transform.sane(*[F.col(c) for c in ("a1", "b1", "a2", "b2")])).select("id")


@query(
    f"""WITH {IMGSTAR}, w AS (SELECT *, {_sql(PLANE[6])} * x + {_sql(PLANE[7])} * y + 1 AS w FROM imgstar)
SELECT id, round({_sql(AFFINE[0])} * x + {_sql(AFFINE[1])} * y + {AFFINE[2]}, 5) AS ax, round({_sql(AFFINE[3])} * x + {_sql(AFFINE[4])} * y + {AFFINE[5]}, 5) AS ay,
  round(({_sql(PLANE[0])} * x + {_sql(PLANE[1])} * y + {PLANE[2]}) / w, 5) AS hx, round(({_sql(PLANE[3])} * x + {_sql(PLANE[4])} * y + {PLANE[5]}) / w, 5) AS hy, x AS sx, y AS sy FROM w"""
)
def pixel_transforms(spark, sf_dir):
    x, y, out = F.col("x"), F.col("y"), []
    for name, model, p in (("a", "affine", AFFINE), ("h", "projective", PLANE), ("s", "sip", [])):
        for axis, c in zip("xy", transform.pixel_transform(model, _lits(p), x, y), strict=True):
            out.append((c if name == "s" else F.round(c, 5)).alias(name + axis))
    return v_imgstar(spark, sf_dir).select("id", *out)


@query(f"WITH {IMGSTAR} SELECT min(id) AS id FROM imgstar GROUP BY floor(x / 40), floor(y / 40)")
def distinct_centres(spark, sf_dir):
    """Centres on a coarse grid with jitter far below the tolerance: the first of each stays."""
    s = v_imgstar(spark, sf_dir).select("id", (F.floor(F.col("x") / 40) * 40 + F.col("id") % 3 * 1e-8).alias("cx"), (F.floor(F.col("y") / 40) * 40.0).alias("cy"))
    return transform.first_of_each(s, ["id"], 1e-6).select("id")


@query(f"WITH {SKY} SELECT list_sort(list(ra))[count(*) // 2 + 1] AS ra, list_sort(list(dec))[count(*) // 2 + 1] AS dec FROM sky")
def field_centre(spark, sf_dir):
    return transform.field_centre(v_sky(spark, sf_dir))


COLOURS = {"uniform": (0.0, 0.0), "eccentricity": (0.5, 0.6), "fwhm": (0.9, 1.2)}


def _paint(test: str) -> str:
    return f"CASE {test} ELSE [255, 64, 64] END"


@query(
    f"""WITH {STAR}, med AS (SELECT frame_id, list_sort(list(fwhm))[count(*) // 2 + 1] AS m FROM star GROUP BY frame_id),
c AS (SELECT frame_id, k1, k2, k3, [0, 255, 0] AS u, {_paint("WHEN ecc <= 0.5::DOUBLE THEN [0, 255, 0] WHEN ecc <= 0.6::DOUBLE THEN [255, 255, 0]")} AS e, {_paint("WHEN m <= 0 THEN [0, 255, 0] WHEN fwhm / m < 0.9::DOUBLE THEN [0, 255, 0] WHEN fwhm / m < 1.2::DOUBLE THEN [255, 255, 0]")} AS f FROM star JOIN med USING (frame_id))
SELECT frame_id, k1, k2, k3, """
    + ", ".join(f"{n}[{i + 1}]::INT AS {n}{i}" for n in "uef" for i in range(3))
    + " FROM c"
)
def colour_schemes(spark, sf_dir):
    """Every star's colour by all three schemes; the field's width is the frame's upper median."""
    from ..functions import stats

    s = v_star(spark, sf_dir)
    width = s.groupBy("frame_id").agg(stats.upper_median(stats.values("fwhm")).alias("m"))
    s = s.join(width, "frame_id")
    rgb = {n[0]: transform.colour(n, F.col("ecc"), F.col("fwhm"), F.col("m"), *limits) for n, limits in COLOURS.items()}
    return s.select("frame_id", "k1", "k2", "k3", *[c[i].alias(f"{n}{i}") for n, c in rgb.items() for i in range(3)])


MOST = 20


@query(f"WITH {STAR}, r AS (SELECT frame_id, k1, k2, k3, flux, count(*) OVER (PARTITION BY frame_id) AS n_all, row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, k1, k2, k3) AS place FROM star) SELECT frame_id, place::INT AS place, k1, k2, k3, n_all FROM r WHERE place <= {MOST}")
def late_truncate(spark, sf_dir):
    """A frame's statistics count all of its stars; only then is its list cut to the brightest."""
    w = Window.partitionBy("frame_id")
    r = v_star(spark, sf_dir).select("frame_id", "k1", "k2", "k3", F.count("*").over(w).alias("n_all"), F.row_number().over(w.orderBy(F.desc("flux"), "k1", "k2", "k3")).alias("place"))
    return r.where(F.col("place") <= MOST).select("frame_id", "place", "k1", "k2", "k3", "n_all")


@query(f"{HEAD}, {FILL}, {MED3} SELECT x, y, round(v - m.bg, 4) AS excess FROM pix, sh, med3 m WHERE m.cx = x // cell AND m.cy = y // cell AND v - m.bg > 1.5::DOUBLE * m.sigma")
def pixels_above_map(spark, sf_dir):
    """Pixels joined with their cell's background and noise, and kept if they stand above both."""
    p = v_pix(spark, sf_dir)
    mesh = background.median3(background.filled(background.cells(p)))
    at = p.crossJoin(F.broadcast(background.shape(p))).withColumn("cx", F.expr("x div cell")).withColumn("cy", F.expr("y div cell"))  # one row
    return at.join(mesh, ["cx", "cy"]).where(F.col("v") - F.col("bg") > 1.5 * F.col("sigma")).select("x", "y", F.round(F.col("v") - F.col("bg"), 4).alias("excess"))


TURN = 0.4
_U = f"({math.cos(TURN)!r}::DOUBLE * (x % 25 - 12) + {math.sin(TURN)!r}::DOUBLE * (y % 25 - 12))"
_W = f"({math.cos(TURN)!r}::DOUBLE * (y % 25 - 12) - {math.sin(TURN)!r}::DOUBLE * (x % 25 - 12))"
_R2 = f"(pow({_U} / 3.0, 2) + pow({_W} / 2.0, 2))"


@query(f"WITH {PIX} SELECT x, y, round(10 + 90 * pow(1 + {_R2}, -3.5::DOUBLE), 5) AS moffat, round(10 + 90 * exp(-0.5::DOUBLE * {_R2}), 5) AS gaussian, round(v - (10 + 90 * pow(1 + {_R2}, -3.5::DOUBLE)), 5) AS residual FROM pix")
def model_residual(spark, sf_dir):
    """Both profiles at every pixel of a field of tiles with a star each, and the image less the first."""
    x, y = F.col("x") % 25, F.col("y") % 25
    n = lambda v: F.lit(float(v))
    m = transform.moffat(n(90), n(12), n(12), n(3), n(2), n(TURN), n(3.5), n(10), x, y)
    g = transform.gaussian(n(90), n(12), n(12), n(3), n(2), n(TURN), n(10), x, y)
    return v_pix(spark, sf_dir).select("x", "y", F.round(m, 5).alias("moffat"), F.round(g, 5).alias("gaussian"), F.round(F.col("v") - m, 5).alias("residual"))
