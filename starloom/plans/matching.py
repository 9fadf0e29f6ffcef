"""Spatial queries: distance joins, neighbours, quads, RANSAC, annotation geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import solve, spatial
from .registry import query
from .views import IMGSTAR, STAR, v_imgstar, v_star


@query(f"WITH {IMGSTAR} SELECT id, x, y FROM imgstar a WHERE NOT EXISTS (SELECT 1 FROM imgstar b WHERE b.id <> a.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144)")
def blend_sweep(spark, sf_dir):
    return spatial.without_blends(v_imgstar(spark, sf_dir), 12.0).select("id", "x", "y")


FAST = "fast AS (SELECT id, x + (id % 5) * 0.6::DOUBLE AS x, y - (id % 3) * 0.5::DOUBLE AS y FROM imgstar)"


@query(f"WITH {IMGSTAR}, {FAST}, top AS (SELECT * FROM imgstar ORDER BY flux DESC, id LIMIT 100) SELECT count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM fast f WHERE (f.x - t.x) * (f.x - t.x) + (f.y - t.y) * (f.y - t.y) < 4)) AS found FROM top t")
def coverage_2px(spark, sf_dir):
    """How many of the hundred brightest have a fast detection within 2 pixels."""
    s = v_imgstar(spark, sf_dir)
    fast = s.select("id", (F.col("x") + F.col("id") % 5 * 0.6).alias("x"), (F.col("y") - F.col("id") % 3 * 0.5).alias("y"))
    top = spatial.brightest(s, 100)
    found = spatial.covered(top, fast, 2.0).agg(F.count("*").alias("found"))
    return top.agg(F.count("*").alias("n")).crossJoin(found)  # one row each


PROBES = [(k, float(k * 97 % 1000), float(k * 331 % 1000)) for k in range(10)]


@query(f"WITH {IMGSTAR}, p(probe, px, py) AS (VALUES {', '.join(map(str, PROBES))}), d AS (SELECT probe, id, (x - px) * (x - px) + (y - py) * (y - py) AS d2 FROM imgstar, p), r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY d2, id) AS rn FROM d) SELECT probe::INT AS probe, id, round(sqrt(d2), 6) AS dist FROM r WHERE rn = 1")
def nearest_star(spark, sf_dir):
    probes = spark.createDataFrame(PROBES, "id int, x double, y double")
    return spatial.nearest(probes, v_imgstar(spark, sf_dir)).select("probe", "id", F.round(F.sqrt("d2"), 6).alias("dist"))


TOP = "top AS (SELECT *, row_number() OVER (ORDER BY flux DESC, id) - 1 AS i FROM (SELECT * FROM imgstar ORDER BY flux DESC, id LIMIT 100))"
KNN = "kn AS (SELECT a.i, b.i AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, row_number() OVER (PARTITION BY a.i ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.i) AS rank FROM {0} a JOIN {0} b ON a.i <> b.i)"


@query(f"WITH {IMGSTAR}, {TOP}, {KNN.format('top')} SELECT i::INT AS i, rank::INT AS rank, j::INT AS j, round(sqrt(d2), 6) AS dist FROM kn WHERE rank <= 3")
def knn3(spark, sf_dir):
    k = spatial.knn(spatial.brightest(v_imgstar(spark, sf_dir), 100), 3)
    return k.select("i", F.col("rank").cast("int").alias("rank"), "j", F.round(F.sqrt("d2"), 6).alias("dist"))


def quads_sql(stars: str, tag: str) -> str:
    """CTEs ending in {tag}q: the quads of a bounded star list, groups of four."""
    d = lambda a, b: f"sqrt((x{a} - x{b}) * (x{a} - x{b}) + (y{a} - y{b}) * (y{a} - y{b}))"
    edges = ", ".join(d(a, b) for a in range(4) for b in range(a + 1, 4))
    return f"""{tag}k AS (SELECT a.i, b.i AS j, row_number() OVER (PARTITION BY a.i ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.i) AS rank FROM {stars} a JOIN {stars} b ON a.i <> b.i),
{tag}g AS (SELECT i, max(j) FILTER (WHERE rank = 1) AS j1, max(j) FILTER (WHERE rank = 2) AS j2, max(j) FILTER (WHERE rank = 3) AS j3 FROM {tag}k WHERE rank <= 3 GROUP BY i HAVING count(*) = 3),
{tag}u AS (SELECT *, row_number() OVER (PARTITION BY list_sort([i, j1, j2, j3]) ORDER BY i) AS first FROM {tag}g),
{tag}p AS (SELECT u.i, u.j1, u.j2, u.j3, s0.x AS x0, s0.y AS y0, s1.x AS x1, s1.y AS y1, s2.x AS x2, s2.y AS y2, s3.x AS x3, s3.y AS y3 FROM {tag}u u JOIN {stars} s0 ON s0.i = u.i JOIN {stars} s1 ON s1.i = u.j1 JOIN {stars} s2 ON s2.i = u.j2 JOIN {stars} s3 ON s3.i = u.j3 WHERE first = 1),
{tag}q AS (SELECT i, j1, j2, j3, (x0 + x1 + x2 + x3) / 4 AS cx, (y0 + y1 + y2 + y3) / 4 AS cy, d[6] AS longest, d[1] / d[6] AS r1, d[2] / d[6] AS r2, d[3] / d[6] AS r3, d[4] / d[6] AS r4, d[5] / d[6] AS r5 FROM (SELECT *, list_sort([{edges}]) AS d FROM {tag}p))"""


@query(f"WITH {IMGSTAR}, {TOP}, {quads_sql('top', 'a')} SELECT i::INT AS i, j1::INT AS j1, j2::INT AS j2, j3::INT AS j3, round(cx, 5) AS cx, round(cy, 5) AS cy, round(longest, 5) AS longest, " + ", ".join(f"round(r{n}, 6) AS r{n}" for n in range(1, 6)) + " FROM aq")
def quads(spark, sf_dir):
    q = spatial.quads(spatial.brightest(v_imgstar(spark, sf_dir), 100))
    return q.select("i", *[F.col("idx")[n].alias(f"j{n}") for n in (1, 2, 3)], *[F.round(c, 5).alias(c) for c in ("cx", "cy", "longest")], *[F.round(f"r{n}", 6).alias(f"r{n}") for n in range(1, 6)])


TURNED = "turned AS (SELECT i, 0.0008::DOUBLE * x - 0.0006::DOUBLE * y + 0.1 AS x, 0.0006::DOUBLE * x + 0.0008::DOUBLE * y - 0.2 AS y FROM top)"
MATCH = f"""WITH {IMGSTAR}, {TOP}, {TURNED}, {quads_sql('top', 'a')}, {quads_sql('turned', 'b')}, m0 AS (SELECT a.i AS qi, b.i, a.cx AS qcx, a.cy AS qcy, b.cx, b.cy, b.longest / a.longest AS scale FROM aq a JOIN bq b ON {' AND '.join(f'least(a.r{n}, b.r{n}) / greatest(a.r{n}, b.r{n}) >= 0.99' for n in range(1, 6))}),
md AS (SELECT list_sort(list(scale))[count(*) // 2 + 1] AS mid, count(*) AS n FROM m0), m AS (SELECT m0.* FROM m0, md WHERE n < 3 OR abs(scale - mid) / mid < 0.2)"""


def _turned(spark, sf_dir):
    top = spatial.brightest(v_imgstar(spark, sf_dir), 100)
    other = top.select("i", (0.0008 * F.col("x") - 0.0006 * F.col("y") + 0.1).alias("x"), (0.0006 * F.col("x") + 0.0008 * F.col("y") - 0.2).alias("y"))
    return spatial.match_quads(spatial.quads(top), spatial.quads(other), 0.01)


@query(f"{MATCH} SELECT qi::INT AS qi, i::INT AS i, round(scale * 1000, 5) AS scale FROM m")
def quad_match(spark, sf_dir):
    return _turned(spark, sf_dir).select("qi", "i", F.round(F.col("scale") * 1000, 5).alias("scale"))


@query("SELECT unnest([0.0008, -0.0006, 0.1, 0.0006, 0.0008, -0.2])::DOUBLE AS value, unnest(range(6))::INT AS pos")
def quad_affine(spark, sf_dir):
    """The oracle is the transform of the copy, from the matches of quads with themselves."""
    m = _turned(spark, sf_dir).where("qi = i").select(F.col("qcx").alias("x"), F.col("qcy").alias("y"), F.col("cx").alias("p"), F.col("cy").alias("q"))
    return solve.fit_affine(m).select("pos", F.round("value", 7).alias("value"))


N = 20
TRIPLES = solve.triples(N)
PAIRS = "mt AS (SELECT id - 1 AS idx, x, y, CASE WHEN id % 4 = 0 THEN 0.3::DOUBLE + id * 0.01 ELSE 0.001::DOUBLE * x + 0.0002::DOUBLE * y END AS xi, CASE WHEN id % 4 = 0 THEN -0.2::DOUBLE ELSE 0.001::DOUBLE * y - 0.0002::DOUBLE * x END AS eta FROM imgstar)"


def _ransac_sql() -> str:
    z = lambda v, s: f"({v}0 * (y1 - y2) + {v}1 * (y2 - y0) + {v}2 * (y0 - y1)) / det AS a{s}, ({v}0 * (x2 - x1) + {v}1 * (x0 - x2) + {v}2 * (x1 - x0)) / det AS b{s}, ({v}0 * (x1 * y2 - x2 * y1) + {v}1 * (x2 * y0 - x0 * y2) + {v}2 * (x0 * y1 - x1 * y0)) / det AS c{s}"
    cols = ", ".join(f"m{n}.{c} AS {c}{n}" for n in range(3) for c in ("x", "y", "xi", "eta"))
    return f"""WITH {IMGSTAR}, {PAIRS}, tr(t, s0, s1, s2) AS (VALUES {', '.join(str((t, *s)) for t, s in enumerate(TRIPLES))}),
p3 AS (SELECT t, {cols} FROM tr JOIN mt m0 ON m0.idx = s0 JOIN mt m1 ON m1.idx = s1 JOIN mt m2 ON m2.idx = s2), pd AS (SELECT *, x0 * (y1 - y2) - y0 * (x1 - x2) + (x1 * y2 - x2 * y1) AS det FROM p3),
md AS (SELECT t, {z('xi', 1)}, {z('eta', 2)} FROM pd WHERE abs(det) >= 1e-20),
hit AS (SELECT t, idx FROM mt, md WHERE sqrt((a1 * x + b1 * y + c1 - xi) ^ 2 + (a2 * x + b2 * y + c2 - eta) ^ 2) < 2 * sqrt(a1 * a1 + a2 * a2)), sc AS (SELECT t, count(*) AS n FROM hit GROUP BY t),
st AS (SELECT min(t) FILTER (WHERE n > 0.8::DOUBLE * (SELECT count(*) FROM mt)) AS stop FROM sc), best AS (SELECT arg_max(t, (n, -t)) AS t, max(n) AS n FROM sc, st WHERE stop IS NULL OR t <= stop)
SELECT idx FROM hit JOIN best USING (t) WHERE best.n >= 6"""


@query(_ransac_sql())
def ransac_inliers(spark, sf_dir):
    """All stars as matches, a quarter of them off the plane; the sampled triples stand among the first ``N``."""
    off = F.col("id") % 4 == 0
    x, y = F.col("x"), F.col("y")
    m = v_imgstar(spark, sf_dir).select((F.col("id") - 1).alias("idx"), "x", "y", F.when(off, 0.3 + F.col("id") * 0.01).otherwise(0.001 * x + 0.0002 * y).alias("xi"), F.when(off, -0.2).otherwise(0.001 * y - 0.0002 * x).alias("eta"))
    return spatial.ransac(m, TRIPLES, 2.0, 6)


ANNOTATED = """ann AS (SELECT frame_id, k1, k2, k3, x * 0.5::DOUBLE AS ax, 499 - y * 0.5::DOUBLE AS ay, least(greatest(1.2::DOUBLE * fwhm / (1 - ecc * ecc * 0.36) ^ 0.25 * 0.5 * 2, 3), 40) AS semi_major, least(greatest(1.2::DOUBLE * fwhm * (1 - ecc * ecc * 0.36) ^ 0.25 * 0.5 * 2, 3), 40) AS semi_minor, 0.0::DOUBLE - theta AS theta,
  CASE WHEN ecc <= 0.5 THEN [0, 255, 0] WHEN ecc <= 0.6 THEN [255, 255, 0] ELSE [255, 64, 64] END AS rgb FROM star)"""


def _annotations(spark, sf_dir):
    """Ellipses at half scale on a flipped image: axes clamped, angle negated, colour by eccentricity."""
    squeeze = F.pow(1 - F.col("ecc") * F.col("ecc") * 0.36, F.lit(0.25))
    clamp = lambda c: F.least(F.greatest(c, F.lit(3.0)), F.lit(40.0))
    rgb = F.when(F.col("ecc") <= 0.5, F.array(F.lit(0), F.lit(255), F.lit(0))).when(F.col("ecc") <= 0.6, F.array(F.lit(255), F.lit(255), F.lit(0))).otherwise(F.array(F.lit(255), F.lit(64), F.lit(64)))
    return v_star(spark, sf_dir).select("frame_id", "k1", "k2", "k3", (F.col("x") * 0.5).alias("ax"), (499 - F.col("y") * 0.5).alias("ay"), clamp(1.2 * F.col("fwhm") / squeeze * 0.5 * 2).alias("semi_major"), clamp(1.2 * F.col("fwhm") * squeeze * 0.5 * 2).alias("semi_minor"), (0.0 - F.col("theta")).alias("theta"), rgb.alias("rgb"))


@query(f"WITH {STAR}, {ANNOTATED} SELECT frame_id, k1, k2, k3, ax, ay, round(semi_major, 6) AS semi_major, round(semi_minor, 6) AS semi_minor, round(theta, 6) AS theta, rgb[1]::INT AS r, rgb[2]::INT AS g, rgb[3]::INT AS b FROM ann")
def annotations(spark, sf_dir):
    a = _annotations(spark, sf_dir)
    return a.select("frame_id", "k1", "k2", "k3", "ax", "ay", *[F.round(c, 6).alias(c) for c in ("semi_major", "semi_minor", "theta")], *[F.col("rgb")[n].alias(c) for n, c in enumerate("rgb")])


_VX = "list_transform(range(65), lambda k: ax + semi_major * cos(2 * pi() * k / 64) * cos(theta) - semi_minor * sin(2 * pi() * k / 64) * sin(theta))"
_VY = "list_transform(range(65), lambda k: ay + semi_major * cos(2 * pi() * k / 64) * sin(theta) + semi_minor * sin(2 * pi() * k / 64) * cos(theta))"


@query(f"WITH {STAR}, {ANNOTATED}, p AS (SELECT frame_id, k1, k2, k3, {_VX} AS vx, {_VY} AS vy FROM ann) SELECT frame_id, k1, k2, k3, len(vx) AS n, round(list_min(vx), 4) + 0.0::DOUBLE AS left_x, round(list_max(vx), 4) + 0.0::DOUBLE AS right_x, round(list_min(vy), 4) + 0.0::DOUBLE AS low_y, round(list_max(vy), 4) + 0.0::DOUBLE AS high_y FROM p")
def ellipse_vertices(spark, sf_dir):
    """The 65 vertices of every star's ellipse, and the box that holds them."""
    t = lambda k: 2 * F.pi() * k / 64
    c = F.col
    vertex = lambda k: F.struct((c("ax") + c("semi_major") * F.cos(t(k)) * F.cos("theta") - c("semi_minor") * F.sin(t(k)) * F.sin("theta")).alias("x"), (c("ay") + c("semi_major") * F.cos(t(k)) * F.sin("theta") + c("semi_minor") * F.sin(t(k)) * F.cos("theta")).alias("y"))
    a = _annotations(spark, sf_dir).withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(64)), vertex))
    ends = {"left_x": F.array_min(c("v.x")), "right_x": F.array_max(c("v.x")), "low_y": F.array_min(c("v.y")), "high_y": F.array_max(c("v.y"))}
    return a.select("frame_id", "k1", "k2", "k3", F.size("v").cast("long").alias("n"), *[F.round(e, 4).alias(n) for n, e in ends.items()])


@query()
def annotation_layer(spark, sf_dir):
    """Painted pixels of each frame's layer of its fifty brightest stars (the drawing is tested in pytest)."""
    import numpy as np
    import pyarrow as pa

    from ..operators import annotate
    from ..shipping import ship

    ship(spark)
    stars = _annotations(spark, sf_dir).join(v_star(spark, sf_dir).select("frame_id", "k1", "k2", "k3", "flux", "ecc"), ["frame_id", "k1", "k2", "k3"])

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("flux", "descending"), ("k1", "ascending"), ("k2", "ascending"), ("k3", "ascending")]).slice(0, 50).to_pylist()
        out = annotate.layer([r | {"x": r["ax"], "y": r["ay"]} for r in rows], 500, 500)
        return pa.table({"frame_id": pa.array([rows[0]["frame_id"]], pa.int64()), "painted": pa.array([int(np.count_nonzero(out[..., 3]))], pa.int64())})

    return stars.groupBy("frame_id").applyInArrow(run, "frame_id long, painted long")
