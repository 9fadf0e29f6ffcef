"""Image queries on the pixel view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import background as bg
from ..operators import pixels as px
from .registry import query
from .views import PIX, RGB, v_pix, v_rgb

SIZE = "sz AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM pix)"
MADV = "list_sort(list(abs(v - med)))[count(*) // 2 + 1]"
PARAMS = f"""med AS (SELECT list_sort(list(v))[count(*) // 2 + 1] AS med FROM pix), dev AS (SELECT any_value(med) / 65536 AS m, 1.4826::DOUBLE * {MADV} / 65536 AS s FROM pix, med),
cut AS (SELECT m, s, m > 0.5 AS up, CASE WHEN m > 0.5 OR s = 0 THEN 0.0::DOUBLE ELSE least(greatest(m - 2.8::DOUBLE * s, 0), 1) END AS shadows, CASE WHEN m <= 0.5 OR s = 0 THEN 1.0::DOUBLE ELSE least(greatest(m + 2.8::DOUBLE * s, 0), 1) END AS highlights FROM dev),
ab AS (SELECT *, CASE WHEN up THEN 0.25::DOUBLE ELSE m - shadows END AS a, CASE WHEN up THEN highlights - m ELSE 0.25::DOUBLE END AS b FROM cut),
params AS (SELECT shadows, highlights, CASE WHEN a = 0 THEN 0.0::DOUBLE WHEN a = b THEN 0.5::DOUBLE WHEN a = 1 THEN 1.0::DOUBLE ELSE (b - 1) * a / ((2 * b - 1) * a - b) END AS midtones FROM ab)"""


@query(f"WITH {PIX}, {PARAMS} SELECT round(shadows, 9) AS shadows, round(highlights, 9) AS highlights, round(midtones, 9) AS midtones FROM params")
def stretch_params(spark, sf_dir):
    return px.stretch_params(v_pix(spark, sf_dir)).select(*[F.round(c, 9).alias(c) for c in ("shadows", "highlights", "midtones")])


@query(
    f"""WITH {PIX}, {PARAMS}, k AS (SELECT shadows * 65536 AS lo, highlights * 65536 AS hi, midtones AS m, (midtones - 1) * hs * 255 / 65536 AS k1, (2 * midtones - 1) * hs / 65536 AS k2 FROM (SELECT *, CASE WHEN highlights = shadows THEN 1.0::DOUBLE ELSE 1 / (highlights - shadows) END AS hs FROM params))
SELECT x, y, (CASE WHEN v < lo THEN 0 WHEN v >= hi THEN 255 ELSE floor(least(greatest((v - lo) * k1 / ((v - lo) * k2 - m), 0), 255)) END)::INT AS u8 FROM pix, k"""
)
def stretch_apply(spark, sf_dir):
    return px.stretch(v_pix(spark, sf_dir))


@query(f"WITH {RGB} SELECT x, y, round(0.2126::DOUBLE * max(v) FILTER (WHERE c = 0) + 0.7152::DOUBLE * max(v) FILTER (WHERE c = 1) + 0.0722::DOUBLE * max(v) FILTER (WHERE c = 2), 6) AS lum FROM rgb GROUP BY x, y")
def luminance(spark, sf_dir):
    plane = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    return v_rgb(spark, sf_dir).groupBy("x", "y").agg(F.round(0.2126 * plane(0) + 0.7152 * plane(1) + 0.0722 * plane(2), 6).alias("lum"))


@query(f"WITH {PIX} SELECT p.x, p.y, round(CASE WHEN (p.x + p.y) % 2 = 1 THEN any_value(p.v) ELSE avg(q.v) END, 6) AS green FROM pix p JOIN pix q ON abs(p.x - q.x) + abs(p.y - q.y) = 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y IN (p.y - 1, p.y, p.y + 1) GROUP BY p.x, p.y".replace("FROM pix p JOIN pix q ON abs(p.x - q.x) + abs(p.y - q.y) = 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y IN (p.y - 1, p.y, p.y + 1)", "FROM pix p CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy) LEFT JOIN pix q ON q.x = p.x + dx AND q.y = p.y + dy"))
def green_interp(spark, sf_dir):
    return px.green(v_pix(spark, sf_dir)).select("x", "y", F.round("v", 6).alias("green"))


@query(f"WITH {PIX}, {SIZE} SELECT x // 2 AS x, y // 2 AS y, max(v) FILTER (WHERE x % 2 = 0 AND y % 2 = 0) AS r, round((max(v) FILTER (WHERE x % 2 = 1 AND y % 2 = 0) + max(v) FILTER (WHERE x % 2 = 0 AND y % 2 = 1)) / 2, 6) AS g, max(v) FILTER (WHERE x % 2 = 1 AND y % 2 = 1) AS b FROM pix, sz WHERE x < w - w % 2 AND y < h - h % 2 GROUP BY x // 2, y // 2")
def superpixel_debayer(spark, sf_dir):
    return px.superpixel(v_pix(spark, sf_dir)).select("x", "y", "r", F.round("g", 6).alias("g"), "b")


@query(f"WITH {PIX}, {SIZE} SELECT x // 2 AS x, y // 2 AS y, round(avg(v), 6) AS v FROM pix, sz WHERE x < w - w % 2 AND y < h - h % 2 GROUP BY x // 2, y // 2")
def bin2x2(spark, sf_dir):
    return px.bin2(v_pix(spark, sf_dir)).select("x", "y", F.round("v", 6).alias("v"))


@query(f"WITH {PIX}, {SIZE} SELECT x // 3 AS x, y // 3 AS y, v FROM pix, sz WHERE x % 3 = 0 AND y % 3 = 0 AND x // 3 < w // 3 AND y // 3 < h // 3")
def downscale_n(spark, sf_dir):
    return px.downscale(v_pix(spark, sf_dir), 3)


@query(f"WITH {PIX}, {SIZE} SELECT x, h - 1 - y AS y, v FROM pix, sz")
def flip_vertical(spark, sf_dir):
    return px.flip(v_pix(spark, sf_dir))


@query(f"WITH {PIX} SELECT x, y, u8 AS r, u8 AS g, u8 AS b, 255 AS a FROM (SELECT x, y, (floor(least(v, 255)))::INT AS u8 FROM pix)")
def gray_to_rgba(spark, sf_dir):
    u8 = F.floor(F.least("v", F.lit(255.0))).cast("int")
    return v_pix(spark, sf_dir).select("x", "y", u8.alias("r"), u8.alias("g"), u8.alias("b"), F.lit(255).alias("a"))


def _pass_sql(name: str, source: str, axis: str, kernel: list[float], spacing: int = 1, reflect: bool = True) -> str:
    other, n = ("y", "w") if axis == "x" else ("x", "h")
    taps = ", ".join(f"({k - len(kernel) // 2}, {w!r}::DOUBLE)" for k, w in enumerate(kernel))
    j = f"p.{axis} + o.d * {spacing}"
    if reflect:
        at = f"greatest(least(CASE WHEN {j} < 0 THEN -({j}) WHEN {j} >= {n} THEN 2 * {n} - 2 - ({j}) ELSE {j} END, {n} - 1), 0)"
        return f"{name} AS (SELECT p.x, p.y, sum(q.v * o.k ORDER BY o.d) AS v FROM {source} p CROSS JOIN sz CROSS JOIN (VALUES {taps}) o(d, k) JOIN {source} q ON q.{other} = p.{other} AND q.{axis} = {at} GROUP BY p.x, p.y)"
    r = len(kernel) // 2
    return f"{name} AS (SELECT p.x, p.y, CASE WHEN p.{axis} < {r} OR p.{axis} >= any_value({n}) - {r} THEN 0.0::DOUBLE ELSE sum(q.v * o.k ORDER BY o.d) END AS v FROM {source} p CROSS JOIN sz CROSS JOIN (VALUES {taps}) o(d, k) LEFT JOIN {source} q ON q.{other} = p.{other} AND q.{axis} = {j} GROUP BY p.x, p.y)"


def _smooth_sql(name: str, source: str, spacing: int) -> str:
    return _pass_sql(f"{name}h", source, "x", px.B3, spacing) + ", " + _pass_sql(name, f"{name}h", "y", px.B3, spacing)


def _even(v):
    """Rounded off the ties that sixteenths of hundredths give; engines differ on these."""
    return F.round(v + 1e-9, 6)


@query(f"WITH {PIX}, {SIZE}, {_smooth_sql('s1', 'pix', 1)} SELECT x, y, round(v + 1e-9, 6) AS v FROM s1")
def b3_smooth(spark, sf_dir):
    return px.b3_smooth(v_pix(spark, sf_dir)).select("x", "y", _even(F.col("v")).alias("v"))


@query(f"WITH {PIX}, {SIZE}, {_smooth_sql('s2', 'pix', 2)} SELECT x, y, round(v + 1e-9, 6) AS v FROM s2")
def b3_dilated(spark, sf_dir):
    return px.b3_smooth(v_pix(spark, sf_dir), layer=2).select("x", "y", _even(F.col("v")).alias("v"))


KERNEL, ENERGY = px.gauss_kernel(3.0)
CONV = f"{_pass_sql('gh', 'pix', 'x', KERNEL, 1, False)}, {_pass_sql('gv', 'gh', 'y', KERNEL, 1, False)}, conv AS (SELECT x, y, round(v, 6) AS v FROM gv)"


@query(f"WITH {PIX}, {SIZE}, {CONV} SELECT x, y, v FROM conv")
def gauss_convolve(spark, sf_dir):
    return px.convolve(v_pix(spark, sf_dir), 3.0).select("x", "y", F.round("v", 6).alias("v"))


PEAKS = f"""nb AS (SELECT p.x, p.y, any_value(p.v) AS v, max(q.v) AS rim, count(*) FILTER (WHERE q.v > 40) AS above, count(*) AS n FROM conv p CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)) o(dx, dy) JOIN conv q ON q.x = p.x + dx AND q.y = p.y + dy WHERE p.v > 40 GROUP BY p.x, p.y)"""


@query(f"WITH {PIX}, {SIZE}, {CONV}, {PEAKS} SELECT x, y, v FROM nb WHERE v > rim AND above >= 3 AND n = 8")
def local_maxima(spark, sf_dir):
    return px.local_maxima(gauss_convolve(spark, sf_dir), 40.0)


SHAPE = f"{SIZE}, sh AS (SELECT *, (w + cell - 1) // cell AS nx, (h + cell - 1) // cell AS ny FROM (SELECT w, h, greatest(greatest(w, h) // 32, 16) AS cell FROM sz))"
UL = "l[len(l) // 2 + 1]"


def _mesh_sql() -> str:
    out, name = ["m0 AS (SELECT x // cell AS cx, y // cell AS cy, list_sort(list(v)) AS l, count(*) AS n FROM pix, sh GROUP BY ALL)"], "m0"
    for k in (1, 2, 3):
        out.append(f"m{k} AS (SELECT cx, cy, n, CASE WHEN len(l) < 10 OR s < 1e-6 THEN l ELSE list_filter(l, lambda q: abs(q - m) <= 3.0::DOUBLE * s) END AS l FROM (SELECT *, 1.4826::DOUBLE * list_sort(list_transform(l, lambda q: abs(q - m)))[len(l) // 2 + 1] AS s FROM (SELECT *, {UL} AS m FROM {name})))")
        name = f"m{k}"
    return ", ".join(out) + f""", mesh AS (SELECT cx, cy, n, len(l) AS kept, CASE WHEN abs(a - m) < 0.3::DOUBLE * s THEN 2.5::DOUBLE * m - 1.5::DOUBLE * a ELSE m END AS bg, greatest(s, 0.001::DOUBLE) AS sigma, n >= 10 AND len(l) >= n * 7 // 10 AS valid
  FROM (SELECT *, list_sum(l) / len(l) AS a, 1.4826::DOUBLE * list_sort(list_transform(l, lambda q: abs(q - m)))[len(l) // 2 + 1] AS s FROM (SELECT *, {UL} AS m FROM m3)))"""


MESH = _mesh_sql()
FILL = """fill AS (SELECT c.cx, c.cy, c.valid, CASE WHEN c.valid THEN c.bg ELSE coalesce(f.bg, 0) END AS bg, CASE WHEN c.valid THEN c.sigma ELSE coalesce(f.sigma, 1) END AS sigma FROM mesh c LEFT JOIN (
  SELECT a.cx, a.cy, arg_min(b.bg, (greatest(abs(a.cx - b.cx), abs(a.cy - b.cy)), abs(a.cx - b.cx) + abs(a.cy - b.cy), b.cy, b.cx)) AS bg, arg_min(b.sigma, (greatest(abs(a.cx - b.cx), abs(a.cy - b.cy)), abs(a.cx - b.cx) + abs(a.cy - b.cy), b.cy, b.cx)) AS sigma
  FROM mesh a JOIN mesh b ON b.valid WHERE NOT a.valid GROUP BY a.cx, a.cy) f ON f.cx = c.cx AND f.cy = c.cy)"""
MED3 = "med3 AS (SELECT a.cx, a.cy, any_value(a.valid) AS valid, list_sort(list(b.bg))[count(*) // 2 + 1] AS bg, any_value(a.sigma) AS sigma FROM fill a JOIN fill b ON b.cx BETWEEN a.cx - 1 AND a.cx + 1 AND b.cy BETWEEN a.cy - 1 AND a.cy + 1 GROUP BY a.cx, a.cy)"
HEAD = f"WITH {PIX}, {SHAPE}, {MESH}"


@query(f"{HEAD} SELECT cx, cy, n, kept, round(bg, 6) AS bg, round(sigma, 6) AS sigma, valid FROM mesh")
def mesh_cells(spark, sf_dir):
    return bg.cells(v_pix(spark, sf_dir)).select("cx", "cy", "n", "kept", F.round("bg", 6).alias("bg"), F.round("sigma", 6).alias("sigma"), "valid")


def _half_valid(mesh):
    """Every third cell counts as invalid, so that filling has work to do."""
    return mesh.withColumn("valid", F.col("valid") & ((F.col("cx") + F.col("cy")) % 3 != 0))


HALF = FILL.replace("FROM mesh c LEFT", "FROM half c LEFT").replace("FROM mesh a JOIN mesh b", "FROM half a JOIN half b")


@query(f"{HEAD}, half AS (SELECT * REPLACE (valid AND (cx + cy) % 3 <> 0 AS valid) FROM mesh), {HALF} SELECT cx, cy, valid, round(bg, 6) AS bg, round(sigma, 6) AS sigma FROM fill")
def mesh_fill(spark, sf_dir):
    m = bg.filled(_half_valid(bg.cells(v_pix(spark, sf_dir))))
    return m.select("cx", "cy", "valid", F.round("bg", 6).alias("bg"), F.round("sigma", 6).alias("sigma"))


@query(f"{HEAD}, {FILL}, {MED3} SELECT cx, cy, round(bg, 6) AS bg FROM med3")
def mesh_median3(spark, sf_dir):
    return bg.median3(bg.filled(bg.cells(v_pix(spark, sf_dir)))).select("cx", "cy", F.round("bg", 6).alias("bg"))


@query(f"{HEAD}, {FILL}, {MED3} SELECT round(list_sort(list(bg))[count(*) // 2 + 1], 6) AS background, round(CASE WHEN count(*) FILTER (WHERE valid) = 0 THEN 1.0 ELSE greatest(list_sort(list(sigma) FILTER (WHERE valid))[count(*) FILTER (WHERE valid) // 2 + 1], 0.001) END, 6) AS noise FROM med3")
def mesh_global(spark, sf_dir):
    return bg.overall(bg.median3(bg.filled(bg.cells(v_pix(spark, sf_dir))))).select(F.round("background", 6).alias("background"), F.round("noise", 6).alias("noise"))


def _weight_sql(t: str, k: int) -> str:
    return [f"(-0.5::DOUBLE * {t} * {t} * {t} + {t} * {t} - 0.5::DOUBLE * {t})", f"(1.5::DOUBLE * {t} * {t} * {t} - 2.5::DOUBLE * {t} * {t} + 1)", f"(-1.5::DOUBLE * {t} * {t} * {t} + 2.0::DOUBLE * {t} * {t} + 0.5::DOUBLE * {t})", f"(0.5::DOUBLE * {t} * {t} * {t} - 0.5::DOUBLE * {t} * {t})"][k]


def _bicubic_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT x, y, least(greatest(ix + {i - 1}, 0), nx - 1) AS cx, least(greatest(iy + {j - 1}, 0), ny - 1) AS cy, {_weight_sql('ty', j)} * {_weight_sql('tx', i)} AS wt FROM pos" for i in range(4) for j in range(4))
    return f"""pos AS (SELECT x, y, nx, ny, floor(fx)::BIGINT AS ix, floor(fy)::BIGINT AS iy, fx - floor(fx) AS tx, fy - floor(fy) AS ty FROM (SELECT x, y, nx, ny, (x - cell * 0.5::DOUBLE) / cell AS fx, (y - cell * 0.5::DOUBLE) / cell AS fy FROM pix, sh)), taps AS ({parts})"""


@query(f"{HEAD}, {FILL}, {MED3}, {_bicubic_sql()} SELECT t.x, t.y, round(CASE WHEN any_value(nx) < 2 OR any_value(ny) < 2 THEN (SELECT bg FROM med3 WHERE cx = 0 AND cy = 0) ELSE sum(wt * bg) END, 4) AS bg FROM taps t JOIN med3 m USING (cx, cy), sh GROUP BY t.x, t.y")
def mesh_bicubic(spark, sf_dir):
    p = v_pix(spark, sf_dir)
    return bg.surface(p, bg.median3(bg.filled(bg.cells(p)))).select("x", "y", F.round("bg", 4).alias("bg"))


def _spread_sql(rounds: int) -> str:
    out = [f"r0 AS (SELECT 0.0::DOUBLE AS sd, false AS done)"]  # noqa: F541
    for k in range(rounds):
        used = "TRUE" if k == 0 else "abs(d) <= 3.0::DOUBLE * sd"
        out.append(f"r{k + 1} AS (SELECT CASE WHEN done THEN sd ELSE greatest(nw, 1e-6) END AS sd, done OR ({'TRUE' if k else 'FALSE'} AND abs(sd - nw) < 0.05::DOUBLE * greatest(nw, 1e-6)) AS done FROM (SELECT any_value(sd) AS sd, any_value(done) AS done, coalesce(sqrt(sum(d * d) FILTER (WHERE {used}) / count(*) FILTER (WHERE {used})), greatest(any_value(sd), 1)) AS nw FROM smp, r{k}))")
    return ", ".join(out)


HIST = f"""{PIX}, {SIZE}, bins AS (SELECT round(v) AS b, count(*) AS n, sum(v) AS s FROM pix WHERE v > 0 AND v < 65000 AND round(v) >= 1 AND round(v) < 65000 GROUP BY round(v)),
mode AS (SELECT arg_max(b, (n, -b)) AS mode, sum(s) / sum(n) AS mean FROM bins), bg AS (SELECT CASE WHEN mean > 1.5::DOUBLE * mode THEN mean ELSE mode END AS bg FROM mode),
stp AS (SELECT CASE WHEN st % 2 = 0 THEN st + 1 ELSE st END AS st FROM (SELECT greatest(round(h / 71.0::DOUBLE), 1)::BIGINT AS st FROM sz)), smp AS (SELECT v - bg AS d FROM pix, bg, stp WHERE x % st = 0 AND y % st = 0 AND v <> 0 AND v < 2 * bg), {_spread_sql(7)}"""


@query(f"WITH {HIST} SELECT round(bg, 6) AS bg, round(sd, 6) AS sd FROM bg, r7")
def hist_mode_bg(spark, sf_dir):
    return bg.histogram_background(v_pix(spark, sf_dir)).select(F.round("bg", 6).alias("bg"), F.round("sd", 6).alias("sd"))


@query(f"WITH {HIST}, cum AS (SELECT b, sum(n) OVER (ORDER BY b DESC) AS cum FROM bins), lv AS (SELECT max(b) FILTER (WHERE cum >= 120) AS l1, max(b) FILTER (WHERE cum >= 480) AS l2 FROM cum) SELECT round(greatest(coalesce(l1, bg) - bg - 1, greatest(3.5::DOUBLE * sd, 1)), 6) AS level1, round(greatest(coalesce(l2, bg) - bg - 1, greatest(3.5::DOUBLE * sd, 1)), 6) AS level2 FROM lv, bg, r7")
def star_levels(spark, sf_dir):
    p = v_pix(spark, sf_dir)
    return bg.star_levels(p, bg.histogram_background(p), 20).select(F.round("level1", 6).alias("level1"), F.round("level2", 6).alias("level2"))


def _tiles_sql() -> str:
    out = ["t0 AS (SELECT tx, ty, l, list_sum(l) / len(l) AS mean, 1.0::DOUBLE AS sd, false AS done FROM tl)"]
    for k in range(5):
        used = "l" if k == 0 else "list_filter(l, lambda q: abs(q - mean) <= 3.0::DOUBLE * sd)"
        out.append(
            f"""t{k + 1} AS (SELECT tx, ty, l, CASE WHEN stop OR len(c) = 0 THEN mean ELSE list_sum(c) / len(c) END AS mean, CASE WHEN stop THEN sd ELSE greatest(nw, 1e-6) END AS sd, stop OR ({'TRUE' if k else 'FALSE'} AND abs(sd - nw) < 0.1::DOUBLE * greatest(nw, 1e-6)) AS done FROM (
  SELECT *, list_filter(l, lambda q: abs(q - mean) <= 3.0::DOUBLE * greatest(nw, 1e-6)) AS c FROM (SELECT *, done OR len(u) = 0 AS stop, sqrt(list_sum(list_transform(u, lambda q: (q - mean) * (q - mean))) / len(u)) AS nw FROM (SELECT *, {used} AS u FROM t{k}))))"""
        )
    return ", ".join(out)


@query(
    f"""WITH {PIX}, {SIZE}, g AS (SELECT *, (w + nx - 1) // nx AS tw, (h + ny - 1) // ny AS th FROM (SELECT w, h, CASE WHEN w >= h THEN 12 ELSE greatest(12 * w // h, 1) END AS nx, CASE WHEN w >= h THEN greatest(12 * h // w, 1) ELSE 12 END AS ny FROM sz)),
tp AS (SELECT v, x - (x // tw) * tw AS ox, y - (y // th) * th AS oy, x // tw AS tx, y // th AS ty, greatest(greatest(least((x // tw) * tw + tw, w) - (x // tw) * tw, least((y // th) * th + th, h) - (y // th) * th) // 64, 1) AS st FROM pix, g),
tl AS (SELECT tx, ty, list_sort(list(v)) AS l FROM tp WHERE ox % st = 0 AND oy % st = 0 GROUP BY tx, ty), {_tiles_sql()} SELECT tx, ty, round(mean, 3) AS mean, round(sd, 3) AS sd FROM t5"""
)
def local_bg_tiles(spark, sf_dir):
    return bg.tile_noise(v_pix(spark, sf_dir)).select("tx", "ty", F.round("mean", 3).alias("mean"), F.round("sd", 3).alias("sd"))
