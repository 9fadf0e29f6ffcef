"""Robust statistics and frame quality on the measured stars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import quality
from .registry import query
from .views import STAR, STAR_TRAILED, v_star

UM = "{0}[len({0}) // 2 + 1]"
LISTS = "lists AS (SELECT frame_id, list_sort(list({0})) AS l0 FROM star GROUP BY frame_id)"


def clip_rounds(n: int, kappa: float, least: int, floor: str, key: str = "frame_id") -> str:
    """CTEs c1..cn of clipping rounds on the lists of ``lists``."""
    out, source, name = [], "lists", "l0"
    for k in range(1, n + 1):
        out.append(
            f"""c{k} AS (SELECT {key}, l0, CASE WHEN len(l) < {least} OR s < {floor} THEN l ELSE list_filter(l, lambda q: abs(q - m) <= {kappa}::DOUBLE * s) END AS l FROM (
  SELECT {key}, l0, l, m, 1.4826::DOUBLE * list_sort(list_transform(l, lambda q: abs(q - m)))[len(l) // 2 + 1] AS s FROM (
    SELECT {key}, l0, {name} AS l, {UM.format(name)} AS m FROM {source})))"""
        )
        source, name = f"c{k}", "l"
    return ",\n".join(out)


@query(f"WITH {STAR} SELECT frame_id, count(*) AS n, list_sort(list(flux))[count(*) // 2 + 1] AS median_flux FROM star GROUP BY frame_id")
def upper_median_by_frame(spark, sf_dir):
    return v_star(spark, sf_dir).groupBy("frame_id").agg(F.count("*").alias("n"), stats.median_of("flux").alias("median_flux"))


@query(f"WITH {STAR}, {LISTS.format('fwhm')}, m AS (SELECT frame_id, l0, {UM.format('l0')} AS m FROM lists) SELECT frame_id, m AS median_fwhm, round(1.4826::DOUBLE * list_sort(list_transform(l0, lambda q: abs(q - m)))[len(l0) // 2 + 1], 9) AS madn_fwhm FROM m")
def madn_by_frame(spark, sf_dir):
    df = v_star(spark, sf_dir).groupBy("frame_id").agg(stats.values("fwhm").alias("l"))
    return df.select("frame_id", stats.upper_median(F.col("l")).alias("median_fwhm"), F.round(stats.madn(F.col("l")), 9).alias("madn_fwhm"))


@query(f"WITH {STAR}, {LISTS.format('flux')}, {clip_rounds(2, 3.0, 3, '1e-10')} SELECT frame_id, CASE WHEN len(l) = 0 THEN {UM.format('l0')} ELSE {UM.format('l')} END AS clipped_flux FROM c2")
def sigma_clipped_median(spark, sf_dir):
    df = v_star(spark, sf_dir).groupBy("frame_id").agg(stats.values("flux").alias("l"))
    return df.select("frame_id", quality.clipped_median(F.col("l")).alias("clipped_flux"))


def weighted_sql(source: str, value: str = "v") -> str:
    """(frame_id, m): the weighted median of rows (frame_id, v, w)."""
    return f"""SELECT frame_id, min({value}) AS m FROM (SELECT frame_id, {value}, sum(w) OVER (PARTITION BY frame_id ORDER BY {value}, w ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY frame_id) AS t FROM {source} WHERE w > 0) WHERE c >= t / 2 GROUP BY frame_id"""


def weighted_clip_sql(source: str, tag: str) -> str:
    """CTEs ending in {tag}w2: the clipped weighted median of rows (frame_id, v, w)."""
    out, rows = [], source
    for k in (0, 1):
        out.append(f"{tag}w{k} AS ({weighted_sql(rows)})")
        out.append(f"{tag}s{k} AS (SELECT r.frame_id, any_value(m) AS m, count(*) AS n, 1.4826::DOUBLE * list_sort(list(abs(v - m)))[count(*) // 2 + 1] AS s FROM {rows} r JOIN {tag}w{k} USING (frame_id) GROUP BY r.frame_id)")
        out.append(f"{tag}r{k} AS (SELECT r.* FROM {rows} r JOIN {tag}s{k} USING (frame_id) WHERE n < 3 OR s < 1e-10 OR abs(v - m) <= 3.0::DOUBLE * s)")
        rows = f"{tag}r{k}"
    return ",\n".join([*out, f"{tag}w2 AS ({weighted_sql(rows)})"])


@query(f"WITH {STAR}, src AS (SELECT frame_id, fwhm AS v, 1 / (1 + fit_residual) AS w FROM star) SELECT frame_id, m AS weighted_fwhm FROM ({weighted_sql('src')})")
def weighted_median(spark, sf_dir):
    pair = F.struct(F.col("fwhm").alias("v"), (1 / (1 + F.col("fit_residual"))).alias("w"))
    return v_star(spark, sf_dir).groupBy("frame_id").agg(stats.values(pair).alias("l")).select("frame_id", stats.weighted_median(F.col("l")).alias("weighted_fwhm"))


@query(f"WITH {STAR}, src AS (SELECT frame_id, flux AS v, 1 / (1 + fit_residual) AS w FROM star), {weighted_clip_sql('src', 'a')} SELECT frame_id, m AS flux_scw FROM aw2")
def sc_weighted_median(spark, sf_dir):
    pair = F.struct(F.col("flux").alias("v"), (1 / (1 + F.col("fit_residual"))).alias("w"))
    df = v_star(spark, sf_dir).groupBy("frame_id").agg(stats.values(pair).alias("l"))
    return df.select("frame_id", quality.clipped_weighted_median(F.col("l")).alias("flux_scw"))


CAP = 50


@query(
    f"""WITH {STAR}, cell AS (SELECT *, least((y / 250)::DOUBLE, 3.0) AS gy0, least(floor(x / 250), 3) AS gx, least(floor(y / 250), 3) AS gy FROM star),
ranked AS (SELECT *, (gy * 4 + gx)::BIGINT AS cell, row_number() OVER (PARTITION BY frame_id, gx, gy ORDER BY flux DESC, k1, k2, k3) AS rn FROM cell),
picked AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY rn, cell) AS pick FROM ranked)
SELECT frame_id, pick::BIGINT AS pick, cell, rn::BIGINT AS round_no, x, y, flux FROM picked WHERE pick <= {CAP}"""
)
def roundrobin_cap(spark, sf_dir):
    """The brightest of each of 4 x 4 cells in turn, up to the cap."""
    g = lambda c: F.least(F.floor(F.col(c) / 250), F.lit(3))
    df = v_star(spark, sf_dir).withColumn("cell", (g("y") * 4 + g("x")).cast("long"))
    df = df.withColumn("rn", F.row_number().over(Window.partitionBy("frame_id", "cell").orderBy(F.desc("flux"), "k1", "k2", "k3"))).where(f"rn <= {CAP}")
    df = df.withColumn("pick", F.row_number().over(Window.partitionBy("frame_id").orderBy("rn", "cell"))).where(f"pick <= {CAP}")
    return df.select("frame_id", F.col("pick").cast("long").alias("pick"), "cell", F.col("rn").cast("long").alias("round_no"), "x", "y", "flux")


BOUNDS = f"""tl AS (SELECT frame_id, list_sort(list(fwhm)) AS f, list_sort(list(ecc)) AS e, list_sort(list(peak / flux * 30)) AS s FROM star GROUP BY frame_id),
tm AS (SELECT *, {UM.format('f')} AS mf, {UM.format('e')} AS me, {UM.format('s')} AS ms FROM tl),
td AS (SELECT *, greatest(1.4826::DOUBLE * list_sort(list_transform(f, lambda q: abs(q - mf)))[len(f) // 2 + 1], 0.5::DOUBLE) AS df, greatest(1.4826::DOUBLE * list_sort(list_transform(e, lambda q: abs(q - me)))[len(e) // 2 + 1], 0.03::DOUBLE) AS de, greatest(1.4826::DOUBLE * list_sort(list_transform(s, lambda q: abs(q - ms)))[len(s) // 2 + 1], 0.1::DOUBLE) AS ds FROM tm),
bounds AS (SELECT frame_id, greatest(mf - 3 * df, 1.0::DOUBLE) AS fwhm_lo, least(mf + 3 * df, 200.0::DOUBLE) AS fwhm_hi, greatest(me + 3 * de, 0.85::DOUBLE) AS ecc_max, greatest(ms - 3 * ds, 0.15::DOUBLE) AS sharp_lo, least(ms + 3 * ds, 8.0::DOUBLE) AS sharp_hi FROM td)"""


def _bounds(stars):
    """Adaptive screening bounds of every frame: median plus or minus 3 deviations, with floors and ceilings."""
    df = stars.groupBy("frame_id").agg(stats.values("fwhm").alias("f"), stats.values("ecc").alias("e"), stats.values(F.col("peak") / F.col("flux") * 30).alias("s"))
    m = {c: stats.upper_median(F.col(c)) for c in "fes"}
    d = {c: F.greatest(stats.madn(F.col(c)), F.lit(floor)) for c, floor in (("f", 0.5), ("e", 0.03), ("s", 0.1))}
    return df.select("frame_id", F.greatest(m["f"] - 3 * d["f"], F.lit(1.0)).alias("fwhm_lo"), F.least(m["f"] + 3 * d["f"], F.lit(200.0)).alias("fwhm_hi"), F.greatest(m["e"] + 3 * d["e"], F.lit(0.85)).alias("ecc_max"), F.greatest(m["s"] - 3 * d["s"], F.lit(0.15)).alias("sharp_lo"), F.least(m["s"] + 3 * d["s"], F.lit(8.0)).alias("sharp_hi"))


@query(f"WITH {STAR}, {BOUNDS} SELECT frame_id, round(fwhm_lo, 6) AS fwhm_lo, round(fwhm_hi, 6) AS fwhm_hi, round(ecc_max, 6) AS ecc_max, round(sharp_lo, 6) AS sharp_lo, round(sharp_hi, 6) AS sharp_hi FROM bounds")
def adaptive_thresholds(spark, sf_dir):
    b = _bounds(v_star(spark, sf_dir))
    return b.select("frame_id", *[F.round(c, 6).alias(c) for c in b.columns[1:]])


@query(f"WITH {STAR}, {BOUNDS} SELECT s.frame_id, k1, k2, k3, flux, fwhm, ecc FROM star s JOIN bounds b USING (frame_id) WHERE fwhm >= fwhm_lo AND fwhm <= fwhm_hi AND ecc <= ecc_max AND peak / flux * 30 BETWEEN sharp_lo AND sharp_hi")
def screened(spark, sf_dir):
    s = v_star(spark, sf_dir)
    sharp = F.col("peak") / F.col("flux") * 30
    keep = F.col("fwhm").between(F.col("fwhm_lo"), F.col("fwhm_hi")) & (F.col("ecc") <= F.col("ecc_max")) & sharp.between(F.col("sharp_lo"), F.col("sharp_hi"))
    return s.join(_bounds(s), "frame_id").where(keep).select("frame_id", "k1", "k2", "k3", "flux", "fwhm", "ecc")


TRAIL = f"""fl AS (SELECT frame_id, list_sort(list(fwhm)) AS l0 FROM star GROUP BY frame_id), lists AS (SELECT * FROM fl), {clip_rounds(2, 3.0, 3, '1e-10')},
field AS (SELECT frame_id, CASE WHEN len(l) = 0 THEN {UM.format('l0')} ELSE {UM.format('l')} END AS field_fwhm FROM c2),
sums AS (SELECT frame_id, count(*) AS n, sum(cos(2 * theta)) AS sc, sum(sin(2 * theta)) AS ss, sum(cos(2 * (theta - atan2(y - 500, x - 500)))) AS rc, sum(sin(2 * (theta - atan2(y - 500, x - 500)))) AS rs,
  corr(ecc, sqrt((x - 500) * (x - 500) + (y - 500) * (y - 500))) AS corr, median(ecc) AS med_ecc FROM star GROUP BY frame_id),
ray AS (SELECT s.*, field_fwhm, (sc * sc + ss * ss) / (n * n) AS r_sq, (rc * rc + rs * rs) / (n * n) AS radial_r_sq FROM sums s JOIN field USING (frame_id)),
trail AS (SELECT *, exp(-n * r_sq) AS p, exp(-n * radial_r_sq) AS radial_p, n >= 20 AND field_fwhm >= 2 AND ((r_sq > 0.5 AND exp(-n * r_sq) < 0.01) OR (r_sq > 0.15 AND med_ecc > 0.7 AND exp(-n * r_sq) < 0.05))
  AND NOT ((radial_r_sq > 0.15 AND exp(-n * radial_r_sq) < 0.05) OR coalesce(corr, 0) > 0.25) AS possibly_trailed FROM ray)"""


@query(f"WITH {STAR_TRAILED}, {TRAIL} SELECT frame_id, n, round(r_sq, 6) AS r_sq, round(radial_r_sq, 6) AS radial_r_sq, round(p, 6) AS p, round(corr, 6) AS corr, round(med_ecc, 6) AS med_ecc, possibly_trailed FROM trail")
def trail_rayleigh(spark, sf_dir):
    dist = F.sqrt((F.col("x") - 500) * (F.col("x") - 500) + (F.col("y") - 500) * (F.col("y") - 500))
    df = v_star(spark, sf_dir, trailed=True).groupBy("frame_id").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in quality.axial_sums().items()], F.corr("ecc", dist).alias("corr"), F.median("ecc").alias("med_ecc"), stats.values("fwhm").alias("l"))
    df = quality.trail_columns(df.withColumn("field_fwhm", quality.clipped_median(F.col("l"))))
    return df.select("frame_id", "n", *[F.round(c, 6).alias(c) for c in ("r_sq", "radial_r_sq", "p", "corr", "med_ecc")], "possibly_trailed")


def quality_sql(star: str) -> str:
    return f"""WITH {star}, {TRAIL}, used AS (SELECT s.*, 1 / (1 + fit_residual) AS w FROM star s JOIN trail USING (frame_id)
  JOIN (SELECT frame_id, count(*) FILTER (WHERE ecc <= 0.8) AS nr FROM star GROUP BY frame_id) r USING (frame_id) WHERE possibly_trailed OR nr < 3 OR ecc <= 0.8),
fr AS (SELECT frame_id, fwhm AS v, w FROM used), er AS (SELECT frame_id, ecc AS v, w FROM used), {weighted_clip_sql('fr', 'f')}, {weighted_clip_sql('er', 'e')},
med AS (SELECT frame_id, list_sort(list(flux))[count(*) // 2 + 1] AS mflux, list_sort(list(peak))[count(*) // 2 + 1] AS mpeak, list_sort(list(beta) FILTER (WHERE beta IS NOT NULL)) AS b, count(beta) AS nb FROM star GROUP BY frame_id)
SELECT t.frame_id, t.n AS stars_measured, round(f.m, 6) AS median_fwhm, round(e.m, 6) AS median_eccentricity, round(mflux * mflux / (50.0::DOUBLE * 50 * 1000), 4) AS snr_weight, round(mpeak / 50, 6) AS psf_signal, round(20.0::DOUBLE, 6) AS frame_snr,
  round(r_sq, 6) AS trail_r_squared, possibly_trailed, round({UM.format('b')}, 6) AS median_beta, nb AS moffat_count, t.n - nb AS gaussian_count
FROM trail t JOIN fw2 f ON f.frame_id = t.frame_id JOIN ew2 e ON e.frame_id = t.frame_id JOIN med ON med.frame_id = t.frame_id"""


@query(quality_sql(STAR))
def frame_quality(spark, sf_dir):
    return quality.frame_quality(v_star(spark, sf_dir))


@query(quality_sql(STAR_TRAILED))
def frame_quality_trailed(spark, sf_dir):
    return quality.frame_quality(v_star(spark, sf_dir, trailed=True))


@query(f"WITH {STAR} SELECT frame_id, " + ", ".join(f"round(quantile_cont(fwhm, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM star GROUP BY frame_id")
def percentile_dump(spark, sf_dir):
    pct = F.percentile("fwhm", F.array(*[F.lit(p / 100) for p in (10, 25, 50, 75, 90)]))
    df = v_star(spark, sf_dir).groupBy("frame_id").agg(pct.alias("p"))
    return df.select("frame_id", *[F.round(F.col("p")[k], 6).alias(f"p{p}") for k, p in enumerate((10, 25, 50, 75, 90))])


@query(f"WITH {STAR}, {LISTS.format('flux')} SELECT frame_id, " + ", ".join(f"l0[round({p / 100}::DOUBLE * (len(l0) - 1))::INT + 1] AS r{p}" for p in (5, 50, 95)) + " FROM lists")
def nearest_rank_pct(spark, sf_dir):
    df = v_star(spark, sf_dir).groupBy("frame_id").agg(stats.values("flux").alias("l"))
    return df.select("frame_id", *[F.get("l", F.round(p / 100 * (F.size("l") - 1)).cast("int")).alias(f"r{p}") for p in (5, 50, 95)])


@query(f"WITH {STAR}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, k1, k2, k3) AS rank FROM star WHERE ecc < 0.5 AND k2 >= 3) SELECT frame_id, rank::BIGINT AS rank, k1, k2, k3, flux, ecc FROM r WHERE rank <= 100")
def calibration_stars(spark, sf_dir):
    """Round stars of enough area (its stand-in is k2), the first 100 by flux."""
    w = Window.partitionBy("frame_id").orderBy(F.desc("flux"), "k1", "k2", "k3")
    return v_star(spark, sf_dir).where("ecc < 0.5 AND k2 >= 3").withColumn("rank", F.row_number().over(w)).where("rank <= 100").select("frame_id", F.col("rank").cast("long").alias("rank"), "k1", "k2", "k3", "flux", "ecc")


@query(f"WITH {STAR}, m AS (SELECT frame_id, list_sort(list(fwhm))[count(*) // 2 + 1] AS ff FROM star GROUP BY frame_id), r AS (SELECT s.*, row_number() OVER (PARTITION BY frame_id ORDER BY abs(fwhm - ff), flux DESC, k1, k2, k3) AS near FROM star s JOIN m USING (frame_id)), t AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, k1, k2, k3) AS rank FROM r WHERE near <= 10) SELECT frame_id, rank::BIGINT AS rank, k1, k2, k3, fwhm, flux FROM t")
def closest_to_field(spark, sf_dir):
    """The ten stars nearest to the field's FWHM, brightest first."""
    s = v_star(spark, sf_dir)
    field = s.groupBy("frame_id").agg(stats.values("fwhm").alias("l")).select("frame_id", stats.upper_median(F.col("l")).alias("ff"))
    ties = [F.desc("flux"), "k1", "k2", "k3"]
    near = s.join(field, "frame_id").withColumn("near", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.abs(F.col("fwhm") - F.col("ff")), *ties))).where("near <= 10")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("frame_id").orderBy(*ties))).select("frame_id", F.col("rank").cast("long").alias("rank"), "k1", "k2", "k3", "fwhm", "flux")


@query(f"WITH {STAR} SELECT frame_id, k1, k2, k3, fwhm, CASE WHEN k2 > 1 THEN round(fwhm * (3.76::DOUBLE / (k2 * 100) * 206.265::DOUBLE), 6) END AS fwhm_arcsec FROM star")
def arcsec(spark, sf_dir):
    """Plate scale of 3.76 um pixels; the focal length stands in for k2, and none is known where it is 1."""
    scale = 3.76 / (F.col("k2") * 100) * 206.265
    return v_star(spark, sf_dir).select("frame_id", "k1", "k2", "k3", "fwhm", F.when(F.col("k2") > 1, F.round(F.col("fwhm") * scale, 6)).alias("fwhm_arcsec"))


@query(f"WITH {STAR} SELECT frame_id, count(*) FILTER (WHERE beta IS NOT NULL) AS moffat_count, count(*) FILTER (WHERE beta IS NULL) AS gaussian_count, count(*) AS total FROM star GROUP BY frame_id")
def method_counts(spark, sf_dir):
    return v_star(spark, sf_dir).groupBy("frame_id").agg(F.count_if(F.col("beta").isNotNull()).alias("moffat_count"), F.count_if(F.col("beta").isNull()).alias("gaussian_count"), F.count("*").alias("total"))


REF = "ref AS (SELECT frame_id, printf('frame_%d_%s.fits', frame_id, CASE WHEN frame_id % 3 = 0 THEN '300.00s' ELSE '30.00s' END) AS file, list_sort(list(fwhm))[count(*) // 2 + 1] AS ours, avg(fwhm) AS theirs, stddev_pop(fwhm) AS spread, count(*) AS n FROM star GROUP BY frame_id)"


def _ref(spark, sf_dir):
    """Own robust figures beside a reference's plain ones, by file."""
    name = F.format_string("frame_%d_%s.fits", F.col("frame_id"), F.when(F.col("frame_id") % 3 == 0, "300.00s").otherwise("30.00s"))
    df = v_star(spark, sf_dir).groupBy("frame_id").agg(stats.median_of("fwhm").alias("ours"), F.avg("fwhm").alias("theirs"), F.stddev_pop("fwhm").alias("spread"), F.count("*").alias("n"))
    return df.select("frame_id", name.alias("file"), "ours", "theirs", "spread", "n")


@query(f"WITH {STAR}, {REF} SELECT r.file, round(r.ours, 6) AS ours, round(o.theirs, 6) AS theirs, round(r.ours - o.theirs, 6) AS diff, round(r.spread, 6) AS spread FROM ref r LEFT JOIN (SELECT file, theirs FROM ref WHERE frame_id % 7 <> 0) o ON o.file = r.file")
def compare_report(spark, sf_dir):
    """Own results with the reference's where it has the file."""
    r = _ref(spark, sf_dir)
    other = r.where("frame_id % 7 <> 0").select("file", "theirs")
    return r.drop("theirs").join(other, "file", "left").select("file", F.round("ours", 6).alias("ours"), F.round("theirs", 6).alias("theirs"), F.round(F.col("ours") - F.col("theirs"), 6).alias("diff"), F.round("spread", 6).alias("spread"))


@query(f"WITH {STAR}, {REF} SELECT count(*) AS n, round(regr_slope(ours, theirs), 6) AS slope, round(regr_intercept(ours, theirs), 6) AS intercept, round(regr_r2(ours, theirs), 6) AS r2, round(avg(ours - theirs), 6) AS mean_diff, round(stddev_pop(ours - theirs), 6) AS std_diff FROM ref")
def compare_regression(spark, sf_dir):
    d = F.col("ours") - F.col("theirs")
    return _ref(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.regr_slope("ours", "theirs"), 6).alias("slope"), F.round(F.regr_intercept("ours", "theirs"), 6).alias("intercept"), F.round(F.regr_r2("ours", "theirs"), 6).alias("r2"), F.round(F.avg(d), 6).alias("mean_diff"), F.round(F.stddev_pop(d), 6).alias("std_diff"))


@query(f"WITH {STAR}, {REF} SELECT file, round(abs(ours - theirs), 6) AS gap FROM ref ORDER BY abs(ours - theirs) DESC, file LIMIT 5")
def compare_outliers(spark, sf_dir):
    """The five files that differ most."""
    gap = F.abs(F.col("ours") - F.col("theirs"))
    return _ref(spark, sf_dir).orderBy(gap.desc(), "file").limit(5).select("file", F.round(gap, 6).alias("gap"))


GROUPS = ["300.00s", "30.00s", "frame_1", ".fits"]


@query("WITH " + STAR + ", " + REF + " " + " UNION ALL ".join(f"SELECT '{g}' AS label, count(*) AS n, round(avg(ours), 6) AS mean_ours, round(coalesce(regr_r2(ours, theirs), 0), 6) AS r2 FROM ref WHERE contains(file, '{g}') HAVING count(*) > 0" for g in GROUPS))
def compare_groups(spark, sf_dir):
    """Statistics of overlapping groups: a file is in every group whose label its name holds."""
    labels = F.array_compact(F.array(*[F.when(F.contains("file", F.lit(g)), F.lit(g)) for g in GROUPS]))
    return _ref(spark, sf_dir).withColumn("label", F.explode(labels)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("ours"), 6).alias("mean_ours"), F.round(F.coalesce(F.regr_r2("ours", "theirs"), F.lit(0.0)), 6).alias("r2"))


@query(f"WITH {STAR} SELECT frame_id, k1, k2, k3, round(sqrt((x - 500) * (x - 500) + (y - 300) * (y - 300)), 6) AS dist FROM star WHERE (x - 500) * (x - 500) + (y - 300) * (y - 300) <= 900")
def near_filter(spark, sf_dir):
    d2 = (F.col("x") - 500) * (F.col("x") - 500) + (F.col("y") - 300) * (F.col("y") - 300)
    return v_star(spark, sf_dir).where(d2 <= 900).select("frame_id", "k1", "k2", "k3", F.round(F.sqrt(d2), 6).alias("dist"))
