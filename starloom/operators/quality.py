"""Frame quality: robust medians, trail test, weights; one row a frame, one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

ROUND_ECC = 0.8
TRAIL_LIMIT = 0.5
CENTRE = 500.0


def clipped_median(a: Column) -> Column:
    """Median of sorted values after two clipping rounds at 3 deviations."""
    kept = stats.clipped(a, 3.0, 2, 3, 1e-10)
    return stats.let(kept, lambda k: F.when(F.size(k) == 0, stats.upper_median(a)).otherwise(stats.upper_median(k)))


def clipped_weighted_median(pairs: Column) -> Column:
    """The same with the weighted median as centre, of (v, w) sorted by v."""
    kept = pairs
    for _ in range(2):
        spread = lambda p, m: stats.MAD_SCALE * stats.upper_median(F.sort_array(F.transform(p, lambda q: F.abs(q["v"] - m))))
        kept = stats.let(kept, lambda p: stats.let(stats.weighted_median(p), lambda m: stats.let(spread(p, m), lambda s: F.when((F.size(p) < 3) | (s < 1e-10), p).otherwise(F.filter(p, lambda q: F.abs(q["v"] - m) <= 3.0 * s)))))
    return stats.let(kept, lambda k: stats.weighted_median(F.when(F.size(k) == 0, pairs).otherwise(k)))


def axial_sums() -> dict[str, Column]:
    """Sums of the doubled angles, and of the angles against the direction from the centre."""
    phi = F.atan2(F.col("y") - CENTRE, F.col("x") - CENTRE)
    turn = 2 * (F.col("theta") - phi)
    return {"sc": F.sum(F.cos(2 * F.col("theta"))), "ss": F.sum(F.sin(2 * F.col("theta"))), "rc": F.sum(F.cos(turn)), "rs": F.sum(F.sin(turn))}


def trail_columns(df: DataFrame, limit: float = TRAIL_LIMIT) -> DataFrame:
    """Adds r_sq, p, radial_r_sq, radial_p and possibly_trailed from the sums, n, med_ecc, corr and field_fwhm."""
    nn = F.col("n") * F.col("n")
    df = df.withColumn("r_sq", (F.col("sc") * F.col("sc") + F.col("ss") * F.col("ss")) / nn).withColumn("radial_r_sq", (F.col("rc") * F.col("rc") + F.col("rs") * F.col("rs")) / nn)
    df = df.withColumn("p", F.exp(-F.col("n") * F.col("r_sq"))).withColumn("radial_p", F.exp(-F.col("n") * F.col("radial_r_sq")))
    fires = ((F.col("r_sq") > limit) & (F.col("p") < 0.01)) | ((F.col("r_sq") > 0.15) & (F.col("med_ecc") > 0.7) & (F.col("p") < 0.05))
    optics = ((F.col("radial_r_sq") > 0.15) & (F.col("radial_p") < 0.05)) | (F.coalesce("corr", F.lit(0.0)) > 0.25)
    return df.withColumn("possibly_trailed", (F.col("n") >= 20) & (F.col("field_fwhm") >= 2.0) & fires & ~optics)


def frame_quality(stars: DataFrame, background: float = 1000.0, noise: float = 50.0, trail_limit: float = TRAIL_LIMIT) -> DataFrame:
    """All statistics of every frame; a star's weight is 1 / (1 + residual)."""
    dist = F.sqrt((F.col("x") - CENTRE) * (F.col("x") - CENTRE) + (F.col("y") - CENTRE) * (F.col("y") - CENTRE))
    w = 1 / (1 + F.col("fit_residual"))
    df = stars.groupBy("frame_id").agg(
        F.count("*").alias("n"),
        *[c.alias(k) for k, c in axial_sums().items()],
        F.corr("ecc", dist).alias("corr"),
        F.median("ecc").alias("med_ecc"),
        stats.values("fwhm").alias("fwhms"),
        stats.values("flux").alias("fluxes"),
        stats.values("peak").alias("peaks"),
        stats.values("beta").alias("betas"),
        F.collect_list(F.struct("fwhm", "ecc", w.alias("w"))).alias("stars"),
    )
    df = trail_columns(df.withColumn("field_fwhm", clipped_median(F.col("fwhms"))), trail_limit)
    rounds = F.filter("stars", lambda s: s["ecc"] <= ROUND_ECC)
    df = df.withColumn("used", F.when(F.col("possibly_trailed") | (F.size(rounds) < 3), F.col("stars")).otherwise(rounds))
    pairs = lambda name: F.sort_array(F.transform("used", lambda s: F.struct(s[name].alias("v"), s["w"].alias("w"))))
    df = df.withColumn("median_fwhm", clipped_weighted_median(pairs("fwhm"))).withColumn("median_ecc", clipped_weighted_median(pairs("ecc")))
    flux = stats.upper_median(F.col("fluxes"))
    return df.select(
        "frame_id",
        F.col("n").alias("stars_measured"),
        F.round("median_fwhm", 6).alias("median_fwhm"),
        F.round("median_ecc", 6).alias("median_eccentricity"),
        F.round(flux * flux / (noise * noise * background), 4).alias("snr_weight"),
        F.round(stats.upper_median(F.col("peaks")) / noise, 6).alias("psf_signal"),
        F.round(F.lit(background / noise), 6).alias("frame_snr"),
        F.round("r_sq", 6).alias("trail_r_squared"),
        "possibly_trailed",
        F.when(F.size("betas") > 0, F.round(stats.upper_median(F.col("betas")), 6)).alias("median_beta"),
        F.size("betas").cast("long").alias("moffat_count"),
        (F.col("n") - F.size("betas")).alias("gaussian_count"),
    )
