"""How the driver's tables stand for frames, sources and catalogues.

Each view comes as a DataFrame function and as SQL text for the oracle.
``events`` is one image of 100 columns, ``lineitem`` the measured stars of a
frame per supplier, ``customer`` an image's star list, ``part`` a sky catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image as pixels (x, y, v)."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 100).alias("x"), F.expr("event_id div 100").alias("y"), F.col("value").alias("v"))


PIX = "pix AS (SELECT event_id % 100 AS x, event_id // 100 AS y, value AS v FROM events)"


def v_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved colour pixels (c, x, y, v) of whole triples."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    whole = e.agg((F.expr("count(*) div 3")).alias("n"))
    p = e.select((F.col("event_id") % 3).alias("c"), F.expr("event_id div 3").alias("i"), F.col("value").alias("v"))
    return p.crossJoin(F.broadcast(whole)).where("i < n").select("c", (F.col("i") % 100).alias("x"), F.expr("i div 100").alias("y"), "v")  # ``whole`` is one row


RGB = "rgb AS (SELECT event_id % 3 AS c, (event_id // 3) % 100 AS x, event_id // 300 AS y, value AS v FROM events WHERE event_id // 3 < (SELECT count(*) // 3 FROM events))"


def v_star(spark: SparkSession, sf_dir: str, trailed: bool = False) -> DataFrame:
    """Measured stars, a frame per supplier."""
    line = table(spark, sf_dir, "lineitem")
    theta = (F.col("l_tax") * 100 - 4) / 8 * F.pi()
    if trailed:
        theta = F.when(F.col("l_suppkey") % 2 == 0, 0.2 + F.col("l_tax")).otherwise(theta)
    return line.select(
        F.col("l_suppkey").alias("frame_id"),
        F.col("l_extendedprice").alias("flux"),
        (1.5 + F.col("l_quantity") / 20).alias("fwhm"),
        (F.col("l_discount") * 10).alias("ecc"),
        theta.alias("theta"),
        (F.col("l_partkey") % 1000).cast("double").alias("x"),
        (F.col("l_orderkey") % 1000).cast("double").alias("y"),
        F.col("l_tax").alias("fit_residual"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("peak"),
        F.when(F.col("l_linestatus") != "F", 2.5 + F.col("l_discount") * 10).alias("beta"),
        F.col("l_orderkey").alias("k1"),
        F.col("l_linenumber").alias("k2"),
        F.col("l_partkey").alias("k3"),
    )


def _star(theta: str) -> str:
    return f"""star AS (SELECT l_suppkey AS frame_id, l_extendedprice AS flux, 1.5::DOUBLE + l_quantity / 20 AS fwhm, l_discount * 10 AS ecc,
  {theta} AS theta, (l_partkey % 1000)::DOUBLE AS x, (l_orderkey % 1000)::DOUBLE AS y, l_tax AS fit_residual,
  l_extendedprice / l_quantity AS peak, CASE WHEN l_linestatus <> 'F' THEN 2.5::DOUBLE + l_discount * 10 END AS beta,
  l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3 FROM lineitem)"""


STAR = _star("(l_tax * 100 - 4) / 8 * pi()")
STAR_TRAILED = _star("CASE WHEN l_suppkey % 2 = 0 THEN 0.2::DOUBLE + l_tax ELSE (l_tax * 100 - 4) / 8 * pi() END")


def v_imgstar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image's star list (id, x, y, flux)."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919 % 10007 / 10.0).alias("x"), (F.col("c_custkey") * 104729 % 10009 / 10.0).alias("y"), F.col("c_acctbal").alias("flux"))


IMGSTAR = "imgstar AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10007) / 10.0::DOUBLE AS x, (c_custkey * 104729 % 10009) / 10.0::DOUBLE AS y, c_acctbal AS flux FROM customer)"


def v_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sky catalogue in degrees with proper motions in mas a year."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 137508 % 360000 / 1000.0).alias("ra"), (F.col("p_partkey") * 7919 % 120000 / 1000.0 - 60).alias("dec"), (F.col("p_retailprice") / 100).alias("mag"), (F.col("p_size") * 10).cast("double").alias("pmra"), (F.col("p_size") * -5).cast("double").alias("pmdec"))


SKY = "sky AS (SELECT p_partkey AS id, (p_partkey * 137508 % 360000) / 1000.0::DOUBLE AS ra, (p_partkey * 7919 % 120000) / 1000.0::DOUBLE - 60 AS dec, p_retailprice / 100 AS mag, (p_size * 10)::DOUBLE AS pmra, (p_size * -5)::DOUBLE AS pmdec FROM part)"
