"""Structured Streaming: new frame files under a folder, decoded as they come (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.frames import decode_frames

FILE = "path string, modificationTime timestamp, length long, content binary"


def watch_frames(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of decoded frames, one row a new file."""
    return decode_frames(spark.readStream.format("binaryFile").schema(FILE).load(folder))


def rolling_quality(stars: DataFrame, time_col: str, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Mean width, star count and spread in event-time windows of a stream of measured stars."""
    w = stars.withWatermark(time_col, late).groupBy(F.window(time_col, window))
    return w.agg(F.count("*").alias("stars"), F.avg("fwhm").alias("mean_fwhm"), F.stddev_pop("fwhm").alias("spread")).select("window.start", "window.end", "stars", "mean_fwhm", "spread")
