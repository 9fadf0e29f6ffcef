"""Queries on crowded, larger and odd tables."""

import threading

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from starloom import catalogue
from starloom.operators import spatial
from starloom.sources import fits
from test_oracles import plain


def against_sql(spark, folder, name, table):
    """The query's rows and its SQL's, on the tables of a folder."""
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = catalogue.QUERIES[name](spark, str(folder))
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLES[name]})").fetchall()
    return plain(got.select(*cols).collect()), plain(want)


def test_suppression_of_a_crowd(spark):
    """30,000 stars on one spot and one apart: listing the 450 million pairs would take minutes."""
    crowd = spark.range(30_000).selectExpr("id", "id % 100 / 10.0D AS x", "id div 3000 * 1.0D AS y", "cast(id % 977 AS double) AS flux").union(spark.sql("SELECT -1L, 100.0D, 100.0D, -5.0D"))
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = sorted(r.id for r in spatial.suppressed(crowd, 24.0).collect())
    finally:
        late.cancel()
    assert got == [-1, 976]


@pytest.mark.parametrize("name", ["nms_greedy", "centroid_dedup"])
def test_suppression_of_odd_stars(spark, tmp_path, name):
    """Keys twice, NaN and null fluxes, no key."""
    keys = [k for k in range(3000)] + [5, 5, 77, None]
    flux = [float("nan") if k % 50 == 3 else None if k % 50 == 4 else float(k * 37 % 101) for k in range(3000)] + [1.0, 1e9, None, 3.0]
    pq.write_table(pa.table({"c_custkey": pa.array(keys, pa.int64()), "c_acctbal": pa.array(flux, pa.float64())}), tmp_path / "customer.parquet")
    got, want = against_sql(spark, tmp_path, name, "customer")
    assert got == want


@pytest.mark.parametrize("name", ["stretch_params", "stretch_apply"])
def test_stretch_takes_every_pixel(spark, tmp_path, name):
    """A gradient of more than 500,000 pixels: leaving out its end moves the median."""
    n = np.arange(510_000)
    pq.write_table(pa.table({"event_id": n, "value": n // 100 * 0.01}), tmp_path / "events.parquet")
    got, want = against_sql(spark, tmp_path, name, "events")
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 70_001])
def test_whole_median_is_exact(spark, n):
    from pyspark.sql import functions as F

    from starloom.operators import pixels

    for v in (np.random.default_rng(n).exponential(50, n), np.random.default_rng(n).integers(-3, 3, n).astype(float)):
        df = spark.createDataFrame(pa.table({"v": v}))
        assert pixels.whole_median(df, F.col("v")).collect()[0].med == np.sort(v)[n // 2]


def test_u16_files_of_brighter_pixels(spark, tmp_path):
    """Values from 655.36 on, and negative ones, are past unsigned 16 bits of hundredths."""
    n = np.arange(5000)
    v = n % 977 * 0.67
    v[[17, 1500, 1501, 2600, 2601, 2602, 2603]] = 655.35, 655.36, 700.25, 40000.5, 167773.17, 1e15, -3.5
    v[4000] = 655.35
    pq.write_table(pa.table({"event_id": n, "value": v}), tmp_path / "events.parquet")
    got, want = against_sql(spark, tmp_path, "fits_roundtrip_u16", "events")
    assert got == want
    assert fits.holds(np.array([0.0, 65535.0]), 16, 32768.0)
    assert not any(fits.holds(np.array([b]), 16, 32768.0) for b in (-1.0, 65536.0, np.nan))
