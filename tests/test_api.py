"""Frames from files to stars, quality and previews; the streaming watcher."""

import math

import numpy as np

from starloom.api import FrameAnalyzer, FrameConverter, stretched
from starloom.sources import fits, images
from starloom.streaming.watch import watch_frames

from test_kernels import STARS, field


def test_stars_and_quality(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(fits.encode(np.clip(field(STARS, noise=20.0), 0, 65535)[None], 16, 32768.0))
    analyzer = FrameAnalyzer(spark).with_detection_sigma(6.0)
    got = analyzer.stars(str(tmp_path)).collect()
    for x, y, *_ in STARS:
        assert min(math.hypot(s.x - x, s.y - y) for s in got) < 0.5
    q = analyzer.quality(str(tmp_path)).first()
    assert q.stars_measured == len(got) and abs(q.median_fwhm - 7.06) < 0.5 and not q.possibly_trailed


def test_convert(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(fits.encode(field(STARS)[None], -32))
    row = FrameConverter(spark, downscale=2).convert(str(tmp_path), "png").first()
    assert images.unpng(bytes(row.image)).shape == (100, 100, 3)


def test_non_finite_pixels_are_black():
    px = np.full((1, 64, 64), 1000.0)
    px[0, 10:50, 10:50] = 3000 + np.random.default_rng(0).normal(0, 50, (40, 40))
    px[0, :4] = np.nan
    out = stretched(px)
    assert (out[:4] == 0).all() and (stretched(np.full((1, 8, 8), np.nan)) == 0).all()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fits").write_bytes(fits.encode(np.ones((1, 4, 5)), 16))
    q = watch_frames(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("watched").count() == 1


def test_saved_files(spark, tmp_path):
    from starloom.api import save_images

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fits").write_bytes(fits.encode(field(STARS)[None], -32))
    got = save_images(FrameConverter(spark).convert(str(tmp_path / "in"), "jpeg"), str(tmp_path / "out"), "jpg").collect()
    assert (tmp_path / "out" / "a.jpg").stat().st_size == got[0].bytes


def test_reference_table(spark, tmp_path):
    from starloom.sources.frames import read_reference

    (tmp_path / "r.csv").write_text('Report,1\nsomething\nIndex,File,FWHM,Stars\n1,"a, b.fits",2.5,100\n2,c.fits,oops,7\nshort\n')
    got = {r.File: r for r in read_reference(spark, str(tmp_path / "r.csv")).collect()}
    assert got["a, b.fits"].FWHM == 2.5 and got["c.fits"].FWHM == 0.0 and got["c.fits"].Stars == 7 and len(got) == 2


def test_annotation_drawing():
    from starloom.operators import annotate

    out = annotate.layer([{"x": 50, "y": 25, "semi_major": 10, "semi_minor": 5, "theta": 0.0, "ecc": 0.8, "rgb": [0, 255, 0]}], 100, 60)
    assert out[25, 60].tolist() == [0, 255, 0, 255] and out[20, 50, 3] == 255 and out[25, 50, 3] == 0 and out[25, 62, 3] == 255
    assert len(annotate.thick(np.array([[5, 5]]), 3)) == 9 and annotate.line(0, 0, 3, 1).tolist() == [[0, 0], [1, 0], [2, 1], [3, 1]]
    assert annotate.with_markers(np.zeros((20, 20)), [(10, 10)])[10, 12].tolist() == [255, 64, 64] and annotate.fit_panels(np.eye(4), np.eye(4)).shape == (32, 96, 3)
