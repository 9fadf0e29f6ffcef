"""The frame analysis: maps, screening, widths, the fast ladder, batches and data in memory."""

import math

import numpy as np

from starloom import api
from starloom.operators import analysis, detection
from starloom.sources import fits

from test_kernels import field


def scene(n=30, noise=15.0, slope=0.0, seed=3):
    rng = np.random.default_rng(seed)
    img = 1000 + noise * rng.standard_normal((400, 400))
    yy, xx = np.indices(img.shape)
    img += slope * xx
    stars = []
    for k in range(n):
        x, y = 35 + (k % 6) * 64 + rng.uniform(-5, 5), 35 + (k // 6) * 64 + rng.uniform(-5, 5)
        amp = 3000 + 400 * k
        img += amp * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * 2.0**2))
        stars.append((x, y))
    return img, stars


def test_mesh_follows_a_slope():
    img, _ = scene(n=4, slope=2.0)
    m = analysis.mesh(img)
    yy, xx = np.indices(img.shape)
    inner = (slice(40, 360), slice(40, 360))
    assert np.abs(m.background_map - (1000 + 2.0 * xx))[inner].mean() < 15 and 5 < np.median(m.noise_map) < 40


def test_half_maximum_walk():
    yy, xx = np.indices((61, 61))
    for sigma, share in ((1.5, 0.15), (2.5, 0.15), (4.0, 0.25)):  # the ring of 4 to 8 pixels reaches into wide stars
        stamp = 5000 * np.exp(-((xx - 30.3) ** 2 + (yy - 29.8) ** 2) / (2 * sigma**2))
        assert abs(analysis.half_max_sigma(stamp, 30.3, 29.8) - sigma) < share * sigma
    assert analysis.half_max_sigma(np.zeros((61, 61)), 30, 30) == 2.0


def test_analysis_finds_stars_and_the_field_width():
    img, stars = scene(slope=1.0)
    got, facts = analysis.analyze(img, api.AnalysisConfig())
    assert facts["stars_measured"] == len(stars) and abs(facts["field_fwhm"] - 2.3548 * 2.0) < 0.3 and abs(facts["median_fwhm"] - 4.71) < 0.2
    for x, y in stars:
        assert min(math.hypot(s["x"] - x, s["y"] - y) for s in got) < 0.2
    few, same = analysis.analyze(img, api.AnalysisConfig(max_stars=5))
    assert len(few) == 5 and same == facts and [s["flux"] for s in few] == sorted((s["flux"] for s in got), reverse=True)[:5]


def test_cap_deals_from_all_cells():
    stars = [{"x": 10.0 + k % 3, "y": 10.0, "flux": 1000.0 - k} for k in range(50)] + [{"x": 390.0, "y": 390.0, "flux": 1.0}]
    assert analysis.dealt(stars, (400, 400), 2) == [stars[0], stars[-1]] and analysis.dealt(stars, (400, 400), 0) == stars


def test_screening_drops_the_odd_one_and_keeps_the_least_number():
    img, stars = scene(n=20)
    yy, xx = np.indices(img.shape)
    img += 6000 * np.exp(-((xx - 200) ** 2 / (2 * 14.0**2) + (yy - 330) ** 2 / (2 * 3.0**2)))  # a streak
    found = [{"x": x, "y": y, "flux": 4e4, "area": 20, "peak": 4000.0, "ecc": 0.1} for x, y in stars]
    streak = {"x": 200.0, "y": 330.0, "flux": 9e5, "area": 400, "peak": 6000.0, "ecc": 0.9}
    got = analysis.measure_stars(img, 1000.0, [streak, *found], None, 4.7)
    assert len(got) == len(stars) and min(math.hypot(s["x"] - 200, s["y"] - 330) for s in got) > 20
    apart = [dict(s, area=k + 1, peak=10.0 ** (k % 5)) for k, s in enumerate(found[:12])]
    assert len(analysis.measure_stars(img, 1000.0, apart, None, 4.7)) >= 10


def test_flat_stamps_are_left_out():
    assert analysis.measure_stars(np.full((100, 100), 5.0), 5.0, [{"x": 50.0, "y": 50.0, "flux": 1.0, "area": 9, "peak": 1.0, "ecc": 0.0}]) == []


def test_fast_ladder_and_refinement():
    img, stars = scene()
    got, background, noise = analysis.fast(img, 100, refine=True)
    assert abs(background - 1000) < 15 and 8 < noise < 40
    for x, y in stars:
        assert min(math.hypot(s["x"] - x, s["y"] - y) for s in got) < 0.3
    assert len(got) <= len(stars) + 3 and all(s["fwhm"] == 0 or abs(s["fwhm"] - 4.71) < 0.8 for s in got)
    assert len(analysis.fast(img, 8)[0]) == 8 and analysis.fast(np.zeros((5, 5)))[0] == []


def test_tiles_cover_the_frame():
    for shape in ((400, 300), (100, 1200), (13, 13)):
        seen = np.zeros(shape, int)
        for t in analysis.tiles(shape):
            seen[t] += 1
        assert (seen == 1).all()


def test_data_in_memory_and_batches(spark, tmp_path):
    img, stars = scene()
    analyzer = api.FrameAnalyzer(spark).with_max_stars(7)
    frames = api.frames_of(spark, {"a": img.astype(np.float32), "b": np.stack([img] * 3)})
    assert {r.path: r.n for r in analyzer.measured(frames).groupBy("path").count().withColumnRenamed("count", "n").collect()} == {"a": 30, "b": 30}
    assert all(r.stars_measured == 30 for r in analyzer.facts(frames).collect())
    assert analyzer.detected_fast(frames).where("path = 'a'").count() >= 7
    for k in range(3):
        (tmp_path / f"{k}.fits").write_bytes(fits.encode(img[None], -32))
    (tmp_path / "broken.xisf").write_bytes(b"XISF0100" + b"\x00" * 3)
    assert analyzer.stars(str(tmp_path / "0.fits")).count() == 7
    seen = []
    rows = [r for df in analyzer.analyze_batch([str(p) for p in sorted(tmp_path.iterdir())], 2, lambda done, total: seen.append((done, total))) for r in df.collect()]
    assert seen == [(2, 4), (4, 4)] and len(rows) == 3 and all(r.stars_measured == 30 for r in rows)


def test_broken_files_give_a_row_each(spark, tmp_path):
    from starloom.sources import xisf
    from starloom.sources.frames import read_frames

    whole = xisf.encode(np.ones((1, 40, 40)), "UInt16", "zlib")
    parts = {"cut.xisf": whole[:-9], "garbled.xisf": whole[:4100] + b"\xff" * 20, "short.xisf": whole[:20], "text.xisf": b"hello", "short.fits": b"SIMPLE  =", "fine.xisf": whole}
    for name, data in parts.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r.error for r in read_frames(spark, str(tmp_path)).collect()}
    assert set(got) == set(parts) and got["fine.xisf"] is None and all(e for n, e in got.items() if n != "fine.xisf")


def test_mosaics_and_previews(spark, tmp_path):
    mosaic = np.zeros((8, 8))
    mosaic[0::2, 0::2], mosaic[0::2, 1::2], mosaic[1::2, 0::2], mosaic[1::2, 1::2] = 10, 20, 40, 50
    assert api.superpixel(mosaic, "RGGB")[:, 0, 0].tolist() == [10, 30, 50] and api.superpixel(mosaic, "BGGR")[:, 0, 0].tolist() == [50, 30, 10]
    assert api.binned(mosaic).shape == (4, 4) and api.binned(mosaic)[0, 0] == 30
    (tmp_path / "m.fits").write_bytes(fits.encode(field([])[None], 16, 32768.0, {"BAYERPAT": "'RGGB'"}))
    from starloom.sources import images

    row = api.FrameConverter(spark).convert(str(tmp_path), "png").first()
    assert images.unpng(bytes(row.image)).shape == (100, 100, 3)


def test_detection_takes_maps():
    img, stars = scene(slope=3.0)
    m = analysis.mesh(img)
    got = detection.detect(img, m.background_map, m.noise_map, 4.7, second=True)
    assert len(got) >= len(stars) - 2
