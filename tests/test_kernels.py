"""Kernels against known truth."""

import math

import numpy as np
import pytest

from starloom.functions import sky
from starloom.operators import detection, pixels, psf, solve
from starloom.sources import fits, images, xisf


def gaussian(shape, x, y, amp, s, bg=1000.0):
    yy, xx = np.indices(shape)
    return bg + amp * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * s * s))


def field(stars, shape=(200, 200), noise=5.0, seed=1):
    img = noise * np.random.default_rng(seed).standard_normal(shape) + 1000
    for x, y, amp, s in stars:
        img += gaussian(shape, x, y, amp, s, 0.0)
    return img


STARS = [(50, 50, 5000, 3), (100, 80, 3000, 3), (150, 120, 7000, 3), (30, 160, 4000, 3), (170, 40, 6000, 3)]


def test_kernel_is_zero_sum():
    k, e = pixels.gauss_kernel(3.0)
    assert abs(sum(k)) < 1e-12 and e > 0


def test_five_stars_are_found():
    got = detection.detect(field(STARS), 1000.0, 5.0, 7.0)
    for x, y, *_ in STARS:
        assert min(math.hypot(s["x"] - x, s["y"] - y) for s in got) < 1.5


def test_close_pairs_go_on_the_second_pass():
    pair = [(60, 60, 5000, 2), (68, 60, 4500, 2), (140, 140, 5000, 2)]
    got = detection.detect(field(pair, noise=50.0), 1000.0, 50.0, 4.7, second=True)
    assert [s for s in got if math.hypot(s["x"] - 140, s["y"] - 140) < 1]
    assert not [s for s in got if 55 < s["x"] < 73]


def test_chain_keeps_its_far_end():
    assert detection.blended(np.array([0.0, 8.0, 16.0]), np.zeros(3), 10.0).tolist() == [True, True, False]


def test_blend_chain_over_the_whole_image(spark):
    from starloom.plans import kernels
    from starloom.plans.views import v_imgstar

    sf = "/root/testdata/sf0.01"
    stars = sorted(v_imgstar(spark, sf).collect(), key=lambda s: (-s.flux, s.id))
    out = detection.blended(np.array([s.x for s in stars]), np.array([s.y for s in stars]), 12.0)
    assert sorted(r.id for r in kernels.blend_chain(spark, sf).collect()) == sorted(s.id for s, gone in zip(stars, out, strict=True) if not gone)


def test_suppression_is_greedy():
    assert detection.suppress(np.array([0.0, 3.0, 6.0]), np.zeros(3), 4.0) == [0, 2]


def test_ladder_finds_stars():
    got = detection.ladder(field(STARS), [(2000.0, 5.0), (500.0, 5.0)], 1000.0, 20)
    for x, y, *_ in STARS:
        assert min(math.hypot(s["x"] - x, s["y"] - y) for s in got) < 0.5


def test_hot_pixel_is_no_star():
    img = field([(60, 60, 4000, 2)], (120, 120))
    img[30, 30] += 10_000
    assert not [s for s in detection.ladder(img, [(500.0, 5.0)], 1000.0, 20) if math.hypot(s["x"] - 30, s["y"] - 30) < 3]


def test_noise_of_layers():
    img = np.random.default_rng(2).normal(1000, 30, (200, 200)) + gaussian((200, 200), 100, 100, 2000, 25, 0.0)
    one, four = detection.mrs_noise(img, 1), detection.mrs_noise(img, 4)
    assert four <= one * 1.05 and 20 < one < 35


@pytest.mark.parametrize("sx,sy,theta", [(2.0, 2.0, 0.0), (3.0, 2.0, 0.3), (2.5, 2.0, math.pi / 4)])
def test_gaussian_fit(sx, sy, theta):
    yy, xx = np.indices((25, 25))
    dx, dy = xx - 12.3, yy - 11.8
    u, v = math.cos(theta) * dx + math.sin(theta) * dy, math.cos(theta) * dy - math.sin(theta) * dx
    m = psf.fit_gaussian(100 + 5000 * np.exp(-(u * u / sx**2 + v * v / sy**2) / 2))
    assert abs(m["x"] - 12.3) < 0.05 and abs(m["y"] - 11.8) < 0.05 and abs(m["fwhm_x"] - 2.3548 * sx) < 0.25 and abs(m["fwhm_y"] - 2.3548 * sy) < 0.25


def test_moffat_fit():
    yy, xx = np.indices((31, 31))
    stamp = 500 + 8000 * (1 + ((xx - 15.2) ** 2 + (yy - 14.7) ** 2) / 3.0**2) ** -3.5
    m = psf.fit_moffat(stamp)
    assert abs(m["beta"] - 3.5) < 0.3 and abs(m["fwhm_x"] - 6 * math.sqrt(2 ** (1 / 3.5) - 1)) < 0.1 and abs(m["x"] - 15.2) < 0.05
    assert abs(psf.fit_moffat(stamp, beta=3.5)["y"] - 14.7) < 0.05


def test_refined_centre():
    img = gaussian((201, 201), 100.37, 100.61, 8000, 2.0, 500.0)
    m = psf.fit_moffat(img[90:111, 90:111], beta=4.0, rounds=25, tol=1e-4)
    assert math.hypot(90 + m["x"] - 100.37, 90 + m["y"] - 100.61) < 0.05


@pytest.mark.parametrize("codec", ["none", "zlib", "lz4", "lz4hc", "zstd", "zlib+sh", "lz4+sh", "zstd+sh"])
def test_xisf_round_trip(codec):
    px = np.random.default_rng(0).integers(0, 65535, (3, 10, 13)).astype(np.uint16)
    for embedded in (False, True):
        meta, got = xisf.decode(xisf.encode(px, "UInt16", codec, embedded))
        assert (got == px).all() and meta["channels"] == 3


def test_xisf_size_mismatch():
    data = xisf.encode(np.zeros((1, 8, 8), np.uint16), "UInt16", "zstd")
    with pytest.raises(Exception):
        xisf.decode(data.replace(b"zstd:128", b"zstd:192"))


@pytest.mark.parametrize("planes,ok", [(1, True), (3, True), (5, False)])
def test_fits_planes(planes, ok):
    data = fits.encode(np.ones((3, 4, 5)), -32).replace(b"NAXIS3  =                    3", f"NAXIS3  = {planes:>20}".encode())
    if ok:
        assert fits.decode(data)[1].shape[0] == planes
    else:
        with pytest.raises(ValueError):
            fits.decode(data)


def test_fits_orientation_and_pattern():
    meta, _ = fits.decode(fits.encode(np.ones((1, 4, 5)), 16, extra={"ROWORDER": "'TOP-DOWN'", "BAYERPAT": "'GBRG'"}))
    assert meta["flip"] is False and meta["bayer"] == "GBRG"


def test_png_and_jpeg():
    px = np.random.default_rng(0).integers(0, 255, (20, 33, 3)).astype(np.uint8)
    assert (images.unpng(images.png(px)) == px).all()
    data = images.jpeg(px, 300)
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9" and data == images.jpeg(np.dstack([px, px[..., 0]]), 100)
    with pytest.raises(ValueError):
        images.jpeg(px[..., :2])


def test_wcs_headers_and_scale():
    w = sky.Wcs((10.0, 20.0), (150.0, 25.0), ((1 / 3600, 0.0), (0.0, 1 / 3600)))
    assert dict(w.headers())["CTYPE1"] == "'RA---TAN'" and abs(w.scale_arcsec() - 1) < 1e-12
    assert dict(w.headers())["CD1_1"] == "2.777777777777778E-4"


def test_scenes_have_every_star(spark):
    from starloom.plans import kernels

    sf = "/root/testdata/sf0.001"
    frames = kernels.scenes(spark, sf).collect()
    assert sum(len(f.stars) for f in frames) == spark.read.parquet(f"{sf}/customer.parquet").count()
    for f in frames:
        assert len({(s.sx // 40, s.sy // 50) for s in f.stars}) == len(f.stars) <= 12 and all(20 <= s.sx < 168 and 20 <= s.sy < 128 for s in f.stars)


def test_samples_are_deterministic():
    t = solve.triples(20)
    assert len(t) == 100 and all(len(set(x)) == 3 for x in t) and t == solve.triples(20)


def test_frames_reader(spark, tmp_path):
    from starloom.sources.frames import read_frames

    px = np.arange(12).reshape(1, 3, 4)
    (tmp_path / "a.fits").write_bytes(fits.encode(px, 16, 32768.0))
    (tmp_path / "b.xisf").write_bytes(xisf.encode(px, "UInt16", "zlib"))
    (tmp_path / "c.fits").write_bytes(b"nothing")
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_frames(spark, str(tmp_path)).collect()}
    assert rows["a.fits"].width == 4 and rows["b.xisf"].height == 3 and rows["c.fits"].error
    assert np.frombuffer(rows["a.fits"].data, np.uint16).tolist() == list(range(12))
