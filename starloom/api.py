"""User API: analyse and convert frames of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import analysis, detection
from .shipping import map_arrow
from .sources import images
from .sources.frames import FRAME, decode_frames, read_frames

STAR_FIELDS = "x y peak flux fwhm ecc theta beta fit_residual snr hfr".split()


@dataclass(frozen=True)
class AnalysisConfig:
    detection_sigma: float = 5.0
    min_star_area: int = 5
    saturation: float = 62_258.0
    noise_layers: int = 2
    max_stars: int = 200
    measure_cap: int = 500
    trail_threshold: float = 0.5
    centroid_refine: bool = False


def luminance(px: np.ndarray) -> np.ndarray:
    return px[0] if px.shape[0] == 1 else 0.2126 * px[0] + 0.7152 * px[1] + 0.0722 * px[2]


class FrameAnalyzer:
    """Builder-style analyser: ``FrameAnalyzer(spark).with_detection_sigma(4).stars(path)``."""

    def __init__(self, spark: SparkSession, config: AnalysisConfig = AnalysisConfig()):
        self.spark, self.config = spark, config

    def __getattr__(self, name: str):
        if name.startswith("with_") and name[5:] in AnalysisConfig.__dataclass_fields__:
            return lambda value: FrameAnalyzer(self.spark, replace(self.config, **{name[5:]: value}))
        raise AttributeError(name)

    def _run(self, frames: DataFrame, function, fields: list[str], texts: list[str]) -> DataFrame:
        """A row for each that ``function(luminance, config)`` returns for a frame in the reader's form (path, width, ..., data)."""
        config = self.config
        names = ["path", *fields, *texts]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("path", pa.string()), *[(f, pa.float64()) for f in fields], *[(t, pa.string()) for t in texts]])
            for batch in batches:
                for row in batch.to_pylist():
                    px = np.frombuffer(row["data"], row["dtype"]).reshape(row["channels"], row["height"], row["width"]).astype(float)
                    got = function(luminance(px), config)
                    yield pa.RecordBatch.from_pylist([{k: None if s.get(k) is None else s[k] if k in texts else float(s[k]) for k in names[1:]} | {"path": row["path"]} for s in got], schema=schema)

        good = frames.where("error is null").select("path", "width", "height", "channels", "dtype", "data")
        return map_arrow(good, run, "path string, " + ", ".join([f"{f} double" for f in fields] + [f"{t} string" for t in texts]))

    def measured(self, frames: DataFrame) -> DataFrame:
        """A row a star of frames in the reader's form; all measured stars, so that statistics see them all."""
        whole = lambda img, c: analysis.analyze(img, replace(c, max_stars=0))[0]
        return self._run(frames, whole, STAR_FIELDS, ["method"])

    def facts(self, frames: DataFrame) -> DataFrame:
        """A row a frame: background, noise, counts of each pass, the field's width and beta."""
        return self._run(frames, lambda img, c: [analysis.analyze(img, c)[1]], "background noise pass1_detections stars_detected stars_measured field_fwhm field_beta kernel_fwhm median_fwhm".split(), [])

    def detected_fast(self, frames: DataFrame) -> DataFrame:
        """A row a star by the half-flux ladder, without fits but for the centres if ``centroid_refine`` is on."""
        fields = "x y raw_x raw_y peak flux snr hfd fwhm".split()
        return self._run(frames, lambda img, c: analysis.fast(img, c.max_stars, c.centroid_refine)[0], fields, [])

    def stars(self, path: str) -> DataFrame:
        """The ``max_stars`` brightest measured stars of each file."""
        place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("flux"), "y", "x"))
        found = self.measured(read_frames(self.spark, path))
        return found.withColumn("place", place).where(F.col("place") <= self.config.max_stars).drop("place") if self.config.max_stars else found

    def fast(self, path: str) -> DataFrame:
        return self.detected_fast(read_frames(self.spark, path))

    def quality(self, path: str) -> DataFrame:
        """One row of quality statistics a file, over all of its measured stars."""
        from .operators.quality import frame_quality

        return frame_quality(self.measured(read_frames(self.spark, path)).withColumnRenamed("path", "frame_id"), trail_limit=self.config.trail_threshold)

    def analyze_batch(self, paths: list[str], concurrency: int = 4, progress: Callable[[int, int], None] | None = None) -> Iterator[DataFrame]:
        """Statistics of ``concurrency`` files at a time, as frames that are worked out; ``progress(done, total)`` after each."""
        for start in range(0, len(paths), concurrency):
            chunk = paths[start : start + concurrency]
            rows = self.quality_of(chunk).collect()  # a row a file
            if progress:
                progress(start + len(chunk), len(paths))
            yield self.spark.createDataFrame(rows) if rows else self.quality_of(chunk).limit(0)

    def quality_of(self, paths: list[str]) -> DataFrame:
        from .operators.quality import frame_quality

        frames = decode_frames(self.spark.read.format("binaryFile").load(paths))
        return frame_quality(self.measured(frames).withColumnRenamed("path", "frame_id"), trail_limit=self.config.trail_threshold)


def frames_of(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    """Pixels in memory, (h, w) or (c, h, w) by name, in the reader's form."""
    rows = []
    for name, px in arrays.items():
        px = px[None] if px.ndim == 2 else px
        rows.append((name, px.shape[2], px.shape[1], px.shape[0], str(px.dtype), None, False, px.tobytes(), None))
    return spark.createDataFrame(rows, FRAME)


def stretched(px: np.ndarray) -> np.ndarray:
    """8-bit (h, w, 3) preview of (c, h, w) pixels, each channel stretched on its own; non-finite pixels are black."""
    out = []
    for plane in px.astype(float):
        good = plane[np.isfinite(plane)]
        m = detection.upper_median(good) / 65536
        s = detection.madn(good, m * 65536) / 65536 if len(good) else 0.0
        upper = m > 0.5
        low = 0.0 if upper or s == 0 else min(max(m - 2.8 * s, 0.0), 1.0)
        high = 1.0 if not upper or s == 0 else min(max(m + 2.8 * s, 0.0), 1.0)
        a, b = (0.25, high - m) if upper else (m - low, 0.25)
        mid = 0.0 if a == 0 else 0.5 if a == b else 1.0 if a == 1 else (b - 1) * a / ((2 * b - 1) * a - b)
        hs = 1.0 if high == low else 1 / (high - low)
        d = plane / 65536 - low
        with np.errstate(all="ignore"):
            v = d * (mid - 1) * hs * 255 / (d * (2 * mid - 1) * hs - mid)
        v = np.where(plane < low * 65536, 0, np.where(plane >= high * 65536, 255, np.clip(v, 0, 255)))
        out.append(np.where(np.isfinite(plane), np.nan_to_num(v), 0).astype(np.uint8))
    return np.dstack(out if len(out) == 3 else out[:1] * 3)


def superpixel(mosaic: np.ndarray, pattern: str) -> np.ndarray:
    """(3, h / 2, w / 2) colours of a mosaic of 2 x 2 tiles; the two greens are averaged."""
    h, w = mosaic.shape[0] // 2 * 2, mosaic.shape[1] // 2 * 2
    cells = {(k // 2, k % 2): c for k, c in enumerate(pattern.strip().upper())}
    if sorted(cells.values()) != ["B", "G", "G", "R"]:
        return mosaic[None]
    return np.stack([np.mean([mosaic[y:h:2, x:w:2].astype(float) for (y, x), own in cells.items() if own == c], 0) for c in "RGB"])


def binned(plane: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 pixels."""
    h, w = plane.shape[0] // 2 * 2, plane.shape[1] // 2 * 2
    return plane[:h, :w].astype(float).reshape(h // 2, 2, w // 2, 2).mean((1, 3))


class FrameConverter:
    """Frames to encoded previews: ``FrameConverter(spark).convert(path, 'png')`` gives (path, image)."""

    def __init__(self, spark: SparkSession, quality: int = 95, downscale: int = 1, debayer: bool = True, preview: bool = False):
        self.spark, self.quality, self.downscale, self.debayer, self.preview = spark, quality, max(downscale, 1), debayer, preview

    def convert(self, path: str, kind: str = "jpeg") -> DataFrame:
        """Colour mosaics become superpixels, previews of mono frames 2 x 2 means, then pixels are thinned out and stretched."""
        quality, f, debayer, preview = self.quality, self.downscale, self.debayer, self.preview

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    px = np.frombuffer(row["data"], row["dtype"]).reshape(row["channels"], row["height"], row["width"])
                    if debayer and row["bayer"] and len(px) == 1:
                        px = superpixel(px[0], row["bayer"])
                    elif preview and len(px) == 1:
                        px = binned(px[0])[None]
                    rgb = stretched(px[:, : px.shape[1] // f * f : f, : px.shape[2] // f * f : f])
                    rgb = rgb[::-1] if row["flip"] else rgb
                    data = images.png(rgb) if kind == "png" else images.jpeg(rgb, quality)
                    yield pa.RecordBatch.from_pydict({"path": pa.array([row["path"]], pa.string()), "image": pa.array([data], pa.binary())})

        frames = read_frames(self.spark, path).where("error is null").select("path", "width", "height", "channels", "dtype", "bayer", "flip", "data")
        return map_arrow(frames, run, "path string, image binary")


def save_images(encoded: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Writes each (path, image) to a file of its own in a shared folder; (path, file, bytes) of what was written.

    Files are written under a temporary name and renamed, so a task that runs
    again leaves whole files; running the result is what writes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        disk, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        disk.create_dir(root, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/{row['path'].rsplit('/', 1)[-1].rsplit('.', 1)[0]}.{suffix}"
                with disk.open_output_stream(f"{name}.tmp") as out:
                    out.write(row["image"])
                disk.move(f"{name}.tmp", name)
                yield pa.RecordBatch.from_pydict({"path": pa.array([row["path"]], pa.string()), "file": pa.array([name], pa.string()), "bytes": pa.array([len(row["image"])], pa.int64())})

    return map_arrow(encoded.select("path", "image"), run, "path string, file string, bytes long")
