"""Frame files to DataFrames and back, through Spark's own file readers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import fits, xisf

FRAME = "path string, width int, height int, channels int, dtype string, bayer string, flip boolean, data binary, error string"


def decode(name: str, content: bytes):
    """Dispatch by extension, then by the first bytes."""
    lower = name.lower()
    if lower.endswith(".xisf") or content[:8] == xisf.SIGNATURE:
        return xisf.decode(content)
    if lower.endswith((".fits", ".fit")) or content[:9] == b"SIMPLE  =":
        return fits.decode(content)
    raise ValueError("neither FITS nor XISF")


def decode_frames(files: DataFrame) -> DataFrame:
    """Frames of rows (path, content): a frame a row; a broken file gives a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("dtype", pa.string()), ("bayer", pa.string()), ("flip", pa.bool_()), ("data", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    meta, px = decode(path, content)
                    row = {"path": path, "width": px.shape[2], "height": px.shape[1], "channels": px.shape[0], "dtype": str(px.dtype), "bayer": meta["bayer"], "flip": meta["flip"], "data": px.tobytes(), "error": None}
                except Exception as e:  # whatever a decoder raises on a cut or garbled file
                    row = {k.name: None for k in schema} | {"path": path, "error": f"{type(e).__name__}: {e}"}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return map_arrow(files.select("path", "content"), run, FRAME)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all FITS and XISF files under a path that Spark can read."""
    return decode_frames(spark.read.format("binaryFile").load(path))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """A reference table: lines from the one that begins 'Index,' on, columns by name, unreadable numbers as 0."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?s)\A.*?(?=^Index,)", "").alias("v"))
    head = spark.read.text(path).where(F.col("value").startswith("Index,")).first()
    names = [n.strip().strip('"') for n in head[0].split(",")]
    rows = lines.select(F.explode(F.split("v", r"\r?\n")).alias("line")).where(~F.col("line").startswith("Index,"))
    cells = rows.select(F.split("line", r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)").alias("c")).where(F.size("c") >= len(names))
    clean = lambda k: F.regexp_replace(F.col("c")[k], r'^\s*"|"\s*$', "")
    return cells.select(*[(clean(k) if n == "File" else F.coalesce(F.try_to_number(clean(k), F.lit("999999999999.999999999999")).cast("double"), clean(k).try_cast("double"), F.lit(0.0))).alias(n) for k, n in enumerate(names)])
