"""WARC archives in seekable Zstandard bundles.

Method: records are grouped into independent Zstandard frames; a bundle is a
run of frames with a seek table in a skippable footer frame (the public
seekable format); an index maps each record's identifier to its bundle, its
frame and its offset inside the frame, so that one record is read by
decompressing one frame.

Of records with equal payloads of at least ``least`` bytes the one with the
smallest identifier is a response and the others revisit it.

Bundles are written by executors through the file system the shared folder
names: under a temporary name, then renamed, so a task that runs again or
twice leaves whole files only.  The index lists the files that count.

Defined cases: null HTML is an empty payload, a null URL an empty target;
repeated rows (one identifier, one payload) share the smallest identifier and
are all responses; a row with a null identifier is recorded without one, and
revisits an equal payload that has one, else it is a response; an empty table
writes no bundle; other columns are ignored, whatever their names.  Payloads
are written whole: one longer than a frame makes a frame of its own.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import Scratch

# Fixed values of the seekable format: skippable frame and footer magic numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
LEAST = 100
# The date is a parameter, since a record made again must be the same.
DATE = "2024-01-01T00:00:00Z"
NONE = "-"  # stands for a null identifier
INDEX = "page_id long, payload_digest string, bundle string, frame int, offset long, length long"


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit holds no payload but names its full length and digest."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(i))}>"
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(NONE + digest if page_id is None else page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join(url.split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {NONE if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content block of one record; raises on a broken one."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("wrong Content-Length")
    return headers, rest[:size]


class Bundle:
    """Collects records into frames; ``close`` gives the bytes with the seek table at the end."""

    def __init__(self, level: int = 3):
        import zstandard

        self._zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.data: list[bytes] = []
        self.held: list[bytes] = []
        self.fill = 0
        self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame of the record and its offset inside the frame."""
        if self.fill and self.fill + len(data) > FRAME_BYTES:
            self._cut()
        at = (len(self.frames), self.fill)
        self.held.append(data)
        self.fill += len(data)
        return at

    def _cut(self) -> None:
        if self.held:
            packed = self._zstd.compress(b"".join(self.held))
            self.data.append(packed)
            self.frames.append((len(packed), self.fill))
            self.size += len(packed)
            self.held, self.fill = [], 0

    def close(self) -> bytes:
        self._cut()
        table = b"".join(struct.pack("<II", a, b) for a, b in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(self.data) + struct.pack("<II", SKIPPABLE, len(table)) + table


class BundleReader:
    """Random access to a bundle: the seek table is read once, and a frame at a time is held."""

    def __init__(self, file):
        import zstandard

        self.file, self._zstd = file, zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flags:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * count - 8)
        table = file.read(8 * count + 8)
        if struct.unpack("<II", table[:8]) != (SKIPPABLE, 8 * count + 9):
            raise ValueError("broken seek table")
        self.starts, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, 8 + 8 * k)
            self.starts.append((at, packed, plain))
            at += packed
        self._held: tuple[int, bytes] = (-1, b"")

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if self._held[0] != frame:
            at, packed, plain = self.starts[frame]
            self.file.seek(at)
            self._held = (frame, self._zstd.decompress(self.file.read(packed), max_output_size=plain))
        return self._held[1][offset : offset + length]


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file:" + uri.removeprefix("file:"))


def decide(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """(digest, first): the smallest identifier of each payload that several records of at least ``least`` bytes have."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload, 256).alias("digest"), F.length(payload).alias("n")).where(F.col("n") >= least)
    return slim.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes the bundles into ``folder`` and returns the index; running the index is what writes."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(decide(pages, id_col, html_col, least), "digest", "left").select("id", "url", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = _file_system(folder)
        disk.create_dir(root, recursive=True)
        bundle, index, name = Bundle(), [], uuid.uuid4().hex

        def flush() -> pa.RecordBatch:
            nonlocal bundle, index, name
            path = f"{root}/{name}.warc.zst"
            with disk.open_output_stream(f"{path}.tmp") as out:
                out.write(bundle.close())
            disk.move(f"{path}.tmp", path)
            columns = list(zip(*index, strict=True))
            got = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array([f"{name}.warc.zst"] * len(index), pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                names=["page_id", "payload_digest", "bundle", "frame", "offset", "length"],
            )
            bundle, index, name = Bundle(), [], uuid.uuid4().hex
            return got

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for page_id, url, body, digest, first in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns), strict=True):
                    again = first is not None and first != page_id
                    data = record(page_id, url, body, digest, "revisit" if again else "response", first)
                    frame, offset = bundle.add(data)
                    index.append((page_id, digest, frame, offset, len(data)))
                    if bundle.size + bundle.fill >= BUNDLE_BYTES:
                        yield flush()
        if index:
            yield flush()

    return map_arrow(rows, run, INDEX)


def read(index: DataFrame, folder: str) -> DataFrame:
    """Reads every record that the index names, checks it, and returns its fields and payload (null for a revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = _file_system(folder)
        name, reader = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for page_id, digest, bundle, frame, offset, length in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    if bundle != name:
                        name, reader = bundle, BundleReader(disk.open_input_file(f"{root}/{bundle}"))
                    headers, body = parse(reader.read(frame, offset, length))
                    kind, refers = headers["WARC-Type"], headers.get("X-Refers-To-Page")
                    if headers["X-Page-ID"] != (NONE if page_id is None else str(page_id)) or headers["WARC-Payload-Digest"] != f"sha256:{digest}" or (kind == "response" and hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"record {page_id} of {bundle} is broken")
                    out.append((page_id, headers["WARC-Target-URI"], int(headers["X-Payload-Length"]), digest, kind, int(refers) if refers else None, body if kind == "response" else None))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    # Records of a bundle stand together, in order of their frames, so that each frame is decompressed once.
    together = index.select("page_id", "payload_digest", "bundle", "frame", "offset", "length").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    return map_arrow(together, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(spark: SparkSession, pages: DataFrame, **columns) -> DataFrame:
    """Writes bundles and their index to the shared folder, and reads all records back."""
    scratch = Scratch(spark, "warc")
    folder = scratch.path("bundles")
    return read(scratch.write(write(pages, folder, **columns), "index"), folder)
