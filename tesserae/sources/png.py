"""PNG pictures: a source of pixel relations, and a sink for previews."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rasters import PIXEL

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of each colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows without their filters: none, left, above, mean of both, or the one nearest to their linear guess."""
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int32)
    data = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    for k in range(height):
        kind, row = int(data[k, 0]), data[k, 1:].astype(np.int32)
        if kind == 1:
            row = np.cumsum(row.reshape(-1, step), 0).reshape(-1)
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            left, corner = np.zeros(step, np.int32), np.zeros(step, np.int32)
            for a in range(0, stride, step):
                up = above[a : a + step]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    linear = left + up - corner
                    gaps = np.abs(np.stack([left, up, corner]) - linear)
                    guess = np.choose(gaps.argmin(0), (left, up, corner))
                left = (row[a : a + step] + guess) & 255
                corner = up
                row[a : a + step] = left
        elif kind:
            raise ValueError("unknown PNG filter")
        above = row & 255
        out[k] = above
    return out


def decode(data: bytes) -> np.ndarray:
    """Height x width x 4 (r, g, b, alpha) of a PNG of 8 or 16 bits that is not interlaced."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, packed, palette, clear = len(SIGNATURE), [], None, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
    if interlaced or bits not in (8, 16) or colour not in CHANNELS:
        raise ValueError("interlaced PNGs and those of under 8 bits are not read")
    n, wide = CHANNELS[colour], bits // 8
    rows = _unfiltered(zlib.decompress(b"".join(packed)), height, width * n * wide, n * wide)
    px = rows.reshape(height, width, n, wide)[..., 0]
    opaque = np.full((height, width, 1), 255, np.uint8)
    if colour == 3:
        table = np.full((len(palette), 1), 255, np.uint8)
        table[: len(clear), 0] = np.frombuffer(clear, np.uint8)
        return np.concatenate([palette, table], 1)[px[..., 0]]
    if n <= 2:
        return np.concatenate([np.repeat(px[..., :1], 3, 2), px[..., 1:] if n == 2 else opaque], 2)
    return px if n == 4 else np.concatenate([px, opaque], 2)


def encode(rgba: np.ndarray) -> bytes:
    """A PNG of height x width x 4 bytes."""
    h, w, _ = rgba.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgba.reshape(h, -1)], 1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """A pixel relation (label null) of all PNG files under a folder; image_id is the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    return pixels_of(files.select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("image_id"), "content"))


def pixels_of(files: DataFrame) -> DataFrame:
    """The same of rows (image_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("image_id").to_pylist(), batch.column("content")):
                px = decode(content.as_py())
                h, w, _ = px.shape
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                flat = px.reshape(-1, 4)
                cols = [pa.array([name] * (h * w)), pa.array(y), pa.array(x), *[pa.array(flat[:, k].astype(np.int16)) for k in range(3)], pa.array(flat[:, 3] / 255.0), pa.nulls(h * w, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=PIXEL.names)

    return files.mapInArrow(run, PIXEL)


def pictures(pixels: DataFrame) -> DataFrame:
    """image_id, content: each image of a relation (image_id, y, x, r, g, b, alpha) as a PNG; a canvas-sized image is a task's group."""

    def run(image: pa.Table) -> pa.Table:
        y, x = image.column("y").to_numpy(), image.column("x").to_numpy()
        out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 4), np.uint8)
        for k, c in enumerate(("r", "g", "b", "alpha")):
            out[y, x, k] = np.clip(np.rint(image.column(c).to_numpy() * (255 if c == "alpha" else 1)), 0, 255)
        return pa.table({"image_id": image.column("image_id")[:1], "content": pa.array([encode(out)], pa.binary())})

    columns = ["image_id", "y", "x", *[F.col(c).cast("double").alias(c) for c in ("r", "g", "b", "alpha")]]
    return pixels.select(*columns).groupBy("image_id").applyInArrow(run, "image_id string, content binary")


def write_files(rows: DataFrame, name: str, content: str, folder: str, suffix: str) -> int:
    """One file for each row, for pictures and documents that are asked for one by one; rows pass the driver one at a time.

    Files go through Hadoop's file systems, so the folder may be in any store.
    """
    spark, n = rows.sparkSession, 0
    jvm = spark.sparkContext._jvm
    for row in rows.select(name, content).toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{row[0]}{suffix}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        body = row[1] if isinstance(row[1], (bytes, bytearray)) else (json.dumps(json.loads(row[1]), indent=2, ensure_ascii=False) + "\n").encode()
        out.write(bytearray(body))
        out.close()
        n += 1
    return n
