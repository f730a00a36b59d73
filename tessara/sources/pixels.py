"""Image files as pixel tables: PNG and binary PGM / PPM, on any file system that Spark reads. Other formats fail."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by PNG colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
IMAGE = "path string, height int, width int, channels int, samples array<int>"


def decode(data: bytes) -> np.ndarray:
    """height x width x samples of an image file; 8 or 16 bits a sample, a palette becomes its colours."""
    if data[:8] == PNG:
        return _png(data)
    if data[:2] in (b"P5", b"P6"):
        return _netpbm(data)
    raise ValueError("neither PNG nor binary PGM or PPM")


def _png(data: bytes) -> np.ndarray:
    parts: dict[bytes, list[bytes]] = {}
    at = 8
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        parts.setdefault(kind, []).append(data[at + 8 : at + 8 + size])
        at += size + 12
    width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"][0])
    if interlaced or bits not in (8, 16):
        raise ValueError("interlaced PNG, or one of under 8 bits a sample")
    step = SAMPLES[colour] * bits // 8
    rows = np.frombuffer(zlib.decompress(b"".join(parts[b"IDAT"])), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        above = out[y] = _unfiltered(int(rows[y, 0]), rows[y, 1:], above, step)
    samples = out.view(">u2").astype(np.int32) if bits == 16 else out.astype(np.int32)
    image = samples.reshape(height, width, SAMPLES[colour])
    if colour == 3:
        image = np.frombuffer(parts[b"PLTE"][0], np.uint8).astype(np.int32).reshape(-1, 3)[image[:, :, 0]]
    return image


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes from what a filter left of them; the first two kinds and the copy are sums over whole rows."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise ValueError("unknown PNG filter")
    left, out, up = [0] * step, [], above.tolist()
    corner = [0] * step
    for i, x in enumerate(row.tolist()):
        a, b, c = left[i % step], up[i], corner[i % step]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        x = (x + guess) & 255
        left[i % step], corner[i % step] = x, b
        out.append(x)
    return np.array(out, np.uint8)


def _netpbm(data: bytes) -> np.ndarray:
    head = re.match(rb"P([56])" + rb"(?:\s+(?:#[^\n]*\n\s*)*(\d+))" * 3 + rb"\s", data)
    if not head:
        raise ValueError("bad PGM or PPM header")
    n = 1 if head[1] == b"5" else 3
    width, height, most = (int(head[i]) for i in (2, 3, 4))
    kind = np.dtype(">u2" if most > 255 else np.uint8)
    return np.frombuffer(data, kind, width * height * n, head.end()).astype(np.int32).reshape(height, width, n)


def plain_path(path: Column) -> Column:
    """A path whose scheme is followed by one slash, as file lists and readers write it differently."""
    return F.regexp_replace(F.regexp_replace(path, "^/+", "file:/"), "^([a-z][a-z0-9]+):/+", "$1:/")


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """path, height, width, channels, samples (row by row) of the image files below path. Files stay files until a task
    reads them, so a table of paths costs no pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf.path, pdf.content):
                image = decode(bytes(data))
                yield pd.DataFrame({"path": [name], "height": [image.shape[0]], "width": [image.shape[1]], "channels": [image.shape[2]], "samples": [image.reshape(-1)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(plain_path(F.col("path")).alias("path"), "content").mapInPandas(run, IMAGE)


def pixels(frames: DataFrame, depth: DataFrame, colour: DataFrame | None = None) -> DataFrame:
    """frame_index, x, y, depth (raw) and, with colour images, r, g, b of frames (frame_index, depth_path, rgb_path).

    Frames meet their images by path, and a frame's two images before either is unrolled, so no pixel is ever shuffled.
    Frames without an image, and images of no frame, give nothing; images of different sizes fail."""
    own = frames.select("frame_index", plain_path(F.col("depth_path")).alias("path"), *([plain_path(F.col("rgb_path")).alias("rgb")] if colour is not None else []))
    both = own.join(depth.select("path", "height", "width", "channels", "samples"), "path")
    if colour is not None:
        fit = (F.col("height") == F.col("__h")) & (F.col("width") == F.col("__w"))
        both = both.join(colour.select(F.col("path").alias("rgb"), F.col("height").alias("__h"), F.col("width").alias("__w"), F.col("channels").alias("__n"), F.col("samples").alias("__c")), "rgb")
        both = both.withColumn("__c", F.when(fit, F.col("__c")).otherwise(F.raise_error(F.lit("colour and depth images differ in size"))))
    n = F.col("channels")
    keep = ["frame_index", "width", "channels", "samples", *(["__n", "__c"] if colour is not None else [])]
    each = both.select(*keep, F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("i"))
    out = [(F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), F.get("samples", F.col("i") * n).cast("double").alias("depth")]
    if colour is not None:
        grey = F.col("__n") < 3
        out += [F.get("__c", F.col("i") * F.col("__n") + F.when(grey, 0).otherwise(k)).alias(c) for k, c in enumerate("rgb")]
    return each.select("frame_index", *out)
