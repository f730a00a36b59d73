"""Keypoints and descriptors: validity, grid, normalisation, bags of words, and scale-space extraction in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessara.functions import camera as C
from tessara.functions import vectors as V
from tessara.operators import topk


def valid_keypoints(keypoints: DataFrame, low: Column, high: Column, by: list[str] | None = None, order: str = "kp_index") -> DataFrame:
    """Keypoints whose depth lies in [low, high], numbered anew from 0 in their order."""
    return topk.reindexed(keypoints.where(F.col("depth").between(low, high)), by or ["frame_index"], [F.col(order)], order)


def _over(v: Column, total: Callable[[Column], Column], each: Callable[[Column, Column], Column]) -> Column:
    """each(x, total(v)) for each term x of v. The total stands outside the loop over the terms, so it is worked out once a
    vector, not once a term."""
    return V.let(v, lambda v: V.let(F.struct(v.alias("v"), total(v).alias("n")), lambda s: F.transform(s.v, lambda x: each(x, s.n))))


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l1_root(v: Column) -> Column:
    """Square roots of the shares of the sum, times 512, to the nearest whole number up to 255."""
    return _over(v, lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), lambda x, n: F.least(F.lit(255), F.round(512 * F.sqrt(x / n)).cast("int")))


def l2_unit(v: Column) -> Column:
    """The unit vector, times 512, to the nearest whole number up to 255."""
    return _over(v, _length, lambda x, n: F.least(F.lit(255), F.round(512 * x / n).cast("int")))


def clamped_unit(v: Column, most: float = 0.2) -> Column:
    """Unit length, terms cut at `most`, unit length again."""
    return _over(_over(v, _length, lambda x, n: F.least(x / n, F.lit(most))), _length, lambda x, n: x / n)


def with_grid(keypoints: DataFrame, bounds: Column, cols: int = 64, rows: int = 48) -> DataFrame:
    """Keypoints with their cell gx, gy of a grid over the bounds struct (min_x, max_x, min_y, max_y); those outside go."""
    b = bounds
    g = keypoints.withColumns({"gx": C.grid_cell(F.col("x"), b["min_x"], b["max_x"], cols), "gy": C.grid_cell(F.col("y"), b["min_y"], b["max_y"], rows)})
    return g.where("gx IS NOT NULL AND gy IS NOT NULL")


def undistorted(keypoints: DataFrame) -> DataFrame:
    """Keypoints, joined with their camera, moved to where they were without the lens."""
    k = F.col("dist_coef")
    p = C.undistort(F.col("x"), F.col("y"), k, F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    return keypoints.withColumn("__p", p).withColumns({"x": F.col("__p")[0], "y": F.col("__p")[1]}).drop("__p")


def append(first: DataFrame, second: DataFrame, by: list[str] | None = None, index: str = "kp_index") -> DataFrame:
    """Keypoints of both, those of second numbered after those of first."""
    keys = by or ["frame_index"]
    n = first.groupBy(*keys).agg(F.max(index).alias("__n"))
    moved = second.join(n, keys, "left").withColumn(index, F.col(index) + F.coalesce(F.col("__n") + 1, F.lit(0))).drop("__n")
    return first.unionByName(moved.select(*first.columns))


def strongest(keypoints: DataFrame, by: list[str], scale: Column, most: int = 8192) -> DataFrame:
    return topk.top_k(keypoints, by, [F.desc(scale), F.col("kp_index")], most).drop("rank")


def bag_of_words(words: DataFrame, image: str = "image", word: str = "word") -> DataFrame:
    """image, word, weight: share of the image's words times log of the images over those with the word, then scaled to a
    sum of 1 per image. The weighting is the engine's own choice."""
    tf = words.groupBy(image, word).agg(F.count(F.lit(1)).alias("n"))
    total = tf.groupBy(image).agg(F.sum("n").alias("all"))
    df = tf.groupBy(word).agg(F.count(F.lit(1)).alias("df"))
    images = total.agg(F.count(F.lit(1)).alias("images"))
    w = tf.join(total, image).join(df, word).crossJoin(F.broadcast(images))  # one row
    w = w.withColumn("weight", F.col("n") / F.col("all") * F.log(F.col("images") / F.col("df"))).where("weight > 0")
    norm = w.groupBy(image).agg(F.sum("weight").alias("norm"))
    return w.join(norm, image).select(image, word, (F.col("weight") / F.col("norm")).alias("weight"))


def assign_words(descriptors: DataFrame, centres: np.ndarray, vector: str = "descriptor", into: str = "word") -> DataFrame:
    """descriptors with the nearest of the vocabulary's centres, an array of a size the vocabulary sets; ties to the first.
    Rows meet centres in slices of 1,024 by 4,096, so scores take 32 MB whatever the vocabulary."""
    shared = descriptors.sparkSession.sparkContext.broadcast(np.asarray(centres, float))

    def nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        best, at = np.full(len(v), np.inf), np.zeros(len(v), int)
        for i in range(0, len(c), 4096):
            part = c[i : i + 4096]
            score = (part * part).sum(1) - 2 * v @ part.T
            own = score.argmin(1)
            least = score[np.arange(len(v)), own]
            at, best = np.where(least < best, own + i, at), np.minimum(best, least)
        return at

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for pdf in batches:
            if len(pdf):
                v = np.array(pdf[vector].tolist(), float)
                pdf[into] = np.concatenate([nearest(v[i : i + 1024], c) for i in range(0, len(v), 1024)])
            else:
                pdf[into] = np.zeros(0, int)
            yield pdf

    return descriptors.mapInPandas(run, descriptors.withColumn(into, F.lit(0).cast("long")).schema)


# scale space, one image at a time


def gaussian_kernel(sigma: float, factor: float = 4.0, most: int = 33) -> np.ndarray:
    """Odd width 2 * ceil(factor * sigma - 0.5) + 1, at most `most`, with a sum of 1."""
    width = min(2 * ceil(factor * sigma - 0.5) + 1, most)
    x = np.arange(width) - width // 2
    k = np.exp(-x * x / (2 * sigma * sigma))
    return k / k.sum()


def smooth(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian; borders repeat their last pixel."""
    k = gaussian_kernel(sigma)
    r = len(k) // 2
    wide = np.pad(image, ((0, 0), (r, r)), mode="edge")
    rows = sum(w * wide[:, i : i + image.shape[1]] for i, w in enumerate(k))
    tall = np.pad(rows, ((r, r), (0, 0)), mode="edge")
    return sum(w * tall[i : i + image.shape[0]] for i, w in enumerate(k))


def upsample(image: np.ndarray, times: int = 1) -> np.ndarray:
    """Twice the size per time, values between pixels by straight lines."""
    for _ in range(times):
        h, w = image.shape
        y, x = np.arange(2 * h) / 2, np.arange(2 * w) / 2
        y0, x0 = y.astype(int), x.astype(int)
        y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
        fy, fx = (y - y0)[:, None], (x - x0)[None, :]
        image = (1 - fy) * ((1 - fx) * image[np.ix_(y0, x0)] + fx * image[np.ix_(y0, x1)]) + fy * ((1 - fx) * image[np.ix_(y1, x0)] + fx * image[np.ix_(y1, x1)])
    return image


def downsample(image: np.ndarray, times: int = 1) -> np.ndarray:
    return image[:: 2**times, :: 2**times]


def gradient(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half the length of the central difference, and its angle."""
    wide = np.pad(image, 1, mode="edge")
    gx, gy = wide[1:-1, 2:] - wide[1:-1, :-2], wide[2:, 1:-1] - wide[:-2, 1:-1]
    return np.hypot(gx, gy) / 2, np.arctan2(gy, gx)


def extrema(dogs: np.ndarray, contrast: float, edge: float = 10.0) -> list[tuple[float, float, float, float]]:
    """(level, y, x, value) of points above or below their 26 neighbours, with enough contrast, not on an edge, moved by a
    3 x 3 x 3 parabola by less than one step."""
    out = []
    limit = (edge + 1) ** 2 / edge
    around = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    core = dogs[1:-1, 1:-1, 1:-1]
    near = np.stack([dogs[1 + a : dogs.shape[0] - 1 + a, 1 + b : dogs.shape[1] - 1 + b, 1 + c : dogs.shape[2] - 1 + c] for a, b, c in around])
    hits = (np.abs(core) > 0.8 * contrast) & ((core > near.max(0)) | (core < near.min(0)))
    for s, y, x in np.argwhere(hits) + 1:
        d = dogs[s - 1 : s + 2, y - 1 : y + 2, x - 1 : x + 2]
        g = np.array([d[2, 1, 1] - d[0, 1, 1], d[1, 2, 1] - d[1, 0, 1], d[1, 1, 2] - d[1, 1, 0]]) / 2
        h = np.zeros((3, 3))
        h[0, 0] = d[2, 1, 1] + d[0, 1, 1] - 2 * d[1, 1, 1]
        h[1, 1] = d[1, 2, 1] + d[1, 0, 1] - 2 * d[1, 1, 1]
        h[2, 2] = d[1, 1, 2] + d[1, 1, 0] - 2 * d[1, 1, 1]
        h[0, 1] = h[1, 0] = (d[2, 2, 1] - d[2, 0, 1] - d[0, 2, 1] + d[0, 0, 1]) / 4
        h[0, 2] = h[2, 0] = (d[2, 1, 2] - d[2, 1, 0] - d[0, 1, 2] + d[0, 1, 0]) / 4
        h[1, 2] = h[2, 1] = (d[1, 2, 2] - d[1, 2, 0] - d[1, 0, 2] + d[1, 0, 0]) / 4
        trace, det = h[1, 1] + h[2, 2], h[1, 1] * h[2, 2] - h[1, 2] ** 2
        if det <= 0 or trace * trace / det >= limit:
            continue
        try:
            move = -np.linalg.solve(h, g)
        except np.linalg.LinAlgError:
            continue
        value = d[1, 1, 1] + g @ move / 2
        if np.abs(move).max() < 1 and abs(value) > contrast:
            out.append((s + move[0], y + move[1], x + move[2], value))
    return out


def orientations(mag: np.ndarray, ang: np.ndarray, y: float, x: float, sigma: float, most: int = 2) -> list[float]:
    """Angles of the peaks of a 36-bin histogram of gradients around a point, smoothed six times round the ring."""
    r = int(round(3 * 1.5 * sigma))
    y0, x0 = int(round(y)), int(round(x))
    ys, xs = np.mgrid[max(0, y0 - r) : min(mag.shape[0], y0 + r + 1), max(0, x0 - r) : min(mag.shape[1], x0 + r + 1)]
    w = np.exp(-((ys - y) ** 2 + (xs - x) ** 2) / (2 * (1.5 * sigma) ** 2)) * mag[ys, xs]
    h = np.bincount((np.floor(ang[ys, xs] / (2 * np.pi) * 36).astype(int) % 36).ravel(), w.ravel(), 36)
    for _ in range(6):
        h = (np.roll(h, 1) + h + np.roll(h, -1)) / 3
    a, b = np.roll(h, 1), np.roll(h, -1)
    peaks = np.flatnonzero((h > a) & (h > b) & (h > 0.8 * h.max()))
    peaks = peaks[np.argsort(-h[peaks], kind="stable")][:most]
    return [float((p + 0.5 + (b[p] - a[p]) / (2 * (2 * h[p] - a[p] - b[p]))) / 36 * 2 * np.pi) for p in peaks]


def descriptor(mag: np.ndarray, ang: np.ndarray, y: float, x: float, sigma: float, turn: float) -> np.ndarray:
    """128 numbers: votes of gradients into 4 x 4 squares by 8 angles, shared out between neighbours; unit length, cut at
    0.2, unit length."""
    side = 3 * sigma
    r = int(round(side * 2.5 * np.sqrt(2)))
    y0, x0 = int(round(y)), int(round(x))
    ys, xs = np.mgrid[max(0, y0 - r) : min(mag.shape[0], y0 + r + 1), max(0, x0 - r) : min(mag.shape[1], x0 + r + 1)]
    dx, dy = (xs - x).ravel() / side, (ys - y).ravel() / side
    c, s = np.cos(turn), np.sin(turn)
    u, v = c * dx + s * dy + 1.5, -s * dx + c * dy + 1.5
    o = np.mod((ang[ys, xs].ravel() - turn) / (2 * np.pi) * 8, 8)
    w = mag[ys, xs].ravel() * np.exp(-((u - 1.5) ** 2 + (v - 1.5) ** 2) / 8)
    out = np.zeros((4, 4, 8))
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                iu, iv, io = np.floor(u).astype(int) + i, np.floor(v).astype(int) + j, np.floor(o).astype(int) + k
                part = w * (1 - np.abs(u - iu)) * (1 - np.abs(v - iv)) * (1 - np.abs(o - io))
                ok = (iu >= 0) & (iu < 4) & (iv >= 0) & (iv < 4)
                np.add.at(out, (iv[ok], iu[ok], io[ok] % 8), part[ok])
    d = out.ravel()
    d = np.minimum(d / max(np.linalg.norm(d), 1e-12), 0.2)
    return d / max(np.linalg.norm(d), 1e-12)


def detect(image: np.ndarray, octaves: int = 3, levels: int = 3, sigma0: float = 1.6, contrast: float = 0.02 / 3) -> list[tuple[float, float, float, float, np.ndarray]]:
    """(x, y, scale, angle, descriptor) of the keypoints of a grey image with values in [0, 1]."""
    out, base = [], smooth(image, np.sqrt(max(sigma0**2 - 0.25, 0.01)))
    for octave in range(octaves):
        if min(base.shape) < 16:
            break
        stack = [base]
        for i in range(1, levels + 3):
            before, after = sigma0 * 2 ** ((i - 1) / levels), sigma0 * 2 ** (i / levels)
            stack.append(smooth(stack[-1], np.sqrt(after**2 - before**2)))
        dogs = np.stack([b - a for a, b in zip(stack, stack[1:])])
        grads = [gradient(s) for s in stack]
        for level, y, x, _ in extrema(dogs, contrast):
            sigma = sigma0 * 2 ** (level / levels)
            mag, ang = grads[int(round(level))]
            for turn in orientations(mag, ang, y, x, sigma):
                out.append((x * 2**octave, y * 2**octave, sigma * 2**octave, turn, descriptor(mag, ang, y, x, sigma, turn)))
        base = stack[levels][::2, ::2]
    return out


def extract(images: DataFrame, most: int = 8192) -> DataFrame:
    """Keypoints of images (frame_index, height, width, grey: binary of bytes, row by row), the largest scales first, with
    affine terms and the descriptor as whole numbers up to 255."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                grey = np.frombuffer(r.grey, np.uint8).reshape(r.height, r.width) / 255.0
                for i, (x, y, scale, turn, d) in enumerate(sorted(detect(grey), key=lambda k: (-k[2], k[0], k[1], k[3]))[:most]):
                    c, s = scale * np.cos(turn), scale * np.sin(turn)
                    root = np.sqrt(d / max(d.sum(), 1e-12))
                    rows.append((r.frame_index, i, x, y, 0.0, c, -s, s, c, np.minimum(255, np.round(512 * root)).astype(int).tolist()))
            yield pd.DataFrame(rows, columns=["frame_index", "kp_index", "x", "y", "depth", "a11", "a12", "a21", "a22", "descriptor"])

    return images.mapInPandas(run, "frame_index long, kp_index long, x double, y double, depth double, a11 double, a12 double, a21 double, a22 double, descriptor array<short>")
