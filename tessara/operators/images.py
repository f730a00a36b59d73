"""Pixel tables: conversion, normals, filters, point clouds, dense matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessara.functions import numbers as N
from tessara.functions import vectors as V
from tessara.operators import aggs

FRAME = ["frame_index"]


def convert_depth(pixels: DataFrame, scale: Column | float, low: float | None = None, high: float | None = None) -> DataFrame:
    """Raw depth to metres; with bounds, depth outside them becomes null."""
    d = F.col("depth") * scale
    if low is not None:
        d = F.when(d.between(low, high), d)
    return pixels.withColumn("depth", d)


def with_points(pixels: DataFrame, fx, fy, cx, cy) -> DataFrame:
    """Pixels that have a depth, with their point."""
    d = F.col("depth")
    p = F.array((F.col("x") - cx) / fx * d, (F.col("y") - cy) / fy * d, d)
    return pixels.where((d != 0) & d.isNotNull()).withColumn("p", p)


def normals(points: DataFrame, by: list[str] = FRAME) -> DataFrame:
    """Pixels with `n`, the unit cross product of the steps to the right and lower neighbour; zero without both."""
    right = F.lead("p").over(Window.partitionBy(*by, "y").orderBy("x"))
    right_x = F.lead("x").over(Window.partitionBy(*by, "y").orderBy("x"))
    low = F.lead("p").over(Window.partitionBy(*by, "x").orderBy("y"))
    low_y = F.lead("y").over(Window.partitionBy(*by, "x").orderBy("y"))
    near = points.withColumns({"__r": F.when(right_x == F.col("x") + 1, right), "__d": F.when(low_y == F.col("y") + 1, low)})
    n = F.when(F.col("__r").isNotNull() & F.col("__d").isNotNull(), V.normalize(V.cross(V.minus(F.col("__r"), F.col("p")), V.minus(F.col("__d"), F.col("p")))))
    zero = F.array(*[F.lit(0.0)] * 3)
    return near.withColumn("n", F.coalesce(n, zero)).drop("__r", "__d")


def point_cloud(pixels: DataFrame, fx, fy, cx, cy) -> DataFrame:
    """Coloured points with normals; pixels without depth give none."""
    return normals(with_points(pixels, fx, fy, cx, cy))


def temporal_median(stack: DataFrame, low: float, high: float, frames: int = 10) -> DataFrame:
    """Upper median depth of each pixel over a stack of at most `frames` frames; 0 outside [low, high]."""
    return aggs.upper_medians(stack, ["x", "y"], "depth", low, high, "depth", samples=frames)


def windows_of_frames(frames: DataFrame, camera: str, order: str, n: int) -> DataFrame:
    """Frames with `stack`, the number of their run of n, and whether they are its middle one."""
    i = F.row_number().over(Window.partitionBy(camera).orderBy(order)) - 1
    return frames.withColumns({"stack": F.floor(i / n), "middle": i % n == F.lit(n // 2)})


def _offsets(radius: int) -> Column:
    side = range(-radius, radius + 1)
    return F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in side for j in side]))


def bilateral(pixels: DataFrame, radius: int = 25, sigma_value: float = 12.5, sigma_space: float = 50.0, by: list[str] = FRAME) -> DataFrame:
    """Depth averaged over a disc with weights that fall with distance and with difference in depth. Each pixel is copied
    to the window around it and met there by an equi-join."""
    moved = pixels.select(*by, "x", "y", F.col("depth").alias("__v"), _offsets(radius).alias("o")).where(F.col("o.dx") ** 2 + F.col("o.dy") ** 2 <= radius**2)
    moved = moved.select(*by, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "__v", (F.col("o.dx") ** 2 + F.col("o.dy") ** 2).alias("__d2"))
    near = pixels.select(*by, "x", "y", "depth").join(moved, [*by, "x", "y"])
    diff = F.col("__v") - F.col("depth")
    w = F.exp(-F.col("__d2") / (2 * sigma_space**2) - diff * diff / (2 * sigma_value**2))
    return near.groupBy(*by, "x", "y").agg((F.sum(w * F.col("__v")) / F.sum(w)).alias("depth"))


def with_luma(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("luma", N.luma(F.col("r"), F.col("g"), F.col("b")))


def normal_image(points: DataFrame) -> DataFrame:
    return points.select("*", *[N.normal_to_rgb(F.col("n")[i]).alias(c) for i, c in enumerate(("nr", "ng", "nb"))])


def _weighed_correlation(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., score of a and b with weights wa and wb; means and variances by either's own, the product by wa. Not below -1."""

    def mean(weight: str, of: Column) -> Column:
        return F.sum(F.col(weight) * of) / F.sum(weight)

    a, b = F.col("a"), F.col("b")
    sums = rows.groupBy(*by).agg(mean("wa", a).alias("ma"), mean("wb", b).alias("mb"), mean("wa", a * a).alias("aa"), mean("wb", b * b).alias("bb"), mean("wa", a * b).alias("ab"))
    sums = sums.withColumns({"va": F.col("aa") - F.col("ma") ** 2, "vb": F.col("bb") - F.col("mb") ** 2}).where("va >= 1e-5 AND vb >= 1e-5")
    return sums.select(*by, F.greatest(F.lit(-1.0), (F.col("ab") - F.col("ma") * F.col("mb")) / F.sqrt(F.col("va") * F.col("vb"))).alias("score"))


def dense_match(left: DataFrame, right: DataFrame, warp: DataFrame, neigh: int = 2, radius: int = 5, normal_gate: float = 0.2, least: float | None = None, sigma_color: float | None = None, sigma_space: float = 1.0, white: float = 255.0) -> DataFrame:
    """For each left pixel the best right pixel in the (2 neigh + 1)^2 window where the pose puts it: x, y, rx, ry, score.

    left, right: x, y, luma, n; warp: x, y, wx, wy. Candidates whose normals differ (1 - n.n' >= normal_gate) are out; the
    score is the correlation of the luma windows. With sigma_color (EngineConfig's, say) it is the bilateral one, with luma
    in parts of `white`: a window's pixels count the less, the further they are from its centre and the more they differ
    from it; products are weighed as on the left, so in noise a score can pass 1. There, a window of a variance below 1e-5
    scores nothing. Windows come together by equi-joins on offsets."""
    c = left.join(warp, ["x", "y"]).select("x", "y", "n", (F.col("wx")).alias("wx"), (F.col("wy")).alias("wy"), _offsets(neigh).alias("o"))
    c = c.select("x", "y", "n", (F.col("wx") + F.col("o.dx")).alias("rx"), (F.col("wy") + F.col("o.dy")).alias("ry"))
    c = c.join(right.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("n").alias("m")), ["rx", "ry"]).where(1 - V.dot(F.col("n"), F.col("m")) < normal_gate)
    one, two = (d.select("x", "y", (F.col("luma") / white).alias("v")) for d in (left, right))
    c = c.join(one.withColumnRenamed("v", "a0"), ["x", "y"]).join(two.toDF("rx", "ry", "b0"), ["rx", "ry"])
    w = c.select("x", "y", "rx", "ry", "a0", "b0", _offsets(radius).alias("o"))
    w = w.select("x", "y", "rx", "ry", "a0", "b0", "o", (F.col("x") + F.col("o.dx")).alias("lx"), (F.col("y") + F.col("o.dy")).alias("ly"), (F.col("rx") + F.col("o.dx")).alias("sx"), (F.col("ry") + F.col("o.dy")).alias("sy"))
    w = w.join(one.toDF("lx", "ly", "a"), ["lx", "ly"]).join(two.toDF("sx", "sy", "b"), ["sx", "sy"])
    far = (F.col("o.dx") ** 2 + F.col("o.dy") ** 2) / (2 * sigma_space**2)
    if sigma_color is None:
        scored = w.groupBy("x", "y", "rx", "ry").agg(F.corr("a", "b").alias("score"))
    else:
        w = w.withColumns({f"w{v}": F.exp(-far - (F.col(v) - F.col(f"{v}0")) ** 2 / (2 * sigma_color**2)) for v in "ab"})
        scored = _weighed_correlation(w, ["x", "y", "rx", "ry"])
    scored = scored.where(F.col("score").isNotNull() & ~F.isnan("score"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    best = F.max_by(F.struct("rx", "ry", "score"), F.struct("score", -F.col("ry"), -F.col("rx")))
    return scored.groupBy("x", "y").agg(best.alias("b")).select("x", "y", "b.*")


def cross_check(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Forward matches (x, y to rx, ry) that the backward ones lead back from."""
    back = backward.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("rx").alias("x"), F.col("ry").alias("y"))
    return forward.join(back, ["x", "y", "rx", "ry"], "left_semi")


def best_per_tile(matches: DataFrame, size: int = 16) -> DataFrame:
    """The match of the highest score of each tile of size x size pixels; ties to the upper left."""
    best = F.max_by(F.struct("x", "y", "rx", "ry", "score"), F.struct("score", -F.col("y"), -F.col("x")))
    return matches.groupBy(F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty")).agg(best.alias("m")).select("tx", "ty", "m.*")


def halve(pixels: DataFrame, times: int = 1, by: list[str] = FRAME) -> DataFrame:
    """Every 2^n-th pixel of either axis."""
    n = 2**times
    return pixels.where((F.col("x") % n == 0) & (F.col("y") % n == 0)).withColumns({"x": (F.col("x") / n).cast("int"), "y": (F.col("y") / n).cast("int")})


def pyramid_down(pixels: DataFrame, sigma: float = 30.0, by: list[str] = FRAME) -> DataFrame:
    """Half-size depth: mean over 5 x 5 pixels around every second one of those within 3 sigma of its depth."""
    centre = pixels.where((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)).select(*by, "x", "y", F.col("depth").alias("__c"))
    moved = pixels.select(*by, "depth", "x", "y", _offsets(2).alias("o")).select(*by, "depth", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    near = centre.join(moved, [*by, "x", "y"]).where(F.abs(F.col("depth") - F.col("__c")) < 3 * sigma)
    return near.groupBy(*by, (F.col("x") / 2).cast("int").alias("x"), (F.col("y") / 2).cast("int").alias("y")).agg(F.avg("depth").alias("depth"))
