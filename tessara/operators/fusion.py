"""Sparse signed-distance fusion as keyed tables: allocation, integration, merging, collection, ray casting, surfaces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessara.functions import camera as C
from tessara.operators.sizes import stored

KEY = ["vx", "vy", "vz"]
CORNERS = [(i & 1, i >> 1 & 1, i >> 2 & 1) for i in range(8)]


def merge(observations: DataFrame, by: list[str] | None = None, most: float = 99999999.0) -> DataFrame:
    """Weighted mean distance and capped weight of each voxel. observations: by..., sdf, weight (negative to take one
    out again). A voxel whose weight falls to 0.001 or less is gone. Sums combine before rows move."""
    keys = by or KEY
    sums = observations.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("sdf")).alias("__s"), F.sum("weight").alias("__w"))
    return sums.where("__w > 0.001").select(*keys, (F.col("__s") / F.col("__w")).alias("sdf"), F.least(F.col("__w"), F.lit(float(most))).alias("weight"))


def colour_average(observations: DataFrame, by: list[str] | None = None, order: str = "frame_index", channels: tuple[str, ...] = ("r", "g", "b"), old: float = 0.8) -> DataFrame:
    """Colours by a running 0.8 / 0.2 average in order of the frame; the first observation sets it.

    An average of n observations is a sum with weights 0.2 * 0.8^k, k counted from the last, and 0.8^(n - 1) for the
    first. So it is a window and a plain sum, and no list of a voxel's observations is made."""
    from pyspark.sql import Window

    keys = by or KEY
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))) - 1
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    ranked = observations.withColumns({"__k": back, "__first": first})
    weight = F.pow(F.lit(old), F.col("__k")) * F.when(F.col("__first"), 1.0).otherwise(1 - old)
    return ranked.groupBy(*keys).agg(*[F.sum(weight * F.col(c)).alias(c) for c in channels])


def combine(a: DataFrame, b: DataFrame, colours: bool = True, most: float = 99999999.0) -> DataFrame:
    """Two voxel tables in one: distances by weight, weights added; colours half and half where both have one."""
    both = a.unionByName(b)
    out = merge(both, most=most)
    if not colours:
        return out
    return out.join(both.groupBy(*KEY).agg(*[F.avg(c).alias(c) for c in ("r", "g", "b")]), KEY)


def starve(voxels: DataFrame) -> DataFrame:
    """Every weight less one, no less than zero."""
    return voxels.withColumn("weight", F.greatest(F.lit(0.0), F.col("weight") - 1))


def with_block(voxels: DataFrame, side: int = 8) -> DataFrame:
    return voxels.withColumns({f"b{c}": C.voxel_to_block(F.col(f"v{c}"), side) for c in "xyz"})


def collect_garbage(voxels: DataFrame, block: list[str] | None = None) -> DataFrame:
    """voxels without the blocks whose largest weight is zero."""
    keys = block or ["bx", "by", "bz"]
    dead = voxels.groupBy(*keys).agg(F.max("weight").alias("__w")).where("__w = 0")
    return voxels.join(dead, keys, "left_anti")


def visible_blocks(blocks: DataFrame, inside: Column) -> DataFrame:
    """Blocks in the frustum: a filter is all the compaction there is."""
    return blocks.where(inside)


def allocate(rays: DataFrame, size: float = 0.01, side: int = 8, base: float = 0.02, scale: float = 0.06, most: float = 3.0, max_steps: int = 1024, frame: str | None = None) -> DataFrame:
    """Blocks that a stretch of each ray around its depth passes. rays: origin, direction (arrays of 3, direction of depth
    1 along the view), depth. A walk from cell to cell along the ray, at most max_steps. Distinct blocks come out; with
    `frame`, a long column of rays, distinct blocks of each frame."""
    own = [frame] if frame else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = size * side
        for pdf in batches:
            pdf = pdf[(pdf.depth > 0) & (pdf.depth <= most)]
            found: set[tuple[int, ...]] = set()
            for o, d, z, *of in zip(pdf.origin, pdf.direction, pdf.depth, *[pdf[c] for c in own]):
                o, d, t = np.array(o), np.array(d), base + scale * z
                found.update((*of, *cell) for cell in _walk((o + d * max(0.0, z - t)) / step, (o + d * min(most, z + t)) / step, max_steps))
            yield pd.DataFrame(sorted(found), columns=[*own, "bx", "by", "bz"], dtype="int64")

    schema = ", ".join(f"`{c}` long" for c in [*own, "bx", "by", "bz"])
    return rays.select("origin", "direction", "depth", *own).mapInPandas(run, schema).distinct()


def _walk(a: np.ndarray, b: np.ndarray, max_steps: int) -> Iterator[tuple[int, int, int]]:
    """Cells of the unit lattice that the stretch from a to b passes."""
    cell, end = np.floor(a).astype(int), np.floor(b).astype(int)
    d = b - a
    step = np.sign(d).astype(int)
    with np.errstate(divide="ignore", invalid="ignore"):
        each = np.where(d != 0, np.abs(1 / d), np.inf)
        at = np.where(d > 0, (cell + 1 - a) / d, np.where(d < 0, (cell - a) / d, np.inf))
    for _ in range(max_steps):
        yield tuple(map(int, cell))
        if (cell == end).all() or at.min() > 1:
            return
        i = int(at.argmin())
        cell[i] += step[i]
        at[i] += each[i]


def observe(blocks: DataFrame, depth: DataFrame, view: list[float] | str, intrinsics: tuple[float, float, float, float], size: float = 0.01, side: int = 8, base: float = 0.02, scale: float = 0.06, most: float = 3.0, sign: float = 1.0) -> DataFrame:
    """Observations of the blocks' voxels by one frame: each voxel meets the depth pixel that it projects to, and counts
    if it isn't further behind the surface than the truncation. view: 3 x 4, world to camera, flat; depth: frame_index,
    x, y, depth, r, g, b. sign -1 takes the frame out again. view as the name of a column: blocks have it and frame_index,
    and a block's voxels meet the pixels of their own frame."""
    fx, fy, cx, cy = intrinsics
    local = F.explode(F.sequence(F.lit(0), F.lit(side**3 - 1)))
    own = ["frame_index"] if isinstance(view, str) else []
    v = blocks.select("bx", "by", "bz", *own, *([F.col(view).alias("__view")] if own else []), local.alias("i"))
    view = [F.col("__view")[i] for i in range(12)] if own else list(map(F.lit, view))
    v = v.select(*own, *(["__view"] if own else []), (F.col("bx") * side + F.col("i") % side).alias("vx"), (F.col("by") * side + F.floor(F.col("i") / side) % side).alias("vy"), (F.col("bz") * side + F.floor(F.col("i") / side**2)).alias("vz"))
    w = [F.col(k) * size for k in KEY]
    p = [sum((view[4 * i + j] * w[j] for j in range(3)), view[4 * i + 3]) for i in range(3)]
    v = v.withColumn("pz", p[2]).where("pz > 0")
    v = v.withColumns({"x": F.floor(fx * p[0] / p[2] + cx + 0.5).cast("int"), "y": F.floor(fy * p[1] / p[2] + cy + 0.5).cast("int")})
    seen = v.join(depth.where((F.col("depth") > 0) & (F.col("depth") <= most)), [*own, "x", "y"])
    trunc = base + scale * F.col("depth")
    sdf = F.col("depth") - F.col("pz")
    return seen.where(sdf > -trunc).select(*KEY, "frame_index", F.least(F.greatest(sdf, -trunc), trunc).alias("sdf"), F.lit(float(sign)).alias("weight"), "r", "g", "b")


def splat(blocks: DataFrame, view: list[float], intrinsics: tuple[float, float, float, float], width: int, height: int, size: float = 0.01, side: int = 8) -> DataFrame:
    """Nearest and furthest block corner that covers each tile of 8 x 8 pixels: tx, ty, near, far."""
    fx, fy, cx, cy = intrinsics
    corners = F.explode(F.array(*[F.array(*map(F.lit, c)) for c in CORNERS]))
    c = blocks.select("bx", "by", "bz", corners.alias("c"))
    w = [(F.col(f"b{k}") + F.col("c")[i]) * (side * size) for i, k in enumerate("xyz")]
    p = [sum((view[4 * i + j] * w[j] for j in range(3)), F.lit(view[4 * i + 3])) for i in range(3)]
    c = c.withColumns({"pz": p[2], "u": fx * p[0] / p[2] + cx, "w": fy * p[1] / p[2] + cy}).where("pz > 0")

    def tile(v: Column, n: int) -> Column:
        return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(n - 1.0)) / 8).cast("int")

    boxes = c.groupBy("bx", "by", "bz").agg(F.min("pz").alias("near"), F.max("pz").alias("far"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("w").alias("w0"), F.max("w").alias("w1"))
    boxes = boxes.where((F.col("u1") >= 0) & (F.col("u0") < width) & (F.col("w1") >= 0) & (F.col("w0") < height))
    wide = boxes.withColumn("tx", F.explode(F.sequence(tile(F.col("u0"), width), tile(F.col("u1"), width))))
    tall = wide.withColumn("ty", F.explode(F.sequence(tile(F.col("w0"), height), tile(F.col("w1"), height))))
    return tall.groupBy("tx", "ty").agg(F.min("near").alias("near"), F.max("far").alias("far"))


def raycast(voxels: DataFrame, rays: DataFrame, size: float = 0.01, increment: float = 0.016, near: float = 0.1, far: float = 3.0, max_jump: float = 0.5, bisections: int = 3) -> DataFrame:
    """First surface along each ray: ray_id, depth. rays: ray_id, origin, direction.

    Samples along rays meet the eight voxels around them in one equi-join; a sample counts if all eight have weight.
    Where two samples in a row go from front to back and are close, the crossing is the linear estimate between them. Each
    of `bisections` rounds samples the voxels at the estimate, takes the part that holds the change of sign and estimates
    again; the last estimate counts, and a crossing whose estimate has no sample doesn't. State travels with the samples,
    so a round is one more join of the crossings, which are few, and nothing before it is worked out twice. All joins are
    with the voxels that rays pass, a written table."""
    from pyspark.sql import Window

    n = int((far - near) / increment)
    samples = rays.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("t", F.lit(near) + F.col("k") * increment)
    for i, k in enumerate(KEY):
        samples = samples.withColumn(f"p{k}", (F.col("origin")[i] + F.col("t") * F.col("direction")[i]) / size)
        samples = samples.withColumn(f"s{k}", F.col(f"p{k}") - F.col("direction")[i] * increment / size)
    voxels = passed(voxels, samples)
    samples = in_blocks(samples.select("ray_id", "t", *[f"p{k}" for k in KEY]), voxels)
    sampled = interpolate(samples, voxels, ["ray_id", "t"]).join(rays.select("ray_id", "origin", "direction").hint("merge"), "ray_id")
    along = Window.partitionBy("ray_id").orderBy("t")
    steps = sampled.withColumns({"t0": F.lag("t").over(along), "d0": F.lag("sdf").over(along)})
    hits = steps.where((F.col("d0") > 0) & (F.col("sdf") <= 0) & (F.col("t") - F.col("t0") < 1.5 * increment) & (F.abs(F.col("sdf") - F.col("d0")) < max_jump))
    state = ["ray_id", "origin", "direction", "start", "t0", "d0", "t1", "d1", "depth"]
    now = hits.select("ray_id", "origin", "direction", F.col("t").alias("start"), "t0", "d0", F.col("t").alias("t1"), F.col("sdf").alias("d1"))
    now = now.withColumn("depth", linear_root("t0", "t1", "d0", "d1"))
    for i in range(bisections):
        now = now.withColumns({f"p{k}": (F.col("origin")[j] + F.col("depth") * F.col("direction")[j]) / size for j, k in enumerate(KEY)})
        now, front = interpolate(now, voxels, state), F.col("sdf") > 0
        halves = {"t0": F.when(front, F.col("depth")).otherwise(F.col("t0")), "d0": F.when(front, F.col("sdf")).otherwise(F.col("d0"))}
        halves |= {"t1": F.when(front, F.col("t1")).otherwise(F.col("depth")), "d1": F.when(front, F.col("d1")).otherwise(F.col("sdf"))}
        now = now.withColumns(halves).drop("sdf")
        if i + 1 < bisections:
            now = now.withColumn("depth", linear_root("t0", "t1", "d0", "d1"))
    return now.groupBy("ray_id").agg(F.min_by("depth", "start").alias("depth"))


def in_blocks(points: DataFrame, voxels: DataFrame, side: int = 8) -> DataFrame:
    """points (pvx, pvy, pvz in voxel units) in blocks that hold a voxel with weight. Others have no sample."""
    blocks = [f"b{k[1]}" for k in KEY]
    held = with_block(voxels.where("weight > 0"), side).select(*blocks).distinct()
    own = points.withColumns({b: C.voxel_to_block(F.floor(F.col(f"p{k}")), side) for b, k in zip(blocks, KEY)})
    return own.join(held.hint("merge"), blocks, "left_semi").drop(*blocks)


def passed(voxels: DataFrame, samples: DataFrame) -> DataFrame:
    """The voxels with weight that may be around a point of a stretch that ends in a sample (from svx, svy, svz to pvx,
    pvy, pvz in voxel units), as a written table: vx, vy, vz, sdf, weight. The margin is for rounding."""
    ends = [f"{e}{k}" for e in "sp" for k in KEY]
    cells = in_blocks(samples.select(*ends), voxels)
    for k in KEY:
        low, high = F.least(f"s{k}", f"p{k}") - 1e-6, F.greatest(f"s{k}", f"p{k}") + 1e-6
        cells = cells.withColumn(k, F.explode(F.sequence(F.floor(low), F.floor(high) + 1)))
    around = cells.select(*KEY).distinct()
    return stored(voxels.where("weight > 0").select(*KEY, "sdf", "weight").join(around.hint("merge"), KEY, "left_semi"))


def linear_root(t0: str, t1: str, d0: str, d1: str) -> Column:
    """Where the line through (t0, d0) and (t1, d1) is zero."""
    return F.col(t0) + F.col(d0) / (F.col(d0) - F.col(d1)) * (F.col(t1) - F.col(t0))


def bisection_root(f, t0: float, t1: float, rounds: int = 3) -> float:
    """The crossing of f between t0 (f > 0) and t1, by rounds of linear estimates in the half that holds it."""
    d0, d1, t = f(t0), f(t1), t0
    for _ in range(rounds):
        t = t0 + d0 / (d0 - d1) * (t1 - t0)
        d = f(t)
        if d > 0:
            t0, d0 = t, d
        else:
            t1, d1 = t, d
    return t


def interpolate(points: DataFrame, voxels: DataFrame, by: list[str]) -> DataFrame:
    """Trilinear sdf at points (pvx, pvy, pvz in voxel units); a point any of whose eight voxels has no weight is left out.

    Spark takes a table of voxels made by explode() for as small as what it was made of, so the join is named here: it
    never broadcasts voxels."""
    offsets = F.explode(F.array(*[F.array(*map(F.lit, c)) for c in CORNERS]))
    c = points.withColumn("c", offsets)
    weight = F.lit(1.0)
    for i, k in enumerate(KEY):
        low = F.floor(F.col(f"p{k}"))
        part = F.col(f"p{k}") - low
        c = c.withColumn(k, (low + F.col("c")[i]).cast("long"))
        weight = weight * F.when(F.col("c")[i] == 1, part).otherwise(1 - part)
    c = c.withColumn("__w", weight)
    near = c.join(voxels.where("weight > 0").select(*KEY, "sdf").hint("merge"), KEY)
    return near.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col("__w") * F.col("sdf")).alias("sdf")).where("__n = 8").drop("__n")


def gradients(voxels: DataFrame) -> DataFrame:
    """Central differences of sdf at voxels with both neighbours on each axis."""
    out = voxels.where("weight > 0").select(*KEY)
    for k in KEY:
        parts = voxels.where("weight > 0").select(*KEY, "sdf")
        up = parts.withColumn(k, F.col(k) - 1).withColumnRenamed("sdf", "__up")
        down = parts.withColumn(k, F.col(k) + 1).withColumnRenamed("sdf", "__down")
        out = out.join(up, KEY).join(down, KEY).withColumn(f"g{k[1]}", (F.col("__up") - F.col("__down")) / 2).drop("__up", "__down")
    return out


TETRAHEDRA = ((0, 5, 1, 7), (0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7))


@lru_cache
def surface_cases() -> tuple[tuple[tuple[int, int], ...], ...]:
    """For each of the 256 sign patterns of a cube's corners (bit set: behind the surface), the cut edges (pairs of
    corners), three to a triangle. From a rule: the cube is six tetrahedra along its diagonal; one with one corner
    apart from the others gives a triangle, one with two and two a quadrangle."""
    out = []
    for case in range(256):
        triangles: list[tuple[int, int]] = []
        for tet in TETRAHEDRA:
            back = [c for c in tet if case >> c & 1]
            front = [c for c in tet if not case >> c & 1]
            if len(back) in (1, 3):
                one, others = (back[0], front) if len(back) == 1 else (front[0], back)
                triangles += [(one, o) for o in others]
            elif len(back) == 2:
                (a, b), (c, d) = back, front
                triangles += [(a, c), (a, d), (b, d), (a, c), (b, d), (b, c)]
        out.append(tuple(triangles))
    return tuple(out)


def isosurface(voxels: DataFrame, size: float = 0.01, threshold: float = 10.0, box: tuple[tuple, tuple] | None = None, limit: int | None = None) -> DataFrame:
    """Triangles (tri_id from the cube and its place, v: nine coordinates) of the zero surface.

    A cube's eight corners come together in one group-by; all must have weight, and distances that differ by over
    threshold * size mark a jump in depth and give nothing. The pattern picks the cut edges from a table of 256 rows;
    vertices lie where the distance is zero along them. limit: a cap on triangles, a setting of the operator."""
    solid = voxels.where("weight > 0")
    cubes = solid.select("sdf", F.explode(F.array(*[F.struct(*[(F.col(k) - c[i]).alias(k) for i, k in enumerate(KEY)], F.lit(n).alias("corner")) for n, c in enumerate(CORNERS)])).alias("c")).select("sdf", "c.*")
    at = [F.max(F.when(F.col("corner") == n, F.col("sdf"))) for n in range(8)]
    cubes = cubes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.array(*at).alias("d")).where("n = 8")
    cubes = cubes.where((F.array_max("d") > 0) & (F.array_min("d") < 0) & (F.array_max("d") - F.array_min("d") < threshold * size))
    if box:
        low, high = box
        cubes = cubes.where(" AND ".join(f"{k} * {size} BETWEEN {low[i]} AND {high[i]}" for i, k in enumerate(KEY)))
    case = sum((F.when(F.col("d")[n] < 0, 1 << n).otherwise(0) for n in range(8)), F.lit(0))
    table = voxels.sparkSession.createDataFrame([(i, [list(e) for e in es]) for i, es in enumerate(surface_cases()) if es], "case int, edges array<array<int>>")
    cut = cubes.withColumn("case", case).join(F.broadcast(table), "case")  # 254 rows
    corner = [F.array(*[F.lit(float(c[i])) for c in CORNERS]) for i in range(3)]

    def vertex(e: Column) -> Column:
        a, b = F.get("d", e[0]), F.get("d", e[1])
        part = a / (a - b)
        return F.array(*[(F.col(k) + F.get(corner[i], e[0]) + part * (F.get(corner[i], e[1]) - F.get(corner[i], e[0]))) * size for i, k in enumerate(KEY)])

    points = cut.withColumn("p", F.transform("edges", vertex)).select(*KEY, "p", F.explode(F.sequence(F.lit(0), (F.size("p") / 3 - 1).cast("int"))).alias("tri"))
    tris = points.select(*KEY, "tri", F.flatten(F.slice("p", F.col("tri") * 3 + 1, 3)).alias("v"))
    return tris.limit(limit) if limit else tris


def mesh(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (vertex_id = 3 i + k, x, y, z) and faces (a, b, c) of triangles numbered in order of cube and place.

    Numbers come from counts per column of cubes, so no task holds the mesh."""
    from pyspark.sql import Window

    lane = triangles.groupBy("vx", "vy").agg(F.count(F.lit(1)).alias("n"))
    base = lane.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("vx", "vy").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("vx", "vy").orderBy("vz", "tri")) - 1
    numbered = triangles.withColumn("own", own).join(base, ["vx", "vy"]).withColumn("i", F.col("base") + F.col("own"))
    vertices = numbered.select("i", F.posexplode(F.array(*[F.slice("v", 3 * k + 1, 3) for k in range(3)])).alias("k", "p"))
    vertices = vertices.select((3 * F.col("i") + F.col("k")).alias("vertex_id"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("p")[2].alias("z"))
    return vertices, numbered.select(*[(3 * F.col("i") + k).alias(n) for k, n in enumerate("abc")])

