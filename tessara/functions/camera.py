"""Pinhole camera, grid, voxel and affine-keypoint functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessara.functions import vectors as V


def unproject(x: Column, y: Column, depth: Column, fx, fy, cx, cy) -> Column:
    return F.array((x - cx) / fx * depth, (y - cy) / fy * depth, depth)


def project(p: Column, fx, fy, cx, cy) -> Column:
    return F.array(fx * p[0] / p[2] + cx, fy * p[1] / p[2] + cy)


def project_jacobian(p: Column, fx, fy) -> Column:
    """2 x 3, of the pixel by the point."""
    z = p[2]
    return F.array(fx / z, F.lit(0.0), -fx * p[0] / (z * z), F.lit(0.0), fy / z, -fy * p[1] / (z * z))


def ray(x: Column, y: Column, fx, fy, cx, cy) -> Column:
    return V.normalize(unproject(x, y, F.lit(1.0), fx, fy, cx, cy))


def centre_ray(width: Column, height: Column, fx, fy, cx, cy) -> Column:
    return ray(width / 2, height / 2, fx, fy, cx, cy)


def border_rays(width: Column, height: Column, fx, fy, cx, cy) -> Column:
    zero = F.lit(0.0)
    return F.array(*[ray(x, y, fx, fy, cx, cy) for x, y in ((zero, zero), (width, zero), (width, height), (zero, height))])


def transform_pixel_to_point(x: Column, y: Column, depth: Column, pose: Column, fx, fy, cx, cy) -> Column:
    return V.transform_point(pose, unproject(x, y, depth, fx, fy, cx, cy))


def transform_pixel(x: Column, y: Column, depth: Column, pose: Column, fx, fy, cx, cy) -> Column:
    return project(transform_pixel_to_point(x, y, depth, pose, fx, fy, cx, cy), fx, fy, cx, cy)


def in_frustum(p: Column, fx, fy, cx, cy, width: int, height: int, near: float, far: float) -> Column:
    """Whether the point, in camera coordinates, lies in 95 % of the view's box."""
    uv = project(p, fx, fy, cx, cy)
    ndc = [2 * uv[0] / (width - 1) - 1, 1 - 2 * uv[1] / (height - 1), (p[2] - near) / (far - near)]
    inside = [F.abs(v * 0.95) <= 1 for v in ndc[:2]]
    return (p[2] > 0) & inside[0] & inside[1] & (ndc[2] * 0.95 >= 0) & (ndc[2] * 0.95 <= 1)


def in_box(p: Column, low: tuple[float, float, float], high: tuple[float, float, float]) -> Column:
    return p[0].between(low[0], high[0]) & p[1].between(low[1], high[1]) & p[2].between(low[2], high[2])


def distort(x: Column, y: Column, k: Column) -> tuple[Column, Column]:
    """Of a point on the image plane at depth 1. k: k1, k2, p1, p2, k3."""
    r2 = x * x + y * y
    radial = 1 + r2 * (k[0] + r2 * (k[1] + r2 * k[4]))
    return x * radial + 2 * k[2] * x * y + k[3] * (r2 + 2 * x * x), y * radial + k[2] * (r2 + 2 * y * y) + 2 * k[3] * x * y


def undistort(x: Column, y: Column, k: Column, fx, fy, cx, cy, rounds: int = 5) -> Column:
    """The pixel that the lens moved to (x, y), by fixed-point rounds; as it is where k1 is 0."""
    start = F.struct(((x - cx) / fx).alias("x"), ((y - cy) / fy).alias("y"))

    def step(s: Column, _: Column) -> Column:
        r2 = s.x * s.x + s.y * s.y
        radial = 1 + r2 * (k[0] + r2 * (k[1] + r2 * k[4]))
        dx = 2 * k[2] * s.x * s.y + k[3] * (r2 + 2 * s.x * s.x)
        dy = k[2] * (r2 + 2 * s.y * s.y) + 2 * k[3] * s.x * s.y
        return F.struct((((x - cx) / fx - dx) / radial).alias("x"), (((y - cy) / fy - dy) / radial).alias("y"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return F.when(k[0] == 0, F.array(x, y)).otherwise(F.array(found.x * fx + cx, found.y * fy + cy))


def image_bounds(width: Column, height: Column, k: Column, fx, fy, cx, cy) -> Column:
    """struct(min_x, max_x, min_y, max_y) of the undistorted corners; the image's own where k1 is 0."""
    zero = F.lit(0.0)
    a, b, c, d = (undistort(x, y, k, fx, fy, cx, cy, 20) for x, y in ((zero, zero), (width * 1.0, zero), (zero, height * 1.0), (width * 1.0, height * 1.0)))
    return F.struct(F.least(a[0], c[0]).alias("min_x"), F.greatest(b[0], d[0]).alias("max_x"), F.least(a[1], b[1]).alias("min_y"), F.greatest(c[1], d[1]).alias("max_y"))


def grid_cell(v: Column, low, high, cells: int) -> Column:
    """The nearest of `cells` grid lines between low and high; null outside."""
    cell = F.round((v - low) * (cells / (high - low)))
    return F.when((cell >= 0) & (cell < cells), cell.cast("int"))


# affine keypoints: a11, a12, a21, a22


def affine_scale_x(a11: Column, a21: Column) -> Column:
    return F.sqrt(a11 * a11 + a21 * a21)


def affine_orientation(a11: Column, a21: Column) -> Column:
    return F.atan2(a21, a11)


def affine_scale_y(a11: Column, a12: Column, a21: Column, a22: Column) -> Column:
    o = affine_orientation(a11, a21)
    shear = affine_shear(a11, a12, a21, a22)
    return F.sqrt(a12 * a12 + a22 * a22) * F.cos(shear) if o is not None else None


def affine_shear(a11: Column, a12: Column, a21: Column, a22: Column) -> Column:
    return F.atan2(-a12, a22) - affine_orientation(a11, a21)


def affine_scale(a11: Column, a12: Column, a21: Column, a22: Column) -> Column:
    return (affine_scale_x(a11, a21) + affine_scale_y(a11, a12, a21, a22)) / 2


def affine_from_parameters(scale_x: Column, scale_y: Column, orientation: Column, shear: Column) -> Column:
    c = F.cos(shear)
    return F.struct(
        (scale_x * F.cos(orientation)).alias("a11"), (-scale_y * F.sin(orientation + shear) / c).alias("a12"),
        (scale_x * F.sin(orientation)).alias("a21"), (scale_y * F.cos(orientation + shear) / c).alias("a22"),
    )


# voxels: whole coordinates of a lattice with a step of `size`; blocks of 8 x 8 x 8


def half_away(x: Column) -> Column:
    """x to the nearest whole number, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def world_to_voxel(x: Column, size: float) -> Column:
    return half_away(x / size)


def voxel_to_block(v: Column, side: int = 8) -> Column:
    return F.floor(v / side).cast("long")


def voxel_in_block(v: Column, side: int = 8) -> Column:
    return F.pmod(v, F.lit(side))


def local_index(vx: Column, vy: Column, vz: Column, side: int = 8) -> Column:
    return (voxel_in_block(vz, side) * side * side + voxel_in_block(vy, side) * side + voxel_in_block(vx, side)).cast("int")


def from_local_index(i: Column, side: int = 8) -> Column:
    return F.struct((i % side).alias("x"), (F.floor(i / side) % side).alias("y"), F.floor(i / (side * side)).alias("z"))


def spatial_hash(x: Column, y: Column, z: Column, buckets: int) -> Column:
    """Bucket of a cell. The three primes. The product wraps to 32 bits."""

    def wrapped(v: Column, prime: int) -> Column:
        low = F.pmod(v.cast("decimal(38,0)") * prime, F.lit(1 << 32).cast("decimal(38,0)")).cast("long")
        return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)

    h = wrapped(x, 73856093).bitwiseXOR(wrapped(y, 19349669)).bitwiseXOR(wrapped(z, 83492791))
    return F.pmod(h, F.lit(buckets))


def truncation(z: Column, base: float = 0.02, scale: float = 0.06) -> Column:
    return base + scale * z


def stream_chunk(p: Column, extent: float = 1.0) -> Column:
    """The chunk of a world coordinate."""
    return half_away(p / extent)


def chain_residual(i: Column, j: Column, k: Column, p: Column, pixel: Column, fx, fy, cx, cy, inverse: bool = False) -> Column:
    """Where i^-1 j k takes point p in the image, less the pixel that saw it; inverse: (i^-1 j k)^-1 instead. i, j, k: poses,
    of a node, of another one and of the latter's frame."""
    chain = V.compose(V.inverse_pose(i), V.compose(j, k))
    moved = V.transform_point(V.inverse_pose(chain) if inverse else chain, p)
    return V.let(moved, lambda m: V.let(project(m, fx, fy, cx, cy), lambda at: F.array(at[0] - pixel[0], at[1] - pixel[1])))
