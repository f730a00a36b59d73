"""Vectors and matrices as flat arrays, and rigid transforms as struct(q, t), all as column arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(v: Column, f: Callable[[Column], Column]) -> Column:
    """f(v) with v worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(v), f), 1)


def dot(a: Column, b: Column) -> Column:
    """The sum of products in order of the index, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column, s: Column | float) -> Column:
    return F.transform(v, lambda x: x * s)


def normalize(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    return let(F.struct(v.alias("v"), length(v).alias("n")), lambda s: F.when(s.n > 0, F.transform(s.v, lambda x: x / s.n)).otherwise(s.v))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def lerp(a: Column, b: Column, t: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x + (y - x) * t)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))


def fabs(v: Column) -> Column:
    return F.transform(v, F.abs)


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def reflect(i: Column, n: Column) -> Column:
    """i less twice its part along n."""
    return minus(i, scaled(n, 2.0 * dot(n, i)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (length(a) * length(b))


def angle(d: Column) -> Column:
    """The angle of a dot product of unit vectors."""
    return F.acos(F.least(d, F.lit(1.0)))


def matmul(a: Column, b: Column, rows: int, inner: int, cols: int) -> Column:
    return F.array(*[reduce(add, [a[i * inner + k] * b[k * cols + j] for k in range(inner)]) for i in range(rows) for j in range(cols)])


def transpose(a: Column, rows: int, cols: int) -> Column:
    return F.array(*[a[i * cols + j] for j in range(cols) for i in range(rows)])


def identity(n: int) -> Column:
    return F.array(*[F.lit(float(i == j)) for i in range(n) for j in range(n)])


def det2(a: Column) -> Column:
    return a[0] * a[3] - a[1] * a[2]


def det3(a: Column) -> Column:
    return a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])


def inverse2(a: Column) -> Column:
    d = det2(a)
    return F.array(a[3] / d, -a[1] / d, -a[2] / d, a[0] / d)


def inverse3(a: Column) -> Column:
    cofactors = [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]
    return let(a, lambda a: let(det3(a), lambda d: F.array(*[(a[p] * a[q] - a[r] * a[s]) / d for p, q, r, s in cofactors])))


def quaternion_to_matrix(q: Column) -> Column:
    def of(q: Column) -> Column:
        x, y, z, w = (q[i] for i in range(4))
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
            2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
            2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
        )

    return let(q, of)


def matrix_to_quaternion(r: Column) -> Column:
    """x, y, z, w of a rotation, by its largest diagonal term."""

    def of(r: Column) -> Column:
        four = (
            F.when(r[0] + r[4] + r[8] > 0, F.array(r[7] - r[5], r[2] - r[6], r[3] - r[1], 1 + r[0] + r[4] + r[8]))
            .when((r[0] >= r[4]) & (r[0] >= r[8]), F.array(1 + r[0] - r[4] - r[8], r[1] + r[3], r[2] + r[6], r[7] - r[5]))
            .when(r[4] >= r[8], F.array(r[1] + r[3], 1 - r[0] + r[4] - r[8], r[5] + r[7], r[2] - r[6]))
            .otherwise(F.array(r[2] + r[6], r[5] + r[7], 1 - r[0] - r[4] + r[8], r[3] - r[1]))
        )
        return normalize(four)

    return let(r, of)


def quaternion_product(a: Column, b: Column) -> Column:
    ax, ay, az, aw = (a[i] for i in range(4))
    bx, by, bz, bw = (b[i] for i in range(4))
    return F.array(
        aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz,
    )


def rotate(q: Column, p: Column) -> Column:
    u = F.slice(q, 1, 3)
    t = scaled(cross(u, p), 2.0)
    return plus(plus(p, scaled(t, q[3])), cross(u, t))


def pose(q: Column, t: Column) -> Column:
    return F.struct(q.alias("q"), t.alias("t"))


def identity_pose() -> Column:
    return pose(F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))), F.array(*map(F.lit, (0.0, 0.0, 0.0))))


def transform_point(a: Column, p: Column) -> Column:
    return plus(rotate(a["q"], p), a["t"])


def compose(a: Column, b: Column) -> Column:
    """First b, then a."""
    return let(a, lambda a: let(b, lambda b: pose(quaternion_product(a["q"], b["q"]), transform_point(a, b["t"]))))


def inverse_pose(a: Column) -> Column:
    def of(a: Column) -> Column:
        q = F.array(-a["q"][0], -a["q"][1], -a["q"][2], a["q"][3])
        return pose(q, scaled(rotate(q, a["t"]), -1.0))

    return let(a, of)


def pose_to_matrix(a: Column) -> Column:
    """4 x 4."""
    def of(s: Column) -> Column:
        r, t = s.r, s.t
        return F.array(*[x for i in range(3) for x in (r[3 * i], r[3 * i + 1], r[3 * i + 2], t[i])], *map(F.lit, (0.0, 0.0, 0.0, 1.0)))

    return let(a, lambda a: let(F.struct(quaternion_to_matrix(a["q"]).alias("r"), a["t"].alias("t")), of))


def matrix_to_pose(m: Column) -> Column:
    return let(m, lambda m: pose(matrix_to_quaternion(matrix_rotation(m)), F.array(m[3], m[7], m[11])))


def matrix_rotation(m: Column) -> Column:
    return F.array(*[m[4 * i + j] for i in range(3) for j in range(3)])


def projection_rows(a: Column) -> Column:
    """The 3 x 4 matrix of a pose."""
    return F.slice(pose_to_matrix(a), 1, 12)


def camera_centre(a: Column) -> Column:
    """Where the point that a maps to the origin lies."""
    return inverse_pose(a)["t"]


def point_depth(a: Column, p: Column) -> Column:
    return transform_point(a, p)[2]


def is_rotation(r: Column, tolerance: float = 1e-6) -> Column:
    """Whether r is orthonormal and keeps handedness."""
    off = minus(matmul(r, transpose(r, 3, 3), 3, 3, 3), identity(3))
    return (F.array_max(fabs(off)) < tolerance) & (F.abs(det3(r) - 1) < tolerance)


def rotation_error(true: Column, found: Column) -> Column:
    """Relative distance of quaternions, the nearer of both signs."""
    return F.least(length(minus(true, found)), length(plus(true, found))) / length(true)


def translation_error(true: Column, found: Column) -> Column:
    return length(minus(true, found)) / length(true)
