"""Image files, dense matches, surfaces and frames put together."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessara.functions import camera as C
from tessara.functions import vectors as V
from tessara.operators import features, fusion, images, registration
from tessara.operators import solvers as S
from tessara.sources import pixels
from tests.test_operators import pose_case, sphere


def png(image, bits, colour, kinds):
    """A PNG whose rows use the filters of kinds in turn."""
    h, w, n = image.shape
    step = n * bits // 8
    raw = image.astype(">u2" if bits == 16 else np.uint8).tobytes()
    rows = [list(raw[y * w * step : (y + 1) * w * step]) for y in range(h)]
    out = bytearray()
    for y, row in enumerate(rows):
        kind, up = kinds[y % len(kinds)], rows[y - 1] if y else [0] * len(row)
        out.append(kind)
        for i, x in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((x - (0, a, b, (a + b) // 2, nearest)[kind]) & 255)

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    packed = zlib.compress(bytes(out))
    return pixels.PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + part(b"IDAT", packed[:9]) + part(b"IDAT", packed[9:]) + part(b"IEND", b"")


@pytest.mark.parametrize(("bits", "colour", "n"), [(8, 0, 1), (16, 0, 1), (8, 2, 3), (16, 2, 3), (8, 6, 4), (8, 4, 2)])
def test_png_round_trip(bits, colour, n):
    image = np.random.default_rng(bits + colour).integers(0, 1 << bits, (11, 7, n))
    assert (pixels.decode(png(image, bits, colour, [0, 1, 2, 3, 4])) == image).all()


def test_netpbm_and_others():
    assert pixels.decode(b"P5\n# note\n2 1\n65535\n\x01\x00\x00\x02").tolist() == [[[256], [2]]]
    assert pixels.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    with pytest.raises(ValueError, match="neither"):
        pixels.decode(b"")


def test_files_to_pixels(spark, tmp_path):
    rng = np.random.default_rng(1)
    depth, colour = rng.integers(0, 9000, (2, 3, 4, 1)), rng.integers(0, 256, (2, 3, 4, 3))
    for i in range(2):
        (tmp_path / f"d{i}.png").write_bytes(png(depth[i], 16, 0, [4, 1]))
        (tmp_path / f"c{i}.png").write_bytes(png(colour[i], 8, 2, [3]))
    frames = spark.createDataFrame([(i, f"{tmp_path}/c{i}.png", f"file://{tmp_path}/d{i}.png") for i in range(3)], "frame_index long, rgb_path string, depth_path string")
    found = pixels.images(spark, str(tmp_path))
    got = pixels.pixels(frames, found, found).collect()
    assert len(got) == 24 and all(r.depth == depth[r.frame_index, r.y, r.x, 0] and [r.r, r.g, r.b] == colour[r.frame_index, r.y, r.x].tolist() for r in got)
    assert pixels.pixels(frames, found).columns == ["frame_index", "x", "y", "depth"]


def test_dense_scores(spark):
    rng = random.Random(4)
    one, two = (np.array([[rng.randint(0, 255) for _ in range(6)] for _ in range(6)]) for _ in range(2))
    names = "x int, y int, luma int, n array<double>"
    tables = [spark.createDataFrame([(x, y, int(g[x, y]), [0.0, 0.0, 1.0]) for x in range(6) for y in range(6)], names) for g in (one, two)]
    warp = spark.createDataFrame([(x, y, x, y) for x in range(6) for y in range(6)], "x int, y int, wx int, wy int")
    got = images.dense_match(*tables, warp, neigh=0, radius=1, sigma_color=0.2).collect()
    assert len(got) == 36
    a, b = one / 255, two / 255
    for r in got:
        at = [(r.x + i, r.y + j, i * i + j * j) for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= r.x + i < 6 and 0 <= r.y + j < 6]
        va, vb, d = np.array([a[i, j] for i, j, _ in at]), np.array([b[i, j] for i, j, _ in at]), np.array([k for *_, k in at])
        wa, wb = (np.exp(-d / 2 - (v - g[r.x, r.y]) ** 2 / 0.08) for v, g in ((va, a), (vb, b)))
        ma, mb = np.average(va, weights=wa), np.average(vb, weights=wb)
        spread = (np.average(va**2, weights=wa) - ma**2) * (np.average(vb**2, weights=wb) - mb**2)
        assert np.isclose(r.score, max(-1, (np.average(va * vb, weights=wa) - ma * mb) / np.sqrt(spread)), atol=1e-9)


def test_bisection_samples_again(spark):
    """Depths are those of bisection_root() on the trilinear distance along the ray."""
    field = {(x, y, z): (np.sqrt(x * x + y * y + z * z) - 6.3) ** 3 * 0.0003 for x in range(-10, 11) for y in range(-10, 11) for z in range(-10, 11)}
    voxels = spark.createDataFrame([(*k, float(d), 1.0) for k, d in field.items()], "vx long, vy long, vz long, sdf double, weight double")
    o, d = np.array([0.011, -0.022, -0.3]), np.array([0.02, 0.01, 1.0])
    rays = spark.createDataFrame([(1, o.tolist(), d.tolist())], "ray_id int, origin array<double>, direction array<double>")

    def sdf(t):
        p = (o + t * d) / 0.01
        low = np.floor(p).astype(int)
        part = p - low
        return sum(np.prod([part[i] if c[i] else 1 - part[i] for i in range(3)]) * field[tuple(map(int, low + c))] for c in fusion.CORNERS)

    steps = [0.1 + 0.016 * k for k in range(8, 17)]
    near, far = next((s, t) for s, t in zip(steps, steps[1:]) if sdf(s) > 0 >= sdf(t))
    for rounds in (1, 3):
        assert np.isclose(fusion.raycast(voxels, rays, bisections=rounds).first().depth, fusion.bisection_root(sdf, near, far, rounds), atol=1e-9)
    assert fusion.raycast(sphere(spark), rays, bisections=0).count() == 1


def test_raycast_broadcasts_no_voxels(spark):
    """Voxels made by explode() count as small in Spark's plan. The written voxels are all that the rays need."""
    one, s = F.sequence(F.lit(-6), F.lit(6)), spark.range(40, numPartitions=4)
    for c in "xyz":
        s = s.withColumn(f"v{c}", F.explode(one))
    far = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2) - 3.7
    s = s.select((F.col("id") * 14 + F.col("vx")).alias("vx"), F.col("vy").cast("long").alias("vy"), F.col("vz").cast("long").alias("vz"), (far * 0.01).alias("sdf"), F.lit(1.0).alias("weight"))
    direction = F.array(F.lit(0.02), F.lit(-0.03), F.lit(1.0))
    rays = spark.range(40).select(F.col("id").alias("ray_id"), F.array(F.col("id") * 0.14 - 0.002, F.lit(0.009), F.lit(-0.3)).alias("origin"), direction.alias("direction"))
    got = fusion.raycast(s, rays)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    whole = {tuple(r[:3]): r.sdf for r in s.collect()}
    for r in got.join(rays, "ray_id").collect():
        o, d = np.array(r.origin), np.array(r.direction)

        def sdf(t):
            p = (o + t * d) / 0.01
            low = np.floor(p).astype(int)
            return sum(np.prod([p[i] - low[i] if c[i] else 1 - p[i] + low[i] for i in range(3)]) * whole[tuple(map(int, low + c))] for c in fusion.CORNERS)

        steps = [0.1 + 0.016 * k for k in range(10, 17)]
        near, end = next((a, b) for a, b in zip(steps, steps[1:]) if sdf(a) > 0 >= sdf(b))
        assert np.isclose(r.depth, fusion.bisection_root(sdf, near, end, 3), atol=1e-9)
    assert got.count() == 40


def test_integrate_adds_up_frames(spark):
    """As observe() frame by frame, over the blocks of that frame; a frame with sign -1 is taken out."""
    k = (100.0, 100.0, 8.0, 8.0)
    px = spark.createDataFrame([(f, x, y, 1.0 + 0.01 * f, 1, 2, 3) for f in (1, 2, 3) for x in range(16) for y in range(16)], "frame_index long, x int, y int, depth double, r int, g int, b int")
    shift = {1: [0.0, 0.0, 0.0], 2: [0.02, 0.0, 0.01]}
    poses = spark.createDataFrame([(f, ([0.0, 0.0, 0.0, 1.0], t), 1.0) for f, t in shift.items()], "frame_index long, world struct<q: array<double>, t: array<double>>, sign double")
    got = {tuple(r[:3]): tuple(r[3:]) for r in registration.integrate(px, poses, k).collect()}
    parts = []
    for f, t in shift.items():
        own = px.where(F.col("frame_index") == f)
        rays = own.select(F.array(*map(F.lit, t)).alias("origin"), F.array((F.col("x") - 8) / 100, (F.col("y") - 8) / 100, F.lit(1.0)).alias("direction"), "depth")
        parts.append(fusion.observe(fusion.allocate(rays), own, [1.0, 0, 0, -t[0], 0, 1.0, 0, -t[1], 0, 0, 1.0, -t[2]], k))
    want = {tuple(r[:3]): tuple(r[3:]) for r in fusion.merge(parts[0].unionByName(parts[1])).collect()}
    assert got.keys() == want.keys() and len(got) > 500 and all(np.allclose(got[c], want[c]) for c in got)
    both = poses.unionByName(poses.withColumn("sign", F.lit(-1.0)))
    assert registration.integrate(px, both.where("frame_index = 1 OR sign > 0"), k).count() == fusion.merge(parts[1]).count()


def test_global_edges_and_cloud(spark):
    r, t, p, _, k, _ = pose_case(12, 60, 0)
    vec = np.random.default_rng(12).normal(size=(60, 16))
    vec /= np.linalg.norm(vec, axis=1)[:, None]
    c = p @ r.T + t
    a = S.project(np.eye(3), np.zeros(3), p, k)
    b = S.project(r, t, p, k) + np.random.default_rng(3).normal(size=(60, 2)) * 0.05
    one = spark.createDataFrame([(0, 1, i, *map(float, a[i]), float(p[i, 2]), vec[i].tolist()) for i in range(60)], "src long, dst long, l_id long, l_x double, l_y double, l_depth double, l_vec array<double>")
    two = spark.createDataFrame([(0, 1, i, *map(float, b[i]), float(c[i, 2]), vec[i].tolist()) for i in range(60)], "src long, dst long, r_id long, r_x double, r_y double, r_depth double, r_vec array<double>")
    weights = spark.createDataFrame([(0, 1, 5.0)], "src long, dst long, weight double")
    e, plain = registration.global_edges(one, two, weights, k).first(), registration.global_edges(one, two, weights.limit(0), k).first()
    assert np.allclose(e.t, -r.T @ t, atol=0.01) and np.isclose(e.cost, 5 * plain.cost) and e.n >= 55
    pose = "struct<q: array<double>, t: array<double>>"
    unit = [0.0, 0.0, 0.0, 1.0]
    cloud = registration.merged_cloud(spark.createDataFrame([(3, [1.0, 0.0, 0.0], 9), (4, [0.0] * 3, 9)], "frame_index long, p array<double>, r int"), spark.createDataFrame([(3, 0, (unit, [0.0, 1.0, 0.0]))], f"frame_index long, node long, pose {pose}"), spark.createDataFrame([(0, (unit, [0.0, 0.0, 2.0]))], f"node long, pose {pose}"))
    assert [tuple(x) for x in cloud.select("node", "p", "r").collect()] == [(0, [1.0, 1.0, 2.0], 9)]


def test_chain_residual(spark):
    rng = np.random.default_rng(8)
    poses = [(S.exp_so3(rng.normal(size=3) * 0.2), rng.normal(size=3) * 0.1) for _ in range(3)]
    columns = [V.pose(F.array(*map(F.lit, S.quaternion(r).tolist())), F.array(*map(F.lit, t.tolist()))) for r, t in poses]
    p, (fx, fy, cx, cy) = np.array([0.1, -0.2, 3.0]), (500.0, 400.0, 320.0, 240.0)
    m = [np.vstack([np.c_[r, t], [0, 0, 0, 1]]) for r, t in poses]
    chain = np.linalg.inv(m[0]) @ m[1] @ m[2]
    for inverse in (False, True):
        q = ((np.linalg.inv(chain) if inverse else chain) @ [*p, 1])[:3]
        got = spark.range(1).select(C.chain_residual(*columns, F.array(*map(F.lit, p.tolist())), F.array(F.lit(300.0), F.lit(200.0)), fx, fy, cx, cy, inverse).alias("d")).first().d
        assert np.allclose(got, [fx * q[0] / q[2] + cx - 300, fy * q[1] / q[2] + cy - 200])


def test_words_in_slices(spark):
    rng = np.random.default_rng(5)
    centres, v = rng.normal(size=(9000, 3)), rng.normal(size=(1500, 3))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i int, descriptor array<double>").coalesce(1)
    got = [r.word for r in features.assign_words(rows, centres).orderBy("i").collect()]
    assert got == [int(((centres - x) ** 2).sum(1).argmin()) for x in v]
