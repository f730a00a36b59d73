"""Operators on small tables with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessara.functions import vectors as V
from tessara.operators import aggs, estimate, features, fusion, graph, images, joins, registration, topk
from tessara.operators import solvers as S


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_nearest_rules(spark):
    def unit(a):
        return [math.cos(a), math.sin(a)]

    left = spark.createDataFrame([(1, unit(0.0)), (2, unit(1.0)), (3, unit(2.0))], "l_id int, l_vec array<double>")
    right = spark.createDataFrame([(10, unit(0.05)), (11, unit(0.9)), (12, unit(1.1)), (13, unit(2.9))], "r_id int, r_vec array<double>")
    got = {r.l_id: r.r_id for r in joins.nearest(left, right).collect()}
    assert got == {1: 10}  # 2 fails the ratio test, 3 is too far
    assert {r.l_id for r in joins.nearest(left, right, ratio=1e9, mutual=False, max_angle=None).collect()} == {1, 2, 3}
    assert joins.nearest(left, right, extra=lambda: F.col("r_id") != 10).where("l_id = 1").isEmpty()


def greedy(a, b, tolerance):
    pairs = sorted((abs(x - y), x, y) for x in a for y in b if abs(x - y) < tolerance)
    out = []
    for _, x, y in pairs:
        if x in a and y in b:
            a, b = a - {x}, b - {y}
            out.append((x, y))
    return sorted(out)


def test_time_associate(spark):
    rng = random.Random(1)
    a, b = ({rng.randint(0, 400) / 4 for _ in range(60)} for _ in range(2))
    one, two = (spark.createDataFrame([(x,) for x in s], f"{n} double") for s, n in ((a, "a"), (b, "b")))
    assert [x[:2] for x in rows(joins.time_associate(one, two, 2.0))] == greedy(a, b, 2.0)
    assert joins.time_associate(one, two.limit(0), 2.0).count() == 0


def test_time_associate_in_stretches(spark):
    """Cuts in time change nothing, nor do clocks that drift apart, of which each pair waits for the next."""
    from tessara.operators.joins import Stretch

    for seed in range(300):
        rng = random.Random(seed)
        a, b = (sorted(rng.sample(range(200), rng.randint(0, 30))) for _ in "ab")
        tolerance = rng.choice([2, 9, 500])
        rest = sorted([(x, True) for x in a] + [(x, False) for x in b], key=lambda p: (p[0], not p[1]))
        found, size, turn = [], rng.randint(3, 9), 0
        while rest:
            alone = len(rest) <= size
            cuts = [0, *range(size - turn % 2 * (size // 2), len(rest), size), len(rest)] if not alone else [0, len(rest)]
            left = []
            for i, j in zip(cuts, cuts[1:]):
                at = [x for x, _ in rest[i:j]]
                pairs, lost = Stretch(at, [k for _, k in rest[i:j]], at, at, tolerance, not alone).walk()
                found += [(at[x], at[y]) for x, y in pairs]
                left += [rest[i + x] for x in lost]
            size *= 2 if len(left) == len(rest) else 1
            rest, turn = sorted(left, key=lambda p: (p[0], not p[1])), turn + 1
        assert sorted(found) == greedy({*a}, {*b}, tolerance)
    a, b = [10.0 * i for i in range(16)], [10.0 * i + 4 - i / 20 for i in range(16)]
    one, two = spark.createDataFrame([(x,) for x in a], "a double"), spark.createDataFrame([(x,) for x in b], "b double")
    assert [x[:2] for x in rows(joins.time_associate(one, two, 20.0, chunk=24))] == greedy({*a}, {*b}, 20.0)


def test_forest_of_many_sequences(spark):
    """Sequences of any key, null and NaN too, are folds of their own, and roots are where trees begin."""
    keys = [None, float("nan"), 1.0, 2.0]
    nodes = spark.createDataFrame([(k, i) for k in keys for i in range(5)], "seq double, node_index long")
    edges = spark.createDataFrame([(k, i, i - 1, 1.0) for k in keys for i in (1, 2, 4)] + [(2.0, 9, 1, 1.0)], "seq double, src long, dst long, cost double")
    got = graph.spanning_forest(edges, ["seq"], nodes).collect()
    assert len(got) == 20
    assert {(r.node_index, r.parent, r.root, r.path_len, r.main) for r in got} == {(0, None, 0, 0, True), (1, 0, 0, 1, True), (2, 1, 0, 2, True), (3, None, 3, 0, False), (4, 3, 3, 1, False)}


def test_range_join(spark):
    rng = random.Random(2)
    p = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(80)]
    left, right = spark.createDataFrame(p, "i int, x double, y double"), spark.createDataFrame(p, "j int, u double, v double")
    got = {(r.i, r.j) for r in joins.range_join(left, right, ("x", "u"), ("y", "v"), 1.5).collect()}
    assert got == {(a[0], b[0]) for a in p for b in p if abs(a[1] - b[1]) < 1.5 and abs(a[2] - b[2]) < 1.5}


def test_words(spark):
    q = spark.createDataFrame([(1, w, 1.0) for w in "abcde"], "query int, word string, weight double")
    r = spark.createDataFrame([(10, w, 1.0) for w in "abcde"] + [(11, w, 1.0) for w in "abc"] + [(12, w, 1.0) for w in "ab"], "ref int, word string, weight double")
    n = joins.shared_words(q, r)
    assert rows(n) == [(1, 10, 5), (1, 11, 3), (1, 12, 2)]
    assert rows(topk.max_relative(n, ["query"], "n", 0.6)) == [(1, 10, 5), (1, 11, 3)] and rows(topk.max_relative(n, ["query"], "n", 0.6, strict=True)) == [(1, 10, 5)]
    assert [x.ref for x in joins.retrieve(q, r, 1).collect()] == [10]
    co = spark.createDataFrame([(11, 10)], "ref int, co int")
    assert {x.ref for x in joins.overlapping(q, r, co, 0.1, factor=0.5).collect()} == {10}


def test_lookups(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert rows(joins.lookup(a, b, ["k"], strict=False)) == [(1, "x")] and rows(joins.without_known(a, b, ["k"])) == [(2,)]
    with pytest.raises(Exception, match="no match"):
        joins.lookup(a, b, ["k"]).collect()
    v = spark.createDataFrame([(0, 0, 0, 0.5, 2.0)], "vx int, vy int, vz int, sdf double, weight double")
    at = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "vx int, vy int, vz int")
    assert rows(joins.voxel_lookup(at, v)) == [(0, 0, 0, 0.5, 2.0), (1, 0, 0, 0.0, 0.0)]


def test_medians_and_chunks(spark):
    d = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)] + [("b", 99.0)], "g string, v double")
    assert rows(aggs.upper_medians(d, ["g"], "v", 0, 50)) == [("a", 3.0), ("b", 0.0)] == rows(aggs.upper_medians(d, ["g"], "v", 0, 50, samples=4))
    t = spark.createDataFrame([("s", float(x)) for x in (0, 1, 2, 9, 10, 30)], "g string, t double")
    assert [r.segment for r in topk.gap_segments(t, ["g"], "t").orderBy("t").collect()] == [0, 0, 0, 1, 1, 2]


def test_histograms(spark):
    h = spark.createDataFrame([(1, i, 10.0 if i == 0 else 9.0 if i == 18 else 0.0) for i in range(36)], "k int, bin int, v double")
    smooth = topk.circular_smooth(h, ["k"], "bin", "v", 36, 6)
    assert math.isclose(smooth.agg(F.sum("v")).first()[0], 19) and {r.bin for r in topk.histogram_peaks(smooth, ["k"], "bin", "v", 36).collect()} == {0, 18}


def test_voxels(spark):
    o = spark.createDataFrame([(0, 0, 0, 0.1, 1.0, 1, 10.0), (0, 0, 0, 0.3, 3.0, 2, 20.0), (9, 0, 0, 0.2, 1.0, 1, 5.0), (9, 0, 0, 0.2, -1.0, 2, 5.0)], "vx int, vy int, vz int, sdf double, weight double, frame_index int, r double")
    assert [tuple(map(lambda x: round(x, 9), r)) for r in rows(fusion.merge(o))] == [(0, 0, 0, 0.25, 4.0)]
    assert math.isclose(fusion.colour_average(o, channels=("r",)).where("vx = 0").first().r, 0.8 * 10 + 0.2 * 20)
    assert fusion.merge(o, most=3).first().weight == 3
    v = fusion.with_block(spark.createDataFrame([(0, 0, 0, 0.0), (8, 0, 0, 1.0)], "vx int, vy int, vz int, weight double"))
    assert [r.vx for r in fusion.collect_garbage(v).collect()] == [8]


def sphere(spark, n=10, radius=6.3):
    cells = [(x, y, z, (math.sqrt(x * x + y * y + z * z) - radius) * 0.01, 1.0) for x in range(-n, n + 1) for y in range(-n, n + 1) for z in range(-n, n + 1)]
    return spark.createDataFrame(cells, "vx long, vy long, vz long, sdf double, weight double")


def test_surface(spark):
    t = fusion.isosurface(sphere(spark))
    got = np.array([r.v for r in t.collect()]).reshape(-1, 3, 3)
    assert np.abs(np.linalg.norm(got.reshape(-1, 3), axis=1) - 0.063).max() < 0.001
    area = np.linalg.norm(np.cross(got[:, 1] - got[:, 0], got[:, 2] - got[:, 0]), axis=1).sum() / 2
    assert abs(area / (4 * math.pi * 0.063**2) - 1) < 0.05
    vertices, faces = fusion.mesh(t)
    assert faces.count() * 3 == vertices.count() == vertices.select("vertex_id").distinct().count()
    rays = spark.createDataFrame([(1, [0.001, 0.002, -0.3], [0.0, 0.0, 1.0]), (2, [0.2, 0.0, -0.3], [0.0, 0.0, 1.0])], "ray_id int, origin array<double>, direction array<double>")
    hit = fusion.raycast(sphere(spark), rays).collect()
    assert [r.ray_id for r in hit] == [1] and abs(hit[0].depth - (0.3 - math.sqrt(0.063**2 - 5e-6))) < 0.002
    assert math.isclose(fusion.bisection_root(lambda x: 1 - x * x, 0, 2, 40), 1, abs_tol=1e-6)


def test_allocate_and_observe(spark):
    rays = spark.createDataFrame([([0.0, 0.0, 0.0], [0.0, 0.0, 1.0], 1.0), ([0.0, 0.0, 0.0], [0.0, 0.0, 1.0], 5.0)], "origin array<double>, direction array<double>, depth double")
    blocks = fusion.allocate(rays)
    assert {(r.bx, r.by) for r in blocks.collect()} == {(0, 0)} and [r[0] for r in rows(blocks.select("bz"))] == list(range(11, 14))
    depth = spark.createDataFrame([(7, x, y, 1.0, 1, 2, 3) for x in range(16) for y in range(16)], "frame_index long, x int, y int, depth double, r int, g int, b int")
    view = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0]
    seen = fusion.observe(blocks, depth, view, (100.0, 100.0, 0.0, 0.0))
    assert seen.count() > 100 and seen.where("abs(sdf - least(0.08, 1 - vz * 0.01)) > 1e-9").isEmpty()
    assert fusion.splat(blocks, view, (100.0, 100.0, 0.0, 0.0), 64, 64).where("near > far").isEmpty()


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.random()) for _ in range(m)]


def test_components_and_forests(spark):
    edges = [e for e in random_graph(60, 45, 3) if e[0] != e[1]]
    frame = spark.createDataFrame(edges, "src long, dst long, cost double")
    label = {i: i for e in edges for i in e[:2]}
    for _ in label:
        for a, b, _ in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(rows(graph.components(frame))) == label
    found = graph.minimum_forest(frame).collect()
    tree = {i: i for i in label}

    def top(i):
        return i if tree[i] == i else top(tree[i])

    total = 0.0
    for a, b, c in sorted(edges, key=lambda e: e[2]):
        if top(a) != top(b):
            tree[top(a)] = top(b)
            total += c
    assert math.isclose(sum(r.cost for r in found), total) and len(found) == len(label) - len(set(label.values()))
    depth = {r.node: r.path_len for r in graph.path_lengths(frame, graph.components(frame)).collect()}
    assert set(depth) == set(label) and all(abs(depth[a] - depth[b]) <= 1 for a, b, _ in edges)


def test_incremental_forest(spark):
    f = graph.Forest()
    for es in ([], [(0, 5.0)], [], [(2, 1.0)], [(1, 2.0), (3, 9.0)], [(0, 1.0), (1, 1.0)]):
        f.add(es)
    assert f.root == [0] * 6 and f.parent[0] == -1 and f.path(2) == [2, 3, 4, 1, 5, 0] and f.depth[2] == 5
    rng = random.Random(4)
    for _ in range(30):
        f = graph.Forest()
        for i in range(25):
            f.add([(j, rng.random()) for j in rng.sample(range(i), min(i, rng.randint(0, 3)))])
        assert sum(p == -1 for p in f.parent) == len(set(f.root)) and all(f.path(i)[-1] == f.root[i] and f.depth[i] == len(f.path(i)) - 1 for i in range(25))
        f.reroot()
        assert all(f.path(i)[-1] == f.root[i] for i in range(25))
    nodes = spark.createDataFrame([("s", i) for i in range(4)], "seq string, node_index long")
    e = spark.createDataFrame([("s", 1, 0, 1.0), ("s", 3, 2, 1.0), ("s", 3, 1, 2.0)], "seq string, src long, dst long, cost double")
    got = {r.node_index: (r.parent, r.root) for r in graph.spanning_forest(e, ["seq"], nodes).collect()}
    assert got == {0: (None, 0), 1: (0, 0), 2: (3, 0), 3: (1, 0)}


def test_poses_along_a_forest(spark):
    forest = spark.createDataFrame([(0, None), (1, 0), (2, 1)], "node long, parent long")
    q = F.array(*map(F.lit, (0.0, 0.0, math.sqrt(0.5), math.sqrt(0.5))))
    e = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long").withColumn("transform", V.pose(q, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))))
    got = {r.node: r.pose.t for r in graph.propagate_poses(forest, e).collect()}
    assert np.allclose(got[2], [1, 1, 0]) and got[0] == [0, 0, 0]


def test_visual_index(spark):
    empty = spark.createDataFrame([], "image long, cx long, cy long, cz long")
    at = spark.createDataFrame([(1, [0.1, -0.1, 5.0]), (2, None)], "image long, position array<double>")
    index = graph.index_add(empty, at)
    assert rows(graph.lost_images(index)) == [(2,)]
    now = graph.index_locate(index, spark.createDataFrame([(2, [0.0, 0.0, 4.5]), (1, [9.0, 9.0, 9.0])], "image long, position array<double>"))
    assert rows(now) == [(1, 0, -1, 2), (2, 0, 0, 2)]
    probe = joins.cell_probe(spark.createDataFrame([(0.0, 0.0, 4.1)], "x double, y double, z double"), now, 2.0)
    assert {r.image for r in probe.collect()} == {1, 2}


def test_consistent_groups(spark):
    steps = [(s, 0, m) for s in range(5) for m in (s, s + 1)] + [(4, 1, 77)]
    g = spark.createDataFrame(steps, "step int, candidate int, member int")
    got = graph.consistent_groups(g.select("step", "candidate").distinct(), g, least=3)
    assert sorted((r.step, r.candidate) for r in got.collect()) == [(3, 0), (4, 0)]


def pose_case(seed, n=40, outliers=0.3, noise=0.0):
    rng = np.random.default_rng(seed)
    r, t, k = S.exp_so3(rng.normal(size=3) * 0.3), rng.normal(size=3) * 0.2, (500.0, 500.0, 320.0, 240.0)
    p = rng.uniform([-1, -1, 2], [1, 1, 5], (n, 3))
    uv = S.project(r, t, p, k) + rng.normal(size=(n, 2)) * noise
    bad = rng.permutation(n)[: int(outliers * n)]
    uv[bad] += rng.uniform(40, 200, (len(bad), 2))
    return r, t, p, uv, k, set(range(n)) - set(bad.tolist())


def test_pnp(spark):
    cases = [pose_case(s, noise=0.2) for s in range(4)]
    data = [(g, i, *map(float, p), *map(float, w)) for g, c in enumerate(cases) for i, (p, w) in enumerate(zip(c[2], c[3]))]
    m = spark.createDataFrame(data + [(9, 0, 0.0, 0.0, 1.0, 0.0, 0.0)], "pair int, match int, x double, y double, z double, u double, v double")
    found = estimate.pnp(m, ["pair"], cases[0][4], refine=True)
    got = {r.pair: r for r in found.collect()}
    assert not got[9].success
    for g, (r, t, _, _, _, inliers) in enumerate(cases):
        assert got[g].success and set(got[g].inliers) >= inliers - {-1} and np.allclose(S.rotation(np.array(got[g].q)), r.T, atol=0.01) and np.allclose(got[g].t, -r.T @ t, atol=0.02)
    again = estimate.refine(m, ["pair"], found.where("success"), cases[0][4], rounds=3)
    for r in again.collect():
        assert np.allclose(r.t, -cases[r.pair][0].T @ cases[r.pair][1], atol=0.02)


def test_epnp():
    good = 0
    for s in range(20):
        _, _, p, uv, k, _ = pose_case(s, 4, 0)
        good += S.pixel_error(S.epnp(p, uv, k), p, uv, k).max() < 1
        r, t, p, uv, k, _ = pose_case(s, 8, 0)
        found = S.epnp(p, uv, k)
        assert np.allclose(found[0], r, atol=1e-3) and np.allclose(found[1], t, atol=1e-2)
    assert good >= 16  # four points may have other minima


def test_adaptive_ransac():
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 10, 200)
    y = 2 * x + 1 + rng.normal(size=200) * 0.0001
    y[:40] += 5
    r = S.adaptive_ransac(x, y, 2, S.line_fit, S.line_residuals, S.RansacConfig(max_residual=3.0, upper_bound=1.0))
    assert r.success and abs(r.ratio - 0.8) < 0.02 and abs(r.model[0] - 2) < 0.01


def test_alignment_and_metrics(spark):
    rng = np.random.default_rng(8)
    r, t = S.exp_so3(np.array([0.2, 0.5, -0.1])), np.array([1.0, -2.0, 0.5])
    model = rng.normal(size=(50, 3))
    truth = model @ r.T + t
    est = [(i * 1.0 + 0.004, *map(float, m)) for i, m in enumerate(model)] + [(1e6, 0.0, 0.0, 0.0)]
    gt = [(i * 1.0, *map(float, m)) for i, m in enumerate(truth)]
    names = "stamp double, tx double, ty double, tz double"
    pairs, metrics = registration.evaluate_trajectory(spark.createDataFrame(gt, names), spark.createDataFrame(est, names))
    m = metrics.first()
    assert m.pairs == 50 and m.rmse < 1e-9 and pairs.count() == 50
    with pytest.raises(ValueError):
        registration.evaluate_trajectory(spark.createDataFrame(gt, names), spark.createDataFrame(est[-1:], names))
    poses = spark.createDataFrame([("a", S.quaternion(S.exp_so3(np.array([0, 0, a]))).tolist(), [a, 0.0, 0.0]) for a in (0.1, 0.3)], "g string, q array<double>, t array<double>")
    mean = estimate.average_poses(poses.select("g", F.struct("q", "t").alias("pose")), ["g"]).first()
    assert np.allclose(S.rotation(np.array(mean.q)), S.exp_so3(np.array([0, 0, 0.2]))) and math.isclose(mean.t[0], 0.2)


def test_pose_graph_closes_a_loop(spark):
    rng = np.random.default_rng(9)
    true = [(S.exp_so3(np.array([0, 0, i * math.pi / 3])), np.array([math.cos(i), math.sin(i), 0.1 * i])) for i in range(6)]
    e = []
    for i, j in [(i, i + 1) for i in range(5)] + [(0, 5), (1, 4)]:
        (ri, ti), (rj, tj) = true[i], true[j]
        e.append(("c", i, j, S.quaternion(ri.T @ rj).tolist(), (ri.T @ (tj - ti) + rng.normal(size=3) * 0.001).tolist()))
    got = {r.node: np.array(r.t) for r in estimate.pose_graph(spark.createDataFrame(e, "c string, src long, dst long, q array<double>, t array<double>"), ["c"]).collect()}
    r0, t0 = true[0]
    for i, (_, t) in enumerate(true):
        assert np.allclose(got[i], r0.T @ (t - t0), atol=0.01)


def test_icp(spark):
    rng = np.random.default_rng(10)
    r, t = S.exp_so3(np.array([0.01, -0.02, 0.03])), np.array([0.01, 0.02, -0.01])
    p = rng.normal(size=(60, 3))
    q = p @ r.T + t
    n = rng.normal(size=(60, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    pairs = spark.createDataFrame([("g", *map(float, a), *map(float, b)) for a, b in zip(p, q)], "g string, px double, py double, pz double, qx double, qy double, qz double")
    assert np.allclose(estimate.icp(pairs, ["g"]).first().t, t)
    rows_ = spark.createDataFrame([("g", a.tolist(), b.tolist(), c.tolist()) for a, b, c in zip(p, q, n)], "g string, p array<double>, q array<double>, n array<double>")
    twist = estimate.icp_plane(rows_, ["g"]).first().twist
    assert np.allclose(twist, [0.01, -0.02, 0.03, *t], atol=2e-3)


def test_normal_equations(spark):
    r, t, p, uv, k, _ = pose_case(3, 30, 0)
    c = p @ r.T + t
    d = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(c, uv + 0.5)], "x double, y double, z double, u double, v double")
    terms = aggs.reprojection_terms(*[F.col(n) for n in "xyzuv"], *k)
    got = aggs.normal_equations(d.withColumns(terms), []).first()
    step = np.linalg.solve(np.array(got.h).reshape(6, 6), -np.array(got.b))
    moved = S.project(S.exp_so3(step[3:]), step[:3], c, k)
    assert np.abs(moved - uv - 0.5).mean() < 0.2 and got.cost > 0


def plane(spark):
    return spark.createDataFrame([(1, x, y, 1.0 + 0.1 * x, (7 * x + 13 * y) % 64, 0, 0) for x in range(12) for y in range(10)], "frame_index long, x int, y int, depth double, r int, g int, b int")


def test_images(spark):
    cloud = images.point_cloud(plane(spark), 100.0, 100.0, 6.0, 5.0)
    n = [r.n for r in cloud.where("x < 11 AND y < 9").collect()]
    assert cloud.where("x = 11").select("n").first().n == [0, 0, 0] and all(math.isclose(np.linalg.norm(v), 1) for v in n)
    smooth = images.bilateral(plane(spark), radius=2)
    assert smooth.count() == 120 and images.halve(plane(spark)).count() == 30 and images.pyramid_down(plane(spark)).count() == 30
    stack = spark.createDataFrame([(0, 0, d) for d in (1.0, 2.0, 3.0, 4.0)], "x int, y int, depth double")
    assert images.temporal_median(stack, 0, 10).first().depth == 3
    assert images.convert_depth(plane(spark), 2.0, 0, 3).where("depth IS NULL").count() > 0


def test_dense_match(spark):
    rng = random.Random(11)
    left = [(x, y, rng.randint(0, 255), [0.0, 0.0, 1.0]) for x in range(14) for y in range(14)]
    names = "x int, y int, luma int, n array<double>"
    one, two = spark.createDataFrame(left, names), spark.createDataFrame([(x + 1, y, v, n) for x, y, v, n in left], names)
    warp = spark.createDataFrame([(x, y, x, y) for x, y, _, _ in left], "x int, y int, wx int, wy int")
    there = images.dense_match(one, two, warp, neigh=1, radius=2)
    back = images.dense_match(two, one, spark.createDataFrame([(x + 1, y, x + 1, y) for x, y, _, _ in left], "x int, y int, wx int, wy int"), neigh=1, radius=2)
    both = images.cross_check(there, back)
    assert both.where("rx = x + 1 AND ry = y").count() > 150 and images.best_per_tile(both, 7).count() == 4


def test_features(spark):
    v = F.array(*map(F.lit, (1.0, 3.0, 0.0)))
    q = spark.range(1).select(features.l1_root(v).alias("a"), features.l2_unit(v).alias("b")).first()
    assert q.a == [255, 255, 0] and q.b == [162, 255, 0]
    img = np.zeros((64, 64))
    yy, xx = np.mgrid[:64, :64]
    for y, x in ((20, 22), (40, 44)):
        img += np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * 3.0**2))
    grey = (img / img.max() * 255).astype(np.uint8)
    frame = spark.createDataFrame([(5, 64, 64, bytearray(grey.tobytes()))], "frame_index long, height int, width int, grey binary")
    k = features.extract(frame).collect()
    assert {(round(r.x), round(r.y)) for r in k} >= {(22, 20), (44, 40)} and all(len(r.descriptor) == 128 for r in k)
    assert np.isclose(features.gaussian_kernel(1.6).sum(), 1) and features.upsample(np.ones((3, 4))).shape == (6, 8)
    w = features.assign_words(spark.createDataFrame([(1, [0.0, 0.9]), (2, [5.0, 5.0])], "i int, descriptor array<double>"), np.array([[0.0, 1.0], [4.0, 4.0]]))
    assert rows(w.select("i", "word")) == [(1, 0), (2, 1)]


def test_pair_edges(spark):
    rng = np.random.default_rng(12)
    r, t, p, _, k, _ = pose_case(12, 60, 0)
    vec = rng.normal(size=(60, 16))
    vec /= np.linalg.norm(vec, axis=1)[:, None]
    c = p @ r.T + t
    a, b = S.project(np.eye(3), np.zeros(3), p, k), S.project(r, t, p, k)
    one = spark.createDataFrame([(0, 1, i, *map(float, a[i]), float(p[i, 2]), vec[i].tolist()) for i in range(60)], "src long, dst long, l_id long, l_x double, l_y double, l_depth double, l_vec array<double>")
    two = spark.createDataFrame([(0, 1, i, *map(float, b[i]), float(c[i, 2]), vec[i].tolist()) for i in range(60)], "src long, dst long, r_id long, r_x double, r_y double, r_depth double, r_vec array<double>")
    e = registration.pair_edges(one, two, k, (-1e4, 1e4, -1e4, 1e4)).first()
    assert e.n == 60 and np.allclose(e.t, -r.T @ t, atol=1e-3)
    edges = spark.createDataFrame([(7, 0, 1, e.q, e.t, 0.1)], "chunk long, src long, dst long, q array<double>, t array<double>, cost double")
    nodes = spark.createDataFrame([(7, 0), (7, 1), (7, 2)], "chunk long, node long")
    assert {(x.node, x.visible) for x in registration.merge_chunk(edges, nodes).collect()} == {(0, True), (1, True), (2, False)}
