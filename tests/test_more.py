"""Further operators on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessara.functions import vectors as V
from tessara.operators import aggs, features, fusion, graph, images, joins, topk
from tessara.plans import catalogue


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ranks(spark):
    rng = random.Random(1)
    data = {g: [float(rng.choice([1, 2, 2, 3, 50, -7, rng.random()])) for _ in range(n)] for g, n in (("a", 1), ("b", 8), ("c", 501))}
    d = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("d", None)], "g string, v double")
    n = F.col("n")
    got = {r.g: (r.lo, r.mid, r.hi) for r in aggs.at_ranks(d, ["g"], "v", {"lo": F.lit(0), "mid": F.floor(n / 2), "hi": n - 1}, buckets=16).collect()}
    assert got == {g: (min(vs), sorted(vs)[len(vs) // 2], max(vs)) for g, vs in data.items()}


def test_places_kept_for_some(spark):
    d = spark.createDataFrame([(1, r, s) for r, s in ((5, 0.9), (6, 0.8), (7, 0.1), (8, 0.7), (9, 0.6))], "q int, ref int, score double")
    last = spark.createDataFrame([(1, 9)], "q int, ref int")
    assert {r.ref for r in topk.first_by_id(d, ["q"], last, 3, 0.25).collect()} == {9, 5, 6}
    v = spark.createDataFrame([(1, 10, 5), (1, 11, 9), (1, 12, 9)], "q int, node int, n int")
    assert [r.node for r in topk.votes_top_k(v, ["q"], F.col("node") == 10, 2).orderBy("rank").collect()] == [10, 11]
    lost = d.withColumn("lost", F.col("ref") == 5)
    assert [r.ref for r in topk.reserved_top_k(lost, ["q"], 3, located=False, has_lost=True).orderBy("rank").collect()] == [6, 8, 5]


def test_matrices(spark):
    d = spark.createDataFrame([("g", [1.0, 2.0, 3.0, 4.0]), ("g", [1.0, 1.0, 1.0, 1.0])], "g string, m array<double>")
    total = aggs.matrix_sum(d, ["g"], "m", 4)
    assert total.first().m == [2, 3, 4, 5]
    r = total.select(aggs.row_sums(F.col("m"), 2, 2).alias("r"), aggs.col_sums(F.col("m"), 2, 2).alias("c")).first()
    assert r.r == [5, 9] and r.c == [6, 8]
    b = spark.createDataFrame([(0, 1, [1.0] * 4), (0, 1, [2.0] * 4)], "i int, j int, values array<double>")
    assert {(x.row, x.col): x.value for x in aggs.scatter_blocks(b, [], 2).collect()} == {(0, 2): 3, (0, 3): 3, (1, 2): 3, (1, 3): 3}
    c = aggs.covariance(spark.createDataFrame([(0.0, 0.0, 0.0), (2.0, 0.0, 4.0)], "x double, y double, z double"), []).first()
    assert c.centroid == [1, 0, 2] and c.scatter[2] == 4


def test_frames_and_keypoints(spark):
    f = spark.createDataFrame([("a", i) for i in range(7)], "camera string, i int")
    w = {r.i: (r.stack, r.middle) for r in images.windows_of_frames(f, "camera", "i", 3).collect()}
    assert w[1] == (0, True) and w[6] == (2, False)
    k = spark.createDataFrame([(1, i, float(i)) for i in range(3)], "frame_index long, kp_index long, x double")
    assert sorted(r.kp_index for r in features.append(k, k).collect()) == list(range(6))
    assert {r.kp_index for r in features.strongest(k, ["frame_index"], F.col("x"), 2).collect()} == {1, 2}
    b = F.struct(F.lit(0.0).alias("min_x"), F.lit(64.0).alias("max_x"), F.lit(0.0).alias("min_y"), F.lit(48.0).alias("max_y"))
    g = features.with_grid(spark.createDataFrame([(0.4, 0.6), (63.6, 1.0), (-0.6, 1.0)], "x double, y double"), b)
    assert rows(g.select("gx", "gy")) == [(0, 1)]


def test_links_of_points(spark):
    m = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 1, 1)], "frame_x int, px int, frame_y int, py int")
    p = spark.createDataFrame([(0, 0, [0.0, 0.0, 1.0]), (0, 1, [0.0, 0.0, 1.0]), (1, 0, [0.0, 0.0, 1.005]), (1, 1, [0.0, 0.0, 2.0])], "frame int, index int, p array<double>")
    assert rows(joins.correspondences(m, p)) == [(0, 0, 1, 0), (1, 0, 0, 0)]
    e = spark.createDataFrame([(0, 1, 0.5)] * 120 + [(0, 2, 0.5)] * 20 + [(0, 3, 9.0)] * 200, "src int, dst int, error double")
    assert rows(graph.densify(e, 1.0)) == [(0, 1, 120)]
    cur = spark.createDataFrame([(0, 0, [0.0, 0.0, 1.0], [0.0, 0.0, 1.0]), (1, 0, [0.5, 0.0, 1.0], [0.0, 0.0, 1.0])], "x int, y int, p array<double>, n array<double>")
    prev = spark.createDataFrame([(5, 5, [0.0, 0.0, 1.01], [0.0, 0.0, 1.0]), (10, 5, [0.5, 0.0, 3.0], [0.0, 0.0, 1.0])], "x int, y int, p array<double>, n array<double>")
    near = joins.projective_association(cur, prev, V.identity_pose(), (10.0, 10.0, 5.0, 5.0), 0.1, 0.3)
    assert [(r.px, r.py) for r in near.collect()] == [(5, 5)]


def test_guides_and_gates(spark):
    one = [F.lit(v) for v in (1.0, 2.0, 1.0, 2.5)]
    eye = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    cross = [0, 0, 0, 0, 0, -1.0, 0, 1.0, 0]  # a sideways step: matches keep their line
    r = spark.range(1).select(joins.homography_guide(eye, 1.0, *one).alias("h"), joins.homography_guide(eye, 0.4, *one).alias("i"), joins.epipolar_guide(cross, 0.2, *one).alias("f"), joins.epipolar_guide(cross, 0.1, *one).alias("g")).first()
    assert tuple(r) == (True, False, True, False)
    e = spark.createDataFrame([(1.0,), (20.0,), (float("nan"),)], "cost double")
    assert rows(aggs.edge_gate(e, 15.0)) == [(1.0,)]


def test_poses_of_edges(spark):
    q = [0.0, 0.0, math.sin(0.2), math.cos(0.2)]
    d = spark.createDataFrame([(0, 1, q, [1.0, 2.0, 3.0], 4.0)], "ref int, cur int, q array<double>, t array<double>, cost double").withColumn("transform", V.pose(F.col("q"), F.col("t")))
    lengths = spark.createDataFrame([(0, 2)], "node int, path_len int")
    e = graph.local_edges(d.select("ref", "cur", "transform", "cost"), lengths).collect()
    assert {(r.src, r.dst, r.cost) for r in e} == {(0, 1, 8.0), (1, 0, 8.0)}
    frames = spark.createDataFrame([(7, 0)], "frame_index int, node int").withColumn("pose", V.identity_pose())
    nodes = d.select(F.lit(0).alias("node"), F.col("transform").alias("pose"))
    assert graph.frame_poses(frames, nodes).first().world.t == [1, 2, 3]


def test_voxel_tables(spark):
    v = "vx long, vy long, vz long, sdf double, weight double, r double, g double, b double"
    a, b = spark.createDataFrame([(0, 0, 0, 0.0, 1.0, 10.0, 0.0, 0.0)], v), spark.createDataFrame([(0, 0, 0, 0.4, 3.0, 20.0, 0.0, 0.0), (1, 0, 0, 0.1, 1.0, 5.0, 0.0, 0.0)], v)
    got = {r.vx: (round(r.sdf, 9), r.weight, r.r) for r in fusion.combine(a, b).collect()}
    assert got == {0: (0.3, 4.0, 15.0), 1: (0.1, 1.0, 5.0)}
    assert rows(fusion.starve(a).select("weight")) == [(0.0,)]
    cube = spark.createDataFrame([(x, y, z, 0.1 * x + 0.2 * y, 1.0) for x in range(4) for y in range(4) for z in range(4)], "vx long, vy long, vz long, sdf double, weight double")
    at = spark.createDataFrame([(1, 1.5, 1.25, 0.5), (2, 3.5, 0.0, 0.0)], "i int, pvx double, pvy double, pvz double")
    assert [(r.i, round(r.sdf, 9)) for r in fusion.interpolate(at, cube, ["i"]).collect()] == [(1, 0.4)]
    g = fusion.gradients(cube).collect()
    assert len(g) == 8 and all(abs(r.gx - 0.1) < 1e-9 and abs(r.gy - 0.2) < 1e-9 and abs(r.gz) < 1e-9 for r in g)


def test_nearest_in_frames_agrees_with_the_plain_form(spark):
    rng = random.Random(2)

    def side(name, n):
        out = []
        for p in ("u", "v"):
            for i in range(n):
                w = [rng.gauss(0, 1) for _ in range(4)]
                s = math.sqrt(sum(x * x for x in w))
                out.append((p, i, [x / s for x in w]))
        return spark.createDataFrame(out, f"pair string, {name}_id long, {name}_vec array<double>")

    left, right = side("l", 20), side("r", 25)
    a = joins.nearest(left, right, ["pair"], ratio=0.9, max_angle=1.0).select("pair", "l_id", "r_id")
    b = joins.nearest(left, right, ["pair"], ratio=0.9, max_angle=1.0, extra=lambda: F.lit(True)).select("pair", "l_id", "r_id")
    assert rows(a) == rows(b) and a.count() > 0


def test_block_by_block_agrees(spark):
    rng = random.Random(3)
    v = {n: [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(n)] for n in (30, 41)}
    left, right = spark.createDataFrame(v[30], "l_id long, l_vec array<double>"), spark.createDataFrame(v[41], "r_id long, r_vec array<double>")
    tops = joins.block_tops(left, right, block=7)
    for side, mine, other in (("l", "l_id", "r_id"), ("r", "r_id", "l_id")):
        got = {r[mine]: (r[other], round(r.second, 9)) for r in topk.best_two(tops.where(F.col("side") == side), [mine], [F.desc("score"), F.col(other)], "score").collect()}
        for i, a in v[30] if side == "l" else v[41]:
            s = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in (v[41] if side == "l" else v[30]))
            assert got[i] == (s[0][1], round(-s[1][0], 9))
    assert joins.nearest(left, right.limit(0)).count() == 0


def test_overlap_at_equal_scores(spark, tmp_path):
    """As its SQL where scores are 0.2 but for rounding, or a text and its neighbours score the same but for rounding."""
    duckdb = pytest.importorskip("duckdb")
    texts, docs = [], []

    def text(shared, rest, times, i):
        words = [f"q{i}w{j}" for j in range(shared)]
        while rest:  # other words, whose squared weights add up to rest
            n = math.isqrt(rest)
            words += [f"q{i}x{len(words)}"] * n
            rest -= n * n
        return " ".join(words * times)

    def case(shared, *parts):
        i = len(texts)
        texts.append((i, text(shared, 0, 1, i)))
        docs.extend((1000 + 10 * i + k, text(shared, *part, i), f"src{i}") for k, part in enumerate(parts))

    for a in (3, 5, 7, 10, 12, 14, 15, 17, 20, 28, 30, 34):
        case(a, (24 * a, 1))
    for a, b, m in ((2, 5, 7), (2, 7, 5), (2, 9, 5), (2, 10, 5), (2, 13, 7), (2, 15, 3)):
        case(a, (b - a, 1), (b - a, m))
        case(a, (b - a, 1), (b, 1), (b - a, m))
        case(a, (b - a, m), (b, 1), (b - a, 1))
    db = duckdb.connect()
    for name, data, schema in (("benchmark", texts, "item_id long, text string"), ("documents", docs, "doc_id long, text string, source string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(db.execute(catalogue.ORACLE_SQL["overlap_covisible"]).fetchall())
    assert rows(catalogue.overlap_covisible(spark, str(tmp_path))) == want and len(want) > 20
