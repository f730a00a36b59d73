"""Column functions on literal values."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessara.config import EngineConfig
from tessara.functions import camera as C
from tessara.functions import numbers as N
from tessara.functions import strings as T
from tessara.functions import vectors as V
from tessara.operators import solvers as S
from tessara.sources import frames as sources


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def array(*xs):
    return F.array(*map(F.lit, map(float, xs)))


def test_strings(spark):
    assert value(spark, T.split(F.lit("a,b c,,d"), ",")) == ["a", "b", "c", "d"]
    assert value(spark, T.to_ints(F.lit("1,x,3"))) == [1, None, 3]
    assert [value(spark, T.has_text(F.lit(s).cast("string"))) for s in (" \t", " a", None)] == [False, True, False]
    assert value(spark, T.join(F.array(F.lit("a"), F.lit("b")), "/")) == "a/b" and value(spark, T.to_number(F.lit(" 1.5 "))) == 1.5


def test_numbers(spark):
    xs = array(3, 1, 10, 2)
    assert value(spark, N.median(xs)) == 2.5 and value(spark, N.upper_median(xs)) == 3 and value(spark, N.mean(xs)) == 4
    assert math.isclose(value(spark, N.variance(xs)), np.var([3, 1, 10, 2], ddof=1)) and value(spark, N.percentile(xs, 50)) == 3
    assert value(spark, N.n_choose_k(F.lit(6), 3)) == 20 and N.n_choose_k_value(6, 7) == 0
    assert value(spark, N.scale_sigmoid(F.lit(10.0))) == 1 and value(spark, N.scale_sigmoid(F.lit(-10.0))) == 0
    assert value(spark, N.huber_cost(F.lit(1.0))) == 0.5 and math.isclose(value(spark, N.huber_weight(F.lit(2.4))), 0.5)
    assert value(spark, N.any_less(xs, 1.5)) and not value(spark, N.any_greater(xs, 10))
    assert value(spark, N.luma(F.lit(255), F.lit(255), F.lit(255))) == 255 and value(spark, N.truncate_cast(F.lit(-3.7), 0, 255)) == 0
    assert N.combinations(spark.range(4).toDF("v"), "v", 2).count() == 6


def test_vectors(spark):
    assert value(spark, V.cross(array(1, 0, 0), array(0, 1, 0))) == [0, 0, 1]
    assert value(spark, V.reflect(array(1, -1, 0), array(0, 1, 0))) == [1, 1, 0]
    rng = np.random.default_rng(1)
    m = rng.normal(size=(3, 3))
    assert np.allclose(value(spark, V.inverse3(array(*m.ravel()))), np.linalg.inv(m).ravel())
    assert np.allclose(value(spark, V.det3(array(*m.ravel()))), np.linalg.det(m))
    for w in ([0.1, -0.4, 0.3], [3.0, 0.2, 0.1], [0, 0, 3.1], [0, 3.1, 0.05]):
        r = S.exp_so3(np.array(w))
        q = value(spark, V.matrix_to_quaternion(array(*r.ravel())))
        assert np.allclose(S.rotation(np.array(q)), r) and np.allclose(value(spark, V.quaternion_to_matrix(array(*q))), r.ravel())
        assert value(spark, V.is_rotation(array(*r.ravel())))
        a = V.pose(array(*q), array(1, 2, 3))
        assert np.allclose(value(spark, V.transform_point(a, array(4, 5, 6))), r @ [4, 5, 6] + [1, 2, 3])
        assert np.allclose(value(spark, V.compose(a, V.inverse_pose(a)))["t"], 0, atol=1e-12)
        assert np.allclose(value(spark, V.pose_to_matrix(V.matrix_to_pose(V.pose_to_matrix(a)))), value(spark, V.pose_to_matrix(a)))
    assert value(spark, V.rotation_error(array(0, 0, 0, 1), array(0, 0, 0, -1))) == 0


def test_camera(spark):
    k = (500.0, 510.0, 320.0, 240.0)
    p = C.unproject(F.lit(100.0), F.lit(50.0), F.lit(2.0), *k)
    assert np.allclose(value(spark, C.project(p, *k)), [100, 50])
    lens = array(0.2624, -0.9531, -0.0054, 0.0026, 1.1633)
    x, y = F.lit(0.1), F.lit(-0.2)
    dx, dy = C.distort(x, y, lens)
    back = C.undistort(dx * k[0] + k[2], dy * k[1] + k[3], lens, *k, 30)
    assert np.allclose(value(spark, back), [0.1 * k[0] + k[2], -0.2 * k[1] + k[3]], atol=1e-6)
    assert [value(spark, C.voxel_to_block(F.lit(v))) for v in (-1, 0, 7, 8)] == [-1, 0, 0, 1]
    assert [value(spark, C.half_away(F.lit(v))) for v in (0.5, -0.5, 1.4, -1.6)] == [1, -1, 1, -2]
    i = C.local_index(F.lit(9), F.lit(-1), F.lit(2))
    assert value(spark, i) == 2 * 64 + 7 * 8 + 1 and value(spark, C.from_local_index(i)) == (1, 7, 2)
    assert value(spark, C.grid_cell(F.lit(640.0), F.lit(0.0), F.lit(640.0), 64)) is None and value(spark, C.grid_cell(F.lit(14.9), F.lit(0.0), F.lit(640.0), 64)) == 1
    assert 0 <= value(spark, C.spatial_hash(F.lit(-5), F.lit(123456), F.lit(7), 800)) < 800
    assert value(spark, C.in_frustum(array(0, 0, 1), *k, 640, 480, 0.1, 3.0)) and not value(spark, C.in_frustum(array(0, 0, -1), *k, 640, 480, 0.1, 3.0))
    s = C.affine_from_parameters(F.lit(2.0), F.lit(3.0), F.lit(0.3), F.lit(0.1))
    assert math.isclose(value(spark, C.affine_orientation(s["a11"], s["a21"])), 0.3) and math.isclose(value(spark, C.affine_scale_x(s["a11"], s["a21"])), 2)


def test_config_and_settings(spark):
    c = EngineConfig.load("min_matches: 30\nunknown: 1\n# comment\n")
    assert c.min_matches == 30 and EngineConfig.load(c.dump()) == c
    a, b = F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2)), F.create_map(F.lit("y"), F.lit(3))
    assert value(spark, sources.merge_settings(a, b)) == {"x": 1, "y": 3}
