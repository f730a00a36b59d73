"""Readers and writers on small files, and the chunker as a batch and as a stream."""

import pytest
from pyspark.sql import functions as F

from tessara.sources import frames, text
from tessara.streaming import chunker


@pytest.fixture
def put(tmp_path):
    def write(name, body):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
        return str(p)

    return write


def test_stamped(spark, put):
    p = put("t.txt", "# stamp tx\n1.0,1 2 3 0 0 0 1\n2.0\t4 5 6 0 0 0 1\n3\n1.0 9 9 9 0 0 0 1\n")
    got = {r.stamp: (r.tx, r.qw) for r in text.trajectory(spark, p).collect()}
    assert got == {1.0: (9.0, 1.0), 2.0: (4.0, 1.0)}


def test_associated_list(spark, put):
    p = put("rgbd_freiburg1_desk/associate.txt", "0.1 rgb/a.png 0.11 depth/a.png\n0.2 rgb/b.png 0.21 depth/b.png\nbad\n0.3 rgb/c.png 0.31 depth/c.png\n")
    got = frames.associated_list(spark, p).orderBy("frame_index").collect()
    assert [r.stamp for r in got] == [0.1, 0.2] and got[0].camera == "freiburg1" and got[0].max_depth == 25000 and got[0].rgb_path.endswith("/rgb/a.png")
    assert frames.camera_presets(spark).count() == 4
    c = put("calibration.txt", "500 501 320 240\n")
    f, cam = frames.calibrated_list(spark, p, c, 640, 480)
    assert cam.first().fy == 501 and f.first().max_depth == 15000


def test_keyed_recording(spark, put):
    p = put("info.txt", "m_depthWidth = 640\nm_depthHeight = 480\nm_depthShift = 1000\nm_calibrationColorIntrinsic = 583 0 320 0 0 584 240 0\nm_frames.size = 3\n")
    f, cam = frames.keyed_recording(spark, p)
    assert [r.rgb_path for r in f.orderBy("frame_index").collect()] == [f"frame-00000{i}.color.jpg" for i in range(3)]
    r = cam.first()
    assert (r.fx, r.fy, r.cx, r.cy, r.width, r.depth_scale) == (583, 584, 320, 240, 640, 0.001)


def test_frame_list_and_registry(spark, put, tmp_path):
    block = "- frameId: {}\n  camera: {}\n  rgbImage: r{}.png\n  depthImage: d{}.png\n  minDepth: 0.5\n  maxDepth: 3\n"
    p = put("frames_0.yaml", "".join(block.format(i, c, i, i) for i, c in ((0, "a"), (1, "b"), (2, "a"), (3, "zz"))))
    cams = spark.createDataFrame([("a", 1), ("b", 2)], "ser_num string, width int")
    known, lost = frames.frame_list(spark, p, cams)
    assert [r.camera for r in lost.collect()] == ["zz"] and frames.frame_at(known, "a", 1).first().frameId == 2
    assert {r.camera: r.frames for r in frames.frame_counts(known).collect()} == {"a": 2, "b": 1} and frames.every_camera(known, 0).count() == 2
    assert frames.add_cameras(cams, spark.createDataFrame([("b", 9), ("c", 3)], "ser_num string, width int")).count() == 3
    assert frames.delete_camera(cams, "a").count() == 1
    frames.write_frames(known, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert frames.routed(known.withColumn("camera_pos", F.lit(5)), 3).first().pipe == 2


def test_ply_and_estimates(spark, tmp_path):
    pts = spark.createDataFrame([(i, float(i), 0.0, 1.0, 1, 2, 3) for i in range(5)], "i int, x double, y double, z double, r int, g int, b int")
    faces = spark.createDataFrame([(0, 1, 2)], "a long, b long, c long")
    text.write_ply(pts, str(tmp_path / "m"), ["i"], faces)
    p, f = text.read_ply(spark, str(tmp_path / "m"))
    assert p.count() == 5 and [tuple(r) for r in f.collect()] == [(0, 1, 2)]
    rows = [(i, i // 2, i != 1, *[0.0] * 6, 1.0) for i in range(4)]
    est = spark.createDataFrame(rows, "frame_index long, cluster long, visible boolean, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    truth = spark.createDataFrame([(i, 10.0 + i) for i in range(9)], "pos long, stamp double")
    text.write_estimates(est, truth, str(tmp_path / "e"))
    mapping = sorted(r.value for r in spark.read.text(str(tmp_path / "e/mapping")).collect())
    assert mapping == ["10.0 0", "12.0 2", "13.0 3"] and spark.read.text(str(tmp_path / "e/keyframe")).count() == 2


def fold(links, size, linked):
    out, chunk, first, total = [], 0, None, 0
    for i, n in links:
        first = i if first is None else first
        total += n
        span = i - first + 1
        end = span >= 2 * size or (span >= size and total > linked)
        out.append((i, chunk, end))
        if end:
            chunk, first, total = chunk + 1, None, 0
    return out


def test_chunker(spark, tmp_path):
    rows = [("s", i, 0 if i % 7 == 3 else 60 if i < 40 else 5) for i in range(100)]
    raw = spark.createDataFrame(rows, "sequence string, frame_id long, n_keypoints long")
    f = chunker.indexed(raw).withColumn("links", F.col("n_keypoints"))
    got = [(r.frame_index, r.chunk, r.closed) for r in chunker.chunks(f, 10, 300).orderBy("frame_index").collect()]
    want = fold([(i, n) for _, i, n in rows if n], 10, 300)
    want[-1] = (*want[-1][:2], True)
    assert got == want
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "in")
    for lo in (0, 30, 60):
        f.where((F.col("frame_index") >= lo) & (F.col("frame_index") < (lo + 30 if lo < 60 else 100))).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = chunker.chunk_stream(stream, 10, 300).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.frame_index, r.chunk) for r in spark.sql("SELECT * FROM chunks ORDER BY frame_index").collect()] == [x[:2] for x in got]
    assert [(r.frame_index, r.chunk, r.closed) for r in chunker.flushed(spark.table("chunks")).orderBy("frame_index").collect()] == got
