"""Frame sources: list files with presets, key = value recordings, frame lists by camera, and the camera registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessara.sources.text import fields, lines, until_first_bad

#: Intrinsics by a part of the path.
PRESETS = {
    "freiburg0": (481.20, -480.00, 319.50, 239.50, (0.0, 0.0, 0.0, 0.0, 0.0)),
    "freiburg1": (517.3, 516.5, 318.6, 255.3, (0.2624, -0.9531, -0.0054, 0.0026, 1.1633)),
    "freiburg2": (520.9, 521.0, 325.1, 249.7, (0.2312, -0.7849, -0.0033, -0.0001, 0.9172)),
    "freiburg3": (535.4, 539.2, 320.1, 247.6, (0.0, 0.0, 0.0, 0.0, 0.0)),
}
CAMERA = "ser_num string, fx double, fy double, cx double, cy double, width int, height int, depth_scale double, dist_coef array<double>"


def camera_presets(spark: SparkSession) -> DataFrame:
    rows = [(k, fx, fy, cx, cy, 640, 480, 1 / 5000, list(d)) for k, (fx, fy, cx, cy, d) in PRESETS.items()]
    return spark.createDataFrame(rows, CAMERA)


def preset_of(path: Column) -> Column:
    """The preset whose name the path holds, the first in order; null if none."""
    out = F.lit(None).cast("string")
    for name in reversed(PRESETS):
        out = F.when(path.contains(name), F.lit(name)).otherwise(out)
    return out


def associated_list(spark: SparkSession, path: str, low: float = 500, high: float = 25000) -> DataFrame:
    """Frames of list files of `stamp rgb stamp depth` lines; a file ends at its first line that hasn't four parts. Cameras
    by preset; depth bounds in raw units."""
    rows = lines(spark, path).withColumn("f", fields(F.col("line")))
    good = until_first_bad(rows, F.size("f") == 4)
    folder = F.regexp_replace("path", "/[^/]*$", "/")
    return good.select(
        F.col("pos").cast("long").alias("frame_index"), F.col("f")[0].cast("double").alias("stamp"), F.concat(folder, F.col("f")[1]).alias("rgb_path"), F.concat(folder, F.col("f")[3]).alias("depth_path"),
        F.lit(float(low)).alias("min_depth"), F.lit(float(high)).alias("max_depth"), preset_of(F.col("path")).alias("camera"),
    )


def calibrated_list(spark: SparkSession, path: str, calibration: str, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Frames as associated_list() with raw bounds 500 to 15000, and the camera of a `fx fy cx cy` file."""
    f = lines(spark, calibration).where("pos = 0").select(fields(F.col("line")).alias("f"))
    cam = f.select(F.lit("calibrated").alias("ser_num"), *[F.col("f")[i].cast("double").alias(c) for i, c in enumerate(("fx", "fy", "cx", "cy"))], F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(1 / 5000).alias("depth_scale"), F.array(*[F.lit(0.0)] * 5).alias("dist_coef"))
    return associated_list(spark, path, 500, 15000).withColumn("camera", F.lit("calibrated")), cam


def keyed_recording(spark: SparkSession, info: str) -> tuple[DataFrame, DataFrame]:
    """Frames and camera of a `key = value` file: frames are named by number up to m_frames.size; raw bounds 100 to 3000."""
    kv = lines(spark, info).where(F.col("line").contains("=")).select(F.trim(F.split("line", "=", 2)[0]).alias("k"), F.trim(F.split("line", "=", 2)[1]).alias("v"))
    one = kv.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))  # a handful of keys
    frames = one.select(F.explode(F.sequence(F.lit(0), F.col("m")["m_frames.size"].cast("long") - 1)).alias("frame_index"))
    named = frames.select("frame_index", F.format_string("frame-%06d.color.jpg", "frame_index").alias("rgb_path"), F.format_string("frame-%06d.depth.png", "frame_index").alias("depth_path"), F.lit(100.0).alias("min_depth"), F.lit(3000.0).alias("max_depth"), F.lit("recording").alias("camera"))
    k = F.filter(F.split(F.col("m")["m_calibrationColorIntrinsic"], r"\s+"), lambda x: x != "")
    places = (0, 5, 2, 6)
    cam = one.select(F.lit("recording").alias("ser_num"), *[F.get(k, F.lit(i)).cast("double").alias(c) for i, c in zip(places, ("fx", "fy", "cx", "cy"))], F.col("m")["m_depthWidth"].cast("int").alias("width"), F.col("m")["m_depthHeight"].cast("int").alias("height"), (1 / F.col("m")["m_depthShift"].cast("double")).alias("depth_scale"), F.array(*[F.lit(0.0)] * 5).alias("dist_coef"))
    return named, cam


def frame_list(spark: SparkSession, path: str, cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of frame-list files (`- key: value` blocks) with a known camera, numbered by camera; and the rows without one."""
    rows = lines(spark, path).where("trim(line) != ''")
    start = F.sum(F.when(F.col("line").rlike(r"^\s*-\s"), 1).otherwise(0)).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    kv = rows.withColumn("row", start).select("path", "row", F.regexp_extract("line", r"^\s*(?:-\s+)?(\w+)\s*:", 1).alias("k"), F.trim(F.regexp_replace("line", r"^\s*(?:-\s+)?\w+\s*:\s*", "")).alias("v"))
    kinds = {"frameId": "long", "camera": "string", "rgbImage": "string", "depthImage": "string", "minDepth": "double", "maxDepth": "double"}
    wide = kv.where("k != ''").groupBy("path", "row").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).cast(t).alias(k) for k, t in kinds.items()])
    known = wide.join(cameras.select(F.col("ser_num").alias("camera")), "camera", "left_semi")
    order = Window.partitionBy("camera").orderBy("path", "row")
    return known.withColumn("position", F.row_number().over(order) - 1), wide.join(cameras.select(F.col("ser_num").alias("camera")), "camera", "left_anti")


def frame_at(frames: DataFrame, camera: str, position: int) -> DataFrame:
    """By place in the camera's list."""
    return frames.where((F.col("camera") == camera) & (F.col("position") == position))


def every_camera(frames: DataFrame, position: int) -> DataFrame:
    """One frame of each camera."""
    return frames.where(F.col("position") == position)


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("camera").agg(F.count(F.lit(1)).alias("frames"))


def routed(frames: DataFrame, pipes: int) -> DataFrame:
    """Frames with the pipe of their camera, the camera's place mod the number of pipes."""
    return frames.withColumn("pipe", F.pmod(F.col("camera_pos"), F.lit(pipes)))


def add_cameras(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with cameras that it hasn't got; those it has stay."""
    return registry.unionByName(new.dropDuplicates(["ser_num"]).join(registry, "ser_num", "left_anti"))


def delete_camera(registry: DataFrame, ser_num: str) -> DataFrame:
    return registry.where(F.col("ser_num") != ser_num)


def write_frames(frames: DataFrame, path: str) -> None:
    frames.write.partitionBy("camera").parquet(path)


def convert(spark: SparkSession, kind: str, path: str, out: str) -> None:
    """A recording of a kind (list or keyed) as a frames table."""
    frames = associated_list(spark, path) if kind == "list" else keyed_recording(spark, path)[0]
    write_frames(frames, out)


def record(stream: DataFrame, out: str, checkpoint: str):
    """A stream of frames written by camera as it comes."""
    return stream.writeStream.partitionBy("camera").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_settings(*maps: Column) -> Column:
    """Maps in one; of equal keys the last map's value stays."""
    out = maps[0]
    for m in maps[1:]:
        out = _over(out, m)
    return out


def _over(old: Column, new: Column) -> Column:
    keys = F.map_keys(new)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(keys, k)), new)
