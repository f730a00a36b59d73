"""Line-based sources and sinks, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, line of each file, whole files as rows: these lists are small by their nature (a line per frame of a
    recording), and many recordings are many rows."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\r?\n").alias("ls"))
    return files.select("path", F.posexplode("ls").alias("pos", "line"))


def fields(line: Column) -> Column:
    """Parts between spaces, tabs and commas."""
    return F.filter(F.split(line, r"[\s,]+"), lambda x: x != "")


def stamped(spark: SparkSession, path: str) -> DataFrame:
    """stamp, values of lines of a stamp and more: comments (#) and lines of under two parts are dropped; of several lines
    with a stamp the last stays."""
    rows = lines(spark, path).where(~F.col("line").startswith("#")).select("path", "pos", fields(F.col("line")).alias("f")).where(F.size("f") > 1)
    rows = rows.select("path", "pos", F.col("f")[0].cast("double").alias("stamp"), F.slice("f", 2, 1 << 20).alias("values"))
    return rows.groupBy("stamp").agg(F.max_by("values", F.struct("path", "pos")).alias("values"))


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """stamp, tx, ty, tz, qx, qy, qz, qw."""
    names = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
    return stamped(spark, path).select("stamp", *[F.get("values", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])


def until_first_bad(rows: DataFrame, good: Column) -> DataFrame:
    """Rows of each file before its first bad one."""
    marked = rows.withColumn("__good", good)
    first = marked.where(~F.col("__good")).groupBy("path").agg(F.min("pos").alias("__stop"))
    return marked.join(first, "path", "left").where(F.col("__stop").isNull() | (F.col("pos") < F.col("__stop"))).drop("__good", "__stop")


def write_lines(df: DataFrame, line: Column, order: list[str], path: str) -> None:
    """Text lines in order. The rows are sorted by range, so the files, in order of their names, hold the lines in order."""
    df.orderBy(*order).select(line.alias("value")).write.text(path)


def trajectory_line(prefix: str = "") -> Column:
    return F.concat_ws(" ", *[F.col(prefix + c).cast("string") for c in ("stamp", "tx", "ty", "tz", "qx", "qy", "qz", "qw")])


def write_ply(points: DataFrame, path: str, order: list[str], faces: DataFrame | None = None) -> None:
    """A PLY file's parts under path: header, then points (x, y, z, r, g, b), then faces (a, b, c)."""
    spark = points.sparkSession
    head = ["ply", "format ascii 1.0", f"element vertex {points.count()}", *[f"property float {c}" for c in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue")]]
    if faces is not None:
        head += [f"element face {faces.count()}", "property list uchar int vertex_indices"]
    spark.createDataFrame([("\n".join([*head, "end_header"]),)], "value string").coalesce(1).write.text(f"{path}/part0_header")
    write_lines(points, F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x", "y", "z", "r", "g", "b")]), order, f"{path}/part1_vertices")
    if faces is not None:
        write_lines(faces, F.concat_ws(" ", F.lit("3"), *[F.col(c).cast("string") for c in "abc"]), ["a"], f"{path}/part2_faces")


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points (x, y, z, r, g, b) and faces (a, b, c) of what write_ply() wrote."""
    v = spark.read.text(f"{path}/part1_vertices").select(F.split("value", " ").alias("f"))
    points = v.select(*[F.col("f")[i].cast("double").alias(c) for i, c in enumerate("xyz")], *[F.get("f", F.lit(3 + i)).cast("int").alias(c) for i, c in enumerate("rgb")])
    if "element face" not in spark.read.text(f"{path}/part0_header", wholetext=True).first()[0]:
        return points, spark.createDataFrame([], "a long, b long, c long")
    f = spark.read.text(f"{path}/part2_faces").select(F.split("value", " ").alias("f"))
    return points, f.select(*[F.col("f")[1 + i].cast("long").alias(c) for i, c in enumerate("abc")])


def write_estimates(frames: DataFrame, truth: DataFrame, path: str) -> None:
    """Three files of a reconstruction: estimate, keyframe (first frame of each cluster) and mapping (stamp to index).

    frames: frame_index, cluster, visible, tx .. qw; truth: pos, stamp. The k-th line of truth belongs to the k-th frame,
    visible or not; only visible frames are written."""
    placed = frames.withColumn("pos", F.row_number().over(Window.orderBy("frame_index")) - 1).join(truth.select("pos", "stamp"), "pos")
    seen = placed.where("visible")
    first = F.row_number().over(Window.partitionBy("cluster").orderBy("frame_index")) == 1
    write_lines(seen, trajectory_line(), ["frame_index"], f"{path}/estimate")
    write_lines(placed.withColumn("__first", first).where("__first AND visible"), trajectory_line(), ["frame_index"], f"{path}/keyframe")
    write_lines(seen, F.concat_ws(" ", F.col("stamp").cast("string"), F.col("frame_index").cast("string")), ["frame_index"], f"{path}/mapping")
