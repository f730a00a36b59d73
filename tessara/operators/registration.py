"""Compositions: pair edges, local chunks, trajectories against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessara.config import EngineConfig
from tessara.functions import vectors as V
from tessara.operators import aggs, estimate, fusion, graph, joins
from tessara.operators import solvers as S
from tessara.operators.sizes import stored

Intrinsics = tuple[float, float, float, float]


def pair_edges(keypoints_x: DataFrame, keypoints_y: DataFrame, intrinsics: Intrinsics, bounds: tuple[float, float, float, float], config: EngineConfig = EngineConfig(), fallback: int = 100) -> DataFrame:
    """Edges of frame pairs: src, dst, q, t (right to left), cost, n.

    keypoints_x, keypoints_y: src, dst, l_id / r_id, l_ / r_ x, y, depth, vec (unit). Matches by nearest neighbours both
    ways, then a robust pose; pairs with fewer than `fallback` inliers are matched again around where the pose puts
    their points and refined in rounds, the others refined on their inliers. Edges must have a cost below the limit.
    Two branches and a union: a pair runs through one of them."""
    by = ["src", "dst"]
    matches, poses = _posed(keypoints_x, keypoints_y, intrinsics, config)
    many, few = poses.where(F.size("inliers") >= fallback), poses.where(F.size("inliers") < fallback)
    place = matches.select(*by, "match", "x", "y", "z", "u", "v")
    ranked = place.join(many.select(*by, F.explode("inliers").alias("match")), [*by, "match"])
    one = estimate.refine(ranked, by, many, intrinsics)
    fx, fy, cx, cy = intrinsics
    depth = F.col("r_depth")
    p = F.array((F.col("r_x") - cx) / fx * depth, (F.col("r_y") - cy) / fy * depth, depth)
    moved = keypoints_y.join(few.select(*by, "q", "t"), by).withColumn("__p", V.transform_point(V.pose(F.col("q"), F.col("t")), p))
    moved = moved.withColumns({"r_x": fx * F.col("__p")[0] / F.col("__p")[2] + cx, "r_y": fy * F.col("__p")[1] / F.col("__p")[2] + cy})
    again = joins.projection_match(keypoints_x.select(*by, "l_id", "l_x", "l_y", "l_vec"), moved.select(*by, "r_id", "r_x", "r_y", "r_vec"), bounds, by=by)
    two = estimate.refine(_with_points(again, keypoints_x, keypoints_y, intrinsics), by, few, intrinsics, rounds=3, keep=config.cost_threshold)
    return aggs.edge_gate(one.unionByName(two).where("success"), config.max_avg_cost).select(*by, "q", "t", "cost", "n")


def _posed(keypoints_x: DataFrame, keypoints_y: DataFrame, intrinsics: Intrinsics, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """Matches of frame pairs by nearest neighbours both ways, and the robust poses that they give."""
    by = ["src", "dst"]
    left = keypoints_x.select(*by, "l_id", "l_vec")
    right = keypoints_y.select(*by, "r_id", "r_vec")
    found = joins.nearest(left, right, by)
    matches = _with_points(found, keypoints_x, keypoints_y, intrinsics)
    ransac = S.RansacConfig(max_residual=config.max_pnp_residual, trials=config.num_of_trials, confidence=config.confidence, trial_factor=config.trial_factor)
    return matches, estimate.pnp(matches, by, intrinsics, ransac, config.min_matches, config.min_inliers, config.min_inlier_ratio).where("success")


def _with_points(found: DataFrame, keypoints_x: DataFrame, keypoints_y: DataFrame, k: Intrinsics) -> DataFrame:
    from tessara.operators.topk import reindexed

    by = ["src", "dst"]
    d = F.col("l_depth")
    left = keypoints_x.select(*by, "l_id", ((F.col("l_x") - k[2]) / k[0] * d).alias("x"), ((F.col("l_y") - k[3]) / k[1] * d).alias("y"), d.alias("z"))
    right = keypoints_y.select(*by, "r_id", F.col("r_x").alias("u"), F.col("r_y").alias("v"))
    return reindexed(found.join(left, [*by, "l_id"]).join(right, [*by, "r_id"]), by, [F.col("l_id"), F.col("r_id")], "match")


def merge_chunk(edges: DataFrame, frames: DataFrame, chunk: str = "chunk") -> DataFrame:
    """chunk, node, pose, visible, path_len of each chunk's frames: the pose graph of its largest component is solved, the
    frames off it are not visible. edges: chunk, src, dst, q, t, cost; frames: chunk, node."""
    named = edges.select(F.struct(chunk, F.col("src").alias("n")).alias("src"), F.struct(chunk, F.col("dst").alias("n")).alias("dst"))
    every = frames.select(F.struct(chunk, F.col("node").alias("n")).alias("node"))
    ids = every.withColumn("id", F.xxhash64("node"))
    hashed = named.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"))
    roots = graph.components(hashed, ids.select(F.col("id").alias("node")))
    labelled = ids.join(roots.select(F.col("node").alias("id"), "root"), "id").select(F.col(f"node.{chunk}").alias(chunk), F.col("node.n").alias("node"), "root")
    sizes = labelled.groupBy(chunk, "root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    main = sizes.groupBy(chunk).agg(F.max_by("root", F.struct("n", -F.col("first"))).alias("root"))
    inside = labelled.join(main, [chunk, "root"])
    solved = estimate.pose_graph(edges.join(inside.select(chunk, F.col("node").alias("src")), [chunk, "src"]), [chunk])
    start = inside.groupBy(chunk).agg(F.min("node").alias("root"))
    names = solved.join(start, chunk).select(chunk, "node", V.pose(F.col("q"), F.col("t")).alias("pose"))
    alone = start.join(names, chunk, "left_anti").select(chunk, F.col("root").alias("node"), V.identity_pose().alias("pose"))
    return frames.select(chunk, "node").join(names.unionByName(alone), [chunk, "node"], "left").withColumn("visible", F.col("pose").isNotNull())


def evaluate_trajectory(truth: DataFrame, found: DataFrame, tolerance: float = 0.02, offset: float = 0.0, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Associates two trajectories (stamp, tx, ty, tz) by time, aligns the found one to the true one and measures it.

    Returns the pairs with the aligned point and its error, and the metrics (one row). Fewer than two pairs fail."""
    a, b = truth.select(F.col("stamp").alias("a")), found.select(F.col("stamp").alias("b"))
    pairs = joins.time_associate(a, b, tolerance, offset)
    one = truth.select(F.col("stamp").alias("a"), *[F.col(f"t{c}").alias(f"g{c}") for c in "xyz"])
    two = found.select(F.col("stamp").alias("b"), *[(F.col(f"t{c}") * scale).alias(f"e{c}") for c in "xyz"])
    both = stored(pairs.join(one, "a").join(two, "b"))
    if both.limit(2).count() < 2:
        raise ValueError("fewer than two stamps match within the tolerance")
    errors = estimate.aligned_errors(both, [], ("ex", "ey", "ez"), ("gx", "gy", "gz"))
    return errors, aggs.ate_metrics(errors, [], stamp="a")


def integrate(pixels: DataFrame, poses: DataFrame, intrinsics: Intrinsics, size: float = 0.01, side: int = 8, base: float = 0.02, scale: float = 0.06, most: float = 3.0) -> DataFrame:
    """Voxels (vx, vy, vz, sdf, weight) that all frames with a pose give. pixels: frame_index (long), x, y, depth, r, g, b;
    poses: frame_index, world (pose, camera to world), sign where a frame is to be taken out again (-1).

    A frame's blocks meet its own pixels only, so the work is that of the frames one by one; observations are added up
    before rows move. A frame without pose is left out, one of unknown index as well."""
    fx, fy, cx, cy = intrinsics
    placed = poses.select("frame_index", "world", (F.col("sign") if "sign" in poses.columns else F.lit(1.0)).cast("double").alias("sign"))
    ray = V.rotate(F.col("world.q"), F.array((F.col("x") - cx) / fx, (F.col("y") - cy) / fy, F.lit(1.0)))
    rays = pixels.join(placed, "frame_index").select("frame_index", F.col("world.t").alias("origin"), ray.alias("direction"), F.col("depth").cast("double").alias("depth"))
    blocks = fusion.allocate(rays, size, side, base, scale, most, frame="frame_index")
    blocks = blocks.join(placed.select("frame_index", "sign", V.projection_rows(V.inverse_pose(F.col("world"))).alias("view")), "frame_index")
    seen = fusion.observe(blocks, pixels, "view", intrinsics, size, side, base, scale, most)
    signed = seen.join(placed.select("frame_index", "sign"), "frame_index").withColumn("weight", F.col("sign"))
    return fusion.merge(signed)


def global_edges(keypoints_x: DataFrame, keypoints_y: DataFrame, weights: DataFrame, intrinsics: Intrinsics, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Edges of frame pairs of different clusters: src, dst, q, t (right to left), cost, n. Keypoints as for pair_edges().

    One branch for all pairs: matches, a robust pose, a refinement on its inliers, the limit of the cost; the cost is then
    times the pair's weight. weights: src, dst, weight (the sum of the path lengths + 1); a pair without one has weight 1."""
    by = ["src", "dst"]
    matches, poses = _posed(keypoints_x, keypoints_y, intrinsics, config)
    place = matches.select(*by, "match", "x", "y", "z", "u", "v")
    refined = estimate.refine(place.join(poses.select(*by, F.explode("inliers").alias("match")), [*by, "match"]), by, poses, intrinsics)
    kept = aggs.edge_gate(refined.where("success"), config.max_avg_cost).join(weights.select(*by, "weight"), by, "left")
    return kept.select(*by, "q", "t", (F.col("cost") * F.coalesce("weight", F.lit(1.0))).alias("cost"), "n")


def merged_cloud(points: DataFrame, frames: DataFrame, nodes: DataFrame) -> DataFrame:
    """points (frame_index, p and more) of frames that have a place, with their node and p in the world. frames:
    frame_index, node, pose; nodes: node, pose."""
    placed = graph.frame_poses(frames, nodes).select("frame_index", "node", "world")
    return points.join(placed, "frame_index").withColumn("p", V.transform_point(F.col("world"), F.col("p"))).drop("world")
