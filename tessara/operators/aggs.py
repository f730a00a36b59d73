"""Aggregates: grid winners, robust statistics, moments, votes, weighted voxel merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessara.functions import numbers as N
from tessara.functions import vectors as V
from tessara.operators import topk


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column], buckets: int = 1024) -> DataFrame:
    """The values at places (from 0) of each group's sorted values, one column for each of `ranks`, which are expressions
    of the group's count n. Nulls aren't counted.

    Equal values become one row with a count. Each group's span is cut into buckets, whose counts are added up in order;
    then only the values of the bucket in which a place falls are put in order. So no task sorts a group."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    span = counted.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.sum("__n").alias("n"))
    part = (F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0)) * buckets
    cut = counted.join(span.drop("n"), by).withColumn("__b", F.coalesce(F.least(F.floor(part), F.lit(buckets - 1)), F.lit(0)))
    per = cut.groupBy(*by, "__b").agg(F.sum("__n").alias("__m"))
    upto = F.sum("__m").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    wanted = span.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("__k"), r.cast("long").alias("__r")) for k, r in ranks.items()])).alias("w")).select(*by, "w.*")
    hit = per.withColumn("__upto", upto).join(wanted, by).where((F.col("__r") < F.col("__upto")) & (F.col("__r") >= F.col("__upto") - F.col("__m")))
    inside = cut.select(*by, "__b", value, "__n").join(hit, [*by, "__b"])
    along = Window.partitionBy(*by, "__k").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("__c", F.col("__upto") - F.col("__m") + F.sum("__n").over(along)).where(F.col("__c") > F.col("__r"))
    return found.groupBy(*by).agg(*[F.min(F.when(F.col("__k") == k, F.col(value))).alias(k) for k in ranks])


def upper_medians(df: DataFrame, by: list[str], value: str, low: float, high: float, into: str = "median", samples: int | None = None) -> DataFrame:
    """The upper median of each group, and 0 where it lies outside [low, high].

    A group may be of any size; `samples`: a proven bound of a group's rows (frames in a stack), for which the group is
    sorted as one array."""
    if samples is not None:
        found = df.groupBy(*by).agg(N.upper_median(F.collect_list(value)).alias("__m"))
    else:
        found = at_ranks(df, by, value, {"__m": F.floor(F.col("n") / 2)})
    inside = F.when(F.col("__m").between(low, high), F.col("__m")).otherwise(F.lit(0.0))
    return found.select(*by, inside.alias(into))


def medians(df: DataFrame, by: list[str], value: str, into: str = "median") -> DataFrame:
    """The median of each group, the mean of the two middle values of an even number. Nulls aren't counted."""
    n = F.col("n")
    middles = at_ranks(df, by, value, {"__m0": F.floor((n - 1) / 2), "__m1": F.floor(n / 2)})
    return middles.select(*by, ((F.col("__m0") + F.col("__m1")) / 2).alias(into))


def grid_argmin(df: DataFrame, by: list[str], x: str, y: str, cost: Column, size_x: float, size_y: float | None = None, tie: str = "id") -> DataFrame:
    """The row of the least cost of each cell of a grid, ties to the smaller `tie`; a partial aggregate."""
    cells = df.withColumns({"gx": F.floor(F.col(x) / size_x), "gy": F.floor(F.col(y) / (size_y or size_x)), "__cost": cost})
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = cells.groupBy(*by, "gx", "gy").agg(F.min_by(row, F.struct("__cost", tie)).alias("r"))
    return best.select(*[c for c in by if c not in df.columns], "gx", "gy", "r.*")


def cell_proportional(df: DataFrame, by: list[str], x: str, y: str, cost: Column, size_x: float, target: int, size_y: float | None = None, tie: str = "id") -> DataFrame:
    """floor(target * rows of the cell / all rows of the group) rows of each cell, the least costs first."""
    cells = df.withColumns({"gx": F.floor(F.col(x) / size_x), "gy": F.floor(F.col(y) / (size_y or size_x)), "__cost": cost})
    own = cells.groupBy(*by, "gx", "gy").agg(F.count(F.lit(1)).alias("__cell"))
    if by:
        whole = own.groupBy(*by).agg(F.sum("__cell").alias("__all"))
        shares = own.join(whole, by)
    else:
        shares = own.crossJoin(F.broadcast(own.agg(F.sum("__cell").alias("__all"))))  # one row
    shares = shares.withColumn("__keep", F.floor(F.lit(target) * F.col("__cell").cast("double") / F.col("__all")))
    ranked = topk.top_k(cells, [*by, "gx", "gy"], [F.col("__cost"), F.col(tie)], target, "__rank")
    return ranked.join(shares, [*by, "gx", "gy"]).where(F.col("__rank") <= F.col("__keep")).drop("__cost", "__rank", "__keep", "__cell", "__all")


def matrix_sum(df: DataFrame, by: list[str], column: str, cells: int) -> DataFrame:
    """Element-wise sum of flat matrices of one shape."""
    sums = [F.sum(F.col(column)[i]) for i in range(cells)]
    return (df.groupBy(*by) if by else df).agg(F.array(*sums).alias(column))


def row_sums(m: Column, rows: int, cols: int) -> Column:
    return F.array(*[F.aggregate(F.slice(m, 1 + i * cols, cols), F.lit(0.0), lambda a, x: a + x) for i in range(rows)])


def col_sums(m: Column, rows: int, cols: int) -> Column:
    return F.array(*[F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.get(m, i * cols + F.lit(j))), F.lit(0.0), lambda a, x: a + x) for j in range(cols)])


def icp_sums(df: DataFrame, by: list[str], row: str, residual: str) -> DataFrame:
    """29 sums of point-to-plane rows (array of 6): the upper triangle of A and b, row after row (27), squared residual,
    count."""
    terms = [F.col(row)[i] for i in range(6)] + [F.col(residual)]
    products = [terms[i] * terms[j] for i in range(6) for j in range(i, 7)]
    sums = [F.sum(p) for p in products] + [F.sum(terms[6] * terms[6]), F.count(F.lit(1)).cast("double")]
    return (df.groupBy(*by) if by else df).agg(F.array(*sums).alias("sums"))


def reprojection_terms(x: Column, y: Column, z: Column, u: Column, v: Column, fx: float, fy: float, cx: float, cy: float, k: float = 1.2) -> dict[str, Column]:
    """Residuals rx, ry, Huber cost and weight, and the 2 x 6 Jacobian (translation, rotation) of a point's pixel."""
    rx, ry = fx * x / z + cx - u, fy * y / z + cy - v
    norm = F.sqrt(rx * rx + ry * ry)
    jx = [fx / z, F.lit(0.0), -fx * x / (z * z), -fx * x * y / (z * z), fx * (1 + x * x / (z * z)), -fx * y / z]
    jy = [F.lit(0.0), fy / z, -fy * y / (z * z), -fy * (1 + y * y / (z * z)), fy * x * y / (z * z), fy * x / z]
    return {"rx": rx, "ry": ry, "cost": N.huber_cost(norm, k), "weight": N.huber_weight(norm, k), "jx": F.array(*jx), "jy": F.array(*jy)}


def normal_equations(df: DataFrame, by: list[str], mask: Column | None = None) -> DataFrame:
    """Sums over rows with the columns of reprojection_terms(): cost; h, the 6 x 6 of unweighted products; m, its weighted
    diagonal; b, weighted. Rows outside the mask add nothing."""
    rows = df.where(mask) if mask is not None else df

    def pair(i: int, j: int) -> Column:
        return F.col("jx")[i] * F.col("jx")[j] + F.col("jy")[i] * F.col("jy")[j]

    h = [F.sum(pair(i, j)) for i in range(6) for j in range(6)]
    m = [F.sum(F.col("weight") * pair(i, i)) for i in range(6)]
    b = [F.sum(F.col("weight") * (F.col("jx")[i] * F.col("rx") + F.col("jy")[i] * F.col("ry"))) for i in range(6)]
    grouped = rows.groupBy(*by) if by else rows
    return grouped.agg(F.sum("cost").alias("cost"), F.array(*h).alias("h"), F.array(*m).alias("m"), F.array(*b).alias("b"))


def scatter_blocks(blocks: DataFrame, by: list[str], size: int = 6) -> DataFrame:
    """Sums of entries at whole-matrix places. blocks: by..., i, j (block places), values (size x size, flat)."""
    entries = blocks.select(*by, "i", "j", F.posexplode("values").alias("k", "v"))
    at = entries.select(*by, (F.col("i") * size + F.floor(F.col("k") / size)).alias("row"), (F.col("j") * size + F.col("k") % size).alias("col"), "v")
    return at.groupBy(*by, "row", "col").agg(F.sum("v").alias("value"))


def support(df: DataFrame, by: list[str], residual: str, most: float) -> DataFrame:
    """Inliers (residual <= most), their share and the sum of their residuals."""
    ok = F.col(residual) <= most
    return (df.groupBy(*by) if by else df).agg(
        F.count_if(ok).alias("inliers"), (F.count_if(ok) / F.count(F.lit(1))).alias("ratio"), F.sum(F.when(ok, F.col(residual)).otherwise(0.0)).alias("residual_sum")
    )


def better_support(inliers_a: Column, inliers_b: Column) -> Column:
    """Whether support b is preferred to a; equals go to b."""
    return inliers_b >= inliers_a


def covariance(df: DataFrame, by: list[str], xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Centroid and the 3 x 3 matrix of summed products of centred coordinates."""
    pairs = [(F.covar_pop(a, b) * F.count(F.lit(1))) for a in xyz for b in xyz]
    return (df.groupBy(*by) if by else df).agg(F.array(*map(F.avg, xyz)).alias("centroid"), F.array(*pairs).alias("scatter"))


def votes(candidates: DataFrame, query: list[str], node: str = "node") -> DataFrame:
    """Per node: frames that vote for it, the best score and the pair that has it, the earliest among equals. candidates:
    query..., node, ref, cur, score."""
    best = F.max_by(F.struct("ref", "cur"), F.struct("score", -F.col("cur"), -F.col("ref")))
    return candidates.groupBy(*query, node).agg(F.countDistinct("cur").alias("n"), F.max("score").alias("score"), best.alias("p")).select(*query, node, "n", "score", "p.*")


def min_acceptable_score(neighbours: DataFrame, previous: DataFrame, frame: str = "frame") -> DataFrame:
    """Half the least score to a neighbour, or half the score to the previous frame, or a half."""
    own = neighbours.groupBy(frame).agg(F.min("score").alias("least"))
    return previous.join(own, frame, "left").select(frame, (0.5 * F.coalesce("least", F.col("score"), F.lit(1.0))).alias("min_score"))


def ate_metrics(errors: DataFrame, by: list[str], error: str = "error", stamp: str = "stamp") -> DataFrame:
    """Trajectory error: pairs, rmse, mean, median, population standard deviation, least and largest with their stamps."""
    e = F.col(error)
    by, alone = (by, errors) if by else (["__all"], errors.withColumn("__all", F.lit(0)))
    picked = medians(alone, by, error)
    found = alone.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"),
        F.min(e).alias("min"), F.min_by(stamp, F.struct(e, F.col(stamp))).alias("min_stamp"), F.max(e).alias("max"), F.max_by(stamp, F.struct(e, -F.col(stamp))).alias("max_stamp"),
    )
    names = [c for c in by if c != "__all"] + ["pairs", "rmse", "mean", "median", "std", "min", "min_stamp", "max", "max_stamp"]
    return found.join(picked, by, "left").select(*names)


def cross_moments(pairs: DataFrame, by: list[str], model: tuple[str, str, str], data: tuple[str, str, str]) -> DataFrame:
    """n, centroids and the nine summed products of centred model and data coordinates, row by model."""
    w = [F.covar_pop(m, d) * F.count(F.lit(1)) for m in model for d in data]
    return (pairs.groupBy(*by) if by else pairs).agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.avg, model)).alias("model_mean"), F.array(*map(F.avg, data)).alias("data_mean"), F.array(*w).alias("w"))


def point_weight(points: DataFrame, by: list[str], xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Mean distance of an edge's points from the camera; NaN fails the query."""
    x, y, z = map(F.col, xyz)
    mean = points.groupBy(*by).agg(F.avg(F.sqrt(x * x + y * y + z * z)).alias("point_weight"))
    checked = F.when(F.assert_true(~F.isnan("point_weight"), F.lit("point weight is NaN")).isNull(), F.col("point_weight"))
    return mean.withColumn("point_weight", checked)


def rms_spread(df: DataFrame, by: list[str], x: str, y: str, threshold: float) -> DataFrame:
    """Root mean square distance of points from their mean, and whether it is below the threshold (too narrow)."""
    spread = F.sqrt(F.var_pop(x) + F.var_pop(y))
    return (df.groupBy(*by) if by else df).agg(spread.alias("rms"), (spread < threshold).alias("rejected"))


def edge_gate(edges: DataFrame, most: float) -> DataFrame:
    return edges.where(~F.isnan("cost") & (F.col("cost") < most))


def registration_counts(df: DataFrame, ok: Column) -> DataFrame:
    return df.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def robust_stats(df: DataFrame, by: list[str], value: str, percentiles: tuple[float, ...] = (5, 95)) -> DataFrame:
    """mean, median (mean of the middles), sample variance and deviation, and nearest-rank percentiles."""
    n = F.col("n")
    ranks = {"__m0": F.floor((n - 1) / 2), "__m1": F.floor(n / 2)} | {f"p{p:g}": F.round(F.lit(p / 100) * (n - 1)) for p in percentiles}
    picked = at_ranks(df, by, value, ranks)
    moments = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("std_dev"))
    return moments.join(picked, by).select(*by, "mean", ((F.col("__m0") + F.col("__m1")) / 2).alias("median"), "variance", "std_dev", *[f"p{p:g}" for p in percentiles])


def se3_moments(poses: DataFrame, by: list[str], weight: Column | None = None, pose: str = "pose") -> DataFrame:
    """Weighted mean rotation matrix (not yet a rotation) and translation; see estimate.average_poses()."""
    w = weight if weight is not None else F.lit(1.0)
    r = V.quaternion_to_matrix(F.col(pose)["q"])
    total = F.sum(w)
    return (poses.groupBy(*by) if by else poses).agg(
        F.array(*[F.sum(w * r[i]) / total for i in range(9)]).alias("r"), F.array(*[F.sum(w * F.col(pose)["t"][i]) / total for i in range(3)]).alias("t")
    )


def lost_count(nodes: DataFrame, root: str = "root", size: str = "n_frames") -> DataFrame:
    """Frames in nodes off the largest tree (ties: the smallest root)."""
    trees = nodes.groupBy(root).agg(F.count(F.lit(1)).alias("__n"))
    main = trees.agg(F.max_by(root, F.struct("__n", -F.col(root))).alias("__main"))
    return nodes.crossJoin(F.broadcast(main)).agg(F.coalesce(F.sum(F.when(F.col(root) != F.col("__main"), F.col(size))), F.lit(0)).alias("lost"))  # one row
