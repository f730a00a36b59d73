"""Grouped estimators: a numpy solver per group of rows, and alignments whose sums Spark adds up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessara.functions import vectors as V
from tessara.operators import aggs
from tessara.operators import solvers as S

POSE_COLUMNS = "q array<double>, t array<double>"


def estimate(pairs: DataFrame, by: list[str], estimator: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """One row per group from any function of the group's rows. A group is what one problem holds (the matches of a frame
    pair), so it fits a task by its nature."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(by, key)) | estimator(pdf)])

    own = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)
    return pairs.groupBy(*by).applyInPandas(run, f"{own}, {schema}")


def ransac_line(df: DataFrame, by: list[str], x: str, y: str, config: S.RansacConfig = S.RansacConfig(), adaptive: bool = False) -> DataFrame:
    """slope, intercept, n, inliers, trials of the line that most points of each group agree with. Points are put in order
    before sampling, so results don't hang on how rows arrive."""

    def one(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna(subset=[x, y]).sort_values([x, y])
        run = S.adaptive_ransac if adaptive else S.ransac
        r = run(pdf[x].to_numpy(float), pdf[y].to_numpy(float), 2, S.line_fit, S.line_residuals, config)
        slope, height = r.model if r.success else (None, None)
        return {"slope": slope, "intercept": height, "n": len(pdf), "inliers": len(r.inliers), "trials": r.trials}

    return estimate(df, by, one, "slope double, intercept double, n long, inliers long, trials long")


def pnp(matches: DataFrame, by: list[str], intrinsics: tuple[float, float, float, float], config: S.RansacConfig = S.RansacConfig(), min_matches: int = 25, min_inliers: int = 15, min_ratio: float = 0.3, refine: bool = False) -> DataFrame:
    """Pose of the left camera's points seen by the right camera, of each group of matches (x, y, z: point in the left
    camera; u, v: pixel in the right): its inverse as q, t with inliers (places in order of `match`), cost, success.

    Groups with fewer than min_matches, or then fewer than min_inliers or min_ratio inliers, fail."""

    def one(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values("match")
        bad = {"success": False, "q": None, "t": None, "inliers": [], "cost": None, "trials": 0}
        if len(pdf) < min_matches:
            return bad
        p, uv = pdf[["x", "y", "z"]].to_numpy(float), pdf[["u", "v"]].to_numpy(float)
        r = S.ransac(p, uv, 4, lambda a, b: S.epnp(a, b, intrinsics), lambda m, a, b: S.pixel_error(m, a, b, intrinsics), config)
        if not r.success or r.ratio < min_ratio or len(r.inliers) < min_inliers:
            return bad | {"trials": r.trials}
        rot, t = r.model
        cost = float(S.huber(S.pixel_error(r.model, p[r.inliers], uv[r.inliers], intrinsics))[0].mean())
        if refine:
            rot, t, total = S.refine_pose(rot, t, p[r.inliers], uv[r.inliers], intrinsics)
            cost = total / len(r.inliers)
        return {"success": True, "q": S.quaternion(rot.T).tolist(), "t": (-rot.T @ t).tolist(), "inliers": r.inliers.tolist(), "cost": cost, "trials": r.trials}

    return estimate(matches, by, one, f"success boolean, {POSE_COLUMNS}, inliers array<long>, cost double, trials int")


def refine(matches: DataFrame, by: list[str], poses: DataFrame, intrinsics: tuple[float, float, float, float], min_spread: float = 0.0, rounds: int = 1, keep: float = 2.0) -> DataFrame:
    """Pairwise bundle adjustment from the poses (q, t: right to left) of groups. In each round after the first only
    matches with a cost in [0, keep) take part. Matches whose pixels spread less than min_spread fail."""

    def one(pdf: pd.DataFrame) -> dict:
        p, uv = pdf[["x", "y", "z"]].to_numpy(float), pdf[["u", "v"]].to_numpy(float)
        spread = float(np.sqrt(((uv - uv.mean(0)) ** 2).sum(1).mean()))
        if spread < min_spread:
            return {"success": False, "q": None, "t": None, "cost": None, "n": len(pdf)}
        rot = S.rotation(np.array(pdf.q.iloc[0])).T
        t = -rot @ np.array(pdf.t.iloc[0])
        mask = np.ones(len(p), bool)
        for _ in range(rounds):
            rot, t, cost = S.refine_pose(rot, t, p[mask], uv[mask], intrinsics)
            n = int(mask.sum())
            mask = S.huber(S.pixel_error((rot, t), p, uv, intrinsics))[0] < keep
            if mask.sum() < 4:
                break
        return {"success": True, "q": S.quaternion(rot.T).tolist(), "t": (-rot.T @ t).tolist(), "cost": cost / n, "n": n}

    return estimate(matches.join(poses.select(*by, "q", "t"), by), by, one, f"success boolean, {POSE_COLUMNS}, cost double, n long")


def align(pairs: DataFrame, by: list[str], model: tuple[str, str, str], data: tuple[str, str, str]) -> DataFrame:
    """Rotation r (3 x 3) and translation t that bring model points nearest to data points, of each group.

    The nine moments are sums that Spark adds up over any number of rows; only the 3 x 3 of each group is solved."""
    moments = aggs.cross_moments(pairs, by, model, data)

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                r = S.rotation_of_moments(np.array(row.w).reshape(3, 3))
                out.append((*[getattr(row, c) for c in by], r.reshape(-1).tolist(), (np.array(row.data_mean) - r @ np.array(row.model_mean)).tolist(), row.n))
            yield pd.DataFrame(out, columns=[*by, "r", "t", "n"])

    own = "".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}, " for c in by)
    return moments.mapInPandas(run, f"{own}r array<double>, t array<double>, n long")


def aligned_errors(pairs: DataFrame, by: list[str], model: tuple[str, str, str], data: tuple[str, str, str]) -> DataFrame:
    """pairs with the model point aligned (ax, ay, az) and its distance from the data point, `error`."""
    found = align(pairs, by, model, data)
    joined = pairs.join(found, by) if by else pairs.crossJoin(F.broadcast(found))  # one row
    moved = [sum((F.col("r")[3 * i + j] * F.col(model[j]) for j in range(3)), F.col("t")[i]) for i in range(3)]
    joined = joined.withColumns(dict(zip(("ax", "ay", "az"), moved)))
    e = sum(((F.col(a) - F.col(d)) * (F.col(a) - F.col(d)) for a, d in zip(("ax", "ay", "az"), data)), F.lit(0.0))
    return joined.withColumn("error", F.sqrt(e)).drop("r", "t", "n")


def average_poses(poses: DataFrame, by: list[str], weight=None) -> DataFrame:
    """Mean pose of each group: rotations are averaged as matrices and brought to the nearest rotation."""
    means = aggs.se3_moments(poses, by, weight)

    def run(batches):
        for pdf in batches:
            pdf["q"] = [S.quaternion(S.nearest_rotation(np.array(r).reshape(3, 3))).tolist() for r in pdf.r]
            yield pdf[[*by, "q", "t"]]

    own = "".join(f"`{c}` {poses.schema[c].dataType.simpleString()}, " for c in by)
    return means.mapInPandas(run, f"{own}{POSE_COLUMNS}")


def pose_graph(edges: DataFrame, component: list[str], iterations: int = 200, tree: bool = False, loop_weight: float = 3.0) -> DataFrame:
    """Poses q, t of the nodes of each component from its edges (src < dst, q, t: of dst in src's frame). A component is
    one dense problem; the engine keeps it small by solving chunks first.

    tree: edges with column in_tree count once, the others loop_weight times."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        names = sorted({*pdf.src, *pdf.dst})
        at = {v: i for i, v in enumerate(names)}
        es = [(at[r.src], at[r.dst], S.rotation(np.array(r.q)), np.array(r.t)) for r in pdf.itertuples()]
        start: dict[int, tuple] = {0: (np.eye(3), np.zeros(3))}
        waiting = True
        while waiting:
            waiting = False
            for i, j, r, t in es:
                if i in start and j not in start:
                    ri, ti = start[i]
                    start[j], waiting = (ri @ r, ti + ri @ t), True
                elif j in start and i not in start:
                    rj, tj = start[j]
                    start[i], waiting = (rj @ r.T, tj - rj @ r.T @ t), True
        weights = [1.0 if x else loop_weight for x in pdf.in_tree] if tree else None
        solved = S.pose_graph(len(names), es, [start.get(i, (np.eye(3), np.zeros(3))) for i in range(len(names))], iterations, weights)
        return pd.DataFrame([(*key, v, S.quaternion(r).tolist(), t.tolist()) for v, (r, t) in zip(names, solved)], columns=[*component, "node", "q", "t"])

    own = "".join(f"`{c}` {edges.schema[c].dataType.simpleString()}, " for c in component)
    return edges.groupBy(*component).applyInPandas(run, f"{own}node long, {POSE_COLUMNS}")


def icp(pairs: DataFrame, by: list[str], rounds: int = 4, most: float = 0.01) -> DataFrame:
    """Pose q, t of point pairs (px, py, pz to qx, qy, qz) of each group, robust in rounds."""

    def one(pdf: pd.DataFrame) -> dict:
        r, t = S.icp_point(pdf[["px", "py", "pz"]].to_numpy(float), pdf[["qx", "qy", "qz"]].to_numpy(float), rounds, most)
        return {"q": S.quaternion(r).tolist(), "t": t.tolist()}

    return estimate(pairs, by, one, POSE_COLUMNS)


def icp_plane(associated: DataFrame, by: list[str]) -> DataFrame:
    """The twist (rotation, translation) of one point-to-plane step of each group. associated: p, q (points), n (normal of
    q). The 29 sums are Spark's."""
    p, q, n = F.col("p"), F.col("q"), F.col("n")
    rows = associated.select(*by, F.concat(V.cross(p, n), n).alias("row"), V.dot(n, V.minus(q, p)).alias("residual"))
    sums = aggs.icp_sums(rows, by, "row", "residual")

    def run(batches):
        for pdf in batches:
            pdf["twist"] = [S.icp_plane_step(np.array(s)).tolist() for s in pdf.sums]
            pdf["error"], pdf["n"] = [s[27] for s in pdf.sums], [s[28] for s in pdf.sums]
            yield pdf[[*by, "twist", "error", "n"]]

    own = "".join(f"`{c}` {associated.schema[c].dataType.simpleString()}, " for c in by)
    return sums.mapInPandas(run, f"{own}twist array<double>, error double, n double")
