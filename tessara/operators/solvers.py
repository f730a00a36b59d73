"""Small dense solvers in numpy, for use inside grouped functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from math import ceil, log

import numpy as np


def kabsch(model: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R, t that bring rows of model nearest to rows of data."""
    m, d = model.mean(0), data.mean(0)
    r = rotation_of_moments((model - m).T @ (data - d))
    return r, d - r @ m


def rotation_of_moments(w: np.ndarray) -> np.ndarray:
    """The rotation of summed products model x data; a mirror image is turned into a rotation."""
    u, _, vt = np.linalg.svd(w.T)
    s = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1])
    return u @ s @ vt


def nearest_rotation(r: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(r)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt


def skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def exp_so3(w: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(w)
    k = skew(w)
    if a < 1e-9:
        return np.eye(3) + k
    return np.eye(3) + np.sin(a) / a * k + (1 - np.cos(a)) / a**2 * k @ k


def quaternion(r: np.ndarray) -> np.ndarray:
    """x, y, z, w of a rotation, w not negative."""
    k = np.array([
        [r[0, 0] - r[1, 1] - r[2, 2], r[1, 0] + r[0, 1], r[2, 0] + r[0, 2], r[2, 1] - r[1, 2]],
        [r[1, 0] + r[0, 1], r[1, 1] - r[0, 0] - r[2, 2], r[2, 1] + r[1, 2], r[0, 2] - r[2, 0]],
        [r[2, 0] + r[0, 2], r[2, 1] + r[1, 2], r[2, 2] - r[0, 0] - r[1, 1], r[1, 0] - r[0, 1]],
        [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], r[0, 0] + r[1, 1] + r[2, 2]],
    ])
    q = np.linalg.eigh(k)[1][:, -1]
    return q if q[3] >= 0 else -q


def rotation(q: np.ndarray) -> np.ndarray:
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


@dataclass(frozen=True)
class RansacConfig:
    max_residual: float = 5.991
    trials: int = 100
    confidence: float = 0.99
    trial_factor: float = 3.0
    seed: int = 0
    # adaptive
    target_ratio: float = 0.8
    ratio_delta: float = 0.02
    step: float = 0.5
    end_delta: float = 1e-5
    upper_bound: float = 0.001
    min_stop_ratio: float = 0.3


@dataclass
class RansacReport:
    success: bool = False
    model: object = None
    inliers: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    ratio: float = 0.0
    trials: int = 0
    max_residual: float = 0.0


Fit = Callable[[np.ndarray, np.ndarray], object]
Residuals = Callable[[object, np.ndarray, np.ndarray], np.ndarray]


def trials_needed(ratio: float, samples: int, c: RansacConfig) -> int:
    """Draws after which a clean sample has come up with the confidence, times the factor."""
    if c.confidence >= 1:
        return 1 << 31
    miss = 1 - max(ratio, 0.05) ** samples
    return 1 if miss <= 0 else ceil(log(1 - c.confidence) / log(miss) * c.trial_factor)


def ransac(x: np.ndarray, y: np.ndarray, samples: int, fit: Fit, residuals: Residuals, c: RansacConfig, local: bool = True) -> RansacReport:
    """The model that most rows agree with, of models of random samples; a later one with as many wins.

    local: a better model is fitted again to all that agree with it, and the refit stays if it is no worse."""
    rng, n = np.random.RandomState(c.seed), len(x)
    out = RansacReport(max_residual=c.max_residual)
    if n < samples:
        return out
    most, best = c.trials, 0

    def agree(model: object) -> np.ndarray:
        return np.flatnonzero(residuals(model, x, y) <= c.max_residual)

    while out.trials < most:
        out.trials += 1
        pick = rng.permutation(n)[:samples]
        model = fit(x[pick], y[pick])
        if model is None:
            continue
        inliers = agree(model)
        if len(inliers) < best:
            continue
        if local and len(inliers) > samples:
            again = fit(x[inliers], y[inliers])
            if again is not None and len(more := agree(again)) >= len(inliers):
                model, inliers = again, more
        best, out.model, out.inliers = len(inliers), model, inliers
        most = min(c.trials, trials_needed(best / n, samples, c))
    out.ratio, out.success = best / n, out.model is not None
    return out


def adaptive_ransac(x: np.ndarray, y: np.ndarray, samples: int, fit: Fit, residuals: Residuals, c: RansacConfig) -> RansacReport:
    """ransac() at the residual limit whose share of inliers is nearest target_ratio, within ratio_delta.

    The share grows with the limit, so the limits tried so far leave a bracket: the tightest whose share is above the
    target and the loosest whose share isn't. While one side is missing the limit is scaled by step towards it, and
    given up where it is wide (a tenth of upper_bound) and still finds under min_stop_ratio; then the middle is tried,
    until the sides are end_delta apart. Where the share jumps over the target, the looser side whose limit is below
    upper_bound is taken; there is none: no success."""
    bracket: dict[bool, RansacReport] = {}
    limit = c.max_residual
    while True:
        found = ransac(x, y, samples, fit, residuals, replace(c, max_residual=limit))
        if abs(found.ratio - c.target_ratio) < c.ratio_delta or not (bracket or found.success):
            return found
        above = found.ratio > c.target_ratio
        if bracket and not bracket.keys() - {above} and limit >= c.upper_bound / 10 and found.ratio < c.min_stop_ratio:
            return replace(found, success=False)
        bracket[above] = found
        ends = [r.max_residual for r in bracket.values()]
        after = sum(ends) / 2 if len(ends) == 2 else limit * (c.step if above else 1 / c.step)
        if np.ptp([*ends, after]) <= c.end_delta or not np.isfinite(after):
            break
        limit = after
    within = [bracket[side] for side in (True, False) if side in bracket and bracket[side].max_residual < c.upper_bound]
    return within[0] if within else replace(bracket.get(True) or bracket[False], success=False)


def line_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """Slope and height of the least-squares line; None for points above each other."""
    d = x - x.mean()
    s = float(d @ d)
    return None if s == 0 else (float(d @ y) / s, float(y.mean() - d @ y / s * x.mean()))


def line_residuals(model: tuple[float, float], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(y - model[0] * x - model[1])


def project(r: np.ndarray, t: np.ndarray, p: np.ndarray, k: tuple[float, float, float, float]) -> np.ndarray:
    c = p @ r.T + t
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.stack([k[0] * c[:, 0] / c[:, 2] + k[2], k[1] * c[:, 1] / c[:, 2] + k[3]], 1)


def pixel_error(model: tuple[np.ndarray, np.ndarray], p: np.ndarray, uv: np.ndarray, k: tuple) -> np.ndarray:
    e = np.linalg.norm(project(*model, p, k) - uv, axis=1)
    behind = (p @ model[0].T + model[1])[:, 2] <= 0
    return np.where(behind | np.isnan(e), np.inf, e)


_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
_BETAS = [(i, j) for j in range(4) for i in range(j + 1)]


def epnp(p: np.ndarray, uv: np.ndarray, k: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray] | None:
    """Pose of a calibrated camera from four or more points, by four control points: points are weighted sums of them,
    their places in the camera's frame lie in a null space, and weights in it follow from their known distances.
    Three starts with one, two and three weights, five Gauss-Newton steps each, the least pixel error wins; a pose of
    under six points is refined."""
    n = len(p)
    if n < 4:
        return None
    centre = p.mean(0)
    _, s, vt = np.linalg.svd(p - centre, full_matrices=False)
    control = np.vstack([centre, centre + (np.maximum(s, 1e-9) / np.sqrt(n))[:, None] * vt])
    try:
        alpha = np.linalg.solve(np.vstack([control.T, np.ones(4)]), np.vstack([p.T, np.ones(n)])).T
    except np.linalg.LinAlgError:
        return None
    fx, fy, cx, cy = k
    m = np.zeros((2 * n, 12))
    for j in range(4):
        m[0::2, 3 * j], m[0::2, 3 * j + 2] = alpha[:, j] * fx, alpha[:, j] * (cx - uv[:, 0])
        m[1::2, 3 * j + 1], m[1::2, 3 * j + 2] = alpha[:, j] * fy, alpha[:, j] * (cy - uv[:, 1])
    null = np.linalg.eigh(m.T @ m)[1][:, :4].T.reshape(4, 4, 3)  # the smallest first
    diff = np.array([[null[b, i] - null[b, j] for i, j in _PAIRS] for b in range(4)])
    grid = np.array([[(1 if i == j else 2) * diff[i, e] @ diff[j, e] for i, j in _BETAS] for e in range(6)])
    rho = np.array([np.sum((control[i] - control[j]) ** 2) for i, j in _PAIRS])
    best, least = None, np.inf
    for used in (1, 2, 3):
        columns = [c for c, (i, j) in enumerate(_BETAS) if (i == 0 if used == 1 else j < used)]
        found = dict(zip([_BETAS[c] for c in columns], np.linalg.lstsq(grid[:, columns], rho, rcond=None)[0]))
        b0 = np.sqrt(abs(found[0, 0]))
        if b0 == 0:
            continue
        sign = np.sign(found[0, 0]) or 1.0
        beta = np.array([b0, *[sign * found.get((0, j), 0.0) / b0 for j in (1, 2, 3)]])
        for _ in range(5):
            terms = np.array([beta[i] * beta[j] for i, j in _BETAS])
            jacobian = np.zeros((6, 4))
            for c, (i, j) in enumerate(_BETAS):
                jacobian[:, i] += grid[:, c] * beta[j]
                jacobian[:, j] += grid[:, c] * beta[i]
            beta = beta + np.linalg.lstsq(jacobian, rho - grid @ terms, rcond=None)[0]
        camera = alpha @ np.tensordot(beta, null, 1)
        if camera[:, 2].mean() < 0:
            camera = -camera
        pose = kabsch(p, camera)
        error = pixel_error(pose, p, uv, k).mean()
        if n < 6 and np.isfinite(error) and error > 1e-6:  # so few points leave the weights loose
            pose = refine_pose(*pose, p, uv, k, 20, np.inf)[:2]
            error = pixel_error(pose, p, uv, k).mean()
        if error < least:
            best, least = pose, error
    return best


def huber(r: np.ndarray, k: float = 1.2) -> tuple[np.ndarray, np.ndarray]:
    """Costs and weights of residual lengths."""
    a = np.abs(r)
    return np.where(a < k, a * a / 2, k * (a - k / 2)), np.where(a < k, 1.0, k / np.maximum(a, 1e-12))


def refine_pose(r: np.ndarray, t: np.ndarray, p: np.ndarray, uv: np.ndarray, k: tuple, iterations: int = 50, relax: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Robust least-squares pose by damped steps: damping starts at a hundredth of half the trace, halves when a step
    lowers the cost and doubles when not. The translation stays within `relax` of where it began."""
    fx, fy = k[:2]
    start = t.copy()

    def cost_of(r: np.ndarray, t: np.ndarray) -> float:
        return float(huber(np.linalg.norm(project(r, t, p, k) - uv, axis=1))[0].sum())

    cost, damping = cost_of(r, t), None
    for _ in range(iterations):
        c = p @ r.T + t
        z = c[:, 2]
        e = project(r, t, p, k) - uv
        w = huber(np.linalg.norm(e, axis=1))[1]
        jp = np.zeros((len(p), 2, 3))
        jp[:, 0, 0], jp[:, 0, 2], jp[:, 1, 1], jp[:, 1, 2] = fx / z, -fx * c[:, 0] / z**2, fy / z, -fy * c[:, 1] / z**2
        cross = np.zeros((len(p), 3, 3))
        cross[:, 0, 1], cross[:, 0, 2], cross[:, 1, 2] = c[:, 2], -c[:, 1], c[:, 0]
        cross -= cross.transpose(0, 2, 1)
        j = np.concatenate([jp, jp @ cross], 2)
        h, b = np.einsum("nij,n,nik->jk", j, w, j), np.einsum("nij,n,ni->j", j, w, e)
        damping = 0.005 * np.trace(h) if damping is None else damping
        for _ in range(20):
            try:
                step = np.linalg.solve(h + damping * np.eye(6), -b)
            except np.linalg.LinAlgError:
                damping *= 2
                continue
            turn = exp_so3(step[3:])
            r2, t2 = turn @ r, np.clip(turn @ t + step[:3], start - relax, start + relax)
            new = cost_of(r2, t2)
            if new < cost:
                gain, r, t, cost, damping = cost - new, r2, t2, new, damping / 2
                break
            damping *= 2
        else:
            break
        if gain < 1e-10 * (1 + cost):
            break
    return r, t, cost


def pose_graph(n: int, edges: list[tuple[int, int, np.ndarray, np.ndarray]], start: list[tuple[np.ndarray, np.ndarray]], iterations: int = 200, weights: list[float] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Poses (R, t) of n nodes that fit relative poses (i, j, R, t) of edges: residuals are the difference in place and
    twice the vector part of the difference in turn. Damped normal equations over all nodes; node 0 is put back to
    the identity afterwards."""
    poses = [(r.copy(), t.copy()) for r, t in start]
    ws = weights or [1.0] * len(edges)

    def residual(r1, t1, r2, t2, r, t):
        d = r.T @ (r1.T @ r2)
        return np.concatenate([r1.T @ (t2 - t1) - t, 2 * quaternion(d)[:3]])

    def total(ps):
        return sum(w * float(e @ e) for (i, j, r, t), w in zip(edges, ws) for e in [residual(*ps[i], *ps[j], r, t)])

    cost, damping, eps = total(poses), 1e-6, 1e-6
    for _ in range(iterations):
        h, b = np.zeros((6 * n, 6 * n)), np.zeros(6 * n)
        for (i, j, r, t), w in zip(edges, ws):
            e = residual(*poses[i], *poses[j], r, t)
            both = np.zeros((6, 12))
            for side, node in enumerate((i, j)):
                for k in range(6):
                    d = np.zeros(6)
                    d[k] = eps
                    moved = _moved(poses[node], d)
                    args = (*moved, *poses[j]) if side == 0 else (*poses[i], *moved)
                    both[:, 6 * side + k] = (residual(*args, r, t) - e) / eps
            at = np.r_[6 * i : 6 * i + 6, 6 * j : 6 * j + 6]
            h[np.ix_(at, at)] += w * both.T @ both
            b[at] += w * both.T @ e
        h[:6, :6] += 1e6 * np.eye(6)  # node 0 holds still
        step = np.linalg.solve(h + damping * np.eye(6 * n), -b)
        new = [_moved(p, step[6 * i : 6 * i + 6]) for i, p in enumerate(poses)]
        now = total(new)
        if now < cost:
            done = cost - now < 1e-12 * (1 + cost)
            poses, cost, damping = new, now, damping / 4
            if done:
                break
        else:
            damping = max(damping, 1e-9) * 10
            if damping > 1e8:
                break
    r0, t0 = poses[0]
    return [(r0.T @ r, r0.T @ (t - t0)) for r, t in poses]


def _moved(pose: tuple[np.ndarray, np.ndarray], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pose[0] @ exp_so3(d[3:]), pose[1] + d[:3]


def icp_point(p: np.ndarray, q: np.ndarray, rounds: int = 4, most: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Pose that brings p to q, refitted in rounds to the pairs that agree to within `most` (all, if fewer than 3 do)."""
    r, t = kabsch(p, q)
    for _ in range(rounds - 1):
        ok = np.linalg.norm(p @ r.T + t - q, axis=1) < most
        if ok.sum() < 3:
            break
        r, t = kabsch(p[ok], q[ok])
    return r, t


def icp_plane_step(sums: np.ndarray) -> np.ndarray:
    """The six-vector (rotation, translation) of 29 point-to-plane sums: rows of A's upper triangle, each with its b."""
    a, b, k = np.zeros((6, 6)), np.zeros(6), 0
    for i in range(6):
        for j in range(i, 7):
            if j == 6:
                b[i] = sums[k]
            else:
                a[i, j] = a[j, i] = sums[k]
            k += 1
    return np.linalg.solve(a, b)
