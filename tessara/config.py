"""Engine settings: one frozen value, passed to operators that need it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """The defaults that results depend on."""

    # input
    filter_frames: int = 10
    min_depth: int = 100
    max_depth: int = 3000
    # robust estimation
    num_of_trials: int = 100
    max_pnp_residual: float = 5.991
    upper_bound_residual: float = 0.001
    confidence: float = 0.99
    trial_factor: float = 3.0
    step_factor: float = 0.5
    inlier_ratio_threshold: float = 0.8
    adaptive_end_delta: float = 0.00001
    inlier_ratio_delta: float = 0.02
    min_inlier_ratio: float = 0.3
    min_matches: int = 25
    min_inliers: int = 15
    rms_threshold: float = 100.0
    max_avg_cost: float = 15.0
    relaxation: float = 1.0
    cost_threshold: float = 2.0
    # voxel fusion
    voxel_size: float = 0.010
    max_integration_distance: float = 3.0
    trunc_scale: float = 0.06
    truncation: float = 0.02
    integration_weight_sample: int = 1
    integration_weight_max: int = 99999999
    max_num_triangles: int = 10000000
    marching_cubes_factor: float = 10.0
    # retrieval
    min_score: float = 0.25
    num_neighs: int = 10
    max_num_features: int = 8192
    overlap_num: int = 5
    # dense matching
    neigh: int = 2
    window_radius: int = 5
    sigma_color: float = 0.2
    delta_normal_threshold: float = 0.2
    ncc_threshold: float = 0.5
    downsample_scale: int = 16
    # graph
    chunk_size: int = 30
    max_point_error: float = 0.01
    match_factor_threshold: float = 0.8
    vocabulary_path: str = ""

    @classmethod
    def load(cls, text: str) -> EngineConfig:
        """Settings from `key: value` lines or a JSON object; unknown keys are ignored, a value of the wrong kind fails."""
        text = text.strip()
        found = json.loads(text) if text.startswith("{") else dict(pair(line) for line in text.splitlines() if line.strip() and not line.lstrip().startswith(("#", "%", "---")))
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return replace(cls(), **{k: kinds[k](v) for k, v in found.items() if k in kinds})

    def dump(self) -> str:
        return "".join(f"{k}: {v}\n" for k, v in asdict(self).items())


def pair(line: str) -> tuple[str, str]:
    key, _, value = line.partition(":")
    return key.strip(), value.strip().strip("'\"")
