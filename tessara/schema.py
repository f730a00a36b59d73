"""Schemas of the engine's tables. Poses are (q: x, y, z, w; t); matrices are flat, row-major."""

from __future__ import annotations

POSE = "struct<q:array<double>,t:array<double>>"
CAMERAS = "ser_num string, fx double, fy double, cx double, cy double, width int, height int, depth_scale double, dist_coef array<double>"
FRAMES = f"frame_index long, frame_id long, camera string, rgb_path string, depth_path string, min_depth double, max_depth double, pose {POSE}, visible boolean"
PIXELS = "frame_index long, x int, y int, depth double, r int, g int, b int"
KEYPOINTS = "frame_index long, kp_index long, x double, y double, depth double, a11 double, a12 double, a21 double, a22 double, descriptor array<short>"
BOW = "frame_index long, word long, weight double"
MATCHES = "frame_x long, frame_y long, px long, py long"
EDGES = f"src long, dst long, transform {POSE}, point_weight double, cost double"
FOREST = "node_index long, parent long, root long, path_len int"
VOXELS = "vx long, vy long, vz long, sdf double, weight double, r double, g double, b double"
TRAJECTORY = "stamp double, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
