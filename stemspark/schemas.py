"""Schemas of the library's tables.

frames: one row per scan position, detector pixels row by row in `counts`.
voxels: one row per scan position and detector pixel.
pixel_images: one row per detector pixel, the scan image row by row in `img`.
datasets: one row per acquisition, with its extents.
"""

from __future__ import annotations

FRAMES = "dataset_id string, frame_idx bigint, scan_y int, scan_x int, det_h int, det_w int, counts array<int>"
VOXELS = "dataset_id string, scan_y int, scan_x int, det_y int, det_x int, count bigint"
PIXEL_IMAGES = "dataset_id string, det_y int, det_x int, scan_h int, scan_w int, img array<double>"
DATASETS = "dataset_id string, n_frames bigint, det_h int, det_w int, file_size bigint"
IMAGE = "dataset_id string, y int, x int, value double"
SHIFTS = "dataset_id string, det_y int, det_x int, shift_y double, shift_x double, quality double"
FFT = "dataset_id string, det_y int, det_x int, ky int, kx int, re double, im double"
RUNS = "run_id bigint, dataset_id bigint, ts timestamp, step_completed int"
SCAN = ["dataset_id", "scan_y", "scan_x"]
DETECTOR = ["dataset_id", "det_y", "det_x"]
