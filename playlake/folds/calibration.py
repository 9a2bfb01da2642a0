"""Calibration over time: blending with the prior, propagation with decay, and epochs of the frame of reference.

Cuts and interframe homographies come as columns; whatever makes them out of images is upstream of this fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from playlake.folds.ordered import fold_in_order, fold_stream

H = [f"h{i}" for i in range(9)]
D = [f"d{i}" for i in range(9)]


@dataclass(frozen=True)
class CalibrationConfig:
    """Parameters of the calibration's course over time."""

    smoothing: float = 0.5
    max_age: int = 5
    max_jump_yd: float = 4.0
    decay: float = 0.80
    min_confidence: float = 0.45
    width: float = 900.0
    height: float = 506.0

    def __post_init__(self) -> None:
        shares = (self.smoothing, self.decay, self.min_confidence)
        if not all(0 <= s <= 1 for s in shares) or self.max_age < 0 or not min(self.max_jump_yd, self.width, self.height) > 0:
            raise ValueError("calibration: shares lie within 0 and 1, and lengths are positive")


def _apply(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    mapped = np.column_stack([points, np.ones(len(points))]) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return mapped[:, :2] / mapped[:, 2:]


def jump_yd(old: np.ndarray, new: np.ndarray, c: CalibrationConfig) -> float:
    """Greatest distance between where two homographies put three points of the middle line."""
    probes = np.array([[c.width * s, c.height / 2] for s in (0.5, 0.25, 0.75)])
    return float(np.linalg.norm(_apply(old, probes) - _apply(new, probes), axis=1).max())


def is_plausible(h: np.ndarray, c: CalibrationConfig) -> bool:
    """Whether a view isn't mirrored, and 100 pixels at its centre are between half a yard and 35 yards."""
    if not abs(np.linalg.det(h)) >= 1e-12:
        return False
    centre = np.array([c.width / 2, c.height / 2])
    at = _apply(h, np.array([centre, centre + [100, 0], centre - [0, 100]]))
    right, up = at[1] - at[0], at[2] - at[0]
    return bool(right[0] * up[1] - right[1] * up[0] > 0 and all(0.5 < np.hypot(*v) < 35.0 for v in (right, up)))


class Calibration:
    """The fold of one run: a step is a frame's own calibration, whether it may project, and whether a cut precedes it."""

    def __init__(self, config: CalibrationConfig = CalibrationConfig()):
        self.config, self.epoch, self.source = config, 0, None
        self._forget()

    def _forget(self) -> None:
        self.h, self.age, self.confidence, self.mode = None, 0, 0.0, "uncalibrated"

    def step(self, rows: pd.DataFrame) -> list[dict]:
        if len(rows) > 1:
            raise ValueError("calibration: a frame occurs twice")
        r, c = rows.iloc[0], self.config
        cut = bool(r["is_cut"])
        if cut:
            self._forget()
        moved = None if cut or pd.isna(r["d0"]) else r[D].to_numpy(float).reshape(3, 3)
        if bool(r["can_project"]):
            return [self._direct(r, moved, cut)]
        if cut or self.h is None:
            return [self._out(r, cut, None, "uncalibrated", 0.0, "camera_cut_uncalibrated" if cut else r["failure_reason"], 0)]
        self.age += 1
        self.confidence = float(np.round(self.confidence * c.decay, 4))
        prior = self._prior(moved)
        if self.age > c.max_age or self.confidence < c.min_confidence:
            self.h, self.mode = None, "uncalibrated"
            return [self._out(r, cut, None, "uncalibrated", self.confidence, "confidence_expired", self.age)]
        self.h = prior
        return [self._out(r, cut, prior, self.mode, self.confidence, None, self.age)]

    def _prior(self, moved: np.ndarray | None) -> np.ndarray | None:
        """The last homography, carried along with the camera if that gives a plausible one that isn't far off."""
        if self.h is None or moved is None or abs(np.linalg.det(moved)) < 1e-300:
            return self.h
        h = self.h @ np.linalg.inv(moved)
        if abs(h[2, 2]) <= 1e-9:
            return self.h
        h = h / h[2, 2]
        return h if is_plausible(h, self.config) and jump_yd(self.h, h, self.config) <= 2 * self.config.max_jump_yd else self.h

    def _direct(self, r: pd.Series, moved: np.ndarray | None, cut: bool) -> dict:
        c = self.config
        seen = r[H].to_numpy(float).reshape(3, 3)
        seen = seen / seen[2, 2]
        prior, source = self._prior(moved), None if pd.isna(r["coordinate_frame_id"]) else r["coordinate_frame_id"]
        if prior is None or self.mode != r["x_coord_mode"] or source != self.source or jump_yd(prior, seen, c) > c.max_jump_yd:
            self.epoch += 1
            self.h = seen
        else:
            w = c.smoothing * self.confidence / max(1e-6, self.confidence + r["confidence"])
            blend = w * prior + (1 - w) * seen
            blend = blend / blend[2, 2]
            self.h = blend if is_plausible(blend, c) else seen
        self.source, self.age, self.confidence, self.mode = source, 0, float(r["confidence"]), r["x_coord_mode"]
        return self._out(r, cut, self.h, self.mode, self.confidence, None, 0)

    def _out(self, r: pd.Series, cut: bool, h: np.ndarray | None, mode: str, confidence: float, reason: str | None, age: int) -> dict:
        values = [None] * 9 if h is None else [float(v) for v in h.ravel()]
        return {
            "frame_id": int(r["frame_id"]), "success": h is not None, **dict(zip(H, values, strict=True)), "is_plausible": h is not None, "x_coord_mode": mode, "confidence": confidence,
            "failure_reason": None if reason is None or reason != reason else reason, "is_propagated": h is not None and age > 0, "propagation_age": age,
            "coordinate_frame_id": None if h is None else f"calibration:{self.epoch}", "is_cut": cut,
        }


CALIBRATIONS = (
    "run_id int, frame_id long, success boolean, " + ", ".join(f"{h} double" for h in H) + ", is_plausible boolean, x_coord_mode string, confidence double, failure_reason string, is_propagated boolean, "
    "propagation_age int, coordinate_frame_id string, is_cut boolean"
)


def propagate_calibrations(frames: DataFrame, config: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """Every frame's calibration after the frames before it.

    `frames` has run_id, frame_id, is_cut, can_project, h0 to h8, d0 to d8 (the homography from the frame before, NULL
    if unknown), x_coord_mode, confidence, failure_reason and coordinate_frame_id.
    """
    return fold_in_order(frames, ["run_id"], "frame_id", CALIBRATIONS, lambda: Calibration(config))


def propagate_stream(stream: DataFrame, config: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """The same over a stream."""
    return fold_stream(stream, ["run_id"], "frame_id", CALIBRATIONS, lambda: Calibration(config))
