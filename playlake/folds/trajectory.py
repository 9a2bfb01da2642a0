"""Field trajectories: a gated constant-velocity Kalman filter per track, with explicit dead reckoning.

Only accepted measurements give positions. Without one, or if the gate rejects it, the sample carries a prediction
that is named as such, for `max_gap` frames at most. A camera cut or a new frame of reference starts the state anew and
counts the coordinate segment up; the distance travelled goes on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlake.folds.ordered import fold_in_order, fold_stream
from playlake.operators.projection import field_covariances, geometry_state, project_footpoints

#: Fixed value: why a measurement is rejected.
FIELD_GATE = "jump_rejected_field_mahalanobis_gate"


@dataclass(frozen=True)
class TrajectoryConfig:
    """Parameters of the filter and the gate; all are positive."""

    fps: float = 30.0
    acceleration_std: float = 5.0
    gate: float = 9.21
    max_speed: float = 12.0
    max_acceleration: float = 25.0
    max_gap: int = 3
    max_rejections: int = 3
    warmup: int = 2
    velocity_variance: float = 4.0

    def __post_init__(self) -> None:
        if not all(math.isfinite(v) and v > 0 for v in vars(self).values()):
            raise ValueError("trajectory: parameters are positive and finite")


def floored(cov: np.ndarray, floor: float) -> np.ndarray:
    """A symmetric covariance with its principal variances raised to a floor."""
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    return (axes * np.maximum(values, floor)) @ axes.T


class Kalman:
    """Position and velocity in the plane, by white-noise acceleration."""

    def __init__(self, xy: np.ndarray, cov: np.ndarray, time_s: float, config: TrajectoryConfig, velocity: np.ndarray | None = None):
        self.config, self.time_s, self.updates = config, time_s, 1
        self.mean = np.concatenate([xy, np.zeros(2) if velocity is None else velocity])
        self.cov = np.diag([max(cov[0, 0], 1e-6), max(cov[1, 1], 1e-6), config.velocity_variance, config.velocity_variance])
        self.cov[0, 1] = self.cov[1, 0] = cov[0, 1]
        self.clipped = self._slow_down()

    def predict(self, time_s: float) -> None:
        dt = time_s - self.time_s
        if not dt >= 0:
            raise ValueError("trajectory: time doesn't decrease")
        move = np.eye(4)
        move[0, 2] = move[1, 3] = dt
        axis = np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]]) * self.config.acceleration_std**2
        self.mean = move @ self.mean
        self.cov = floored(move @ self.cov @ move.T + np.kron(axis, np.eye(2)), 1e-8)
        self.time_s, self.clipped = time_s, False

    def distance2(self, xy: np.ndarray, cov: np.ndarray) -> float:
        """Squared Mahalanobis distance of a measurement from the prediction."""
        miss = xy - self.mean[:2]
        return float(miss @ np.linalg.solve(floored(self.cov[:2, :2] + cov, 1e-4), miss))

    def update(self, xy: np.ndarray, cov: np.ndarray) -> None:
        gain = self.cov[:, :2] @ np.linalg.inv(floored(self.cov[:2, :2] + cov, 1e-4))
        self.mean = self.mean + gain @ (xy - self.mean[:2])
        keep = np.eye(4)
        keep[:, :2] -= gain
        self.cov = floored(keep @ self.cov @ keep.T + gain @ cov @ gain.T, 1e-8)  # symmetric whatever the rounding
        self.updates += 1
        self.clipped = self._slow_down()

    def _slow_down(self) -> bool:
        speed = float(np.hypot(*self.mean[2:]))
        if speed > self.config.max_speed:
            self.mean[2:] *= self.config.max_speed / speed
            return True
        return False


class Trajectory:
    """The fold of one track: a step is the track's row of a frame."""

    def __init__(self, config: TrajectoryConfig = TrajectoryConfig()):
        self.config, self.cuts, self.segment, self.travelled, self.key = config, None, 0, 0.0, None
        self._restart()

    def _restart(self) -> None:
        self.filter: Kalman | None = None
        self.rejections = 0
        self.measured = self.measured_frame = self.accepted = self.reported_frame = None
        self.reported_velocity = np.zeros(2)

    def step(self, rows: pd.DataFrame) -> list[dict]:
        if len(rows) > 1:
            raise ValueError("trajectory: a track occurs twice in a frame")
        r, c = rows.iloc[0], self.config
        frame, cuts = int(r["frame_id"]), int(r["n_cuts"])
        if self.cuts is not None and cuts > self.cuts:
            self.segment += cuts - self.cuts
            self.key = None
            self._restart()
        self.cuts = cuts
        projectable = r["geometry_state"] != "unknown"
        if projectable:
            key = (r["x_coord_mode"], r["coordinate_frame_id"])
            if self.key is not None and key != self.key:
                self.segment += 1
                self._restart()
            self.key = key
        since = 0 if self.measured_frame is None else frame - self.measured_frame
        expired = since > c.max_gap
        if expired:
            self.filter, self.measured, self.accepted, self.reported_frame, self.rejections = None, None, None, None, 0
        time_s = frame / c.fps
        xy = None if pd.isna(r["x_yd"]) else np.array([r["x_yd"], r["y_yd"]], float)
        s = {"position": None, "predicted": None, "cov": None, "rejected": False, "inflated": False, "gate": None, "after_gap": expired and xy is not None, "after_rejections": False}
        if xy is not None:
            self._measure(s, frame, time_s, xy, np.array([[r["mxx"], r["mxy"]], [r["mxy"], r["myy"]]], float))
            if s["position"] is not None:
                since = 0
        elif self.filter is not None:
            if since <= c.max_gap:
                self.filter.predict(time_s)
                s |= {"predicted": self.filter.mean[:2].copy(), "cov": floored(self.filter.cov[:2, :2] * (1 + 0.40 * since) ** 2, 1e-4), "inflated": True}
            else:
                self.filter = None
        return [self._report(r, frame, time_s, xy, since, s)]

    def _measure(self, s: dict, frame: int, time_s: float, xy: np.ndarray, cov: np.ndarray) -> None:
        c = self.config
        if self.filter is None:
            gap = None if self.measured is None else frame - self.measured_frame
            velocity = None
            if gap is not None and 0 < gap <= 2 * c.max_gap:
                velocity, s["after_gap"] = (xy - self.measured) * c.fps / gap, gap > 1
            self.filter = Kalman(xy, cov, time_s, c, velocity)
        else:
            self.filter.predict(time_s)
            if self.filter.updates > c.warmup:
                s["gate"] = self.filter.distance2(xy, cov)
            if s["gate"] is None or s["gate"] <= c.gate:
                self.filter.update(xy, cov)
            else:
                s |= {"rejected": True, "inflated": True, "predicted": self.filter.mean[:2].copy(), "cov": floored(self.filter.cov[:2, :2] * 1.5**2, 1e-4)}
                self.rejections += 1
                if self.rejections < c.max_rejections:
                    return
                # the measurements persist, so they are believed from here on
                self.filter = Kalman(xy, cov, time_s, c)
                s |= {"predicted": None, "after_rejections": True}
        s |= {"position": self.filter.mean[:2].copy(), "cov": self.filter.cov[:2, :2].copy()}
        self.rejections, self.measured, self.measured_frame = 0, xy, frame

    def _report(self, r: pd.Series, frame: int, time_s: float, xy: np.ndarray | None, since: int, s: dict) -> dict:
        c, position = self.config, s["position"]
        shown = position if position is not None else s["predicted"]
        moving = shown is not None and self.filter is not None
        velocity = self.filter.mean[2:].copy() if moving else np.zeros(2)
        speed = float(np.hypot(*velocity))
        acceleration = 0.0
        if self.reported_frame is not None and frame != self.reported_frame:
            acceleration = float(np.hypot(*(velocity - self.reported_velocity))) * c.fps / (frame - self.reported_frame)
        if position is not None:
            if self.accepted is not None:
                self.travelled += float(np.hypot(*(position - self.accepted)))
            self.accepted = position
        if shown is not None:
            self.reported_frame, self.reported_velocity = frame, velocity
        still = np.all(np.abs(velocity) < 1e-9)
        pair = lambda v: (None, None) if v is None else (float(v[0]), float(v[1]))
        (px, py), (qx, qy), (rx, ry) = pair(position), pair(s["predicted"]), pair(xy)
        cov = s["cov"] if shown is not None else None
        return {
            "frame_id": frame, "timestamp_s": round(time_s, 6), "geometry_state": r["geometry_state"], "x_coord_mode": r["x_coord_mode"], "track_state": "observed" if r["missed_frames"] == 0 else "coasted",
            "x_yd": px, "y_yd": py, "raw_x": rx, "raw_y": ry, "predicted_x": qx, "predicted_y": qy,
            "position_source": "measured_smoothed" if position is not None else "predicted_dead_reckoning" if s["predicted"] is not None else "none",
            "vx": round(float(velocity[0]), 4), "vy": round(float(velocity[1]), 4), "speed_yd_s": round(speed, 4), "direction_rad": 0.0 if still else round(math.atan2(velocity[1], velocity[0]), 4),
            "accel_yd_s2": round(min(acceleration, c.max_acceleration), 4), "is_acceleration_clipped": acceleration > c.max_acceleration, "is_speed_clipped": bool(moving and self.filter.clipped),
            "distance_cum_yd": round(self.travelled, 4), "cov_xx": None if cov is None else float(cov[0, 0]), "cov_xy": None if cov is None else float(cov[0, 1]), "cov_yy": None if cov is None else float(cov[1, 1]),
            "is_inflated": s["inflated"], "is_outlier_rejected": s["rejected"], "rejection_reason": FIELD_GATE if s["rejected"] else None,
            "is_measurement_used": position is not None, "gate_statistic": s["gate"], "missed_frames": int(r["missed_frames"]), "frames_since_measurement": since,
            "filter_age": 0 if self.filter is None else self.filter.updates, "reinit_after_gap": bool(s["after_gap"]), "reinit_after_rejections": s["after_rejections"], "projection_status": r["projection_status"],
            "coordinate_segment": self.segment, "coordinate_frame_id": None if self.key is None else self.key[1],
        }


SAMPLES = (
    "run_id int, track_id long, frame_id long, timestamp_s double, geometry_state string, x_coord_mode string, track_state string, x_yd double, y_yd double, raw_x double, raw_y double, predicted_x double, predicted_y double, "
    "position_source string, vx double, vy double, speed_yd_s double, direction_rad double, accel_yd_s2 double, is_acceleration_clipped boolean, is_speed_clipped boolean, distance_cum_yd double, cov_xx double, cov_xy double, "
    "cov_yy double, is_inflated boolean, is_outlier_rejected boolean, rejection_reason string, is_measurement_used boolean, gate_statistic double, missed_frames long, frames_since_measurement long, filter_age long, "
    "reinit_after_gap boolean, reinit_after_rejections boolean, projection_status string, coordinate_segment long, coordinate_frame_id string"
)


def measurements(tracks: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Tracks with geometry state, projected position, its covariance and the number of cuts so far.

    `tracks` also has box_id (the track), y1, y2, u, v, is_reliable, unreliable_reason, foot_confidence and missed_frames;
    `calibrations` also coordinate_frame_id and is_cut.
    """
    placed = project_footpoints(tracks, calibrations.drop("coordinate_frame_id", "is_cut"))
    cov = field_covariances(tracks, calibrations.drop("coordinate_frame_id", "is_cut")).select("run_id", "frame_id", "box_id", F.col("cov_xx").alias("mxx"), F.col("cov_xy").alias("mxy"), F.col("cov_yy").alias("myy"))
    sofar = Window.partitionBy("run_id").orderBy("frame_id")
    frames = calibrations.select("run_id", "frame_id", geometry_state().alias("geometry_state"), "coordinate_frame_id", F.sum(F.coalesce("is_cut", F.lit(False)).cast("int")).over(sofar).alias("n_cuts"))
    joined = placed.join(cov, ["run_id", "frame_id", "box_id"], "left").join(frames, ["run_id", "frame_id"], "left")
    last = F.last("n_cuts", ignorenulls=True).over(Window.partitionBy("run_id", "box_id").orderBy("frame_id"))
    joined = joined.withColumns({"geometry_state": F.coalesce("geometry_state", F.lit("unknown")), "n_cuts": F.coalesce(last, F.lit(0))})
    return joined.select("run_id", F.col("box_id").alias("track_id"), "frame_id", "geometry_state", "x_coord_mode", "coordinate_frame_id", "n_cuts", "x_yd", "y_yd", "mxx", "mxy", "myy", "missed_frames", "projection_status")


def build_trajectories(measured: DataFrame, config: TrajectoryConfig = TrajectoryConfig()) -> DataFrame:
    """Trajectory samples of every track, from rows as `measurements` gives."""
    return fold_in_order(measured, ["run_id", "track_id"], "frame_id", SAMPLES, lambda: Trajectory(config))


def trajectory_modes(samples: DataFrame) -> DataFrame:
    """The one mode of each track; tracks of several modes are uncalibrated."""
    return samples.groupBy("run_id", "track_id").agg(F.when(F.min("x_coord_mode") == F.max("x_coord_mode"), F.min("x_coord_mode")).otherwise("uncalibrated").alias("x_coord_mode"), F.count("*").alias("n_samples"))


def trajectory_stream(measured: DataFrame, config: TrajectoryConfig = TrajectoryConfig()) -> DataFrame:
    """The same over a stream of rows as `measurements` gives, whose n_cuts must count all cuts of the run so far."""
    return fold_stream(measured, ["run_id", "track_id"], "frame_id", SAMPLES, lambda: Trajectory(config))
