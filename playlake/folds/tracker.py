"""Multi-object tracking in the image: overlap and distance against damped constant-velocity predictions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlake.folds.ordered import fold_in_order, fold_stream
from playlake.operators.assignment import assign

DAMPING = 0.85
#: Identities are exact to so small a preference for the lower track, then for the earlier detection.
TRACK_TIE, DETECTION_TIE = 1e-7, 1e-9


@dataclass(frozen=True)
class TrackerConfig:
    """Parameters of the tracker; each must lie within its range."""

    max_missed: int = 3
    min_iou: float = 0.15
    max_distance_px: float = 65.0
    min_score: float = 0.22
    min_birth_confidence: float = 0.35
    velocity_weight: float = 0.60
    strong_confidence: float | None = None
    recovery_hits: int = 3

    def __post_init__(self) -> None:
        shares = (self.min_iou, self.min_score, self.min_birth_confidence, self.velocity_weight)
        if not all(math.isfinite(s) and 0 <= s <= 1 for s in shares) or not (math.isfinite(self.max_distance_px) and self.max_distance_px > 0):
            raise ValueError("tracker: shares lie within 0 and 1, and the distance is positive")
        if self.max_missed < 0 or self.recovery_hits < 1 or not (self.strong_confidence is None or 0.1 < self.strong_confidence <= 1):
            raise ValueError("tracker: counts aren't negative, and strong_confidence lies within 0.1 and 1")


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of `a` with every box of `b`."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(high - low, 0, None).prod(axis=2)
    area = [np.maximum((x[:, 2:] - x[:, :2]).prod(axis=1), 1e-6) for x in (a, b)]
    return inter / (area[0][:, None] + area[1][None] - inter)


@dataclass
class Votes:
    """Decaying votes of a track's appearances for the two teams."""

    a: float = 0.0
    b: float = 0.0

    def add(self, team: str | None, confidence: float | None) -> tuple[str, float]:
        """Count an appearance, and return the track's team and confidence."""
        sure = 0.0 if confidence is None else float(confidence)
        if team in ("TEAM_A", "TEAM_B"):
            self.a, self.b = DAMPING * self.a + sure * (team == "TEAM_A"), DAMPING * self.b + sure * (team == "TEAM_B")
        total = self.a + self.b
        if total < 0.40:
            return "UNKNOWN", round(sure, 4)
        name, votes = ("TEAM_A", self.a) if self.a >= self.b else ("TEAM_B", self.b)
        now = sure if team == name else 0.70
        return name, round(min(0.99, max(0.45, 0.55 * votes / max(1e-6, total) + 0.45 * now)), 4)


@dataclass
class Track:
    """What is known of one identity; `box` and `foot` go on while it isn't observed."""

    track_id: int
    frame: int
    box: np.ndarray
    foot: np.ndarray
    confidence: float
    seen_frame: int
    seen_foot: np.ndarray
    velocity: np.ndarray = field(default_factory=lambda: np.zeros(2))
    age: int = 1
    missed: int = 0
    hits: int = 1
    recovered: bool = False
    votes: Votes = field(default_factory=Votes)
    team: tuple[str, float] = ("UNKNOWN", 0.0)

    def shift(self, frames: int) -> np.ndarray:
        """How far the track is expected to move: a geometric sum of ever smaller steps."""
        return self.velocity * DAMPING**self.missed * (1 - DAMPING**frames) / (1 - DAMPING)


class Tracker:
    """The fold: a step is one frame's detections, or a row without a box for a frame that has none."""

    def __init__(self, config: TrackerConfig = TrackerConfig()):
        self.config, self.tracks, self.next_id, self.recoveries = config, [], 1, 0

    def step(self, rows: pd.DataFrame) -> list[dict]:
        frame = int(rows["frame_id"].iloc[0])
        if bool(rows["is_cut"].fillna(False).any()):
            self.tracks = []  # another camera can't continue identities; their numbers aren't used again
        c = self.config
        self.tracks = [t for t in self.tracks if t.missed + frame - t.frame - 1 <= c.max_missed]
        found = rows[rows["x1"].notna()].sort_values(["x1", "y1", "box_id"]).reset_index(drop=True)
        boxes, feet = found[["x1", "y1", "x2", "y2"]].to_numpy(float), found[["u", "v"]].to_numpy(float)
        shifts = [t.shift(frame - t.frame) for t in self.tracks]
        chosen = self._associate(boxes, feet, found["confidence"].to_numpy(float), shifts)
        kept = []
        for at, t in enumerate(self.tracks):
            if at in chosen:
                self._observe(t, frame, boxes[chosen[at]], feet[chosen[at]], found.iloc[chosen[at]])
                kept.append(t)
            elif self._coast(t, frame, shifts[at]):
                kept.append(t)
        least = max(c.min_birth_confidence, c.strong_confidence or 0.0)
        for j in sorted(set(range(len(found))) - set(chosen.values())):
            d = found.iloc[j]
            if d["confidence"] >= least:
                t = Track(self.next_id, frame, boxes[j], feet[j], float(d["confidence"]), frame, feet[j])
                t.team = t.votes.add(_text(d["team"]), _number(d["team_confidence"]))
                self.next_id += 1
                kept.append(t)
        self.tracks = sorted(kept, key=lambda t: t.track_id)
        return [_row(t) for t in self.tracks]

    def _associate(self, boxes: np.ndarray, feet: np.ndarray, confidence: np.ndarray, shifts: list[np.ndarray]) -> dict[int, int]:
        """Which detection continues which track."""
        c, ts = self.config, self.tracks
        if not ts or not len(boxes):
            return {}
        iou = iou_matrix(np.array([t.box + np.tile(s, 2) for t, s in zip(ts, shifts, strict=True)]), boxes)
        apart = np.linalg.norm(np.array([t.foot + s for t, s in zip(ts, shifts, strict=True)])[:, None] - feet[None], axis=2)
        reach = np.array([c.max_distance_px * (1 + 0.35 * t.missed) for t in ts])[:, None]
        score = 0.55 * iou + 0.45 * np.clip(1 - apart / reach, 0, None)
        valid = (score >= c.min_score) & ((iou >= c.min_iou) | (apart <= reach))
        score = score - TRACK_TIE * np.array([t.track_id for t in ts])[:, None] - DETECTION_TIE * np.arange(len(boxes))
        chosen: dict[int, int] = {}

        def match(rows: list[int], columns: list[int], ok: np.ndarray) -> None:
            if rows and columns:
                part = np.ix_(rows, columns)
                chosen.update({rows[r]: columns[k] for r, k in assign(np.where(ok[part], score[part], np.nan))})

        everyone = list(range(len(ts)))
        if c.strong_confidence is None:
            match(everyone, list(range(len(boxes))), valid)
            return chosen
        match(everyone, np.flatnonzero(confidence >= c.strong_confidence).tolist(), valid)
        # a weak box must overlap a proven track; nearness alone is no evidence
        proven = [i for i in everyone if i not in chosen and ts[i].hits >= c.recovery_hits]
        match(proven, np.flatnonzero((confidence >= 0.1) & (confidence < c.strong_confidence)).tolist(), valid & (iou >= 0.3))
        return chosen

    def _observe(self, t: Track, frame: int, box: np.ndarray, foot: np.ndarray, d: pd.Series) -> None:
        gap = frame - t.seen_frame
        seen = (foot - t.seen_foot) / gap
        fresh = t.hits == 1 and t.missed == 0
        w = self.config.velocity_weight
        t.velocity = np.round(seen if fresh else w * seen + (1 - w) * t.velocity, 4)
        t.age += max(1, frame - t.frame)
        t.frame, t.box, t.foot, t.seen_frame, t.seen_foot = frame, box, foot, frame, foot
        t.missed, t.hits, t.confidence, t.recovered = 0, t.hits + 1, float(d["confidence"]), gap > 1
        self.recoveries += t.recovered
        t.team = t.votes.add(_text(d["team"]), _number(d["team_confidence"]))

    def _coast(self, t: Track, frame: int, shift: np.ndarray) -> bool:
        gap = frame - t.frame
        t.missed, t.age, t.frame, t.recovered = t.missed + gap, t.age + gap, frame, False
        if t.missed > self.config.max_missed:
            return False
        t.box, t.foot = np.round(t.box + np.tile(shift, 2), 3), np.round(t.foot + shift, 3)
        t.confidence = round(t.confidence * 0.75, 4)
        return True


def _text(v) -> str | None:
    return v if isinstance(v, str) else None


def _number(v) -> float | None:
    return None if v is None or v != v else float(v)


def _row(t: Track) -> dict:
    x1, y1, x2, y2 = (float(v) for v in t.box)
    return {
        "frame_id": t.frame, "track_id": t.track_id, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "u": float(t.foot[0]), "v": float(t.foot[1]), "confidence": t.confidence, "vu": float(t.velocity[0]),
        "vv": float(t.velocity[1]), "age": t.age, "missed_frames": t.missed, "hits": t.hits, "recovered": bool(t.recovered), "team": t.team[0], "team_confidence": t.team[1],
    }


TRACKS = "run_id int, frame_id long, track_id long, x1 double, y1 double, x2 double, y2 double, u double, v double, confidence double, vu double, vv double, age long, missed_frames long, hits long, recovered boolean, team string, team_confidence double"
_INPUT = ["run_id", "frame_id", "is_cut", "box_id", "x1", "y1", "x2", "y2", "u", "v", "confidence", "team", "team_confidence"]


def tracker_input(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections of each of `frames` (run_id, frame_id, is_cut), with an empty row for frames without any."""
    return frames.join(detections, ["run_id", "frame_id"], "left").select(*_INPUT)


def track(frames: DataFrame, detections: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """Tracks of each run and frame, coasting ones included. Frames of a run must not repeat."""
    return fold_in_order(tracker_input(frames, detections), ["run_id"], "frame_id", TRACKS, lambda: Tracker(config))


def track_stream(stream: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """The same over a stream of rows as `tracker_input` gives."""
    return fold_stream(stream, ["run_id"], "frame_id", TRACKS, lambda: Tracker(config))


def observed_only(tracks: DataFrame) -> DataFrame:
    """Tracks without those that coast."""
    return tracks.where(F.col("missed_frames") == 0)
