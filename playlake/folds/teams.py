"""Two appearances per run: the darker and the lighter team's centroids, carried from frame to frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from playlake.folds.ordered import fold_in_order

#: Rounds of the two-median clustering, and how far medians may move in the last one.
ROUNDS, SETTLED = 12, 1e-3
#: Share of the earlier centroid that stays when a frame's is blended in.
KEPT = 0.75


def two_medians(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of two clusters by medians, from the darkest and the lightest row on; the darker one comes first."""
    low, high = int(np.argmin(features[:, 0])), int(np.argmax(features[:, 0]))
    if low == high:
        low, high = 0, len(features) - 1
    centres = np.stack([features[low], features[high]])
    for _ in range(ROUNDS if len(features) > 1 else 0):
        apart = np.linalg.norm(features[:, None] - centres[None], axis=2)
        first = apart[:, 0] <= apart[:, 1]
        if first.all() or not first.any():
            break
        moved = np.stack([np.median(features[first], axis=0), np.median(features[~first], axis=0)])
        settled = np.allclose(moved, centres, atol=SETTLED)
        centres = moved
        if settled:
            break
    a, b = centres
    darker = a[0] < b[0] - 1e-4 or (abs(a[0] - b[0]) <= 1e-4 and a[1] <= b[1])
    return (a, b) if darker else (b, a)


class Centroids:
    """The fold: a step is a frame's usable torso features; the result are the centroids that its boxes are judged by."""

    def __init__(self, least_apart: float = 14.0):
        self.least_apart, self.pair = least_apart, None

    def step(self, rows: pd.DataFrame) -> list[dict]:
        usable = [np.asarray(f, float) for f, ok in zip(rows["feature"], rows["is_usable"], strict=True) if ok and f is not None]
        if len(usable) >= 2:
            a, b = two_medians(np.stack(usable))
            if np.linalg.norm(a - b) >= self.least_apart:
                if self.pair is not None:
                    a, b = (KEPT * old + (1 - KEPT) * new for old, new in zip(self.pair, (a, b), strict=True))
                    if a[0] > b[0]:
                        a, b = b, a
                self.pair = (a, b)
        a, b = self.pair or (None, None)
        return [{"frame_id": int(rows["frame_id"].iloc[0]), "centroid_a": None if a is None else a.tolist(), "centroid_b": None if b is None else b.tolist()}]


def session_centroids(features: DataFrame, least_apart: float = 14.0) -> DataFrame:
    """Centroids of each run and frame, from features (run_id, frame_id, box_id, feature, is_usable) up to that frame."""
    return fold_in_order(features, ["run_id"], "frame_id", "run_id int, frame_id long, centroid_a array<double>, centroid_b array<double>", lambda: Centroids(least_apart))
