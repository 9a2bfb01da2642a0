"""Optimal one-to-one assignment per frame: as many pairs as possible, then the greatest total score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlake.shipping import ship_package


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matrix in which NaN forbids a pair; scores lie within 0 and 1.

    Each row is added by a cheapest alternating path over reduced costs; a pair is worth more than any
    sum of scores, so the number of pairs comes first.
    """
    rows, columns = score.shape
    if not rows or not columns:
        return []
    size = max(rows, columns)
    value = np.zeros((size, size))
    allowed = ~np.isnan(score)
    value[:rows, :columns][allowed] = score[allowed] + size + 1
    cost = value.max() - value
    row_price, column_price, owner = np.zeros(size), np.zeros(size), np.full(size, -1)
    for new in range(size):
        distance, came, done = cost[new] - row_price[new] - column_price, np.full(size, new), np.zeros(size, bool)
        while True:
            at = int(np.argmin(np.where(done, np.inf, distance)))
            done[at] = True
            if owner[at] < 0:
                break
            r = owner[at]
            through = distance[at] + cost[r] - row_price[r] - column_price
            better = ~done & (through < distance)
            distance[better], came[better] = through[better], r
        reached = distance[at]
        for c in np.flatnonzero(done):
            if c != at:
                column_price[c] += distance[c] - reached
                row_price[owner[c]] += reached - distance[c]
        row_price[new] += reached
        while True:  # turn the path around
            r = came[at]
            previous = int(np.flatnonzero(owner == r)[0]) if r != new else -1
            owner[at] = r
            if r == new:
                break
            at = previous
    return [(int(r), int(c)) for c, r in enumerate(owner) if r < rows and c < columns and allowed[r, c]]


#: Frames whose competing pairs one Python group solves together.
GROUP_FRAMES = 64


def solve_frames(pairs: pd.DataFrame) -> pd.DataFrame:
    """The chosen pairs of all frames of a group; a pair that occurs twice is refused."""
    chosen = []
    for _, frame in pairs.sort_values(["frame_id", "gt_id", "pred_id"]).groupby("frame_id"):
        if frame.duplicated(["gt_id", "pred_id"]).any():
            raise ValueError("assignment: a pair of ids occurs twice in a frame")
        matrix = frame.pivot(index="gt_id", columns="pred_id", values="iou")
        keys = {(matrix.index[r], matrix.columns[c]) for r, c in assign(matrix.to_numpy(float))}
        chosen.append(frame[[k in keys for k in zip(frame["gt_id"], frame["pred_id"], strict=True)]])
    return pd.concat(chosen) if chosen else pairs


def assign_pairs(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """Of candidate pairs (run_id, frame_id, gt_id, pred_id, iou), the optimal assignment per frame.

    Pairs whose ends have no other candidate are taken as they are. Only the others, which compete, go to
    Python, some frames at a time; a frame holds some tens of players, which bounds a group.
    """
    ship_package(spark)
    frame = ["run_id", "frame_id"]
    rivals = {side: F.count("*").over(Window.partitionBy(*frame, side)) for side in ("gt_id", "pred_id")}
    held = pairs.repartition(*frame).withColumn("_g", rivals["gt_id"]).withColumn("_p", rivals["pred_id"])
    alone = (F.col("_g") == 1) & (F.col("_p") == 1)
    competing = held.where(~alone).select(*pairs.columns, F.floor(F.col("frame_id") / GROUP_FRAMES).alias("_group"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        return solve_frames(group.drop(columns="_group"))

    solved = competing.groupBy("run_id", "_group").applyInPandas(solve, pairs.schema)
    return held.where(alone).select(*pairs.columns).unionByName(solved)
