"""Ordered folds: tracker, trajectories and calibration, as sorted batch passes and as streaming state."""
