"""A PySpark engine for tables of play-tracking data: observations, trajectories, plays, scores."""
