"""Which samples count as evidence. The consumers' definitions differ on purpose and stay separate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys under which positions compare: over time within a track, and between tracks at one frame.
TEMPORAL = ("coordinate_frame_id", "coordinate_segment", "x_coord_mode")
SHARED = ("coordinate_frame_id", "x_coord_mode")


def is_finite(name: str) -> Column:
    """Whether a column is neither NULL, NaN nor infinite; never NULL itself."""
    c = F.col(name).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def _accepted() -> Column:
    """An accepted measurement of an observed player, with a position."""
    measured = (F.col("position_source") == "measured_smoothed") & F.col("is_measurement_used") & ~F.col("is_outlier_rejected")
    return F.coalesce(measured & (F.col("track_state") == "observed") & F.col("x_yd").isNotNull() & F.col("y_yd").isNotNull(), F.lit(False))


def _placed() -> Column:
    """A finite position under known geometry."""
    known = (F.col("geometry_state") != "unknown") & (F.col("x_coord_mode") != "uncalibrated")
    return F.coalesce(known, F.lit(False)) & is_finite("x_yd") & is_finite("y_yd")


def is_formation_usable() -> Column:
    """Samples that formations use: accepted and placed, with or without an identified frame of reference."""
    return _accepted() & _placed()


def is_usable() -> Column:
    """Samples that routes, events and play metrics use: also identified and at a finite time."""
    return is_formation_usable() & F.col("coordinate_frame_id").isNotNull() & is_finite("timestamp_s")


def evidence_bucket() -> Column:
    """Why a sample is or isn't motion evidence; the first reason wins, and each sample has one.

    Motion evidence needs an accepted measurement, whatever its geometry state or mode.
    """
    return (
        F.when(F.col("is_outlier_rejected"), "rejected")
        .when(F.col("position_source") == "predicted_dead_reckoning", "dead_reckoning")
        .when((F.col("position_source") == "none") | F.col("x_yd").isNull(), "unprojected")
        .when(F.col("track_state") != "observed", "coasted")
        .when(~_accepted(), "unprojected")
        .otherwise("usable")
    )
