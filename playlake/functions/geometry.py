"""Plane geometry as Columns: boxes, homographies, 2x2 covariances, motion, wrapped angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Denominators below this share of the terms they are made of count as the horizon.
HORIZON = 1e-12
#: Determinant of a matrix scaled to a greatest entry of 1 below which its rank counts as less than 3.
SINGULAR = 1e-15
#: Squared lengths that hold 68 and 95 per cent of a two-dimensional normal distribution, and its median.
CHI2_68, CHI2_95, CHI2_MEDIAN = 2.278, 5.991, 1.386
#: Least variance of a field position, in square yards.
COV_FLOOR = 1e-4

Box = tuple[Column, Column, Column, Column]
Cov = tuple[Column, Column, Column]


def rounded(c: Column, places: int) -> Column:
    """A number rounded half away from zero at the product with a power of ten, as SQL engines do.

    Spark's own rounding goes by the number's shortest decimal form, which differs where the product is just a half.
    """
    return F.round(c * 10.0**places, 0) / 10.0**places


def length(dx: Column, dy: Column) -> Column:
    """Length of a vector by the root of its squares; unlike `hypot`, bit by bit what SQL computes but for its `pow`."""
    return F.sqrt(dx * dx + dy * dy)


def box_iou(a: Box, b: Box) -> Column:
    """Intersection over union of two (x1, y1, x2, y2) boxes; 0 without overlap."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = lambda x: F.greatest((x[2] - x[0]) * (x[3] - x[1]), F.lit(1e-6))
    return inter / (area(a) + area(b) - inter)


def lower_body_overlap(target: Box, other: Box) -> tuple[Column, Column]:
    """Shares of a box that another covers: of its width, and of the area of its lowest third."""
    w, h = (F.greatest(target[i + 2] - target[i], F.lit(1e-6)) for i in (0, 1))
    across = F.greatest(F.lit(0.0), F.least(target[2], other[2]) - F.greatest(target[0], other[0]))
    top = target[1] + h * (2.0 / 3.0)
    down = F.greatest(F.lit(0.0), F.least(target[3], other[3]) - F.greatest(top, other[1]))
    return across / w, across * down / F.greatest(w * (target[3] - top), F.lit(1e-6))


def _largest(h: list[Column]) -> Column:
    return F.greatest(*(F.abs(c) for c in h))


def determinant(h: list[Column]) -> Column:
    """Determinant of a row-major 3x3 matrix."""
    return h[0] * (h[4] * h[8] - h[5] * h[7]) - h[1] * (h[3] * h[8] - h[5] * h[6]) + h[2] * (h[3] * h[7] - h[4] * h[6])


def is_homography(h: list[Column]) -> Column:
    """Whether a matrix is finite and of full rank, whatever its scale; never NULL.

    Full rank is read off the determinant of the matrix scaled to a greatest entry of 1.
    """
    scale = _largest(h)
    finite = (scale > 0) & (scale < float("inf"))
    for c in h:
        finite = finite & c.isNotNull() & ~F.isnan(c)
    return F.coalesce(finite & (F.abs(determinant([c / scale for c in h])) > SINGULAR), F.lit(False))


def project(h: list[Column], u: Column, v: Column) -> tuple[Column, Column]:
    """A point under a row-major 3x3 homography; NULL at the horizon, whatever the matrix's scale."""
    w = h[6] * u + h[7] * v + h[8]
    scale = F.abs(h[6] * u) + F.abs(h[7] * v) + F.abs(h[8])
    safe = F.when(F.abs(w) > scale * HORIZON, w)
    return (h[0] * u + h[1] * v + h[2]) / safe, (h[3] * u + h[4] * v + h[5]) / safe


def jacobian(h: list[Column], u: Column, v: Column) -> tuple[Column, Column, Column, Column]:
    """Partial derivatives (dx/du, dx/dv, dy/du, dy/dv) of `project`."""
    x, y = project(h, u, v)
    w = h[6] * u + h[7] * v + h[8]
    return (h[0] - x * h[6]) / w, (h[1] - x * h[7]) / w, (h[3] - y * h[6]) / w, (h[4] - y * h[7]) / w


def is_plausible_homography(h: list[Column], width: float = 900.0, height: float = 506.0) -> Column:
    """Whether a view isn't mirrored, and 100 pixels at its centre are between half a yard and 35 yards; never NULL."""
    at = [project(h, F.lit(u), F.lit(v)) for u, v in ((width / 2, height / 2), (width / 2 + 100, height / 2), (width / 2, height / 2 - 100))]
    (rx, ry), (ux, uy) = ((at[i][0] - at[0][0], at[i][1] - at[0][1]) for i in (1, 2))
    sane = (F.abs(determinant(h)) >= 1e-12) & (rx * uy - ry * ux > 0)
    for x, y in ((rx, ry), (ux, uy)):
        sane = sane & (F.hypot(x, y) > 0.5) & (F.hypot(x, y) < 35.0)
    return F.coalesce(sane, F.lit(False))


def homography_jump(old: list[Column], new: list[Column], width: float, height: float) -> Column:
    """Greatest distance between where two homographies put three points of the middle line."""
    moved = []
    for share in (0.5, 0.25, 0.75):
        (x0, y0), (x1, y1) = (project(h, F.lit(width * share), F.lit(height * 0.5)) for h in (old, new))
        moved.append(F.hypot(x1 - x0, y1 - y0))
    return F.greatest(*moved)


def propagate(j: tuple[Column, ...], cov: Cov, inflation: Column, floor: float) -> Cov:
    """J S J' * inflation^2 + floor^2 I of a symmetric (xx, xy, yy) covariance."""
    (a, b, c, d), (xx, xy, yy) = j, cov
    k = inflation
    return (
        (a * a * xx + 2 * a * b * xy + b * b * yy) * k * k + floor**2,
        (a * c * xx + (a * d + b * c) * xy + b * d * yy) * k * k,
        (c * c * xx + 2 * c * d * xy + d * d * yy) * k * k + floor**2,
    )


def with_least_variance(cov: Cov, floor: float = COV_FLOOR) -> Cov:
    """The covariance with its principal variances raised to a floor, in closed form."""
    xx, xy, yy = cov
    mean, half = (xx + yy) / 2, (xx - yy) / 2
    root = F.sqrt(half * half + xy * xy)
    high, low = F.greatest(mean + root, F.lit(floor)), F.greatest(mean - root, F.lit(floor))
    # a round covariance has no principal direction, so any will do
    c, s = (F.when(root > 0, x / root).otherwise(o) for x, o in ((half, 1.0), (xy, 0.0)))
    centre, reach = (high + low) / 2, (high - low) / 2
    return centre + reach * c, reach * s, centre - reach * c


def inflate(cov: Cov, factor: Column) -> Cov:
    """The covariance of errors that are so many times as large, with its least variance."""
    return with_least_variance(tuple(c * factor * factor for c in cov))  # type: ignore[arg-type]


def footpoint_covariance(y1: Column, y2: Column, confidence: Column, extra_px: float = 0.0, edge_px: float = 1.0, reference_height: float = 50.0) -> Cov:
    """Assumed pixel covariance of a box's bottom centre; grows with the box, and with doubt about it."""
    scale = F.greatest(F.lit(0.5), F.greatest(F.lit(1.0), y2 - y1) / max(1.0, reference_height))
    sigma = (edge_px * scale + extra_px) * (1 + 1.5 * F.greatest(F.lit(0.0), 1 - confidence))
    sigma = F.greatest(F.lit(0.30), sigma)
    # 0.70 as wide as high, with a correlation of 0.20; decimal factors keep values of few digits on theirs
    return with_least_variance((0.49 * sigma * sigma, 0.14 * sigma * sigma, sigma * sigma), 0.30**2 * 0.25)


def mahalanobis2(dx: Column, dy: Column, cov: Cov) -> Column:
    """Squared Mahalanobis length of a difference; NULL for a singular covariance."""
    xx, xy, yy = cov
    det = xx * yy - xy * xy
    return (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / F.when(det != 0, det)


def ellipse(cov: Cov) -> tuple[Column, Column, Column]:
    """One-sigma major and minor axes, and the major axis' angle."""
    xx, xy, yy = cov
    mean, half = (xx + yy) / 2, (xx - yy) / 2
    root = F.sqrt(half * half + xy * xy)
    return F.sqrt(mean + root), F.sqrt(F.greatest(mean - root, F.lit(0.0))), F.atan2(2 * xy, xx - yy) / 2


def wrap_angle(a: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def speed_and_heading(vx: Column, vy: Column) -> tuple[Column, Column]:
    """Length and angle of a velocity; the angle of a standstill is 0."""
    still = (F.abs(vx) < 1e-9) & (F.abs(vy) < 1e-9)
    return F.hypot(vx, vy), F.when(still, 0.0).otherwise(F.atan2(vy, vx))


def clip_speed(vx: Column, vy: Column, most: float) -> tuple[Column, Column, Column]:
    """The velocity, shortened to a greatest speed, and whether it was shortened."""
    speed = F.hypot(vx, vy)
    fast = speed > most
    share = F.when(fast, F.lit(most) / speed).otherwise(1.0)
    return vx * share, vy * share, fast


def confidence_inflation(confidence: Column) -> Column:
    """How much a covariance grows for a calibration of low confidence."""
    return 1 + 2.5 * (1 - F.least(F.greatest(confidence, F.lit(0.45)), F.lit(1.0)))


def fixed_noise(player: Column, frame: Column, channel: int) -> Column:
    """A number in [-1, 1) that depends on the arguments alone."""
    wave = F.sin(player * 12.9898 + frame * 78.233 + channel * 37.719) * 43758.5453
    return (wave - F.floor(wave)) * 2.0 - 1.0


def yards_to_feet(yards: Column) -> Column:
    return yards * 3.0


def feet_to_yards(feet: Column) -> Column:
    return feet / 3.0
