"""Geometry as column expressions: poses, plan frame, pinhole camera, facings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARTER = 1.5707963267948966
#: Facing number to (axis, sign).
FACINGS = {0: (0, 1), 1: (0, -1), 2: (1, 1), 3: (1, -1)}


def rotation(qx: Column, qy: Column, qz: Column, qw: Column) -> list[list[Column]]:
    """Rows of the rotation of a unit quaternion."""
    return [
        [1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy - qz * qw), 2 * (qx * qz + qy * qw)],
        [2 * (qx * qy + qz * qw), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz - qx * qw)],
        [2 * (qx * qz - qy * qw), 2 * (qy * qz + qx * qw), 1 - 2 * (qx * qx + qy * qy)],
    ]


def moved(r: list[list[Column]], p: tuple[Column, Column, Column], t: tuple[Column, Column, Column]) -> list[Column]:
    return [row[0] * p[0] + row[1] * p[1] + row[2] * p[2] + o for row, o in zip(r, t)]


def unprojected(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """Camera coordinates of a depth pixel."""
    return [(u - cx) / fx * depth, (v - cy) / fy * depth, depth]


def projected(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """Pixel of a point before the camera; null behind it."""
    z = F.when(z > 0, z)
    return [fx * x / z + cx, fy * y / z + cy]


def rescaled_centre(c: Column, scale: Column) -> Column:
    """A principal point after a resize, pixel centres staying where they are."""
    return (c + 0.5) * scale - 0.5


def to_plan(x: Column, z: Column, yaw: Column, ox: Column, oy: Column) -> list[Column]:
    """World to plan: turned by -yaw, z pointing the other way, less the origin."""
    c, s = F.cos(-yaw), F.sin(-yaw)
    return [c * x - s * -z - ox, s * x + c * -z - oy]


def from_plan(px: Column, py: Column, yaw: Column, ox: Column, oy: Column) -> list[Column]:
    c, s = F.cos(yaw), F.sin(yaw)
    x, y = px + ox, py + oy
    return [c * x - s * y, -(s * x + c * y)]


def wrapped_quarter(angle: Column) -> Column:
    """An angle modulo a quarter turn, within an eighth of zero."""
    return F.pmod(angle + QUARTER / 2, F.lit(QUARTER)) - QUARTER / 2


def facing(nx: Column, ny: Column, least: float = 0.85) -> Column:
    """Number of the axis direction a normal points in, -1 if in none; the first on ties."""
    best = F.greatest(nx, -nx, ny, -ny)
    return F.when(best < least, -1).when(nx == best, 0).when(-nx == best, 1).when(ny == best, 2).otherwise(3)


def turned_facing(f: Column, quarters: Column) -> Column:
    """A facing after quarter turns counter-clockwise."""
    order = F.array(*[F.lit(k) for k in (0, 2, 1, 3)])
    place = F.when(f == 0, 0).when(f == 2, 1).when(f == 1, 2).otherwise(3)
    return F.element_at(order, F.pmod(place + quarters, F.lit(4)) + 1)


def focal_pixels(f35: Column, w: Column, h: Column) -> Column:
    """Focal length in pixels from the 35 mm equivalent, by diagonals."""
    return f35 * F.hypot(w, h) / F.hypot(F.lit(36.0), F.lit(24.0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)
