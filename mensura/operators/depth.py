"""From depth pixels to points and rays in the world."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from .measures import flying_pixels, normals


@dataclass(frozen=True)
class DepthOptions:
    """Fixed values of the trust in a pixel, in metres and grades of confidence, and how many pixels are passed over."""

    near: float = 0.25
    far: float = 4.5
    least: int = 2
    stride: int = 2
    scale: float = 1.0
    offset: float = 0.0


def corrected(pixels: DataFrame, options: DepthOptions) -> DataFrame:
    """Depths scaled and moved; a depth of zero is one that is missing, and stays so."""
    return pixels.withColumn("d", F.when(F.col("d") > 0, F.col("d") * options.scale + options.offset).otherwise(F.col("d") * options.scale))


def trusted(pixels: DataFrame, options: DepthOptions) -> DataFrame:
    """Pixels (frame, r, c, d, conf) in range, sure enough, and not on an edge of depth."""
    flying = flying_pixels(pixels).where("flying").select("frame", "r", "c")
    sure = pixels.where((F.col("d") > options.near) & (F.col("d") < options.far) & (F.col("conf") >= options.least))
    return sure.join(flying, ["frame", "r", "c"], "left_anti")


def in_camera(pixels: DataFrame, k: tuple[float, float, float, float]) -> DataFrame:
    """Adds x, y, z in the camera's frame; k is (fx, fy, cx, cy)."""
    x, y, z = geometry.unprojected(F.col("c"), F.col("r"), F.col("d"), *map(F.lit, k))
    return pixels.withColumns({"x": x, "y": y, "z": z})


def in_world(rows: DataFrame, frames: DataFrame, *vectors: tuple[str, str, str], place: tuple[str, str, str] | None = ("x", "y", "z")) -> DataFrame:
    """Points and directions turned into the world by their frame's pose (frame, qx, qy, qz, qw, px, py, pz)."""
    both = rows.join(frames, "frame")
    r = geometry.rotation(*(F.col(f"q{c}") for c in "xyzw"))
    zero = (F.lit(0.0),) * 3
    out = {}
    for names, origin in [(v, zero) for v in vectors] + ([(place, tuple(F.col(f"p{c}") for c in "xyz"))] if place else []):
        out |= dict(zip(names, geometry.moved(r, tuple(F.col(n) for n in names), origin)))
    return both.withColumns(out).select(*rows.columns)


def _strided(rows: DataFrame, stride: int) -> DataFrame:
    return rows.where((F.col("r") % stride == 0) & (F.col("c") % stride == 0))


def backprojected(pixels: DataFrame, frames: DataFrame, k: tuple[float, float, float, float], options: DepthOptions | None = None) -> DataFrame:
    """(frame, r, c, x, y, z, nx, ny, nz): world points and unit normals of every stride-th pixel that is trusted, as are the four that give
    its normal."""
    o = options or DepthOptions()
    points = in_camera(trusted(corrected(pixels, o), o), k).select("frame", "r", "c", "x", "y", "z")
    both = _strided(points, o.stride).join(normals(points), ["frame", "r", "c"])
    return in_world(both, frames, ("nx", "ny", "nz"))


def ray_ends(pixels: DataFrame, frames: DataFrame, k: tuple[float, float, float, float], stride: int = 8, far: float = 6.0) -> DataFrame:
    """World ends of observed rays; less trust is needed than for points."""
    seen = _strided(pixels, stride).where((F.col("d") > DepthOptions.near) & (F.col("d") < far) & (F.col("conf") >= 1))
    return in_world(in_camera(seen, k).select("frame", "r", "c", "x", "y", "z"), frames)


def miss_directions(pixels: DataFrame, frames: DataFrame, k: tuple[float, float, float, float], stride: int = 8, far: float = 5.0) -> DataFrame:
    """Unit world directions of pixels that gave no usable depth: glass, the sky, or too far."""
    gone = _strided(pixels, stride).where((F.col("d") <= 0) | (F.col("d") > far) | (F.col("conf") == 0))
    one = in_camera(gone.withColumn("d", F.lit(1.0)), k)
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + 1.0)
    unit = one.withColumns({"dx": F.col("x") / size, "dy": F.col("y") / size, "dz": 1.0 / size}).select("frame", "r", "c", "dx", "dy", "dz")
    return in_world(unit, frames, ("dx", "dy", "dz"), place=None)
