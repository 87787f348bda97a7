"""From a point cloud to a layout: levels, wall lines, rooms. The relational part is aggregates and windows; rooms are a kernel a scene."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import kernels, outlines, spatial, windows


@dataclass(frozen=True)
class LayoutOptions:
    """Sizes in metres."""

    grid: float = 0.05
    level_bin: float = 0.02
    band: tuple[float, float] = (0.08, 0.08)
    least_wall: float = 0.25
    wall_span: float = 0.9


def levels(points: DataFrame, up: bool, options: LayoutOptions) -> DataFrame:
    """Floor (lowest) or ceiling (highest) of each scene: the outermost bin that holds a quarter of the strongest one's points, by its median."""
    facing = points.where("ny > 0.9" if up else "ny < -0.9").withColumn("bin", spatial.cell(F.col("y"), options.level_bin))
    n = facing.groupBy("scene", "bin").agg(F.count("*").alias("n"))
    strong = n.withColumn("most", F.max("n").over(Window.partitionBy("scene"))).where("n >= 0.25 * most")
    pick = strong.groupBy("scene").agg((F.min("bin") if up else F.max("bin")).alias("bin"))
    near = facing.alias("p").join(pick.withColumnRenamed("bin", "at"), "scene").where(F.abs(F.col("bin") - F.col("at")) <= 1)
    return near.groupBy("scene").agg(F.median("y").alias("floor" if up else "ceiling"))


def layout(points: DataFrame, options: LayoutOptions | None = None) -> dict[str, DataFrame]:
    """levels (scene, floor, ceiling, height), lines (scene, facing, line, first, last, ...), rooms (scene, room, cells, area) and their
    outlines (scene, room, seq, x, z, area)."""
    o = options or LayoutOptions()
    both = levels(points, True, o).join(levels(points, False, o), "scene").withColumn("height", F.col("ceiling") - F.col("floor"))
    h = points.join(both, "scene").withColumn("h", F.col("y") - F.col("floor"))
    side = h.where((F.abs("ny") < 0.25) & (F.col("h") > o.band[0]) & (F.col("h") < F.col("height") - o.band[1]))
    facing = F.when(F.col("nx") > 0.85, 0).when(F.col("nx") < -0.85, 1).when(F.col("nz") > 0.85, 2).when(F.col("nz") < -0.85, 3).otherwise(-1)
    cells = side.select("scene", facing.alias("facing"), spatial.cell(F.col("x"), o.grid).alias("ix"), spatial.cell(F.col("z"), o.grid).alias("iz"), "h")
    walls = cells.groupBy("scene", "facing", "ix", "iz").agg(F.count("*").alias("n"), (F.max("h") - F.min("h")).alias("span")).where(F.col("span") >= o.wall_span)
    across = F.when(F.col("facing") < 2, F.col("ix")).otherwise(F.col("iz"))
    along = F.when(F.col("facing") < 2, F.col("iz")).otherwise(F.col("ix"))
    lines = windows.islands(walls.where("facing >= 0").select("scene", "facing", across.alias("line"), along.alias("k")), 15, o.least_wall, 0.5, o.grid, "scene", "facing", "line")
    floor = h.where((F.col("ny") > 0.9) & (F.abs("h") < 0.04)).select("scene", spatial.cell(F.col("x"), o.grid).alias("ix"), spatial.cell(F.col("z"), o.grid).alias("iz")).distinct()
    axis, sign = F.when(F.col("facing") < 2, 0).otherwise(1), F.when(F.col("facing") % 2 == 0, 1).otherwise(-1)
    # a wall's points lie on its face: at the cell's lower or upper side, as it looks
    face = lines.select("scene", axis.alias("axis"), sign.alias("sign"), (F.col("line") * o.grid).alias("off"), (F.col("first") * o.grid).alias("lo"), ((F.col("last") + 1) * o.grid).alias("hi"))
    return {"levels": both, "lines": lines, "rooms": kernels.rooms_of(floor, o.grid), "outlines": outlines.room_outlines(floor, face, o.grid)}
