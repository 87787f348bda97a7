"""Exact fixtures: point clouds of simulated flats, made by Spark from a table of rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOM = "scene int, room int, x0 double, y0 double, x1 double, y1 double, height double"
DOOR = "scene int, axis int, off double, lo double, hi double, top double"


def flat(spark: SparkSession, rooms: list[tuple], doors: list[tuple], step: float = 0.05) -> DataFrame:
    """Points (scene, x, y, z, nx, ny, nz, grp) on floors, ceilings and inner wall faces, y up, on a grid of `step`; doors are gaps.

    rooms as (scene, room, x0, y0, x1, y1, height), doors as (scene, axis of the wall's normal, offset, from, to, top).
    """
    r = spark.createDataFrame(rooms, ROOM)
    steps = lambda a, b: F.sequence(F.lit(0), F.floor(F.round((F.col(b) - F.col(a)) / step, 6) - 1).cast("int"))
    at = lambda a, k: F.col(a) + (F.col(k) + 0.5) * step
    grid = r.withColumn("i", F.explode(steps("x0", "x1"))).withColumn("j", F.explode(steps("y0", "y1")))
    level = lambda y, ny: grid.select("scene", at("x0", "i").alias("x"), y.alias("y"), at("y0", "j").alias("z"), F.lit(0.0).alias("nx"), F.lit(ny).alias("ny"), F.lit(0.0).alias("nz"), F.col("room").alias("grp"))
    parts = [level(F.lit(0.0), 1.0), level(F.col("height"), -1.0)]
    tall = r.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.round(F.col("height") / step, 6) - 1).cast("int")))).withColumn("y", (F.col("k") + 0.5) * step)
    d = spark.createDataFrame(doors, DOOR)
    for axis, (along, a0, a1) in enumerate((("z", "y0", "y1"), ("x", "x0", "x1"))):
        for end, sign in ((("x0", "x1"), ("y0", "y1"))[axis][0], 1.0), ((("x0", "x1"), ("y0", "y1"))[axis][1], -1.0):
            w = tall.withColumn("i", F.explode(steps(a0, a1))).withColumn("s", at(a0, "i")).withColumn("off", F.col(end))
            gap = (w.scene == d.scene) & (d.axis == axis) & (F.abs(w.off - d.off) < 0.2) & (w.s >= d.lo) & (w.s <= d.hi) & (w.y <= d.top)
            w = w.join(F.broadcast(d), gap, "left_anti")
            x, z = (F.col("off"), F.col("s")) if axis == 0 else (F.col("s"), F.col("off"))
            parts.append(w.select("scene", x.alias("x"), "y", z.alias("z"), F.lit(sign if axis == 0 else 0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(sign if axis == 1 else 0.0).alias("nz"), F.col("room").alias("grp")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
