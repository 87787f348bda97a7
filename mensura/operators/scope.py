"""Scope of work: line items of repair from regions and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measure import imperial

#: Flood cuts in metres, framing distance, margins.
CUTS, JOIST, SEAL_MARGIN, MOLD_MARGIN = (0.6, 1.2), 0.4, 0.15, 0.6


def _line(condition, code, quantity, unit):
    return F.when(condition, F.struct(F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), quantity.cast("double").alias("quantity"), F.lit(unit).alias("unit")))


def lines(regions: DataFrame, rooms: DataFrame, flags: DataFrame) -> DataFrame:
    """(region, room, code, quantity, unit): what each region calls for. One row can give several lines; a surface is painted once."""
    base_flag = flags.where("rule = 'CDR-02'").select("region", F.lit(True).alias("wet_base")).distinct()
    first = F.row_number().over(Window.partitionBy("room", "face").orderBy("region")) == 1
    r = regions.join(rooms.select("room", "height", "length", "width"), "room").join(base_flag, "region", "left").withColumn("first", first)
    c = F.col
    w, h, area = c("u1") - c("u0"), c("v1") - c("v0"), (c("u1") - c("u0")) * (c("v1") - c("v0"))
    wall, ceiling, floor = (c("surface") == s for s in ("wall", "ceiling", "floor"))
    kind = lambda *names: c("class").isin(*names)
    cut_at = F.when(c("v1") + 0.3 <= CUTS[0], CUTS[0]).otherwise(CUTS[1])
    base = wall & kind("water_stain") & F.coalesce(c("wet_base"), F.lit(False))
    crack = F.sqrt(w * w + h * h) + 0.3
    board = (w + 2 * JOIST) * (h + 2 * JOIST)
    large = ceiling & kind("water_stain", "mold") & (area > 0.1)
    widest = F.greatest(w, h)
    found = F.array(
        _line(base, "WTR-FLDCUT", c("length"), "m"), _line(base, "DRY-INST", c("length") * cut_at, "m2"), _line(base, "FC-BASE", c("length"), "m"),
        _line(wall & ~base & kind("water_stain", "peeling_paint"), F.when(kind("water_stain"), "PNT-SEAL").otherwise("PNT-PREP"), (w + 2 * SEAL_MARGIN) * (h + 2 * SEAL_MARGIN), "m2"),
        _line(wall & kind("mold"), "MLD-REM", (w + 2 * MOLD_MARGIN) * F.least(h + 2 * MOLD_MARGIN, c("height")), "m2"),
        _line((wall | ceiling) & kind("crack"), "DRY-CRACK", crack, "m"),
        _line(wall & kind("hole") & (widest <= 0.3), "DRY-PATCH", F.lit(1.0), "ea"), _line(wall & kind("hole") & (widest > 0.3), "DRY-SECT", (w + 0.4) * (h + 0.4), "m2"),
        _line(wall & c("first"), "PNT-WALL", c("length") * c("height"), "m2"),
        _line(large, "DRY-CEIL", board, "m2"), _line(large, "INS-RR", board, "m2"), _line(ceiling & c("first"), "PNT-CEIL", c("length") * c("width"), "m2"),
        _line(floor & kind("water_stain", "mold"), "WTR-FLOOR", area * 4, "m2"), _line(floor & ~kind("water_stain", "mold"), "FLR-REP", area + 0.1, "m2"),
    )
    return r.select("region", "room", F.explode(F.array_compact(found)).alias("l")).select("region", "room", "l.*")


def drying(regions: DataFrame) -> DataFrame:
    """One drying line for each room with water damage."""
    return regions.where("class in ('water_stain', 'mold')").select("room").distinct().select("room", F.lit("WTR-DRY").alias("code"), F.lit(1.0).alias("quantity"), F.lit("ea").alias("unit"))


def imperial_lines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("imperial", imperial(F.col("quantity"), F.col("unit")))
