"""Measured rooms: walls, areas, ceilings, raster neighbours, shapes of regions, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a ceiling that wasn't seen, and tests of a connecting room.
CEILING_PRIOR, CONNECTOR = (2.2, 3.4), (1.5, 2.2)


def walls_of(vertices: DataFrame, definition: float) -> DataFrame:
    """Walls between consecutive corners (room, seq, x, y, sigma): length, its spread from the neighbours' and the corner definition, and
    the outward azimuth in degrees."""
    w = Window.partitionBy("room").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {f"n{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("x", "y", "sigma")}
    prev = F.coalesce(F.lag("sigma").over(w), F.last("sigma").over(whole))
    rows = vertices.withColumns(nxt | {"psigma": prev})
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    return rows.select(
        "room", "seq", F.sqrt(dx * dx + dy * dy).alias("length"), F.sqrt(F.col("psigma") * F.col("psigma") + F.col("nsigma") * F.col("nsigma") + definition * definition).alias("sigma"),
        F.pmod(F.degrees(F.atan2(-dx, dy)), F.lit(360.0)).alias("azimuth"))


def wall_areas(walls: DataFrame) -> DataFrame:
    """Area and spread of walls (length, sigma_l, height, sigma_h); a logarithmic spread counts twice."""
    a, b = F.col("length") * F.col("sigma_h"), F.col("height") * F.col("sigma_l")
    return walls.withColumns({"area": F.col("length") * F.col("height"), "sigma": F.sqrt(a * a + b * b), "sigma_log": 2 * F.col("sigma_log")})


def connectors(rooms: DataFrame) -> DataFrame:
    """Whether a room is a passage: narrow, and long for its width."""
    short, long = F.least("width", "length"), F.greatest("width", "length")
    return rooms.withColumn("connector", (short < CONNECTOR[0]) & (long / short > CONNECTOR[1]))


def ceilings(rooms: DataFrame) -> DataFrame:
    """Ceiling height with bounds: the level if it was seen, else the prior raised to the highest wall point."""
    low, high = F.greatest(F.lit(CEILING_PRIOR[0]), F.coalesce("highest", F.lit(0.0))), F.greatest(F.lit(CEILING_PRIOR[1]), F.coalesce("highest", F.lit(0.0)))
    seen = F.col("ceiling").isNotNull()
    return rooms.withColumns({"lo": F.when(seen, F.col("ceiling") - F.col("spread")).otherwise(low), "hi": F.when(seen, F.col("ceiling") + F.col("spread")).otherwise(high), "value": F.coalesce("ceiling", (low + high) / 2), "observed": seen})


def truth_area(walls: DataFrame, given: DataFrame) -> DataFrame:
    """A room's true area: as given, else of a rectangle by the means of opposite walls, else unknown."""
    n, place = F.count("*").alias("n"), F.col("seq") % 2
    sums = walls.groupBy("room").agg(n, F.avg(F.when(place == 0, F.col("length"))).alias("a"), F.avg(F.when(place == 1, F.col("length"))).alias("b"))
    rect = F.when(F.col("n") == 4, F.col("a") * F.col("b"))
    return given.join(sums, "room", "left").select("room", F.coalesce("floor_area", rect).alias("area"))


def footprint(rooms: DataFrame, key: str) -> DataFrame:
    """Sum of areas if all are known, else null; spread in quadrature, with and without a shared scale."""
    scale = F.col("area") * F.col("sigma_log")
    s2 = F.sum(F.col("sigma") * F.col("sigma"))
    return rooms.groupBy(key).agg(F.when(F.count("*") == F.count("area"), F.sum("area")).alias("area"), F.sqrt(s2).alias("sigma"), F.sqrt(s2 + F.sum(scale * scale)).alias("sigma_stitched"))


def observed_share(edges: DataFrame, key: str) -> DataFrame:
    return edges.groupBy(key).agg(F.try_divide(F.sum(F.col("length") * F.col("observed")), F.sum("length")).alias("observed"))


def mean_heading(angles: DataFrame, key: str) -> DataFrame:
    """Circular mean, in radians."""
    return angles.groupBy(key).agg(F.atan2(F.avg(F.sin("theta")), F.avg(F.cos("theta"))).alias("theta"))


def flying_pixels(depth: DataFrame, share: float = 0.04) -> DataFrame:
    """Pixels (frame, r, c, d) that differ from one of eight neighbours by over `share` of their depth; beyond the edge there's no neighbour."""
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    probe = depth.withColumn("s", F.explode(steps)).select("frame", "r", "c", "d", (F.col("r") + F.col("s.dr")).alias("nr"), (F.col("c") + F.col("s.dc")).alias("nc"))
    other = depth.select("frame", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("d").alias("nd"))
    step = F.max(F.abs(F.col("d") - F.col("nd")))
    return probe.join(other, ["frame", "nr", "nc"], "left").groupBy("frame", "r", "c").agg((F.coalesce(step, F.lit(0.0)) > share * F.greatest(F.max("d"), F.lit(1e-3))).alias("flying"))


def normals(points: DataFrame, reach: int = 2) -> DataFrame:
    """Unit normals of raster points (frame, r, c, x, y, z) by central differences over `reach` pixels, turned to the camera; all four
    neighbours are needed."""
    def shifted(name, dr, dc):
        return points.select("frame", (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), *[F.col(k).alias(f"{name}{k}") for k in "xyz"])

    rows = points
    for name, dr, dc in (("a", 0, reach), ("b", 0, -reach), ("c_", reach, 0), ("d", -reach, 0)):
        rows = rows.join(shifted(name, dr, dc), ["frame", "r", "c"])
    u = {k: F.col(f"a{k}") - F.col(f"b{k}") for k in "xyz"}
    v = {k: F.col(f"c_{k}") - F.col(f"d{k}") for k in "xyz"}
    cross = {"nx": u["y"] * v["z"] - u["z"] * v["y"], "ny": u["z"] * v["x"] - u["x"] * v["z"], "nz": u["x"] * v["y"] - u["y"] * v["x"]}
    rows = rows.withColumns(cross)
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    away = F.signum(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z"))
    return rows.withColumn("_s", size * F.when(away > 0, -1).otherwise(1)).where("_s <> 0").select("frame", "r", "c", *[(F.col(k) / F.col("_s")).alias(k) for k in ("nx", "ny", "nz")])


def shapes(pixels: DataFrame, size: float, *keys: str) -> DataFrame:
    """Area, extents, elongation and straightness of pixel regions (u, v): from the covariance, in closed form."""
    c = F.col
    m = pixels.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.max(k) - F.min(k) + 1).alias(f"d{k}") for k in "uv"], F.var_pop("u").alias("uu"), F.var_pop("v").alias("vv"), F.covar_pop("u", "v").alias("uv"))
    mid, gap = (c("uu") + c("vv")) / 2, F.sqrt((c("uu") - c("vv")) * (c("uu") - c("vv")) / 4 + c("uv") * c("uv"))
    return m.select(*keys, "n", (c("n") * size * size).alias("area"), (c("du") * size).alias("width"), (c("dv") * size).alias("height"),
                    F.sqrt((mid + gap) / F.greatest(mid - gap, F.lit(1e-6))).alias("elongation"))


def covered_cells(cells: DataFrame, boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """Boxes of a grid (x0 <= ix < x1, z0 <= iz < z1) of which at least `share` is occupied."""
    inside = boxes.join(cells, "scene").where("ix >= x0 and ix < x1 and iz >= z0 and iz < z1")
    n = inside.groupBy("scene", "box").agg(F.count("*").alias("n"))
    area = (F.col("x1") - F.col("x0")) * (F.col("z1") - F.col("z0"))
    return boxes.join(n, ["scene", "box"]).withColumn("share", F.col("n") / area).where(F.col("share") >= share).select("scene", "box", "n", "share")


def ray_boxes(rays: DataFrame, boxes: DataFrame) -> DataFrame:
    """Nearest hit of each ray (origin p, end q) on the boxes of its scene, as a share of the ray, by slabs; ties to the least box."""
    both = rays.join(boxes, "scene")
    lo, hi = [], []
    for k, d in zip("xyz", "xyz"):
        run = F.col(f"q{k}") - F.col(f"p{k}")
        run = F.when(F.abs(run) < 1e-12, 1e-12).otherwise(run)
        a, b = (F.col(f"{d}0") - F.col(f"p{k}")) / run, (F.col(f"{d}1") - F.col(f"p{k}")) / run
        lo.append(F.least(a, b))
        hi.append(F.greatest(a, b))
    hit = both.withColumns({"t0": F.greatest(*lo), "t1": F.least(*hi)}).where("t1 >= t0 and t1 >= 0 and t0 <= 1").withColumn("t", F.greatest("t0", F.lit(0.0)))
    return hit.groupBy("scene", "ray").agg(F.min(F.struct("t", "box")).alias("m")).select("scene", "ray", F.col("m.t").alias("t"), F.col("m.box").alias("box"))


def cut_boxes(boxes: DataFrame, cutter: DataFrame) -> DataFrame:
    """Boxes less the cutter of their scene: up to six parts each, in order left, right, below, above, before, behind."""
    c = F.col
    b = boxes.join(cutter.select("scene", *[c(f"{k}{e}").alias(f"c{k}{e}") for k in "xyz" for e in "01"]), "scene", "left")
    clash = F.coalesce((c("x0") < c("cx1")) & (c("cx0") < c("x1")) & (c("y0") < c("cy1")) & (c("cy0") < c("y1")) & (c("z0") < c("cz1")) & (c("cz0") < c("z1")), F.lit(False))
    inner = {f"i{k}0": F.greatest(f"{k}0", f"c{k}0") for k in "xyz"} | {f"i{k}1": F.least(f"{k}1", f"c{k}1") for k in "xyz"}
    b = b.withColumns(inner)

    def part(name, *bounds):
        return F.struct(F.lit(name).alias("part"), *[c(v).alias(k) for k, v in zip(("x0", "x1", "y0", "y1", "z0", "z1"), bounds)])

    parts = F.array(
        part("left", "x0", "ix0", "y0", "y1", "z0", "z1"), part("right", "ix1", "x1", "y0", "y1", "z0", "z1"), part("below", "ix0", "ix1", "y0", "iy0", "z0", "z1"),
        part("above", "ix0", "ix1", "iy1", "y1", "z0", "z1"), part("before", "ix0", "ix1", "iy0", "iy1", "z0", "iz0"), part("behind", "ix0", "ix1", "iy0", "iy1", "iz1", "z1"))
    whole = F.array(part("whole", "x0", "x1", "y0", "y1", "z0", "z1"))
    out = b.select("scene", "box", F.explode(F.when(clash, parts).otherwise(whole)).alias("p")).select("scene", "box", "p.*")
    return out.where("x1 - x0 > 1e-9 and y1 - y0 > 1e-9 and z1 - z0 > 1e-9")


def scale_cues(depths: DataFrame, key: str) -> DataFrame:
    """Log scales by cue from medians of what was measured in raw units: ceilings, doors, camera height. Cues without values are left out."""
    #: Expected metres and spreads of the logarithm.
    expected = {"ceiling": (2.60, 0.08), "door": (2.04, 0.035), "camera": (1.45, 0.10)}
    m = depths.where("value > 0").groupBy(key, "name").agg(F.median("value").alias("m"))
    prior, sigma = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (metres, s) in expected.items():
        prior, sigma = F.when(F.col("name") == name, metres).otherwise(prior), F.when(F.col("name") == name, s).otherwise(sigma)
    return m.select(key, "name", F.log(prior / F.col("m")).alias("log_scale"), sigma.alias("sigma")).where("log_scale is not null")


def band_evidence(points: DataFrame, key: str, bands=(0.06, 0.04, 0.02, 0.01)) -> DataFrame:
    """Median height in ever narrower bands around the group's median; a group is a scene, which is bounded."""
    mid = points.groupBy(key).agg(F.median("y").alias("m"))
    off = F.abs(F.col("y") - F.col("m"))
    return points.join(mid, key).groupBy(key).agg(*[F.median(F.when(off <= b, F.col("y"))).alias(f"within_{int(b * 100)}cm") for b in bands])
