"""Aggregates over points, cells and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(x: Column, size: float) -> Column:
    """Grid index; floors, so that it is right for negative coordinates. Rounded first: a bin can't depend on the last bit."""
    return F.floor(F.round(x / size, 9))


def voxel_fuse(points: DataFrame, size: float, *keys: str) -> DataFrame:
    """Mean position, count and first frame (by seq) of each voxel, and the direction of the sum of its normals (nx, ny, nz), if points have
    any; partial sums are made before the shuffle."""
    ix = [cell(F.col(c), size).alias(f"i{c}") for c in "xyz"]
    normals = [c for c in ("nx", "ny", "nz") if c in points.columns]
    fused = points.groupBy(*keys, *ix).agg(
        *[F.avg(c).alias(c) for c in "xyz"], *[F.sum(c).alias(c) for c in normals], F.count("*").alias("n"), F.min_by("frame", "seq").alias("first_frame"))
    if not normals:
        return fused
    length = F.greatest(F.sqrt(sum((F.col(c) * F.col(c) for c in normals[1:]), F.col("nx") * F.col("nx"))), F.lit(1e-12))
    return fused.withColumn("_l", length).withColumns({c: F.col(c) / F.col("_l") for c in normals}).drop("_l")


def grid_count(points: DataFrame, size: float, weight: Column, *keys: str) -> DataFrame:
    return points.groupBy(*keys, cell(F.col("x"), size).alias("ix"), cell(F.col("z"), size).alias("iz")).agg(F.sum(weight).alias("weight"))


def wall_evidence(points: DataFrame, size: float, *keys: str, span: float = 0.9, count: int = 3) -> DataFrame:
    """Per cell: count, height span and top, and whether that makes a wall."""
    rows = points.groupBy(*keys, cell(F.col("x"), size).alias("ix"), cell(F.col("z"), size).alias("iz")).agg(
        F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("span"), F.max("y").alias("top"))
    return rows.withColumn("is_wall", (F.col("span") >= span) & (F.col("n") >= count))


def ray_carve(rays: DataFrame, size: float, stop: float = 0.06) -> DataFrame:
    """Distinct rays through each cell, sampled at 0.9 cells and stopping short of the end."""
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    length = F.sqrt(dx * dx + dy * dy)
    step = 0.9 * size
    n = F.greatest(F.ceil(F.round((F.col("length") - stop) / step, 9)), F.lit(0)).cast("int")
    steps = rays.withColumns({"dx": dx, "dy": dy, "length": length}).where("length > 0").withColumn("n", n).where("n > 0").withColumn("k", F.explode(F.expr("sequence(0, n - 1)")))
    t = F.col("k") * step / F.col("length")
    placed = steps.select("scene", "ray", cell(F.col("px") + F.col("dx") * t, size).alias("ix"), cell(F.col("py") + F.col("dy") * t, size).alias("iy"))
    return placed.groupBy("scene", "ix", "iy").agg(F.count_distinct("ray").alias("rays"))


def histogram(rows: DataFrame, value: Column, lo: float, width: float, bins: int, *keys: str) -> DataFrame:
    """Counts in fixed bins; only the last bin holds its upper end."""
    k = F.least(F.floor(F.round((value - lo) / width, 9)), F.lit(bins - 1)).cast("int")
    inside = rows.where((value >= lo) & (value <= lo + width * bins))
    return inside.groupBy(*keys, k.alias("bin")).agg(F.count("*").alias("n"))


def densified(hist: DataFrame, bins: int, *keys: str) -> DataFrame:
    """A row for each bin, empty ones too."""
    full = hist.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return full.join(hist, [*keys, "bin"], "left").fillna(0, ["n"])


#: Seven taps of a Gaussian.
TAPS = (0.006, 0.061, 0.242, 0.382, 0.242, 0.061, 0.006)


def peaks(hist: DataFrame, bins: int, *keys: str) -> DataFrame:
    """Local maxima of the smoothed histogram, zero beyond its ends: not under the left neighbour, over the right one."""
    w = Window.partitionBy(*keys).orderBy("bin")
    smooth = sum((F.coalesce(F.lag("n", -j).over(w) if j < 0 else F.lead("n", j).over(w) if j else F.col("n"), F.lit(0)) * TAPS[j + 3] for j in range(-2, 4)), F.coalesce(F.lag("n", 3).over(w), F.lit(0)) * TAPS[0])
    s = densified(hist, bins, *keys).withColumn("s", F.round(smooth, 6))
    left, right = F.coalesce(F.lag("s").over(w), F.lit(0.0)), F.coalesce(F.lead("s").over(w), F.lit(0.0))
    return s.withColumns({"_l": left, "_r": right}).where("s >= _l and s > _r").drop("_l", "_r")


def level(points: DataFrame, band: float, *keys: str) -> DataFrame:
    """Median height, spread (MAD x 1.4826) and distinct 10 cm cells of the points near the median of their group. A group is a scene, which is
    bounded, so its values are held to find the medians; groups that aren't have `order.medians`."""
    mid = points.groupBy(*keys).agg(F.median("y").alias("m"))
    near = points.join(mid, list(keys)).where(F.abs(F.col("y") - F.col("m")) <= band)
    centre = near.groupBy(*keys).agg(F.median("y").alias("height"), F.count_distinct(cell(F.col("x"), 0.1), cell(F.col("z"), 0.1)).alias("cells"))
    spread = near.join(centre.select(*keys, "height"), list(keys)).groupBy(*keys).agg((F.median(F.abs(F.col("y") - F.col("height"))) * 1.4826).alias("spread"))
    return centre.join(spread, list(keys)).withColumn("area", F.col("cells") * 0.01)


def entropy(hist: DataFrame, *keys: str) -> DataFrame:
    """-sum p ln p of each key's histogram."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return hist.withColumn("p", p).groupBy(*keys).agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))


#: Bins of a quarter turn, reach and width (in bins) of their smoothing, and how far (in degrees) from the peak a direction may count.
YAW_BINS, YAW_REACH, YAW_WIDTH, YAW_GATE = 180, 6, 2.0, 8.0


def dominant_yaw(normals: DataFrame, *keys: str) -> DataFrame:
    """Direction that right angles agree on (theta, w), and how strongly all do.

    Directions are folded by quarter turns into bins, whose weights are smoothed around the circle; those near the fullest bin are averaged
    by the fourth harmonic. The strength is the harmonic's length over all directions.
    """
    quarter = 1.5707963267948966
    folded = F.pmod(F.col("theta"), F.lit(quarter))
    rows = normals.withColumn("_f", folded).withColumn("_b", F.least(F.floor(F.round(F.col("_f") / quarter * YAW_BINS, 9)), F.lit(YAW_BINS - 1)).cast("int"))
    hist = rows.groupBy(*keys, "_b").agg(F.sum("w").alias("_w"))
    taps = F.array(*[F.struct(F.lit(d).alias("d"), F.exp(F.lit(-0.5 * (d / YAW_WIDTH) ** 2)).alias("t")) for d in range(-YAW_REACH, YAW_REACH + 1)])
    spread = hist.withColumn("_t", F.explode(taps)).groupBy(*keys, F.pmod(F.col("_b") + F.col("_t.d"), F.lit(YAW_BINS)).alias("_b")).agg(F.round(F.sum(F.col("_w") * F.col("_t.t")), 6).alias("_s"))
    peak = spread.groupBy(*keys).agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col("_b").alias("b"))).alias("_p")).select(*keys, ((F.col("_p.b") + 0.5) * quarter / YAW_BINS).alias("_at"))
    off = F.abs(F.pmod(F.col("_f") - F.col("_at") + quarter / 2, F.lit(quarter)) - quarter / 2)
    near = F.round(off, 9) < F.radians(F.lit(YAW_GATE))
    four = 4 * F.col("theta")
    s, c = F.col("w") * F.sin(four), F.col("w") * F.cos(four)
    sums = rows.join(peak, list(keys)).groupBy(*keys).agg(F.sum(F.when(near, s)).alias("_s"), F.sum(F.when(near, c)).alias("_c"), F.sum(s).alias("_as"), F.sum(c).alias("_ac"), F.sum("w").alias("_w"))
    strength = F.sqrt(F.col("_as") * F.col("_as") + F.col("_ac") * F.col("_ac")) / F.greatest("_w", F.lit(1e-9))
    return sums.select(*keys, (F.atan2("_s", "_c") / 4).alias("yaw"), strength.alias("strength"))


def boundary_lengths(cells: DataFrame, size: float) -> DataFrame:
    """Length of the boundary between each two labels of a grid (ix, iz, label)."""
    def beside(dx, dz):
        shifted = cells.select((F.col("ix") - dx).alias("ix"), (F.col("iz") - dz).alias("iz"), F.col("label").alias("other"))
        return cells.join(shifted, ["ix", "iz"]).where("label <> other")

    both = beside(1, 0).unionByName(beside(0, 1))
    return both.groupBy(F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).agg((F.count("*") * size).alias("length"))


def extent(boxes: DataFrame, *keys: str) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.max("hi") - F.min("lo")).alias("extent"))
