"""Operators that depend on order: paths, islands, runs, circular neighbours, picks."""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def path_length(poses: DataFrame) -> DataFrame:
    """Distance walked up to each pose of a capture."""
    w = Window.partitionBy("capture").orderBy("t", "pose")
    dx, dz = F.col("x") - F.lag("x").over(w), F.col("z") - F.lag("z").over(w)
    step = poses.withColumn("step", F.coalesce(F.sqrt(dx * dx + dz * dz), F.lit(0.0)))
    return step.withColumn("walked", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def angular_velocity(poses: DataFrame) -> DataFrame:
    """Degrees a second since the pose before, by the shorter way round; null at the start and for equal times."""
    w = Window.partitionBy("capture").orderBy("t", "pose")
    turn = F.pmod(F.col("heading") - F.lag("heading").over(w) + 180, F.lit(360.0)) - 180
    return poses.withColumn("omega", F.try_divide(F.abs(turn), F.col("t") - F.lag("t").over(w)))


def select_keyframes(poses: DataFrame, distance: float = 0.04, angle: float = 4.0, seconds: float = 0.6, fastest: float = 90.0) -> DataFrame:
    """Keeps a pose that is far enough from the last one kept, in place, direction or time. Poses that aren't usable (if there is such a column)
    or turn faster than `fastest` degrees a second since the pose before are passed over. State runs along the capture."""
    usable = F.coalesce("usable", F.lit(False)) if "usable" in poses.columns else F.lit(True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "pose"], kind="stable")
        turned = lambda a, b: abs((a - b + 180) % 360 - 180)
        kept, last, before = [], None, None
        for k, (x, z, a, t, ok) in enumerate(zip(pdf["x"], pdf["z"], pdf["heading"], pdf["t"], pdf["usable"])):
            slow = before is None or turned(a, before[0]) / max(t - before[1], 1e-3) <= fastest
            before = (a, t)
            if ok and slow and (last is None or np.hypot(x - last[0], z - last[1]) >= distance or turned(a, last[2]) >= angle or t - last[3] >= seconds):
                kept.append(k)
                last = (x, z, a, t)
        return pdf.iloc[kept][["capture", "pose", "t"]]

    return poses.select("capture", "pose", "t", "x", "z", "heading", usable.alias("usable")).groupBy("capture").applyInPandas(run, "capture long, pose long, t double")


def submaps(poses: DataFrame, distance: float = 1.0, angle: float = 40.0, frames: int = 30) -> DataFrame:
    """Numbers the parts of a capture; a part ends where a pose is far from its first one, or it is full. The distance is rounded at each step,
    as in SQL: np.hypot puts some places that are just `distance` away beyond it."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "pose"], kind="stable")
        part, anchor, size, out = -1, None, 0, []
        for x, z, a in zip(pdf["x"], pdf["z"], pdf["heading"]):
            far = anchor is None or sqrt((x - anchor[0]) ** 2 + (z - anchor[1]) ** 2) > distance or abs((a - anchor[2] + 180) % 360 - 180) > angle or size >= frames
            if far:
                part, anchor, size = part + 1, (x, z, a), 0
            size += 1
            out.append(part)
        return pdf[["capture", "pose"]].assign(submap=out)

    return poses.select("capture", "pose", "t", "x", "z", "heading").groupBy("capture").applyInPandas(run, "capture long, pose long, submap int")


def islands(cells: DataFrame, gap: int, least: float, fill: float, size: float, *keys: str) -> DataFrame:
    """Segments of occupied cells along a line: split at gaps of over `gap` cells, kept if long and full enough."""
    w = Window.partitionBy(*keys).orderBy("k")
    broken = F.when(F.col("k") - F.lag("k").over(w) > gap + 1, 1).otherwise(0)
    numbered = cells.withColumn("_b", broken).withColumn("island", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(*keys, "island").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("cells"))
    span = F.col("last") - F.col("first") + 1
    return found.withColumn("length", span * size).where((F.col("length") >= least) & (F.col("cells") >= fill * span))


def first_run(profile: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """First bin of the first two in a row that reach the threshold."""
    w = Window.partitionBy(*keys).orderBy("bin")
    hit = F.col("share") >= threshold
    flagged = profile.withColumn("_h", hit).withColumn("_n", F.lead("_h").over(w)).withColumn("_next", F.lead("bin").over(w))
    return flagged.where("_h and _n and _next = bin + 1").groupBy(*keys).agg(F.min("bin").alias("bin"))


def last_open(profile: DataFrame, threshold: float, gap: int, *keys: str) -> DataFrame:
    """Last open bin of the first island of open bins; islands end at gaps of over `gap` bins."""
    w = Window.partitionBy(*keys).orderBy("bin")
    opened = profile.where(F.col("share") < threshold).withColumn("_b", F.when(F.col("bin") - F.lag("bin").over(w) > gap, 1).otherwise(0))
    return opened.withColumn("_i", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_i = 0").groupBy(*keys).agg(F.max("bin").alias("bin"))


def half_maximum(profile: DataFrame, *keys: str) -> DataFrame:
    """Where a profile, smoothed over three bins, first crosses half of its maximum, by linear interpolation."""
    w = Window.partitionBy(*keys).orderBy("bin")
    smooth = profile.withColumn("s", F.avg("share").over(w.rowsBetween(-1, 1)))
    half = smooth.withColumn("half", F.max("s").over(Window.partitionBy(*keys)) / 2).withColumn("before", F.lag("s").over(w))
    crossed = half.where("before < half and s >= half").withColumn("at", F.col("bin") - 1 + (F.col("half") - F.col("before")) / (F.col("s") - F.col("before")))
    return crossed.groupBy(*keys).agg(F.min("at").alias("at"))


def polygon_area(vertices: DataFrame, *keys: str) -> DataFrame:
    """Signed area (shoelace) and perimeter of polygons (seq, x, y), the last vertex joined to the first."""
    w = Window.partitionBy(*keys).orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in "xy")
    cross = vertices.withColumns({"nx": nx, "ny": ny})
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    return cross.groupBy(*keys).agg((F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"), F.sum(F.sqrt(dx * dx + dy * dy)).alias("perimeter"))


def rank_by_area(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("area").desc(), "id")))


def even_spread(rows: DataFrame, k: int, order: list[str], *keys: str) -> DataFrame:
    """k rows of each key at even places, first and last among them; all rows if there are no more than k."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(k - 1.0)).cast("int"))
    return placed.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def sector_middle(rows: DataFrame, sectors: int, *keys: str) -> DataFrame:
    """The middle pose, by heading, of each sector of directions."""
    sector = F.floor(F.pmod(F.col("heading"), F.lit(360.0)) * sectors / 360).cast("int")
    w = Window.partitionBy(*keys, "sector")
    placed = rows.withColumn("sector", sector).withColumn("_k", F.row_number().over(w.orderBy("heading", "pose"))).withColumn("_n", F.count("*").over(w))
    return placed.where("_k = _n div 2 + 1").drop("_k", "_n")


def first_of(rows: DataFrame, order: list[str], *keys: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def ordered_distinct(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in the order of their first occurrence."""
    return rows.groupBy(value).agg(F.min(order).alias("first_at"))


def thinned(frames: DataFrame, keep: int, *keys: str) -> DataFrame:
    """Drops the inner frame of least motion, adding its motion to the next, until `keep` are left."""
    columns = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("seq")[[*columns, "seq", "motion"]].to_dict("records")
        while len(rows) > max(keep, 2):
            k = min(range(1, len(rows) - 1), key=lambda i: (rows[i]["motion"], i))
            rows[k + 1]["motion"] += rows[k]["motion"]
            del rows[k]
        return pd.DataFrame(rows, columns=[*columns, "seq", "motion"])

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return frames.groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*columns, "seq", "motion"]))
