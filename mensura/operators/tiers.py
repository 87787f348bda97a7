"""Photo and video tiers, laser truth and structure: scales, agreement, levels, observations of walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry

#: Fixed value: the field of view, in degrees across, that depth models are trained for.
TRAIN_VIEW = 60.0


def camera_heading(r: list[list[Column]]) -> Column:
    """Direction of the optical axis on the floor, in radians."""
    return F.atan2(-r[2][2], r[0][2])


def yaw_turned(x: Column, z: Column, yaw: Column) -> tuple[Column, Column]:
    """A turn about the vertical."""
    c, s = F.cos(yaw), F.sin(yaw)
    return c * x + s * z, -s * x + c * z


def anchored(points: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Points (key, x, y, z) under the correction of their part (key, cx, cy, cz, yaw, tx, ty, tz): turned about its centre, then moved."""
    both = points.join(corrections, key)
    x, z = yaw_turned(F.col("x") - F.col("cx"), F.col("z") - F.col("cz"), F.col("yaw"))
    return both.select(*points.columns[: points.columns.index("x")], (x + F.col("cx") + F.col("tx")).alias("x"), (F.col("y") + F.col("ty")).alias("y"), (z + F.col("cz") + F.col("tz")).alias("z"))


def gravity_frame(ux: Column, uy: Column, uz: Column) -> list[list[Column]]:
    """Rows of the rotation from a camera to a frame with y up that keeps the camera's heading; (ux, uy, uz) is up, seen by the camera."""
    size = F.sqrt(ux * ux + uy * uy + uz * uz)
    up = [ux / size, uy / size, uz / size]
    flat = 1 - up[2] * up[2] < 1e-12
    f = [F.when(flat, e).otherwise(a) for e, a in zip((F.lit(0.0), F.lit(1.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(1.0)))]
    along = f[0] * up[0] + f[1] * up[1] + f[2] * up[2]
    ahead = [a - along * u for a, u in zip(f, up)]
    n = F.sqrt(ahead[0] * ahead[0] + ahead[1] * ahead[1] + ahead[2] * ahead[2])
    back = [-a / n for a in ahead]
    side = [up[1] * back[2] - up[2] * back[1], up[2] * back[0] - up[0] * back[2], up[0] * back[1] - up[1] * back[0]]
    return [side, up, back]


def compass_yaw(phi_a: Column, phi_b: Column, heading_a: Column, heading_b: Column) -> Column:
    """The turn of photo b into a by compass (degrees clockwise, null if there is none) and the headings in their own frames (radians)."""
    return phi_a + F.radians(heading_b - heading_a) - phi_b


def focal_correction(fx: Column, width: Column) -> Column:
    """What a model's depth is to be multiplied by, for a lens other than it was trained for."""
    return fx / (width / 2 / F.tan(F.lit(TRAIN_VIEW / 2 * 3.141592653589793 / 180)))


def upright_turns(up_x: Column, up_y: Column) -> Column:
    """Quarter turns that bring up, seen in the image, nearest to the top."""
    return F.pmod(F.round(F.degrees(F.atan2(up_x, -up_y)) / 90).cast("int"), F.lit(4))


def same_transform(a: str, b: str, degrees: float = 4.0, shift: float = 0.2) -> Column:
    """Whether two rigid transforms, columns with the prefixes a and b (quaternion qx .. qw, place px .. pz), are nearly one."""
    dot = sum((F.col(f"{a}q{k}") * F.col(f"{b}q{k}") for k in "yzw"), F.col(f"{a}qx") * F.col(f"{b}qx"))
    angle = 2 * F.degrees(F.acos(F.least(F.round(F.abs(dot), 12), F.lit(1.0))))
    d = [F.col(f"{a}p{k}") - F.col(f"{b}p{k}") for k in "xyz"]
    return (angle < degrees) & (F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) < shift)


def within_reach(base: DataFrame, pieces: DataFrame, key: str, margin: float = 3.0) -> DataFrame:
    """(key, piece, within): whether all cameras of a piece (piece, x, y, z) lie in the base cameras' box, widened by the margin and the piece's own
    greatest extent."""
    box = base.groupBy(key).agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    own = pieces.groupBy(key, "piece").agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "a"), (F.max, "b"))])
    reach = margin + F.greatest(*[F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"])
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & (F.col(f"a{c}") >= F.col(f"lo{c}") - F.col("reach")) & (F.col(f"b{c}") <= F.col(f"hi{c}") + F.col("reach"))
    return own.withColumn("reach", reach).join(box, key).select(key, "piece", inside.alias("within"))


def frame_scales(observations: DataFrame, least: int = 15, seen: int = 20) -> DataFrame:
    """(frame, scale, n): the median of model depth over measured depth (model, z) of frames with points enough, and enough of them usable."""
    usable = (F.col("z") > 0.05) & (F.col("model") > 0.1)
    m = observations.groupBy("frame").agg(F.count("*").alias("seen"), F.count_if(usable).alias("n"), F.median(F.when(usable, F.col("model") / F.col("z"))).alias("scale"))
    return m.where((F.col("seen") >= seen) & (F.col("n") >= least)).select("frame", "scale", "n")


def sharp_enough(frames: DataFrame, key: str, most: int, cut: float = 0.35) -> DataFrame:
    """Frames (key, frame, sharpness) without the least sharp of a capture that has over `most`; those in order, `most` of them."""
    m = frames.groupBy(key).agg(F.count("*").alias("_n"), F.percentile("sharpness", F.lit(cut)).alias("_cut"))
    left = frames.join(m, key).where((F.col("_n") <= most) | (F.col("sharpness") >= F.col("_cut"))).drop("_n", "_cut")
    return left.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("frame"))).where(F.col("_k") <= most).drop("_k")


def main_rooms(rooms: DataFrame, cameras: DataFrame, key: str) -> DataFrame:
    """The room (key, room, x0, x1, y0, y1, area) of each scene that most cameras (key, x, y) stand in, then the largest, then the first."""
    inside = rooms.join(cameras.select(key, F.col("x").alias("cx"), F.col("y").alias("cy")), key).where("cx > x0 and cx < x1 and cy > y0 and cy < y1")
    n = inside.groupBy(key, "room").agg(F.count("*").alias("cameras"))
    ranked = rooms.join(n, [key, "room"], "left").withColumn("cameras", F.coalesce("cameras", F.lit(0).cast("long")))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("cameras").desc(), F.col("area").desc(), "room"))
    return ranked.withColumn("_k", place).where("_k = 1").select(key, "room", "cameras", "area")


def every_nth(rows: DataFrame, order: list[str], key: str, take: int = 4) -> DataFrame:
    """The first `take` of every n-th row of a key, n so that these are spread over all."""
    w = Window.partitionBy(key)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.floor(F.col("_n") / take), F.lit(1))
    return placed.where((F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < take)).drop("_i", "_n")


def photo_conflicts(photos: DataFrame, floor: DataFrame, rooms: DataFrame, key: str, margin: float = 0.3, least: float = 0.6, points: int = 50) -> DataFrame:
    """Photos (key, photo, x, y) that contradict their room's box (key, x0, x1, y0, y1): the camera stands outside it, by more than the margin, or of
    the floor it sees (photo, x, y), 50 points at least, under 0.6 lies inside."""
    inside = lambda: (F.col("x") > F.col("x0") - margin) & (F.col("x") < F.col("x1") + margin) & (F.col("y") > F.col("y0") - margin) & (F.col("y") < F.col("y1") + margin)
    seen = floor.join(rooms, key).groupBy(key, "photo").agg(F.count("*").alias("n"), F.avg(inside().cast("double")).alias("share"))
    both = photos.join(rooms, key).withColumn("stands", inside()).join(seen, [key, "photo"], "left")
    return both.where(~F.col("stands") | F.coalesce((F.col("n") >= points) & (F.col("share") < least), F.lit(False))).select(key, "photo")


def sheet_consensus(sheets: DataFrame, key: str) -> DataFrame:
    """(key, paper, group, views, long, spread): the sheet of paper that most views (key, view, paper, x, y, long, contrast) agree on, then that of
    most contrast. Detections join the first group, by contrast, whose own first one is within half a sheet."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        for r in pdf.sort_values(["contrast", "view"], ascending=[False, True]).itertuples(index=False):
            near = [g for g in groups if g[0].paper == r.paper and np.hypot(g[0].x - r.x, g[0].y - r.y) < 0.5 * g[0].long]
            near[0].append(r) if near else groups.append([r])
        best = max(range(len(groups)), key=lambda k: (len({r.view for r in groups[k]}), sum(r.contrast for r in groups[k]), -k))
        sizes = np.array([r.long for r in groups[best]])
        views = len({r.view for r in groups[best]})
        spread = float(np.median(np.abs(np.log(sizes / np.median(sizes))))) if views > 1 else 0.0
        return pd.DataFrame([(pdf[key].iloc[0], groups[best][0].paper, views, round(float(np.median(sizes)), 6), round(spread, 6), len(groups) - 1)], columns=[key, "paper", "views", "long", "spread", "others"])

    kind = sheets.schema[key].dataType.simpleString()
    return sheets.select(key, "view", "paper", "x", "y", "long", "contrast").groupBy(key).applyInPandas(run, f"{key} {kind}, paper string, views int, long double, spread double, others int")


def dense_levels(points: DataFrame, key: str, size: float = 0.01, share: float = 0.15, band: float = 0.02, least: int = 500) -> DataFrame:
    """(key, floor, ceiling): the lowest and the highest layer of z that hold `share` of the fullest one's points, by the median around each."""
    base = points.groupBy(key).agg(F.min("z").alias("base"), F.count("*").alias("n")).where(F.col("n") >= least).select(key, "base")
    binned = points.join(base, key).withColumn("bin", F.floor(F.round((F.col("z") - F.col("base")) / size, 9)))
    n = binned.groupBy(key, "bin").agg(F.count("*").alias("n"))
    most = n.groupBy(key).agg(F.max("n").alias("most"))
    ends = n.join(most, key).where(F.col("n") > share * F.col("most")).groupBy(key).agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    near = binned.join(ends, key)
    middle = lambda e: F.median(F.when(F.abs(F.round(F.col("z") - (F.col("base") + (F.col(e) + 0.5) * size), 9)) < band, F.col("z")))
    return near.groupBy(key).agg(middle("low").alias("floor"), middle("high").alias("ceiling"))


def room_levels(points: DataFrame, key: str, size: float = 0.02, band: float = 0.04, second: float = 0.15, least: int = 50) -> DataFrame:
    """(key, main, share, other): the densest layer of ceiling points' heights (y), the share of points near it, and the median of the rest, if that is
    over 15 %; null for under 50 points."""
    base = points.groupBy(key).agg(F.min("y").alias("base"), F.count("*").alias("all"))
    binned = points.join(base, key).withColumn("bin", F.floor(F.round((F.col("y") - F.col("base") + 0.01) / size, 9)))
    n = binned.groupBy(key, "bin").agg(F.count("*").alias("n"))
    top = n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "bin")).alias("b")).select(key, F.col("b.bin").alias("at"))
    near = F.abs(F.round(F.col("y") - (F.col("base") - 0.01 + (F.col("at") + 0.5) * size), 9)) < band
    m = binned.join(top, key).withColumn("near", near).groupBy(key).agg(
        F.first("all").alias("all"), F.median(F.when(F.col("near"), F.col("y"))).alias("main"), F.count_if("near").alias("n"), F.median(F.when(~F.col("near"), F.col("y"))).alias("other"))
    enough = F.col("all") >= least
    return m.select(key, F.when(enough, F.col("main")).alias("main"), F.when(enough, F.col("n") / F.col("all")).alias("share"),
                    F.when(enough & (F.col("all") - F.col("n") > second * F.col("all")), F.col("other")).alias("other"))


def wall_layers(points: DataFrame, *keys: str, bins: int = 60, band: float = 0.12, least: int = 40) -> DataFrame:
    """(keys, offset, support): of the layers of a facing's coordinates (at, h), the one of most points times height (5th to 95th percentile), by the median
    around it; its support is its points over the square of its distance. Layers are local peaks of 60 bins with 0.3 of the fullest one's points."""
    span = points.groupBy(*keys).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("all")).where((F.col("all") >= least) & (F.col("hi") > F.col("lo")))
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.least(F.floor(F.round((F.col("at") - F.col("lo")) / width, 9)), F.lit(bins - 1))
    binned = points.join(span, list(keys)).withColumn("bin", k)
    n = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    w = Window.partitionBy(*keys).orderBy("bin")
    beside = lambda f, d: F.coalesce(F.when(f("bin").over(w) == F.col("bin") + d, f("n").over(w)), F.lit(0))
    peaks = n.withColumns({"before": beside(F.lag, -1), "after": beside(F.lead, 1), "most": F.max("n").over(Window.partitionBy(*keys))})
    peaks = peaks.where("n >= 0.3 * most and n >= before and n >= after").select(*keys, "bin", (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("centre"))
    reach = lambda c: band * F.greatest(F.abs(c), F.lit(0.5))
    layer = points.join(peaks, list(keys)).where(F.round(F.abs(F.col("at") - F.col("centre")) - reach(F.col("centre")), 9) < 0)
    scored = layer.groupBy(*keys, "bin", "centre").agg(F.count("*").alias("n"), (F.percentile("h", F.lit(0.95)) - F.percentile("h", F.lit(0.05))).alias("tall"), F.median("at").alias("offset"))
    best = scored.where("n >= 20").groupBy(*keys).agg(F.max(F.struct(F.round(F.col("n") * F.col("tall"), 6).alias("s"), "bin", "offset", "n")).alias("b"))
    distance = F.greatest(F.abs("b.offset"), F.lit(0.3))
    return best.select(*keys, F.col("b.offset").alias("offset"), (F.col("b.n") / (distance * distance)).alias("support"))


def loop_gate(closures: DataFrame) -> DataFrame:
    """Closures (share, rms, eigen, shift, yaw in degrees, walked) that a walk's likely drift allows: 1.2 cm by the root of the metres walked, and a centimetre."""
    expected = 0.012 * F.sqrt(F.greatest(F.col("walked"), F.lit(1.0))) + 0.01
    good = (F.col("share") >= 0.35) & (F.col("rms") <= 0.02) & (F.col("eigen") >= 8e-3) & (F.abs("yaw") <= 6.0)
    return closures.where(good & (F.col("shift") <= F.least(3 * expected, F.lit(0.35))))


def loop_residuals(closures: DataFrame, moved: DataFrame, key: str) -> DataFrame:
    """(key, residual, largest, mean): the median of what closures (ex, ey, ez) miss by, and the size of the corrections (dx, dy, dz)."""
    size = lambda p: F.sqrt(sum((F.col(f"{p}{c}") * F.col(f"{p}{c}") for c in "yz"), F.col(f"{p}x") * F.col(f"{p}x")))
    residual = closures.groupBy(key).agg(F.median(size("e")).alias("residual"))
    return moved.groupBy(key).agg(F.max(size("d")).alias("largest"), F.avg(size("d")).alias("mean")).join(residual, key, "left")


def blank_lines(documents: DataFrame) -> DataFrame:
    """(document, line_no, line): lines before section 4 of a declaration (document, text) that still hold a placeholder."""
    body = F.split_part("text", F.lit("## 4."), F.lit(1))
    lines = documents.select("document", F.posexplode(F.split(body, "\n")).alias("line_no", "raw"))
    blank = F.col("raw").rlike(r"_{4,}|:\s*\.\.\.\s*$|^\s*(\d+\.)?\s*\.\.\.\s*$")
    return lines.where(blank).select("document", "line_no", F.trim("raw").alias("line"))


def reviewed(rows: DataFrame, decisions: DataFrame, *keys: str) -> DataFrame:
    """Rows that no decision takes out."""
    return rows.join(decisions.select(*keys).distinct(), list(keys), "left_anti")


def nearest_extent(items: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Items (key, ref, truth) with the side (width or depth) of their box that is nearest to the truth; the box of a mesh has no names for walls."""
    both = items.join(boxes, key, "left")
    side = F.when(F.abs(F.col("width") - F.col("truth")) <= F.abs(F.col("depth") - F.col("truth")), F.col("width")).otherwise(F.col("depth"))
    return both.select(*items.columns, side.alias("app_value"))


def rows_of_equations(observations: DataFrame, turns: DataFrame) -> DataFrame:
    """(room, photo, wall, axis, off, weight): what each observed layer (photo, facing, offset, weight) says of a wall, in the room's directions: the
    photo's place along the axis, plus the offset by the photo's scale, is the wall's. turns: photo, turns."""
    both = observations.join(turns, ["room", "photo"])
    # a quarter turn takes x to y, and y to -x
    turns_, along_x = F.col("turns") % 4, F.col("facing") < 2
    sign = F.when(turns_ == 0, 1.0).when(turns_ == 2, -1.0).when(turns_ == 1, F.when(along_x, 1.0).otherwise(-1.0)).otherwise(F.when(along_x, -1.0).otherwise(1.0))
    wall = geometry.turned_facing(F.col("facing"), F.col("turns")).cast("int")
    axis = F.when(F.col("wall") < 2, 0).otherwise(1)
    return both.withColumn("wall", wall).select("room", "photo", "wall", axis.alias("axis"), (F.col("offset") * sign).alias("off"), "weight")
