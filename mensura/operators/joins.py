"""Joins by nearness, range and geometry. Equality keys are made first (buckets, scenes), so no join is a cross product of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(left: DataFrame, right: DataFrame, key: str, tolerance: float, left_id: str = "id", right_id: str = "rid") -> DataFrame:
    """The nearest row of right in time for each row of left, if within the tolerance (inclusive); ties to the least id.

    Times fall into buckets as wide as the tolerance; a row of left looks into three of them.
    """
    bucket = lambda c: F.floor(c / tolerance)
    near = left.withColumn("_b", F.explode(F.array(*[bucket(F.col("t")) + k for k in (-1, 0, 1)])))
    other = right.select(key, F.col("t").alias("rt"), right_id, bucket(F.col("t")).alias("_b"))
    both = near.join(other, [key, "_b"]).withColumn("dt", F.abs(F.col("t") - F.col("rt"))).where(F.col("dt") <= tolerance)
    best = both.groupBy(key, left_id).agg(F.min(F.struct("dt", right_id)).alias("m"))
    return best.select(key, left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.dt").alias("dt"))


def interpolated(left: DataFrame, knots: DataFrame, key: str, left_id: str = "id") -> DataFrame:
    """Linear interpolation of knots (t, v) at the times of left; the end values beyond the ends."""
    both = left.select(key, "t", F.col(left_id), F.lit(None).cast("double").alias("v"), F.lit(1).alias("_side")).unionByName(
        knots.select(key, "t", F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), "v", F.lit(0).alias("_side")))
    w = Window.partitionBy(key).orderBy("t", "_side")
    tv = F.when(F.col("_side") == 0, F.struct("t", "v"))
    prev = F.last(tv, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(tv, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = both.withColumns({"p": prev, "n": after}).where("_side = 1")
    share = (F.col("t") - F.col("p.t")) / (F.col("n.t") - F.col("p.t"))
    value = F.when(F.col("p").isNull(), F.col("n.v")).when(F.col("n").isNull() | (F.col("n.t") == F.col("p.t")), F.col("p.v")).otherwise(F.col("p.v") + share * (F.col("n.v") - F.col("p.v")))
    return got.select(key, left_id, "t", value.alias("v"))


def _near(left: DataFrame, right: DataFrame, radius: float, *keys: str) -> DataFrame:
    """Pairs (keys, id, rid, d2) of points within a radius, by way of 27 neighbouring voxels."""
    cell = lambda c: F.floor(F.col(c) / radius)
    shifts = F.array(*[F.struct(*[F.lit(d).alias(n) for n, d in zip("xyz", (a, b, c))]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    probe = left.withColumn("_s", F.explode(shifts)).select(*keys, "id", *"xyz", *[(cell(c) + F.col(f"_s.{c}")).alias(f"_{c}") for c in "xyz"])
    held = right.select(*keys, F.col("id").alias("rid"), *[F.col(c).alias(f"r{c}") for c in "xyz"], *[cell(c).alias(f"_{c}") for c in "xyz"])
    gap = sum(((F.col(c) - F.col(f"r{c}")) * (F.col(c) - F.col(f"r{c}")) for c in "yz"), (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")))
    return probe.join(held, [*keys, "_x", "_y", "_z"]).withColumn("d2", gap).where(F.col("d2") <= radius * radius).select(*keys, "id", "rid", "d2")


def nearest_points(left: DataFrame, right: DataFrame, radius: float, k: int = 1, *keys: str) -> DataFrame:
    """The k nearest points of right within a radius, among those of equal keys; ties to the least id."""
    place = F.row_number().over(Window.partitionBy(*keys, "id").orderBy("d2", "rid"))
    return _near(left, right, radius, *keys).withColumn("k", place).where(F.col("k") <= k).select(*keys, "id", "rid", F.sqrt("d2").alias("distance"), "k")


def mirrored_share(points: DataFrame, planes: DataFrame, reach: float, least: float = 0.6) -> DataFrame:
    """Share of the points before a plane (scene, axis, off) whose reflections meet a point behind it; a mirror, if `least` do."""
    both = points.join(planes, "scene")
    at = F.when(F.col("axis") == 0, F.col("x")).otherwise(F.col("z"))
    turned = both.where(at < F.col("off")).select("scene", "id", *[F.when(F.col("axis") == a, 2 * F.col("off") - F.col(c)).otherwise(F.col(c)).alias(c) for c, a in (("x", 0), ("y", -1), ("z", 1))])
    behind = both.where(at >= F.col("off")).select("scene", "id", *"xyz")
    met = _near(turned, behind, reach, "scene").select("scene", "id").distinct().withColumn("hit", F.lit(1.0))
    share = turned.join(met, ["scene", "id"], "left").groupBy("scene").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))
    return share.withColumn("mirror", F.col("share") >= least)


def ray_plane(rays: DataFrame, edges: DataFrame, behind: float = 0.15, margin: float = 0.02) -> DataFrame:
    """Rays that pass through a wall edge's plane from the inside and land well beyond it, crossing within its extent."""
    both = rays.join(edges, "scene")
    along = lambda e: F.when(F.col("axis") == 0, F.col(f"{e}x")).otherwise(F.col(f"{e}y"))
    across = lambda e: F.when(F.col("axis") == 0, F.col(f"{e}y")).otherwise(F.col(f"{e}x"))
    a0, a1 = (along("p") - F.col("off")) * F.col("inward"), (along("q") - F.col("off")) * F.col("inward")
    crossing = both.withColumns({"a0": a0, "a1": a1}).where((F.col("a0") > margin) & (F.col("a1") < -behind)).withColumn("share", F.col("a0") / (F.col("a0") - F.col("a1")))
    s = across("p") + (across("q") - across("p")) * F.col("share")
    h = F.col("pz") + (F.col("qz") - F.col("pz")) * F.col("share")
    return crossing.withColumns({"s": s, "h": h}).where((F.col("s") >= F.col("lo")) & (F.col("s") <= F.col("hi"))).select("scene", "ray", "id", "s", "h")


def rays_over(crossings: DataFrame, edges: DataFrame) -> DataFrame:
    """How many crossing rays pass over the top of each edge."""
    return crossings.join(edges.select("id", "top"), "id").groupBy("id").agg(F.count_if(F.col("h") > F.col("top")).alias("over"), F.count("*").alias("through"))


def overlap(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    return F.least(ahi, bhi) - F.greatest(alo, blo)


def _paired(edges: DataFrame, *equal: str) -> DataFrame:
    a = edges.select(*[F.col(c) if c in equal else F.col(c).alias(f"a_{c}") for c in edges.columns])
    b = edges.select(*[F.col(c) if c in equal else F.col(c).alias(f"b_{c}") for c in edges.columns])
    return a.join(b, list(equal)).where("a_id <> b_id").withColumn("shared", overlap(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi")))


def without_occluders(edges: DataFrame) -> DataFrame:
    """Edges but those that stand in front of a higher line: same facing, 3 cm to 1.2 m before it, overlapping by half, top 0.2 m lower."""
    sign = F.when(F.col("facing") % 2 == 0, 1).otherwise(-1)
    back = (F.col("a_off") - F.col("b_off")) * sign
    hidden = _paired(edges, "scene", "facing").where((back >= 0.03) & (back <= 1.2) & (F.col("shared") >= 0.5 * (F.col("a_hi") - F.col("a_lo"))) & (F.col("b_top") >= F.col("a_top") + 0.2))
    return edges.join(hidden.select(F.col("a_id").alias("id")).distinct(), "id", "left_anti")


def best_overlap(edges: DataFrame, lines: DataFrame, snap: float = 0.04) -> DataFrame:
    """For each edge the line (same scene and axis, within `snap`) that overlaps it most; ties to the least id."""
    other = lines.select("scene", "axis", F.col("id").alias("line"), F.col("off").alias("l_off"), F.col("lo").alias("l_lo"), F.col("hi").alias("l_hi"))
    both = edges.join(other, ["scene", "axis"]).where("id <> line").where(F.abs(F.col("off") - F.col("l_off")) <= snap).withColumn("shared", overlap(F.col("lo"), F.col("hi"), F.col("l_lo"), F.col("l_hi"))).where("shared > 0")
    return both.groupBy("id").agg(F.min(F.struct((-F.col("shared")).alias("s"), "line")).alias("m")).select("id", F.col("m.line").alias("line"), (-F.col("m.s")).alias("shared"))


def shared_walls(edges: DataFrame) -> DataFrame:
    """Rooms with a wall between them: edges of one axis, facing away from each other, 3 to 45 cm apart, overlapping by 0.3 m; best overlap."""
    gap = F.abs(F.col("a_off") - F.col("b_off"))
    pairs = _paired(edges, "scene", "axis").where("a_room < b_room and a_inward = -b_inward").where((gap >= 0.03) & (gap <= 0.45) & (F.col("shared") >= 0.3))
    return pairs.groupBy(F.col("a_room").alias("a"), F.col("b_room").alias("b")).agg(F.max("shared").alias("shared"), F.count("*").alias("candidates"))


def overlapping(boxes: DataFrame, least: float, *equal: str) -> DataFrame:
    """Pairs of rectangles (x0, y0, x1, y1) of a group whose common area is over `least`."""
    a = boxes.select(*equal, F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    b = boxes.select(*equal, F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    both = a.join(b, list(equal)).where("a < b and a_x0 < b_x1 and b_x0 < a_x1 and a_y0 < b_y1 and b_y0 < a_y1")
    area = overlap(F.col("a_x0"), F.col("a_x1"), F.col("b_x0"), F.col("b_x1")) * overlap(F.col("a_y0"), F.col("a_y1"), F.col("b_y0"), F.col("b_y1"))
    return both.withColumn("area", area).where(F.col("area") > least).select(*equal, "a", "b", "area")


def in_polygon(points: DataFrame, sides: DataFrame, key: str) -> DataFrame:
    """Whether a point is inside its polygon, by crossings of the half-open sides (x1, y1, x2, y2)."""
    both = points.join(sides, key, "left")
    spans = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    x = F.col("x1") + (F.col("y") - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return both.groupBy(key, "id").agg((F.count_if(spans & (F.col("x") < x)) % 2 == 1).alias("inside"))


def mode_label(hits: DataFrame, least: int, *keys: str) -> DataFrame:
    """The most frequent label of each key that has `least` hits; ties to the smaller label."""
    counts = hits.groupBy(*keys, "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b")).select(*keys, F.col("b.label").alias("label"), (-F.col("b.m")).alias("n"))


def loop_candidates(anchors: DataFrame, gap: int, seconds: float, reach: float, k: int = 3) -> DataFrame:
    """Parts of a capture that come near each other again: apart in order and time, near in place; the k nearest of each."""
    a = anchors.select("capture", *[F.col(c).alias(f"a_{c}") for c in ("part", "t", "x", "z")])
    b = anchors.select("capture", *[F.col(c).alias(f"b_{c}") for c in ("part", "t", "x", "z")])
    dx, dz = F.col("a_x") - F.col("b_x"), F.col("a_z") - F.col("b_z")
    near = a.join(b, "capture").where((F.col("b_part") - F.col("a_part") >= gap) & (F.col("b_t") - F.col("a_t") >= seconds)).withColumn("distance", F.sqrt(dx * dx + dz * dz)).where(F.col("distance") <= reach)
    place = F.row_number().over(Window.partitionBy("capture", "a_part").orderBy("distance", "b_part"))
    return near.withColumn("k", place).where(F.col("k") <= k).select("capture", F.col("a_part").alias("a"), F.col("b_part").alias("b"), "distance", "k")


def dot(a: str, b: str) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vectors: DataFrame) -> DataFrame:
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.withColumn("v", F.transform("v", lambda x: x.cast("double") / n))


def revisits(vectors: DataFrame, gap: int, share: float, k: int, top: int) -> DataFrame:
    """Similar frames of a sequence that aren't neighbours: over the percentile, k best of each, then the best of all."""
    a, b = vectors.select("label", F.col("id").alias("a"), F.col("v").alias("va")), vectors.select("label", F.col("id").alias("b"), F.col("v").alias("vb"))
    pairs = a.join(b, "label").where(F.col("b") - F.col("a") >= gap).select("label", "a", "b", F.round(dot("va", "vb"), 9).alias("similarity"))
    cut = pairs.groupBy("label").agg(F.percentile("similarity", F.lit(share)).alias("cut"))
    over = pairs.join(cut, "label").where("similarity >= cut")
    best = over.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b"))).where(F.col("k") <= k)
    return best.orderBy(F.col("similarity").desc(), "a", "b").limit(top).select("label", "a", "b", "similarity")


def ratio_matches(left: DataFrame, right: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Nearest descriptors, kept where the second nearest is clearly farther."""
    both = left.select("label", F.col("id").alias("a"), F.col("v").alias("va")).join(right.select("label", F.col("id").alias("b"), F.col("v").alias("vb")), "label")
    d = both.select("label", "a", "b", F.round(F.sqrt(F.greatest(2 - 2 * dot("va", "vb"), F.lit(0.0))), 9).alias("d"))
    placed = d.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where("k <= 2")
    pair = placed.groupBy("a").agg(F.max(F.when(F.col("k") == 1, F.col("b"))).alias("b"), F.max(F.when(F.col("k") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("k") == 2, F.col("d"))).alias("d2"))
    return pair.where(F.col("d1") < ratio * F.col("d2"))


def visible(views: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Surfaces a view sees: within 4 m, not too oblique (cosine 0.3); score is cosine over distance."""
    both = views.join(surfaces, "scene")
    dx, dy, dz = (F.col(f"s{c}") - F.col(f"p{c}") for c in "xyz")
    distance = F.sqrt(dx * dx + dy * dy + dz * dz)
    facing = -(dx * F.col("nx") + dy * F.col("ny") + dz * F.col("nz")) / F.col("distance")
    seen = both.withColumn("distance", distance).where("distance > 0.2 and distance <= 4").withColumn("cosine", facing).where("cosine >= 0.3")
    return seen.withColumn("score", F.col("cosine") / F.col("distance"))


def assignment_cost(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Cost of calling a found room by a true one's name, per site (site, room, area, lengths): the area's error as a share of the true one, and what
    the four longest walls differ by, as a share of the first four true walls. A true room of unknown area: four times the mean share by
    which its walls miss their nearest found one; 9 if there is none."""
    four = lambda c: F.slice(F.concat(F.sort_array(F.col(c), asc=False), F.array_repeat(F.lit(0.0), 4)), 1, 4)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    t = truth.select("site", F.col("room").alias("t"), F.col("area").alias("ta"), F.col("lengths").alias("tl"))
    p = found.select("site", F.col("room").alias("p"), F.col("area").alias("pa"), F.col("lengths").alias("pl"))
    both = t.join(p, "site").withColumns({"ts": four("tl"), "ps": four("pl")})
    walls = total(F.zip_with("ts", "ps", lambda x, y: F.abs(x - y))) / F.greatest(total(F.slice("tl", 1, 4)), F.lit(1.0))
    nearest = F.transform("tl", lambda x: F.array_min(F.transform("pl", lambda y: F.abs(x - y))) / x)
    partial = F.when((F.size("tl") > 0) & (F.size("pl") > 0), 4 * total(nearest) / F.size("tl")).otherwise(F.lit(9.0))
    cost = F.when(F.col("ta").isNull(), partial).otherwise(F.abs(F.col("pa") - F.col("ta")) / F.col("ta") + walls)
    return both.select("site", "t", "p", cost.alias("cost"))


def cyclic_alignments(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Sum of wall differences for each direction and shift in which a found outline may be read, both of n walls, and whether it is little over the best."""
    n = F.size("tl")
    both = truth.join(found, ["site", "room"]).where("size(tl) = size(pl)").withColumn("n", n)
    turned = both.withColumn("dir", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("shift", F.explode(F.expr("sequence(0, n - 1)")))
    gap = F.expr("aggregate(transform(sequence(0, n - 1), i -> abs(tl[i] - pl[cast(pmod(shift + dir * i, n) as int)])), 0.0D, (s, x) -> s + x)")
    best = F.min("cost").over(Window.partitionBy("site", "room"))
    return turned.withColumn("cost", F.round(gap, 9)).withColumn("near", F.col("cost") <= best + 0.02 * F.col("n")).select("site", "room", "dir", "shift", "cost", "n", "near")


def door_pairs(doors: DataFrame, tolerance: float = 0.15, relative: float = 0.18) -> DataFrame:
    """Doors of two rooms that may be the same one: nearly equal widths."""
    a = doors.select("scene", F.col("opening").alias("a"), F.col("room").alias("ra"), F.col("width").alias("wa"))
    b = doors.select("scene", F.col("opening").alias("b"), F.col("room").alias("rb"), F.col("width").alias("wb"))
    gap = F.abs(F.col("wa") - F.col("wb"))
    close = a.join(b, "scene").where("ra < rb").where(gap <= F.greatest(F.lit(tolerance), relative * F.greatest("wa", "wb")))
    return close.withColumn("score", (gap / 0.05) * (gap / 0.05)).select("scene", "a", "b", "score")
