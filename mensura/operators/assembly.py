"""Rooms put together: placing, doors, adjacency, boxes, openings behind walls, lines around a room, ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an opening's edges are taken for: gap that counts as met, spreads, density of rays that stop where the wall begins.
MET, SOLID_SIGMA, DENSE, DENSE_SIGMA, THIN_SIGMA = 0.05, 0.02, 0.4, 0.012, 0.03
#: Metres of doors, passages and windows of a laser scan.
FLOOR_GAP, DOOR_HEAD, DOOR_WIDTH, PASSAGE_HEAD, PASSAGE_WIDTH, WINDOW_SILL, WINDOW_HIGH = 0.06, (1.8, 2.6), (0.55, 1.25), 1.9, 3.0, (0.3, 1.6), 0.4


def turned(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    """A plan vector turned counter-clockwise."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return c * x - s * y, s * x + c * y


def placed(corners: DataFrame, placements: DataFrame) -> DataFrame:
    """Corners (room, seq, x, y) under their room's placement (room, rotation, tx, ty), rounded to a tenth of a millimetre."""
    both = corners.join(placements, "room")
    x, y = turned(F.col("x"), F.col("y"), F.col("rotation"))
    return both.select("room", "seq", F.round(x + F.col("tx"), 4).alias("x"), F.round(y + F.col("ty"), 4).alias("y"))


def door_centres(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """(room, opening, x, y, nx, ny): the middle of each opening (room, opening, face, off, width) on its wall (room, face, x0, y0, x1, y1, azimuth),
    and the wall's outward direction."""
    both = openings.join(walls, ["room", "face"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    share = (F.col("off") + F.col("width") / 2) / F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-9))
    a = F.radians("azimuth")
    return both.select("room", "opening", (F.col("x0") + dx * share).alias("x"), (F.col("y0") + dy * share).alias("y"), F.cos(a).alias("nx"), F.sin(a).alias("ny"))


def rotation_options(rooms: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(key, room, rotation, penalty): four turns of each room, with what its compass (north, null if none) says against the reference's."""
    both = rooms.join(reference.select(key, F.col("north").alias("ref")), key, "left")
    each = both.withColumn("rotation", F.explode(F.array(*[F.lit(90.0 * k) for k in range(4)])))
    off = F.pmod(F.col("north") - F.col("rotation") - F.col("ref") + 180, F.lit(360.0)) - 180
    return each.select(key, "room", "rotation", F.coalesce((off / 20) * (off / 20), F.lit(0.0)).alias("penalty"))


def opening_adjacency(openings: DataFrame) -> DataFrame:
    """(site, a, b, kind, via): rooms that share openings that aren't windows, each pair once. openings: site, room, opening, kind, to. The pair has
    the kind of the first room's first opening, and lists the openings of both sides."""
    o = openings.where((F.col("kind") != "window") & F.col("to").isNotNull())
    known = openings.select("site", F.col("room").alias("to")).distinct()
    pair = o.join(known, ["site", "to"], "left_semi").withColumns({"a": F.least("room", "to"), "b": F.greatest("room", "to")}).where("a <> b")
    first = pair.groupBy("site", "a", "b").agg(F.min(F.struct("room", "opening", "kind")).alias("f"))
    back = openings.where(F.col("to").isNotNull()).withColumns({"a": F.least("room", "to"), "b": F.greatest("room", "to")}).select("site", "a", "b", "room", "opening", "kind")
    both = first.join(back, ["site", "a", "b"]).where((F.col("opening") == F.col("f.opening")) | (F.col("room") != F.col("f.room")))
    kind = F.when(F.col("f.kind") == "door", "door").otherwise("open_passage")
    return both.groupBy("site", "a", "b", kind.alias("kind")).agg(F.sort_array(F.collect_set("opening")).alias("via"))


def box_adjacency(boxes: DataFrame, key: str, apart: float = 0.35, shared: float = 0.5) -> DataFrame:
    """(key, a, b): boxes (room, x0, x1, y0, y1) with a wall's thickness between them along one axis that overlap along the other."""
    side = lambda n: boxes.select(key, F.col("room").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("x0", "x1", "y0", "y1")])
    gap = lambda k: F.greatest(F.col(f"b_{k}0") - F.col(f"a_{k}1"), F.col(f"a_{k}0") - F.col(f"b_{k}1"))
    both = side("a").join(side("b"), key).where("a < b").withColumns({"gx": F.round(gap("x"), 9), "gy": F.round(gap("y"), 9)})
    near = lambda k, o: F.col(k).between(0, apart) & (F.col(o) < -shared)
    return both.where(near("gx", "gy") | near("gy", "gx")).select(key, "a", "b")


def first_boxes(boxes: DataFrame, key: str, within: float = 0.05) -> DataFrame:
    """Boxes that aren't, side for side, within 5 cm of an earlier one that is kept. Boxes of a key are one problem, taken in order."""
    sides = ["x0", "x1", "y0", "y1"]
    held = F.collect_list(F.struct("room", *sides))
    near = lambda b, o: [F.abs(b[s] - o[s]) < within for s in sides]

    def keep(kept, b):
        def same(o):
            n = near(b, o)
            return n[0] & n[1] & n[2] & n[3]

        return F.when(F.exists(kept, same), kept).otherwise(F.concat(kept, F.array(b)))

    rows = boxes.groupBy(key).agg(F.sort_array(held).alias("all"))
    empty = F.filter("all", lambda x: F.lit(False))
    return rows.select(key, F.explode(F.aggregate("all", empty, keep)).alias("b")).select(key, "b.*")


def opposite_openings(openings: DataFrame, rooms: DataFrame, key: str, wall: float) -> DataFrame:
    """(key, opening, room, side, off): openings (room, side 0..3 = S E N W, off, width) as seen from the room whose opposite wall lies a wall's
    thickness behind them, if they lie within it. rooms: room, x0, x1, y0, y1."""
    c = F.col
    o = openings.join(rooms, [key, "room"])
    flat = c("side").isin(0, 2)
    at = F.when(c("side") == 0, c("y0") - wall).when(c("side") == 1, c("x1") + wall).when(c("side") == 2, c("y1") + wall).otherwise(c("x0") - wall)
    begins = F.when(c("side") == 0, c("x0") + c("off")).when(c("side") == 1, c("y0") + c("off")).when(c("side") == 2, c("x1") - c("off")).otherwise(c("y1") - c("off"))
    ends = F.when(c("side").isin(0, 1), c("begins") + c("width")).otherwise(c("begins") - c("width"))
    cut = o.select(key, "opening", c("room").alias("from"), "side", flat.alias("flat"), F.round(at, 6).alias("at"), begins.alias("begins"), "width").withColumn("ends", ends)
    r = rooms.select(key, "room", *[c(s).alias(f"r_{s}") for s in ("x0", "x1", "y0", "y1")])
    line = F.when(c("side") == 0, c("r_y1")).when(c("side") == 1, c("r_x0")).when(c("side") == 2, c("r_y0")).otherwise(c("r_x1"))
    lo, hi = F.round(F.least("begins", "ends"), 6), F.round(F.greatest("begins", "ends"), 6)
    r0, r1 = F.when(c("flat"), c("r_x0")).otherwise(c("r_y0")), F.when(c("flat"), c("r_x1")).otherwise(c("r_y1"))
    met = cut.join(r, key).where((c("room") != c("from")) & (F.abs(line - c("at")) < 1e-6) & (lo >= r0 - 1e-6) & (hi <= r1 + 1e-6))
    # walls are walked counter-clockwise, so the opposite one is walked the other way
    off = F.when(c("side") < 2, r1 - hi).otherwise(lo - r0)
    return met.select(key, "opening", "room", ((c("side") + 2) % 4).cast("int").alias("side"), F.round(off, 6).alias("off"))


def nearby_lines(regions: DataFrame, lines: DataFrame, key: str, search: float = 0.6, slack: float = 0.2) -> DataFrame:
    """(key, region, line): lines (line, axis, off, lo, hi) that may bound a region's box (region, x0, x1, y0, y1)."""
    both = regions.join(lines, key)
    b0, b1 = (F.when(F.col("axis") == 0, F.col(f"x{k}")).otherwise(F.col(f"y{k}")) for k in (0, 1))
    a0, a1 = (F.when(F.col("axis") == 0, F.col(f"y{k}")).otherwise(F.col(f"x{k}")) for k in (0, 1))
    near = F.col("off").between(b0 - search, b1 + search) & (F.col("hi") >= a0 - slack) & (F.col("lo") <= a1 + slack)
    return both.where(near).select(key, "region", "line")


def edge_points(edges: DataFrame, points: DataFrame, key: str, band: float = 0.08, margin: float = 0.12) -> DataFrame:
    """(key, edge, id, place): points (id, facing, x, y) on the face of an edge (edge, axis, facing, off, lo, hi), away from its corners: 12 cm, or a
    quarter of a short edge."""
    short = F.col("hi") - F.col("lo") <= 2 * margin
    inset = F.when(short, 0.25 * (F.col("hi") - F.col("lo"))).otherwise(F.lit(margin))
    both = edges.join(points, [key, "facing"])
    across = F.when(F.col("axis") == 0, F.col("x")).otherwise(F.col("y"))
    along = F.when(F.col("axis") == 0, F.col("y")).otherwise(F.col("x"))
    on = (F.abs(across - F.col("off")) < band) & (along > F.col("lo") + inset) & (along < F.col("hi") - inset)
    return both.where(on).select(key, "edge", "id", across.alias("place"))


def line_tops(lines: DataFrame, tops: DataFrame, key: str, size: float) -> DataFrame:
    """(key, line, top): the median, along a line (line, facing, axis, off, lo, hi), of the greatest height in the 3 x 3 cells (facing, ix, iy, top)
    around; 0 if there is none."""
    n = F.greatest(F.floor(F.round((F.col("hi") - F.col("lo")) / size, 9)).cast("int"), F.lit(1))
    step = F.when(F.col("n") > 1, (F.col("hi") - F.col("lo")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    along = lines.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("t", F.col("lo") + F.col("k") * step)
    cell = lambda c: F.floor(F.round(c / size, 9))
    x, y = F.when(F.col("axis") == 0, F.col("off")).otherwise(F.col("t")), F.when(F.col("axis") == 0, F.col("t")).otherwise(F.col("off"))
    around = F.array(*[F.struct((F.col("ix") + a).alias("ix"), (F.col("iy") + b).alias("iy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = tops.select(key, "facing", "top", F.explode(around).alias("s")).groupBy(key, "facing", "s.ix", "s.iy").agg(F.max("top").alias("top")).where("top > 0")
    # Spark takes exploded lines to be as small as the lines and would broadcast them
    probe = along.select(key, "line", "facing", "k", cell(x).alias("ix"), cell(y).alias("iy")).hint("merge")
    best = probe.join(spread, [key, "facing", "ix", "iy"]).groupBy(key, "line", "k").agg(F.max("top").alias("top"))
    found = best.groupBy(key, "line").agg(F.median("top").alias("top"))
    return lines.select(key, "line").join(found, [key, "line"], "left").withColumn("top", F.coalesce("top", F.lit(0.0)))


def wall_cells(cells: DataFrame, ceiling: str = "ceiling") -> DataFrame:
    """Cells (span, n, top, ceiling or null) that are wall: tall enough, or high enough to reach the ceiling over furniture."""
    tall = (F.col("span") >= 0.9) & (F.col("n") >= 2)
    reaching = (F.col("top") >= F.col(ceiling) - 0.2) & (F.col("span") >= 0.3) & (F.col("n") >= 2)
    return cells.where(tall | F.coalesce(reaching, F.lit(False)))


def located_edge(open_: Column, density: Column, solid: Column, direction: Column) -> tuple[Column, Column]:
    """(place, sigma) of a jamb, head or sill between the last open evidence and the first solid one, walking in `direction` (1 or -1)."""
    gap = F.abs(solid - open_)
    crossed = solid.isNull() | ((solid - open_) * direction < -0.01)
    none = open_.isNull()
    place = (
        F.when(none, solid).when(crossed, open_).when(gap <= MET, (open_ + solid) / 2)
        .when(density >= DENSE, open_ + direction * 0.01).otherwise(open_ + direction * F.least(gap, F.lit(0.1)) / 2)
    )
    sigma = (
        F.when(none & solid.isNull(), 0.05).when(none, SOLID_SIGMA).when(crossed, F.when(density < DENSE, THIN_SIGMA).otherwise(DENSE_SIGMA))
        .when(gap <= MET, F.greatest(gap / F.sqrt(F.lit(12.0)), F.lit(0.004))).when(density >= DENSE, DENSE_SIGMA).otherwise(gap / 4 + 0.005)
    )
    return place, sigma


def laser_opening(bottom: Column, top: Column, width: Column) -> Column:
    """What a hole in a scanned wall is; null if nothing that counts."""
    floor = bottom < FLOOR_GAP
    return (
        F.when(floor & top.between(*DOOR_HEAD) & width.between(*DOOR_WIDTH), "door")
        .when(floor & (top >= PASSAGE_HEAD) & (width > DOOR_WIDTH[1]) & (width <= PASSAGE_WIDTH), "open_passage")
        .when(~floor & bottom.between(*WINDOW_SILL) & (top - bottom >= WINDOW_HIGH), "window")
    )


def spaced_levels(peaks: DataFrame, key: str, top: int = 6, least: float = 0.5, apart: float = 0.06) -> DataFrame:
    """(key, rank, y, area): of a scene's strongest peaks (y, s, area) those of enough area, 6 cm from any stronger one kept, by area."""
    by_strength = Window.partitionBy(key).orderBy(F.col("s").desc(), "y")
    strong = peaks.withColumn("_k", F.row_number().over(by_strength)).where(F.col("_k") <= top).where(F.col("area") >= least)
    lists = strong.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_k", "y", "area"))).alias("all"))

    def keep(kept, p):
        return F.when(F.forall(kept, lambda o: F.abs(o["y"] - p["y"]) > apart), F.concat(kept, F.array(p))).otherwise(kept)

    chosen = lists.select(key, F.explode(F.aggregate("all", F.filter("all", lambda x: F.lit(False)), keep)).alias("p")).select(key, "p.y", "p.area")
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("area").desc(), "y")))
