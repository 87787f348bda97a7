"""Concealed-damage rules: a declarative table joined with regions, pair rules, and checks of reference between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The rules' conditions; None means that a condition isn't set.
#: id, name, classes, surfaces, bottom below (m), room types, near a window (m), near an opening's head (m), least area (m2), severity
RULES = [
    ("CDR-01", "ceiling water stain", ["water_stain"], ["ceiling"], None, None, None, None, None, "high"),
    ("CDR-02", "water stain at wall base", ["water_stain"], ["wall"], 0.15, None, None, None, None, "high"),
    ("CDR-03", "water damage on a wet-room wall", ["water_stain", "peeling_paint", "mold"], ["wall"], None, ["bathroom", "kitchen", "laundry"], None, None, None, "medium"),
    ("CDR-04", "water damage near a window", ["water_stain", "peeling_paint", "mold"], ["wall"], None, None, 0.4, None, None, "medium"),
    ("CDR-05", "visible mold", ["mold"], None, None, None, None, None, None, "high"),
    ("CDR-06", "large mold area", ["mold"], None, None, None, None, None, 0.93, "high"),
    ("CDR-07", "crack from an opening corner", ["crack"], ["wall"], None, None, None, 0.35, None, "medium"),
    ("CDR-08", "ceiling crack", ["crack"], ["ceiling"], None, None, None, None, None, "low"),
    ("CDR-09", "hole in wall board", ["hole"], ["wall", "ceiling"], None, None, None, None, None, "low"),
    ("CDR-10", "peeling paint low on a wall", ["peeling_paint"], ["wall"], 0.3, None, None, None, None, "medium"),
    ("CDR-11", "water stain on floor", ["water_stain"], ["floor"], None, None, None, None, None, "high"),
]
PAIR_RULE = ("CDR-12", ["water_stain", "mold"], 0.3, "high")
SCHEMA = "rule string, name string, classes array<string>, surfaces array<string>, bottom_below double, room_types array<string>, near_window double, near_head double, least_area double, severity string"


def table(spark: SparkSession, rows=RULES) -> DataFrame:
    """Rules as rows: a rule file is data, and any table of this schema will do."""
    return spark.createDataFrame(rows, SCHEMA)


def near_openings(regions: DataFrame, openings: DataFrame) -> DataFrame:
    """Distances from each wall region to windows (along the wall) and to head corners of openings on its wall; least of each."""
    o = openings.select("room", "face", "kind", F.col("off").alias("o0"), (F.col("off") + F.col("width")).alias("o1"), (F.col("sill") + F.col("height")).alias("head"))
    both = regions.where("surface = 'wall'").select("region", "room", "face", "u0", "u1", "v0", "v1").join(o, ["room", "face"])
    zero = F.lit(0.0)
    along = F.greatest(F.col("o0") - F.col("u1"), F.col("u0") - F.col("o1"), zero)
    up = F.greatest(F.col("head") - F.col("v1"), F.col("v0") - F.col("head"), zero)
    corner = lambda c: F.sqrt(F.pow(F.greatest(F.col("u0") - F.col(c), zero, F.col(c) - F.col("u1")), F.lit(2.0)) + up * up)
    return both.groupBy("region").agg(F.min(F.when(F.col("kind") == "window", along)).alias("to_window"), F.min(F.least(corner("o0"), corner("o1"))).alias("to_head"))


def evaluate(regions: DataFrame, rooms: DataFrame, openings: DataFrame, rules: DataFrame) -> DataFrame:
    """(region, rule, severity, condition) for every rule a region meets. Conditions that a rule doesn't set hold.

    Rules are met by class first, an equality join; only then are the other conditions tested.
    """
    facts = regions.join(rooms.select("room", "room_type"), "room", "left").join(near_openings(regions, openings), "region", "left")
    by_class = rules.withColumn("class", F.explode("classes"))
    c = F.col
    unset = lambda n: c(n).isNull()
    area = (c("u1") - c("u0")) * (c("v1") - c("v0"))
    wall = c("surface") == "wall"
    near = lambda limit, distance: F.coalesce(wall & (F.round(c(distance), 6) <= c(limit)), F.lit(False))
    holds = (
        (unset("surfaces") | F.array_contains("surfaces", c("surface")))
        & (unset("bottom_below") | (wall & (c("v0") <= c("bottom_below"))))
        & (unset("room_types") | F.coalesce(F.array_contains("room_types", c("room_type")), F.lit(False)))
        & (unset("least_area") | (area >= c("least_area")))
        & (unset("near_window") | near("near_window", "to_window"))
        & (unset("near_head") | near("near_head", "to_head"))
    )
    said = F.concat_ws(
        "; ", F.concat(F.lit("class="), c("class")), F.when(~unset("surfaces"), F.concat(F.lit("surface="), c("surface"))),
        F.when(~unset("bottom_below"), F.format_string("bottom %.2f m", c("v0"))), F.when(~unset("room_types"), F.concat(F.lit("room type "), c("room_type"))),
        F.when(~unset("least_area"), F.format_string("area %.2f m2", area)), F.when(~unset("near_window"), F.lit("near a window")), F.when(~unset("near_head"), F.lit("near a head corner")))
    return facts.join(by_class, "class").where(holds).select("region", "room", "rule", "severity", said.alias("condition"))


#: Regions whose flags are numbered in one task.
NUMBERED = 4096


def flagged(found: DataFrame) -> DataFrame:
    """Numbers flags by region, then rule: within blocks of regions, after a sum over the blocks before."""
    placed = found.withColumn("_b", F.floor(F.col("region") / NUMBERED))
    counts = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_b", F.coalesce(before, F.lit(0)).alias("_s"))
    n = F.row_number().over(Window.partitionBy("_b").orderBy("region", "rule"))
    return placed.withColumn("_k", n).join(starts, "_b").withColumn("flag", F.concat(F.lit("F"), F.col("_s") + F.col("_k"))).drop("_b", "_k", "_s")


def pair_flags(regions: DataFrame, rooms: DataFrame) -> DataFrame:
    """A wall region that reaches the ceiling and a ceiling region near the same room's edge: one source of water."""
    rule, classes, gap, severity = PAIR_RULE
    wet = regions.where(F.col("class").isin(*classes))
    walls = wet.where("surface = 'wall'").select("room", F.col("region").alias("wall_region"), "u0", "u1", "v1")
    ceilings = wet.where("surface = 'ceiling'").select("room", F.col("region").alias("ceiling_region"), F.col("u0").alias("c0"), F.col("u1").alias("c1"), F.col("v0").alias("cv"))
    high = walls.join(rooms.select("room", "height"), "room").where(F.col("height") - F.col("v1") <= gap)
    along = F.greatest(F.col("c0") - F.col("u1"), F.col("u0") - F.col("c1"), F.lit(0.0))
    return high.join(ceilings, "room").where(F.sqrt(along * along + F.col("cv") * F.col("cv")) <= gap).select("room", "wall_region", "ceiling_region", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def integrity_errors(regions: DataFrame, rooms: DataFrame, openings: DataFrame, flags: DataFrame) -> DataFrame:
    """(check, id) for each row that refers to nothing or holds an impossible value."""
    def missing(name, rows, key, target, ident):
        return rows.join(target.select(key).distinct(), key, "left_anti").select(F.lit(name).alias("check"), F.col(ident).cast("long").alias("id"))

    parts = [
        missing("region without room", regions, "room", rooms, "region"),
        missing("opening without room", openings, "room", rooms, "opening"),
        missing("flag without region", flags, "region", regions, "region"),
        regions.where("u1 <= u0 or v1 <= v0").select(F.lit("region without extent").alias("check"), F.col("region").cast("long").alias("id")),
        openings.where("width <= 0 or height <= 0").select(F.lit("opening without extent").alias("check"), F.col("opening").cast("long").alias("id")),
        regions.join(rooms.select("room", "height"), "room").where("surface = 'wall' and v1 > height").select(F.lit("region over the ceiling").alias("check"), F.col("region").cast("long").alias("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def semantic_errors(rooms: DataFrame, surfaces: DataFrame, walls: DataFrame, openings: DataFrame, adjacency: DataFrame, regions: DataFrame, flags: DataFrame, scope: DataFrame) -> DataFrame:
    """(check, id, missing): what refers to nothing in a plan. walls (id, surface), openings (opening, to or null), adjacency (id, room, a row for each
    end), regions (region, surface), flags (flag, region, a row for each cited), scope (item, surface, region and flag, null where none is cited)."""
    def dangling(check, rows, ident, ref, target, key):
        cited = rows.where(F.col(ref).isNotNull()).select(F.lit(check).alias("check"), F.col(ident).cast("long").alias("id"), F.col(ref).cast("long").alias("missing")).distinct()
        return cited.join(target.select(F.col(key).cast("long").alias("missing")), "missing", "left_anti").select("check", "id", "missing")

    parts = [
        dangling("wall on unknown surface", walls, "id", "surface", surfaces, "surface"),
        dangling("opening to unknown room", openings, "opening", "to", rooms, "room"),
        dangling("adjacency with unknown room", adjacency, "id", "room", rooms, "room"),
        dangling("region on unknown surface", regions, "region", "surface", surfaces, "surface"),
        dangling("flag on unknown region", flags, "flag", "region", regions, "region"),
        dangling("scope on unknown surface", scope, "item", "surface", surfaces, "surface"),
        dangling("scope on unknown region", scope, "item", "region", regions, "region"),
        dangling("scope on unknown flag", scope, "item", "flag", flags, "flag"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
