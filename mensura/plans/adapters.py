"""Views that let the operators run on the driver tables, in DataFrame form and as SQL of the same meaning.

Only arithmetic that every engine does alike stands here, so that both forms agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_views(body: str, *views: str) -> str:
    """SQL of a query over views, each view named before those that use it."""
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views) + "\n" + body


TIER = "CASE WHEN o_orderpriority < '3' THEN 'lidar' WHEN o_orderpriority < '4' THEN 'video' ELSE 'photo' END"
KIND = "CASE l_linenumber WHEN 1 THEN 'wall_length' WHEN 2 THEN 'wall_length' WHEN 3 THEN 'ceiling_height' WHEN 4 THEN 'opening_width' WHEN 5 THEN 'floor_area' WHEN 6 THEN 'footprint_area' ELSE 'damage_extent' END"
VALUE = "l_extendedprice / 1000.0D * (1.0D + (l_discount - l_tax) / 10.0D)"



def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score items: a prediction with its interval, against truth."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    base = rows.selectExpr("CAST(o_custkey % 9 AS INT) AS capture", f"{TIER} AS tier", f"{KIND} AS kind", "CAST(l_suppkey % 5 AS INT) AS room", "l_partkey AS ref", "l_extendedprice / 1000.0D AS truth", f"{VALUE} AS value", "l_quantity / 50.0D AS half")
    return base.selectExpr("capture", "tier", "kind", "room", "ref", "truth", "value", "value - half AS lo", "value + half AS hi")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point clouds of scenes, with frames; seq orders the points of a frame. Scenes grow in number with the table, not in size."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity / 10.0D AS x", "l_extendedprice / 20000.0D AS y", "l_discount * 20.0D + l_tax AS z", "CAST(l_orderkey % 64 AS INT) AS frame", "l_orderkey * 8 + l_linenumber AS seq",
        "CAST(l_suppkey div 10 AS INT) AS scene")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera positions of captures in time order; t in seconds."""
    return read(spark, sf_dir, "events").selectExpr(
        "user_id AS capture", "event_id AS pose", "CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS DOUBLE) / 1000000.0D AS t",
        "CAST(event_id % 101 AS DOUBLE) / 50.0D AS x", "CAST(event_id % 37 AS DOUBLE) / 40.0D AS z", "CAST(event_id % 360 AS DOUBLE) AS heading", "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "CAST(label AS INT) AS label", "embedding AS v")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall edges: axis, offset along its normal, extent, and the side that is inside."""
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "CAST(p_partkey div 5 AS INT) AS room", "CAST(p_partkey div 200 AS INT) AS scene", "CAST(p_size % 2 AS INT) AS axis", "CAST(p_partkey * 7 % 113 AS DOUBLE) / 20.0D AS off",
        "CAST(p_partkey * 3 % 47 AS DOUBLE) / 10.0D AS lo", "CAST(p_partkey * 3 % 47 AS DOUBLE) / 10.0D + CAST(p_size AS DOUBLE) / 10.0D AS hi",
        "CAST(CASE WHEN p_partkey % 4 < 2 THEN 1 ELSE -1 END AS INT) AS inward", "CAST(p_size AS DOUBLE) / 20.0D + 1.0D AS top", "CAST(p_partkey % 4 AS INT) AS facing")


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays from a camera (px, py, pz) to an end (qx, qy, qz)."""
    return read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS ray", "CAST(s_suppkey div 10 AS INT) AS scene", "CAST(s_suppkey * 11 % 61 AS DOUBLE) / 10.0D AS px", "CAST(s_suppkey * 13 % 59 AS DOUBLE) / 10.0D AS py", "1.5D AS pz",
        "CAST(s_suppkey * 17 % 67 AS DOUBLE) / 10.0D + 0.05D AS qx", "CAST(s_suppkey * 19 % 71 AS DOUBLE) / 10.0D + 0.05D AS qy", "CAST(s_suppkey * 5 % 23 AS DOUBLE) / 10.0D AS qz")


CLASSES = ("water_stain", "mold", "crack", "hole", "peeling_paint")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage regions on surfaces: extents along the surface (u) and its height (v)."""
    return read(spark, sf_dir, "orders").selectExpr(*_REGION)


_REGION = (
    "o_orderkey AS region", "CAST(o_custkey AS INT) AS room", "CAST(o_orderkey % 6 AS INT) AS face",
    "CASE WHEN o_orderkey % 6 < 4 THEN 'wall' WHEN o_orderkey % 6 = 4 THEN 'floor' ELSE 'ceiling' END AS surface",
    "CASE o_custkey % 5 WHEN 0 THEN 'water_stain' WHEN 1 THEN 'mold' WHEN 2 THEN 'crack' WHEN 3 THEN 'hole' ELSE 'peeling_paint' END AS class",
    "CAST(o_orderkey % 31 AS DOUBLE) / 10.0D AS u0", "CAST(o_orderkey % 31 AS DOUBLE) / 10.0D + CAST(o_custkey % 17 + 1 AS DOUBLE) / 20.0D AS u1",
    "CAST(o_orderkey % 23 AS DOUBLE) / 10.0D AS v0", "CAST(o_orderkey % 23 AS DOUBLE) / 10.0D + CAST(o_custkey % 13 + 1 AS DOUBLE) / 20.0D AS v1",
)


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of plans, with type and height."""
    return read(spark, sf_dir, "part").selectExpr(*_ROOM)


_ROOM = ("CAST(p_partkey AS INT) AS room", "CASE p_partkey % 4 WHEN 0 THEN 'bathroom' WHEN 1 THEN 'kitchen' WHEN 2 THEN 'bedroom' ELSE 'hall' END AS room_type",
         "2.3D + CAST(p_partkey % 5 AS DOUBLE) / 10.0D AS height", "3.0D + CAST(p_partkey % 7 AS DOUBLE) / 2.0D AS length", "2.0D + CAST(p_partkey % 3 AS DOUBLE) AS width")


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doors and windows on walls (room, face), four a room."""
    return read(spark, sf_dir, "part").selectExpr(*_OPENING)


_OPENING = ("p_partkey AS opening", "CAST(p_partkey div 4 + 1 AS INT) AS room", "CAST(p_partkey % 3 AS INT) AS face", "CASE WHEN p_partkey % 2 = 0 THEN 'door' ELSE 'window' END AS kind",
            "CAST(p_partkey % 19 AS DOUBLE) / 10.0D AS off", "0.7D + CAST(p_partkey % 6 AS DOUBLE) / 10.0D AS width", "1.0D + CAST(p_partkey % 11 AS DOUBLE) / 10.0D AS height",
            "CASE WHEN p_partkey % 2 = 0 THEN 0.0D ELSE 0.9D END AS sill")



def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth rasters of 20 x 20 pixels; some are missing, some too far, some unsure."""
    return read(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey div 400 AS INT) AS frame", "CAST(p_partkey % 400 div 20 AS INT) AS r", "CAST(p_partkey % 20 AS INT) AS c",
        "CASE WHEN p_partkey % 97 = 0 THEN 0.0D WHEN p_partkey % 89 = 0 THEN 5.5D ELSE 2.0D + CAST(p_partkey * p_partkey % 61 AS DOUBLE) / 1000.0D END AS d", "CAST(CASE WHEN p_size % 23 = 0 THEN 0 WHEN p_size % 7 = 0 THEN 1 ELSE 2 END AS INT) AS conf")


def frame_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pose for each raster: a turn about x (3, 4) and one about y (5, 12), so that the quaternion is exact."""
    return read(spark, sf_dir, "part").where("p_partkey % 400 = 1").selectExpr(
        "CAST(p_partkey div 400 AS INT) AS frame", "0.6D * 12.0D / 13.0D AS qx", "0.8D * 5.0D / 13.0D AS qy", "-0.6D * 5.0D / 13.0D AS qz", "0.8D * 12.0D / 13.0D AS qw",
        "CAST(p_partkey div 400 AS DOUBLE) AS px", "1.5D AS py", "CAST(p_partkey div 400 AS DOUBLE) / -2.0D AS pz")


def stains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of candidate regions, of the rings around them and of the rest of their surfaces."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_suppkey AS INT) AS region", "CAST(l_quantity AS INT) AS u", "CAST(l_partkey % 37 AS INT) AS w", "CAST(l_linenumber AS INT) AS views",
        "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount / 5.0D + CAST(l_suppkey % 7 AS DOUBLE) / 500.0D - 0.01D END AS protrusion",
        "CASE WHEN l_orderkey % 5 < 2 THEN 'inside' WHEN l_orderkey % 5 < 4 THEN 'ring' ELSE 'rest' END AS part", "(l_partkey + l_suppkey) % 10 >= l_suppkey % 6 AS valid",
        "CASE WHEN l_suppkey % 3 = 0 THEN 'ceiling' ELSE 'wall' END AS kind", "CASE WHEN l_suppkey % 8 = 0 THEN 0.05D ELSE 0.0D END + CAST(l_partkey % 53 AS DOUBLE) / 25.0D * CASE WHEN l_suppkey % 8 = 0 THEN 0.03D ELSE 1.0D END AS v",
        "0.0D AS v0", "2.1D AS v1", "l_quantity * CASE WHEN l_orderkey % 5 < 2 THEN 1.0D + CAST(l_suppkey % 9 AS DOUBLE) / 10.0D ELSE 1.0D END AS l", "l_tax * 100.0D AS a",
        "l_discount * 100.0D + CASE WHEN l_orderkey % 5 < 2 THEN CAST(l_suppkey % 5 AS DOUBLE) ELSE 0.0D END AS b")


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms as boxes, six to a site in two rows of three with walls of 12 cm between them."""
    return read(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey div 6 AS INT) AS site", "CAST(p_partkey % 6 AS INT) AS room", "CAST(p_partkey % 3 AS DOUBLE) * 4.12D AS x0", "CAST(p_partkey % 3 AS DOUBLE) * 4.12D + 4.0D AS x1",
        "CAST(p_partkey % 6 div 3 AS DOUBLE) * 3.12D AS y0", "CAST(p_partkey % 6 div 3 AS DOUBLE) * 3.12D + 3.0D AS y1", "4.0D * 3.0D AS area", "p_partkey AS part", "CAST(p_size AS INT) AS size")


_NO_D = r"\b(\d+\.\d+)D"


def _sql(columns, table, where="") -> str:
    import re

    body = f"SELECT {', '.join(columns)} FROM {table} {where}"
    body = re.sub(r"\bdiv\b", "//", body).replace("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)", "epoch_us(ts)")
    return re.sub(_NO_D, r"CAST(\1 AS DOUBLE)", body)


class _Recorder:
    """Stands in for a DataFrame to get an adapter's expressions, so that they are written once."""

    def __init__(self, name):
        self.name, self.filter = name, ""

    def where(self, text):
        self.filter = f"WHERE {text}"
        return self

    def selectExpr(self, *columns):  # noqa: N802
        return _sql(columns, self.name, self.filter)


def _recorded(adapter) -> str:
    global read
    kept = read
    read = lambda spark, sf_dir, name: _Recorder(name)
    try:
        return adapter(None, "")
    finally:
        read = kept


VIEWS = {f"v_{f.__name__}": _recorded(f) for f in (points, poses, vectors, edges, rays, regions, rooms, openings, pixels, frame_poses, stains, plans)}
VIEWS["v_base"] = _sql(("CAST(o_custkey % 9 AS INT) AS capture", f"{TIER} AS tier", f"{KIND} AS kind", "CAST(l_suppkey % 5 AS INT) AS room", "l_partkey AS ref", "l_extendedprice / 1000.0D AS truth", f"{VALUE} AS value", "l_quantity / 50.0D AS half"), "lineitem JOIN orders ON l_orderkey = o_orderkey")
VIEWS["v_items"] = "SELECT capture, tier, kind, room, ref, truth, value, value - half AS lo, value + half AS hi FROM v_base"
VIEWS["v_sel"] = "SELECT capture, value, truth, ln(truth / value) AS g FROM v_items WHERE tier = 'lidar' AND kind IN ('wall_length', 'ceiling_height') AND value > 0 AND truth > 0"
