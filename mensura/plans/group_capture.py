"""Catalogue: depth to points, damage evidence, assembly of rooms, photo and video tiers, laser truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import assembly, damage, depth, outlines, registration, tiers
from .adapters import edges, frame_poses, items, openings, pixels, plans, points, poses, rays, read, regions, rooms, stains, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


# ---- depth -------------------------------------------------------------------------------------

_K = (20.0, 20.0, 10.0, 10.0)
_OPTIONS = depth.DepthOptions(near=0.25, far=4.5, least=2, stride=2, scale=1.01, offset=0.002)
_FIXED = "SELECT frame, r, c, CASE WHEN d > 0 THEN d * 1.01::DOUBLE + 0.002::DOUBLE ELSE d * 1.01::DOUBLE END AS d, conf FROM v_pixels"
_FLYING = """SELECT p.frame, p.r, p.c FROM ({0}) p JOIN ({0}) q ON p.frame = q.frame AND abs(q.r - p.r) <= 1 AND abs(q.c - p.c) <= 1 AND (q.r <> p.r OR q.c <> p.c)
 GROUP BY p.frame, p.r, p.c HAVING max(abs(p.d - q.d)) > 0.04::DOUBLE * greatest(max(p.d), 0.001)"""
_TRUSTED = "SELECT * FROM ({0}) t WHERE d > 0.25 AND d < 4.5 AND conf >= 2 AND NOT EXISTS (SELECT 1 FROM (" + _FLYING + ") f WHERE f.frame = t.frame AND f.r = t.r AND f.c = t.c)"


@query(_TRUSTED.format("SELECT * FROM v_pixels"), "v_pixels")
def trusted_pixels(spark, d):
    return depth.trusted(pixels(spark, d), depth.DepthOptions())


#: Rows of the rotation that the poses' quaternion stands for, written out.
_QX, _QY, _QZ, _QW = 0.6 * 12 / 13, 0.8 * 5 / 13, -0.6 * 5 / 13, 0.8 * 12 / 13
_R = [[1 - 2 * (_QY**2 + _QZ**2), 2 * (_QX * _QY - _QZ * _QW), 2 * (_QX * _QZ + _QY * _QW)], [2 * (_QX * _QY + _QZ * _QW), 1 - 2 * (_QX**2 + _QZ**2), 2 * (_QY * _QZ - _QX * _QW)],
      [2 * (_QX * _QZ - _QY * _QW), 2 * (_QY * _QZ + _QX * _QW), 1 - 2 * (_QX**2 + _QY**2)]]


def _turn(a: str, b: str, c: str, k: int) -> str:
    return " + ".join(f"{v!r}::DOUBLE * {n}" for v, n in zip(_R[k], (a, b, c)))


_CAM = f"SELECT frame, r, c, (c - 10)::DOUBLE / 20 * d AS x, (r - 10)::DOUBLE / 20 * d AS y, d AS z FROM ({_TRUSTED.format(_FIXED)})"
_NORMAL = f"""SELECT frame, r, c, x, y, z, nx / s AS nx, ny / s AS ny, nz / s AS nz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) * CASE WHEN nx * x + ny * y + nz * z > 0 THEN -1 ELSE 1 END AS s
 FROM (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM (
  SELECT p.*, a.x - b.x AS ux, a.y - b.y AS uy, a.z - b.z AS uz, e.x - f.x AS vx, e.y - f.y AS vy, e.z - f.z AS vz FROM cam p JOIN cam a ON a.frame = p.frame AND a.r = p.r AND a.c = p.c + 2
  JOIN cam b ON b.frame = p.frame AND b.r = p.r AND b.c = p.c - 2 JOIN cam e ON e.frame = p.frame AND e.r = p.r + 2 AND e.c = p.c JOIN cam f ON f.frame = p.frame AND f.r = p.r - 2 AND f.c = p.c))) WHERE s <> 0"""


@query(f"""SELECT * FROM (WITH cam AS MATERIALIZED ({_CAM}) SELECT frame, r, c, round({_turn('x', 'y', 'z', 0)} + px, 5) AS x, round({_turn('x', 'y', 'z', 1)} + py, 5) AS y, round({_turn('x', 'y', 'z', 2)} + pz, 5) AS z,
 round({_turn('nx', 'ny', 'nz', 0)}, 5) AS nx, round({_turn('nx', 'ny', 'nz', 1)}, 5) AS ny, round({_turn('nx', 'ny', 'nz', 2)}, 5) AS nz FROM ({_NORMAL}) JOIN v_frame_poses USING (frame) WHERE r % 2 = 0 AND c % 2 = 0)""", "v_pixels", "v_frame_poses")  # fmt: skip
def backprojected_points(spark, d):
    return _rounded(depth.backprojected(pixels(spark, d), frame_poses(spark, d), _K, _OPTIONS), "x", "y", "z", "nx", "ny", "nz", places=5)


@query(f"""SELECT frame, r, c, round({_turn('x', 'y', 'd', 0)} + px, 6) AS x, round({_turn('x', 'y', 'd', 1)} + py, 6) AS y, round({_turn('x', 'y', 'd', 2)} + pz, 6) AS z
 FROM (SELECT *, (c - 10)::DOUBLE / 20 * d AS x, (r - 10)::DOUBLE / 20 * d AS y FROM v_pixels WHERE r % 4 = 0 AND c % 4 = 0 AND d > 0.25 AND d < 6 AND conf >= 1) JOIN v_frame_poses USING (frame)""", "v_pixels", "v_frame_poses")  # fmt: skip
def ray_ends(spark, d):
    return _rounded(depth.ray_ends(pixels(spark, d), frame_poses(spark, d), _K, 4), "x", "y", "z")


@query(f"""SELECT frame, r, c, round({_turn('x', 'y', 'z', 0)}, 6) AS dx, round({_turn('x', 'y', 'z', 1)}, 6) AS dy, round({_turn('x', 'y', 'z', 2)}, 6) AS dz FROM (SELECT frame, r, c, x / n AS x, y / n AS y, 1 / n AS z
 FROM (SELECT *, sqrt(x * x + y * y + 1) AS n FROM (SELECT *, (c - 10)::DOUBLE / 20 AS x, (r - 10)::DOUBLE / 20 AS y FROM v_pixels WHERE d <= 0 OR d > 5 OR conf = 0))) JOIN v_frame_poses USING (frame)""", "v_pixels", "v_frame_poses")  # fmt: skip
def miss_directions(spark, d):
    return _rounded(depth.miss_directions(pixels(spark, d), frame_poses(spark, d), _K, 1), "dx", "dy", "dz")


@query(f"SELECT frame, round(atan2({-_R[2][2]!r}::DOUBLE, {_R[0][2]!r}::DOUBLE), 6) AS heading FROM v_frame_poses", "v_frame_poses")
def camera_headings(spark, d):
    f = frame_poses(spark, d)
    r = geometry.rotation(*(F.col(f"q{c}") for c in "xyzw"))
    return f.select("frame", F.round(tiers.camera_heading(r), 6).alias("heading"))


# ---- damage ------------------------------------------------------------------------------------


@query("""SELECT region, NOT (coalesce(views < 2, false) OR coalesce(n >= 5 AND proud > 0.012, false) OR coalesce(border > 0.3, false) OR (kind = 'wall' AND coalesce(low >= 0.7, false)) OR (kind = 'wall' AND coalesce(high >= 0.7, false))) AS plausible
 FROM (SELECT region, any_value(kind) AS kind, median(views) FILTER (part = 'inside') AS views, count(protrusion) FILTER (part = 'inside') AS n, median(protrusion) FILTER (part = 'inside') AS proud, avg(CASE WHEN valid THEN 0::DOUBLE ELSE 1 END) FILTER (part <> 'inside') AS border,
 avg(CASE WHEN v < v0 + 0.12::DOUBLE THEN 1::DOUBLE ELSE 0 END) FILTER (part = 'inside') AS low, avg(CASE WHEN v > v1 - 0.06::DOUBLE THEN 1::DOUBLE ELSE 0 END) FILTER (part = 'inside') AS high FROM v_stains GROUP BY region)""", "v_stains")  # fmt: skip
def plausible_regions(spark, d):
    return damage.plausible(stains(spark, d).withColumn("inside", F.col("part") == "inside"))


_LINE = "SELECT region, u, CASE WHEN region % 3 = 0 THEN 7 WHEN region % 3 = 1 THEN 2 * u ELSE w END AS v FROM v_stains WHERE part = 'inside'"


@query(f"""SELECT region, n >= 5 AND NOT (coalesce(round(sqrt((uu + vv + root) / nullif(2 * (uu + vv), 0)), 9) > 0.97, false) AND round(least(angle - 90 * floor(angle / 90), 90 - (angle - 90 * floor(angle / 90))), 6) < 6) AS tortuous
 FROM (SELECT *, sqrt((uu - vv) ** 2 + 4 * uv * uv) AS root, abs(degrees(atan2(2 * uv, uu - vv) / 2)) AS angle FROM (SELECT region, count(*) AS n, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv FROM ({_LINE}) GROUP BY region))""", "v_stains")  # fmt: skip
def tortuous_cracks(spark, d):
    line = F.when(F.col("region") % 3 == 0, 7).when(F.col("region") % 3 == 1, 2 * F.col("u")).otherwise(F.col("w"))
    return damage.tortuous(stains(spark, d).where("part = 'inside'").select("region", "u", line.alias("v")))


_APPEAR = """SELECT region, {} AS tex FROM (SELECT region, count(*) FILTER (part = 'ring' AND valid) >= 20 AS enough, {}, stddev_pop(l) FILTER (part = 'inside') AS sd_i, stddev_pop(l) FILTER (part = 'ring' AND valid) AS sd_r,
 stddev_pop(l) FILTER (valid) AS sd_v FROM v_stains GROUP BY region)""".format(
    ", ".join(f"i{c} - CASE WHEN enough THEN r{c} ELSE v{c} END AS d{c}" for c in "lab") + ", sd_i / greatest(CASE WHEN enough THEN sd_r ELSE sd_v END, 1)",
    ", ".join(f"avg({c}) FILTER (part = 'inside') AS i{c}, avg({c}) FILTER (part = 'ring' AND valid) AS r{c}, avg({c}) FILTER (valid) AS v{c}" for c in "lab"))


@query(f"SELECT region, round(dl, 6) AS dl, round(da, 6) AS da, round(db, 6) AS db, round(tex, 6) AS tex FROM ({_APPEAR})", "v_stains")
def region_appearance(spark, d):
    return _rounded(damage.appearance(stains(spark, d)), "dl", "da", "db", "tex")


_CANDIDATES = """SELECT o_orderkey AS region, o_orderkey % 4 = 0 AS ridge, ['water_stain', 'mold', 'crack', 'hole', 'peeling_paint'][1 + o_custkey % 5] AS class, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS p, CAST(o_custkey % 40 AS DOUBLE) / 100 AS negative,
 CAST(o_orderkey % 30 AS DOUBLE) / 1000 AS area, CAST(o_orderkey % 50 AS DOUBLE) - 40 AS dl, CAST(o_custkey % 9 AS DOUBLE) - 2 AS db, CAST(o_orderkey % 20 AS DOUBLE) / 10 AS tex, o_custkey % 12 AS n, CAST(o_orderkey % 13 AS DOUBLE) / 500 - 0.015::DOUBLE AS proud,
 CAST(o_orderkey % 9 AS DOUBLE) AS elongation, CAST(o_custkey % 20 AS DOUBLE) / 1000 AS thickness, CAST(o_custkey % 25 AS DOUBLE) AS sl FROM orders"""


def _candidates(spark, d):
    return read(spark, d, "orders").selectExpr(
        "o_orderkey AS region", "o_orderkey % 4 = 0 AS ridge", "element_at(array('water_stain', 'mold', 'crack', 'hole', 'peeling_paint'), CAST(1 + o_custkey % 5 AS INT)) AS class", "CAST(o_orderkey % 100 AS DOUBLE) / 100 AS p", "CAST(o_custkey % 40 AS DOUBLE) / 100 AS negative",
        "CAST(o_orderkey % 30 AS DOUBLE) / 1000 AS area", "CAST(o_orderkey % 50 AS DOUBLE) - 40 AS dl", "CAST(o_custkey % 9 AS DOUBLE) - 2 AS db", "CAST(o_orderkey % 20 AS DOUBLE) / 10 AS tex", "o_custkey % 12 AS n", "CAST(o_orderkey % 13 AS DOUBLE) / 500 - 0.015D AS proud",
        "CAST(o_orderkey % 9 AS DOUBLE) AS elongation", "CAST(o_custkey % 20 AS DOUBLE) / 1000 AS thickness", "CAST(o_custkey % 25 AS DOUBLE) AS sl")


@query(f"""SELECT region, class, round(least(p / (p + negative + 1e-6::DOUBLE), 0.95), 6) AS confidence FROM ({_CANDIDATES}) WHERE NOT (ridge AND (class <> 'crack' OR p < 0.5)) AND NOT (class IN ('water_stain', 'mold', 'peeling_paint') AND area < 0.01) AND p >= 0.45 AND p >= negative * 2
 AND NOT (class = 'crack' AND NOT ridge AND (elongation < 4 OR thickness > 0.012)) AND CASE class WHEN 'water_stain' THEN db >= 2.5 OR dl <= -8 WHEN 'mold' THEN dl <= -15 AND tex >= 1.3 WHEN 'peeling_paint' THEN tex >= 1.5 WHEN 'hole' THEN dl <= -20 AND NOT (n >= 5 AND proud > -0.005) ELSE true END""")
def accepted_damage(spark, d):
    return _rounded(damage.accepted(_candidates(spark, d)).select("region", "class", "confidence"), "confidence")


@query(f"""SELECT * FROM (SELECT region, CASE WHEN ridge THEN 'crack' WHEN dl < -12 AND sl > 18 THEN 'mold' WHEN dl < -6 AND db > 3 THEN 'water_stain' END AS class, CASE WHEN ridge THEN 0.4::DOUBLE WHEN dl < -12 AND sl > 18 THEN 0.35::DOUBLE ELSE 0.4::DOUBLE END AS confidence
 FROM (SELECT * EXCLUDE (class) FROM ({_CANDIDATES}))) WHERE class IS NOT NULL""")
def guessed_damage(spark, d):
    return damage.guessed(_candidates(spark, d)).select("region", "class", "confidence")


_WALL_AT = "SELECT id AS region, scene, off AS x, lo AS y, top AS z, CASE WHEN axis = 0 THEN CAST(inward AS DOUBLE) ELSE 0::DOUBLE END AS nx, CASE WHEN axis = 1 THEN CAST(inward AS DOUBLE) ELSE 0::DOUBLE END AS ny FROM v_edges"


@query(f"""SELECT region, view, score FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, view) AS k FROM (SELECT region, ray AS view, round(cosine / greatest(distance, 0.5), 9) AS score FROM (
 SELECT *, ((px - x) * nx + (py - y) * ny) / greatest(distance, 1e-6) AS cosine FROM (SELECT *, sqrt((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2) AS distance FROM ({_WALL_AT}) JOIN v_rays USING (scene))) WHERE cosine >= 0.4 AND distance <= 3.5)) WHERE k = 1""", "v_edges", "v_rays")  # fmt: skip
def best_view_per_candidate(spark, d):
    c = F.col
    normal = lambda k: F.when(c("axis") == k, c("inward").cast("double")).otherwise(F.lit(0.0))
    at = edges(spark, d).select(c("id").alias("region"), "scene", c("off").alias("x"), c("lo").alias("y"), c("top").alias("z"), normal(0).alias("nx"), normal(1).alias("ny"), F.lit(0.0).alias("nz"))
    return damage.best_views(at, rays(spark, d).withColumnRenamed("ray", "view"))


@query("""SELECT surface, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round((c + 0.5) * 0.5::DOUBLE, 6) AS u, round(top - (r + 0.5) * 0.5::DOUBLE, 6) AS v, round(off + (c + 0.5) * 0.3::DOUBLE, 6) AS x, round(lo + (c + 0.5) * 0.4::DOUBLE, 6) AS y, round(top - (r + 0.5) * 0.5::DOUBLE, 6) AS z
 FROM (SELECT *, unnest(range(CAST(greatest(ceil(round(top / 0.5::DOUBLE, 9)), 1) AS BIGINT))) AS r FROM (SELECT *, unnest(range(CAST(greatest(ceil(round((hi - lo) / 0.5::DOUBLE, 9)), 1) AS BIGINT))) AS c FROM (SELECT id AS surface, off, lo, hi, top FROM v_edges)))""", "v_edges")  # fmt: skip
def surface_grid(spark, d):
    c = F.col
    s = edges(spark, d).select(
        c("id").alias("surface"), c("off").alias("ox"), c("lo").alias("oy"), F.lit(0.0).alias("oz"), F.lit(0.6).alias("ux"), F.lit(0.8).alias("uy"), F.lit(0.0).alias("uz"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(1.0).alias("vz"),
        F.lit(0.0).alias("u0"), (c("hi") - c("lo")).alias("u1"), F.lit(0.0).alias("v0"), c("top").alias("v1"))
    return _rounded(damage.surface_grid(s, 0.5), "u", "v", "x", "y", "z")


@query()
def scope_quantities(spark, d):
    r = regions(spark, d)
    w, h = F.col("u1") - F.col("u0") + 0.3, F.col("v1") - F.col("v0") + 0.3
    return damage.quantities(r.select(F.col("region").alias("line"), w.alias("a"), (w - 0.02).alias("a_lo"), (w + 0.03).alias("a_hi"), h.alias("b"), (h - 0.01).alias("b_lo"), (h + 0.01).alias("b_hi")))


# ---- assembly ----------------------------------------------------------------------------------


@query("""SELECT room, CAST(seq AS INT) AS seq, round(c * x - s * y + tx, 4) AS x, round(s * x + c * y + ty, 4) AS y FROM (SELECT part AS room, unnest([0, 1, 2, 3]) AS seq, unnest([x0, x1, x1, x0]) AS x, unnest([y0, y0, y1, y1]) AS y, CAST(size AS DOUBLE) / 3 AS tx, -1::DOUBLE AS ty,
 [1, 0, -1, 0][1 + part % 4] AS c, [0, 1, 0, -1][1 + part % 4] AS s FROM v_plans)""", "v_plans")  # fmt: skip
def placed_corners(spark, d):
    corner = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    p = plans(spark, d).withColumnsRenamed({"room": "_room", "part": "room"})
    corners = p.select("room", F.posexplode(F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in corner])).alias("seq", "p")).select("room", "seq", "p.*")
    turns = p.select("room", (F.col("room") % 4 * 90.0).alias("rotation"), (F.col("size") / 3).alias("tx"), F.lit(-1.0).alias("ty"))
    return assembly.placed(corners, turns)


_FACE = "SELECT room, CAST(unnest([0, 1, 2]) AS INT) AS face, CAST(room % 7 AS DOUBLE) AS x0, unnest([0, 1, 2])::DOUBLE AS y0, CAST(room % 7 AS DOUBLE) + 3 AS x1, unnest([0, 1, 2])::DOUBLE + 4 AS y1, unnest([0, 90, 180])::DOUBLE AS azimuth FROM v_rooms"


@query(f"""SELECT room, opening, round(x0 + 3 * (off + width / 2) / 5, 6) AS x, round(y0 + 4 * (off + width / 2) / 5, 6) AS y, round(cos(radians(azimuth)), 6) AS nx, round(sin(radians(azimuth)), 6) AS ny FROM v_openings JOIN ({_FACE}) USING (room, face)""", "v_openings", "v_rooms")
def door_centres(spark, d):
    c = F.col
    r = rooms(spark, d).select("room", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("face"))
    at = (c("room") % 7).cast("double")
    walls = r.select("room", "face", at.alias("x0"), c("face").cast("double").alias("y0"), (at + 3).alias("x1"), (c("face") + 4.0).alias("y1"), (c("face") * 90.0).alias("azimuth"))
    return _rounded(assembly.door_centres(openings(spark, d), walls), "x", "y", "nx", "ny")


@query("""SELECT site, room, rotation, round(coalesce((m - 360 * floor(m / 360) - 180) / 20, 0) ** 2, 6) AS penalty FROM (SELECT a.site, a.room, rotation, a.north - rotation - b.north + 180 AS m FROM (SELECT *, unnest([0, 90, 180, 270])::DOUBLE AS rotation FROM (
 SELECT site, room, CASE WHEN size % 5 > 0 THEN CAST(part * 7 % 360 AS DOUBLE) END AS north FROM v_plans)) a LEFT JOIN (SELECT site, CASE WHEN size % 5 > 0 THEN CAST(part * 7 % 360 AS DOUBLE) END AS north FROM v_plans WHERE room = 0) b USING (site))""", "v_plans")  # fmt: skip
def rotation_options(spark, d):
    r = plans(spark, d).select("site", "room", F.when(F.col("size") % 5 > 0, (F.col("part") * 7 % 360).cast("double")).alias("north"))
    return _rounded(assembly.rotation_options(r, r.where("room = 0"), "site"), "penalty")


_BEHIND = "SELECT CAST(room // 8 AS INT) AS site, CAST(room % 8 AS INT) AS room, opening, kind, CASE WHEN opening % 7 > 0 THEN CAST((opening * 3 + 1) % 9 AS INT) END AS to_room FROM v_openings"


@query(f"""SELECT site, a, b, CASE WHEN kind = 'door' THEN 'door' ELSE 'open_passage' END AS kind, via FROM (SELECT f.site, f.a, f.b, f.kind, list_sort(list(DISTINCT o.opening)) AS via FROM (
  SELECT site, least(room, to_room) AS a, greatest(room, to_room) AS b, room, opening, kind, row_number() OVER (PARTITION BY site, least(room, to_room), greatest(room, to_room) ORDER BY room, opening) AS k FROM ({_BEHIND}) x
  WHERE kind <> 'window' AND to_room IS NOT NULL AND room <> to_room AND EXISTS (SELECT 1 FROM ({_BEHIND}) y WHERE y.site = x.site AND y.room = x.to_room)) f
 JOIN ({_BEHIND}) o ON o.site = f.site AND least(o.room, o.to_room) = f.a AND greatest(o.room, o.to_room) = f.b AND o.to_room IS NOT NULL AND (o.opening = f.opening OR o.room <> f.room) WHERE f.k = 1 GROUP BY ALL)""", "v_openings")  # fmt: skip
def opening_adjacency(spark, d):
    o = openings(spark, d).selectExpr("CAST(room div 8 AS INT) AS site", "CAST(room % 8 AS INT) AS room", "opening", "kind", "CASE WHEN opening % 7 > 0 THEN CAST((opening * 3 + 1) % 9 AS INT) END AS to")
    return assembly.opening_adjacency(o)


@query("""SELECT a.site, a.room AS a, b.room AS b FROM v_plans a JOIN v_plans b ON a.site = b.site AND a.room < b.room WHERE a.size % 4 > 0 AND b.size % 4 > 0
 AND ((round(greatest(b.x0 - a.x1, a.x0 - b.x1), 9) BETWEEN 0 AND 0.35 AND round(greatest(b.y0 - a.y1, a.y0 - b.y1), 9) < -0.5) OR (round(greatest(b.y0 - a.y1, a.y0 - b.y1), 9) BETWEEN 0 AND 0.35 AND round(greatest(b.x0 - a.x1, a.x0 - b.x1), 9) < -0.5))""", "v_plans")  # fmt: skip
def box_adjacency(spark, d):
    return assembly.box_adjacency(plans(spark, d).where("size % 4 > 0"), "site")


_SEEN = "SELECT CAST(part // 12 AS INT) AS visit, part AS room, 4.12::DOUBLE * (part % 3) + CAST(size % 4 AS DOUBLE) / 50 AS x0, 4.12::DOUBLE * (part % 3) + 4 AS x1, CAST(size % 3 AS DOUBLE) / 40 AS y0, 3::DOUBLE AS y1 FROM v_plans"


@query(f"""SELECT * FROM (WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY visit ORDER BY room) AS k FROM ({_SEEN})),
 s AS (SELECT DISTINCT visit, 0::BIGINT AS k, []::BIGINT[] AS kept FROM b UNION ALL SELECT s.visit, b.k, CASE WHEN count(o.room) = 0 THEN list_append(any_value(s.kept), any_value(b.room)) ELSE any_value(s.kept) END FROM s JOIN b ON b.visit = s.visit AND b.k = s.k + 1
  LEFT JOIN b o ON o.visit = s.visit AND list_contains(s.kept, o.room) AND abs(o.x0 - b.x0) < 0.05 AND abs(o.x1 - b.x1) < 0.05 AND abs(o.y0 - b.y0) < 0.05 AND abs(o.y1 - b.y1) < 0.05 GROUP BY s.visit, b.k)
 SELECT b.visit, b.room, b.x0, b.x1, b.y0, b.y1 FROM b WHERE EXISTS (SELECT 1 FROM s WHERE s.visit = b.visit AND list_contains(s.kept, b.room)))""", "v_plans")  # fmt: skip
def first_boxes(spark, d):
    b = plans(spark, d).selectExpr("CAST(part div 12 AS INT) AS visit", "part AS room", "4.12D * (part % 3) + CAST(size % 4 AS DOUBLE) / 50 AS x0", "4.12D * (part % 3) + 4 AS x1", "CAST(size % 3 AS DOUBLE) / 40 AS y0", "3.0D AS y1")
    return assembly.first_boxes(b, "visit")


_DOORS = "SELECT site, room, part AS opening, CAST(size % 4 AS INT) AS side, 0.5::DOUBLE + CAST(part % 4 AS DOUBLE) / 2 AS off, 0.8::DOUBLE AS width FROM v_plans"


@query(f"""SELECT o.site, o.opening, r.room, CAST((o.side + 2) % 4 AS INT) AS side, round(CASE o.side WHEN 0 THEN r.x1 - (a.x0 + off + width) WHEN 1 THEN r.y1 - (a.y0 + off + width) WHEN 2 THEN a.x1 - off - width - r.x0 ELSE a.y1 - off - width - r.y0 END, 6) AS off
 FROM ({_DOORS}) o JOIN v_plans a ON a.site = o.site AND a.room = o.room JOIN v_plans r ON r.site = o.site AND r.room <> o.room WHERE CASE o.side WHEN 0 THEN abs(r.y1 - (a.y0 - 0.12::DOUBLE)) < 1e-6 AND r.x0 <= a.x0 + off + 1e-6 AND r.x1 >= a.x0 + off + width - 1e-6
 WHEN 1 THEN abs(r.x0 - (a.x1 + 0.12::DOUBLE)) < 1e-6 AND r.y0 <= a.y0 + off + 1e-6 AND r.y1 >= a.y0 + off + width - 1e-6 WHEN 2 THEN abs(r.y0 - (a.y1 + 0.12::DOUBLE)) < 1e-6 AND r.x1 >= a.x1 - off - 1e-6 AND r.x0 <= a.x1 - off - width + 1e-6
 ELSE abs(r.x1 - (a.x0 - 0.12::DOUBLE)) < 1e-6 AND r.y1 >= a.y1 - off - 1e-6 AND r.y0 <= a.y1 - off - width + 1e-6 END""", "v_plans")  # fmt: skip
def opposite_openings(spark, d):
    p = plans(spark, d)
    o = p.selectExpr("site", "room", "part AS opening", "CAST(size % 4 AS INT) AS side", "0.5D + CAST(part % 4 AS DOUBLE) / 2 AS off", "0.8D AS width")
    return assembly.opposite_openings(o, p.select("site", "room", "x0", "x1", "y0", "y1"), "site", 0.12)


@query("""SELECT b.scene, b.region, e.id AS line FROM (SELECT id AS region, scene, off AS x0, off + hi - lo AS x1, lo AS y0, lo + top AS y1 FROM v_edges) b JOIN v_edges e ON e.scene = b.scene
 WHERE CASE WHEN axis = 0 THEN off BETWEEN x0 - 0.6 AND x1 + 0.6 AND hi >= y0 - 0.2 AND lo <= y1 + 0.2 ELSE off BETWEEN y0 - 0.6 AND y1 + 0.6 AND hi >= x0 - 0.2 AND lo <= x1 + 0.2 END""", "v_edges")  # fmt: skip
def nearby_lines(spark, d):
    c, e = F.col, edges(spark, d)
    boxes = e.select("scene", c("id").alias("region"), c("off").alias("x0"), (c("off") + c("hi") - c("lo")).alias("x1"), c("lo").alias("y0"), (c("lo") + c("top")).alias("y1"))
    return assembly.nearby_lines(boxes, e.select("scene", c("id").alias("line"), "axis", "off", "lo", "hi"), "scene")


@query("""SELECT scene, edge, count(*) AS n, round(avg(place), 6) AS place FROM (SELECT e.scene, e.id AS edge, CASE WHEN axis = 0 THEN p.x ELSE p.z END AS place, CASE WHEN axis = 0 THEN p.z ELSE p.x END AS along, off, lo, hi, CASE WHEN hi - lo <= 0.24::DOUBLE THEN 0.25::DOUBLE * (hi - lo) ELSE 0.12::DOUBLE END AS inset
 FROM v_edges e JOIN (SELECT scene, frame % 4 AS facing, x, z FROM v_points) p ON p.scene = e.scene AND p.facing = e.facing) WHERE abs(place - off) < 0.08 AND along > lo + inset AND along < hi - inset GROUP BY ALL""", "v_points", "v_edges")  # fmt: skip
def edge_points(spark, d):
    p = points(spark, d).select("scene", (F.col("frame") % 4).alias("facing"), F.col("seq").alias("id"), "x", F.col("z").alias("y"))
    on = assembly.edge_points(edges(spark, d).withColumnRenamed("id", "edge"), p, "scene")
    return on.groupBy("scene", "edge").agg(F.count("*").alias("n"), F.round(F.avg("place"), 6).alias("place"))


_TOPS = "SELECT scene, frame % 4 AS facing, CAST(floor(round(x / 0.25::DOUBLE, 9)) AS BIGINT) AS ix, CAST(floor(round(z / 0.25::DOUBLE, 9)) AS BIGINT) AS iy, max(y) AS top FROM v_points GROUP BY ALL"
_STEPS = "SELECT *, greatest(CAST(floor(round((hi - lo) / 0.25::DOUBLE, 9)) AS INT), 1) AS n FROM v_edges"
_ALONG = f"SELECT scene, id, facing, axis, off, k, lo + k * CASE WHEN n > 1 THEN (hi - lo) / (n - 1) ELSE 0 END AS t FROM (SELECT *, unnest(range(n)) AS k FROM ({_STEPS}))"


@query(f"""SELECT e.scene, e.id AS line, coalesce(m.top, 0) AS top FROM v_edges e LEFT JOIN (SELECT scene, id, median(top) AS top FROM (SELECT a.scene, a.id, a.k, max(t.top) AS top FROM ({_ALONG}) a JOIN ({_TOPS}) t ON t.scene = a.scene AND t.facing = a.facing
 AND abs(t.ix - floor(round(CASE WHEN axis = 0 THEN off ELSE a.t END / 0.25::DOUBLE, 9))) <= 1 AND abs(t.iy - floor(round(CASE WHEN axis = 0 THEN a.t ELSE off END / 0.25::DOUBLE, 9))) <= 1 GROUP BY ALL) WHERE top > 0 GROUP BY ALL) m ON m.scene = e.scene AND m.id = e.id""", "v_points", "v_edges")  # fmt: skip
def line_tops(spark, d):
    cell = lambda c: F.floor(F.round(F.col(c) / 0.25, 9))
    tops = points(spark, d).groupBy("scene", (F.col("frame") % 4).alias("facing"), cell("x").alias("ix"), cell("z").alias("iy")).agg(F.max("y").alias("top"))
    return assembly.line_tops(edges(spark, d).withColumnRenamed("id", "line"), tops, "scene", 0.25)


@query("""SELECT scene, ix, iz FROM (SELECT scene, CAST(floor(round(x / 0.5::DOUBLE, 9)) AS BIGINT) AS ix, CAST(floor(round(z / 0.5::DOUBLE, 9)) AS BIGINT) AS iz, count(*) AS n, max(y) - min(y) AS span, max(y) AS top FROM v_points WHERE frame < 8 GROUP BY ALL)
 WHERE n >= 2 AND (span >= 0.9 OR (scene % 2 = 0 AND top >= 4.8 AND span >= 0.3))""", "v_points")  # fmt: skip
def wall_cells_by_facing(spark, d):
    cell = lambda c: F.floor(F.round(F.col(c) / 0.5, 9))
    cells = points(spark, d).where("frame < 8").groupBy("scene", cell("x").alias("ix"), cell("z").alias("iz")).agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("span"), F.max("y").alias("top"))
    return assembly.wall_cells(cells.withColumn("ceiling", F.when(F.col("scene") % 2 == 0, F.lit(5.0)))).select("scene", "ix", "iz")


_EVIDENCE = "SELECT id, CASE WHEN id % 5 > 0 THEN off END AS o, CAST(id % 9 AS DOUBLE) / 10 AS density, CASE WHEN id % 7 > 0 THEN off + CAST(id % 23 AS DOUBLE) / 100 * inward - 0.02::DOUBLE * (id % 3) * inward END AS s, inward AS dir FROM v_edges"


@query(f"""SELECT id, round(CASE WHEN o IS NULL THEN s WHEN s IS NULL OR (s - o) * dir < -0.01 THEN o WHEN abs(s - o) <= 0.05 THEN (o + s) / 2 WHEN density >= 0.4 THEN o + dir * 0.01::DOUBLE ELSE o + dir * least(abs(s - o), 0.1) / 2 END, 6) AS place,
 round(CASE WHEN o IS NULL AND s IS NULL THEN 0.05 WHEN o IS NULL THEN 0.02 WHEN s IS NULL OR (s - o) * dir < -0.01 THEN CASE WHEN density < 0.4 THEN 0.03 ELSE 0.012 END WHEN abs(s - o) <= 0.05 THEN greatest(abs(s - o) / sqrt(12), 0.004) WHEN density >= 0.4 THEN 0.012 ELSE abs(s - o) / 4 + 0.005 END::DOUBLE, 6) AS sigma FROM ({_EVIDENCE})""", "v_edges")  # fmt: skip
def located_edges(spark, d):
    e = edges(spark, d).selectExpr("id", "CASE WHEN id % 5 > 0 THEN off END AS o", "CAST(id % 9 AS DOUBLE) / 10 AS density", "CASE WHEN id % 7 > 0 THEN off + CAST(id % 23 AS DOUBLE) / 100 * inward - 0.02D * (id % 3) * inward END AS s", "inward AS dir")
    place, sigma = assembly.located_edge(F.col("o"), F.col("density"), F.col("s"), F.col("dir"))
    return e.select("id", F.round(place, 6).alias("place"), F.round(sigma, 6).alias("sigma"))


@query("""SELECT opening, CASE WHEN sill < 0.06 AND top BETWEEN 1.8 AND 2.6 AND width BETWEEN 0.55 AND 1.25 THEN 'door' WHEN sill < 0.06 AND top >= 1.9 AND width > 1.25 AND width <= 3 THEN 'open_passage' WHEN sill >= 0.06 AND sill BETWEEN 0.3 AND 1.6 AND top - sill >= 0.4 THEN 'window' END AS kind
 FROM (SELECT opening, sill, sill + height AS top, width + CAST(opening % 4 AS DOUBLE) / 4 AS width FROM v_openings)""", "v_openings")  # fmt: skip
def laser_opening_kinds(spark, d):
    wide = F.col("width") + (F.col("opening") % 4).cast("double") / 4
    return openings(spark, d).select("opening", assembly.laser_opening(F.col("sill"), F.col("sill") + F.col("height"), wide).alias("kind"))


_PEAKS = "SELECT CAST(p_partkey // 20 AS INT) AS scene, 2::DOUBLE + CAST(p_partkey * 7 % 97 AS DOUBLE) / 100 AS y, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 13 AS DOUBLE) / 6 AS area FROM part"


@query(f"""SELECT * FROM (WITH RECURSIVE p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY k) AS i FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY s DESC, y) AS k FROM ({_PEAKS})) WHERE k <= 6 AND area >= 0.5),
 t AS (SELECT DISTINCT scene, 0::BIGINT AS i, []::DOUBLE[] AS kept FROM p UNION ALL SELECT t.scene, p.i, CASE WHEN len(list_filter(t.kept, lambda o: abs(o - p.y) <= 0.06)) = 0 THEN list_append(t.kept, p.y) ELSE t.kept END FROM t JOIN p ON p.scene = t.scene AND p.i = t.i + 1)
 SELECT p.scene, p.y, p.area, CAST(row_number() OVER (PARTITION BY p.scene ORDER BY p.area DESC, p.y) AS INT) AS rank FROM p JOIN (SELECT scene, arg_max(kept, i) AS kept FROM t GROUP BY scene) USING (scene) WHERE list_contains(kept, p.y))""")  # fmt: skip
def ceiling_levels(spark, d):
    p = read(spark, d, "part").selectExpr("CAST(p_partkey div 20 AS INT) AS scene", "2.0D + CAST(p_partkey * 7 % 97 AS DOUBLE) / 100 AS y", "CAST(p_size AS DOUBLE) AS s", "CAST(p_partkey % 13 AS DOUBLE) / 6 AS area")
    return assembly.spaced_levels(p, "scene")


# ---- photo, video and laser --------------------------------------------------------------------


@query("""SELECT capture, pose, round(cos(a) * (x - 1) + sin(a) * (z - 2) + 1 + 0.5, 6) AS x, 1.5::DOUBLE AS y, round(-sin(a) * (x - 1) + cos(a) * (z - 2) + 2 - 0.25, 6) AS z FROM (SELECT *, CAST(capture % 7 AS DOUBLE) / 10 AS a FROM v_poses)""", "v_poses")
def anchored_poses(spark, d):
    p = poses(spark, d).select("capture", "pose", "x", F.lit(1.0).alias("y"), "z")
    fix = p.select("capture").distinct().selectExpr("capture", "1.0D AS cx", "1.0D AS cy", "2.0D AS cz", "CAST(capture % 7 AS DOUBLE) / 10 AS yaw", "0.5D AS tx", "0.5D AS ty", "-0.25D AS tz")
    return _rounded(tiers.anchored(p, fix, "capture"), "x", "z")


@query("""SELECT capture, pose, round(uy / n, 6) AS up_y, round(-(1 - uz * uz / (n * n)) / sqrt((ux * uz / (n * n)) ** 2 + (uy * uz / (n * n)) ** 2 + (1 - uz * uz / (n * n)) ** 2), 6) AS back_z, CAST((CAST(round(degrees(atan2(ux, -uy)) / 90) AS INT) % 4 + 4) % 4 AS INT) AS turns
 FROM (SELECT capture, pose, x - 1.01::DOUBLE AS ux, z - 0.52::DOUBLE AS uy, 0.3::DOUBLE AS uz, sqrt((x - 1.01::DOUBLE) ** 2 + (z - 0.52::DOUBLE) ** 2 + 0.09::DOUBLE) AS n FROM v_poses)""", "v_poses")  # fmt: skip
def gravity_frames(spark, d):
    ux, uy, uz = F.col("x") - 1.01, F.col("z") - 0.52, F.lit(0.3)
    r = tiers.gravity_frame(ux, uy, uz)
    return poses(spark, d).select("capture", "pose", F.round(r[1][1], 6).alias("up_y"), F.round(r[2][2], 6).alias("back_z"), tiers.upright_turns(ux, uy).alias("turns"))


@query("SELECT p_partkey AS photo, round(a + radians(h) - b, 6) AS yaw, round(f / (2016::DOUBLE / tan(30 * pi() / 180)), 6) AS focal FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) / 10 AS a, CAST(p_partkey % 7 AS DOUBLE) / 5 AS b, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 360 AS DOUBLE) - 90 END AS h, CAST(p_partkey % 900 + 2500 AS DOUBLE) AS f FROM part)")
def compass_and_focal(spark, d):
    p = read(spark, d, "part").selectExpr("p_partkey AS photo", "CAST(p_size AS DOUBLE) / 10 AS a", "CAST(p_partkey % 7 AS DOUBLE) / 5 AS b", "CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 360 AS DOUBLE) END AS h", "CAST(p_partkey % 900 + 2500 AS DOUBLE) AS f")
    return p.select("photo", F.round(tiers.compass_yaw(F.col("a"), F.col("b"), F.lit(90.0), F.col("h")), 6).alias("yaw"), F.round(tiers.focal_correction(F.col("f"), F.lit(4032.0)), 6).alias("focal"))


@query("""SELECT capture, pose, 2 * degrees(acos(least(round(abs(cos(h / 2 - g / 2)), 12), 1))) < 4 AND sqrt((x - bx) ** 2 + (z - bz) ** 2) < 0.2 AS same FROM (SELECT capture, pose, x, z, radians(heading) AS h, radians(lead(heading) OVER w) AS g, lead(x) OVER w AS bx, lead(z) OVER w AS bz FROM v_poses WINDOW w AS (PARTITION BY capture ORDER BY heading, x, pose)) WHERE g IS NOT NULL""", "v_poses")
def same_transforms(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("capture").orderBy("heading", "x", "pose")
    half = F.radians("heading") / 2
    one = {"aqx": F.lit(0.0), "aqy": F.sin(half), "aqz": F.lit(0.0), "aqw": F.cos(half), "apx": F.col("x"), "apy": F.lit(0.0), "apz": F.col("z")}
    p = poses(spark, d).withColumns(one)
    p = p.withColumns({f"b{n[1:]}": F.lead(n).over(w) for n in one}).where("bqw is not null")
    return p.select("capture", "pose", tiers.same_transform("a", "b").alias("same"))


_PIECE = "SELECT CAST(capture % 10 AS INT) AS walk, CAST(capture // 10 AS INT) AS piece, x * CASE WHEN capture % 3 = 0 THEN 9 ELSE 1 END AS x, value / 100 AS y, z + CASE WHEN capture % 4 = 0 THEN 7 ELSE 0 END AS z FROM v_poses"


@query(f"""SELECT walk, piece, min(x) >= any_value(x0) - any_value(reach) AND max(x) <= any_value(x1) + any_value(reach) AND min(y) >= any_value(y0) - any_value(reach) AND max(y) <= any_value(y1) + any_value(reach) AND min(z) >= any_value(z0) - any_value(reach) AND max(z) <= any_value(z1) + any_value(reach) AS "within"
 FROM (SELECT *, 3 + greatest(max(x) OVER p - min(x) OVER p, max(y) OVER p - min(y) OVER p, max(z) OVER p - min(z) OVER p) AS reach FROM ({_PIECE}) WHERE piece > 0 WINDOW p AS (PARTITION BY walk, piece))
 JOIN (SELECT walk, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM ({_PIECE}) WHERE piece = 0 GROUP BY walk) USING (walk) GROUP BY walk, piece""", "v_poses")  # fmt: skip
def pieces_within_reach(spark, d):
    p = poses(spark, d).selectExpr("CAST(capture % 10 AS INT) AS walk", "CAST(capture div 10 AS INT) AS piece", "x * CASE WHEN capture % 3 = 0 THEN 9 ELSE 1 END AS x", "value / 100 AS y", "z + CASE WHEN capture % 4 = 0 THEN 7 ELSE 0 END AS z")
    return tiers.within_reach(p.where("piece = 0"), p.where("piece > 0"), "walk")


_OBSERVED = "SELECT CAST(l_orderkey // 20 AS INT) AS frame, l_quantity / 10 + l_discount AS model, l_quantity / 12 - 0.2::DOUBLE AS z FROM lineitem"


@query(f"""SELECT frame, round(median(model / z) FILTER (z > 0.05 AND model > 0.1), 6) AS scale, count(*) FILTER (z > 0.05 AND model > 0.1) AS n FROM ({_OBSERVED}) GROUP BY frame HAVING count(*) >= 20 AND count(*) FILTER (z > 0.05 AND model > 0.1) >= 15""")
def frame_scales(spark, d):
    o = read(spark, d, "lineitem").selectExpr("CAST(l_orderkey div 20 AS INT) AS frame", "l_quantity / 10 + l_discount AS model", "l_quantity / 12 - 0.2D AS z")
    return _rounded(tiers.frame_scales(o), "scale")


@query("""SELECT capture, frame FROM (SELECT capture, pose AS frame, row_number() OVER (PARTITION BY capture ORDER BY pose) AS k FROM (SELECT *, count(*) OVER (PARTITION BY capture) AS n, quantile_cont(value, 0.35) OVER (PARTITION BY capture) AS cut FROM v_poses) WHERE n <= 60 OR value >= cut) WHERE k <= 60""", "v_poses")
def sharp_frames(spark, d):
    p = poses(spark, d).select("capture", F.col("pose").alias("frame"), F.col("value").alias("sharpness"))
    return tiers.sharp_enough(p, "capture", 60).select("capture", "frame")


_STAND = "SELECT CAST(s_suppkey // 3 AS INT) AS site, CAST(s_suppkey * 7 % 121 AS DOUBLE) / 10 AS x, CAST(s_suppkey * 11 % 61 AS DOUBLE) / 10 AS y FROM supplier"


@query(f"""SELECT site, room, cameras, area FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY cameras DESC, area DESC, room) AS k FROM (SELECT p.site, p.room, count(s.x) AS cameras, any_value(p.area) AS area FROM v_plans p LEFT JOIN ({_STAND}) s ON s.site = p.site AND s.x > p.x0 AND s.x < p.x1 AND s.y > p.y0 AND s.y < p.y1 GROUP BY p.site, p.room)) WHERE k = 1""", "v_plans")
def main_rooms(spark, d):
    cams = read(spark, d, "supplier").selectExpr("CAST(s_suppkey div 3 AS INT) AS site", "CAST(s_suppkey * 7 % 121 AS DOUBLE) / 10 AS x", "CAST(s_suppkey * 11 % 61 AS DOUBLE) / 10 AS y")
    return tiers.main_rooms(plans(spark, d), cams, "site")


@query("""SELECT capture, pose FROM (SELECT capture, pose, row_number() OVER (PARTITION BY capture ORDER BY t, pose) - 1 AS i, greatest(count(*) OVER (PARTITION BY capture) // 4, 1) AS step FROM v_poses) WHERE i % step = 0 AND i // step < 4""", "v_poses")
def every_nth_view(spark, d):
    return tiers.every_nth(poses(spark, d), ["t", "pose"], "capture").select("capture", "pose")


_INSIDE = "{0}.x > r.x0 - 0.3::DOUBLE AND {0}.x < r.x1 + 0.3::DOUBLE AND {0}.y > r.y0 - 0.3::DOUBLE AND {0}.y < r.y1 + 0.3::DOUBLE"
_FLOOR = "SELECT frame AS photo, x * 1.2::DOUBLE AS x, z * 1.6::DOUBLE AS y, scene FROM v_points"
_PHOTO = "SELECT scene, photo, CAST(photo * 7 % 50 AS DOUBLE) / 10 AS x, CAST(photo * 3 % 34 AS DOUBLE) / 10 AS y FROM (SELECT DISTINCT scene, frame AS photo FROM v_points)"
_ROOM = "SELECT DISTINCT scene, 0::DOUBLE AS x0, 4::DOUBLE AS x1, 0::DOUBLE AS y0, 2 + CAST(scene % 3 AS DOUBLE) / 2 AS y1 FROM v_points"


@query(f"""SELECT p.scene, p.photo FROM ({_PHOTO}) p JOIN ({_ROOM}) r USING (scene) LEFT JOIN (SELECT f.scene, f.photo, count(*) AS n, avg(CASE WHEN {_INSIDE.format('f')} THEN 1::DOUBLE ELSE 0 END) AS share FROM ({_FLOOR}) f JOIN ({_ROOM}) r USING (scene) GROUP BY f.scene, f.photo) s USING (scene, photo)
 WHERE NOT ({_INSIDE.format('p')}) OR coalesce(n >= 50 AND share < 0.6, false)""", "v_points")  # fmt: skip
def photo_conflicts(spark, d):
    p = points(spark, d)
    photos = p.select("scene", F.col("frame").alias("photo")).distinct().selectExpr("scene", "photo", "CAST(photo * 7 % 50 AS DOUBLE) / 10 AS x", "CAST(photo * 3 % 34 AS DOUBLE) / 10 AS y")
    room = p.select("scene").distinct().selectExpr("scene", "0.0D AS x0", "4.0D AS x1", "0.0D AS y0", "2 + CAST(scene % 3 AS DOUBLE) / 2 AS y1")
    return tiers.photo_conflicts(photos, p.selectExpr("scene", "frame AS photo", "x * 1.2D AS x", "z * 1.6D AS y"), room, "scene")


@query()
def sheet_consensus(spark, d):
    s = poses(spark, d).selectExpr("capture", "pose AS view", "CASE WHEN pose % 3 = 0 THEN 'letter' ELSE 'a4' END AS paper", "x / 4 AS x", "z / 4 AS y", "0.297D + value / 1e6 AS long", "value AS contrast")
    return tiers.sheet_consensus(s, "capture")


_BINNED = "SELECT scene, v, base, CAST(floor(round((v - base) / {0}::DOUBLE, 9)) AS BIGINT) AS bin FROM ({1}) JOIN (SELECT scene, min(v) {2} AS base, count(*) AS al FROM ({1}) GROUP BY scene) USING (scene)"


@query(f"""SELECT * FROM (WITH b AS MATERIALIZED ({_BINNED.format(0.01, 'SELECT scene, z AS v FROM v_points', '')} WHERE al >= 500), e AS (SELECT scene, min(bin) AS lo, max(bin) AS hi FROM (SELECT scene, bin, n, max(n) OVER (PARTITION BY scene) AS most FROM (SELECT scene, bin, count(*) AS n FROM b GROUP BY ALL)) WHERE n > 0.15 * most GROUP BY scene)
 SELECT scene, median(v) FILTER (abs(round(v - (base + (lo + 0.5) * 0.01::DOUBLE), 9)) < 0.02) AS floor, median(v) FILTER (abs(round(v - (base + (hi + 0.5) * 0.01::DOUBLE), 9)) < 0.02) AS ceiling FROM b JOIN e USING (scene) GROUP BY scene)""", "v_points")  # fmt: skip
def laser_levels(spark, d):
    return tiers.dense_levels(points(spark, d).select("scene", "z"), "scene")


@query(f"""SELECT * FROM (WITH b AS MATERIALIZED ({_BINNED.format(0.02, 'SELECT scene, y AS v FROM v_points WHERE frame < 12', '- 0.01::DOUBLE')}), t AS (SELECT scene, bin AS peak FROM (SELECT scene, bin, row_number() OVER (PARTITION BY scene ORDER BY count(*) DESC, bin) AS k FROM b GROUP BY scene, bin) WHERE k = 1),
 m AS (SELECT scene, count(*) AS al, count(*) FILTER (near) AS n, median(v) FILTER (near) AS main, median(v) FILTER (NOT near) AS other FROM (SELECT *, abs(round(v - (base + (peak + 0.5) * 0.02::DOUBLE), 9)) < 0.04 AS near FROM b JOIN t USING (scene)) GROUP BY scene)
 SELECT scene, round(CASE WHEN al >= 50 THEN main END, 6) AS main, round(CASE WHEN al >= 50 THEN n / al END, 6) AS share, round(CASE WHEN al >= 50 AND al - n > 0.15 * al THEN other END, 6) AS other FROM m)""", "v_points")  # fmt: skip
def room_levels(spark, d):
    return _rounded(tiers.room_levels(points(spark, d).where("frame < 12").select("scene", "y"), "scene"), "main", "share", "other")


@query("""SELECT * FROM (WITH p AS MATERIALIZED (SELECT scene, CAST(frame % 4 AS INT) AS facing, floor(x * x * 50) / 100 + 0.001::DOUBLE * (frame % 3) AS place, y AS h FROM v_points),
 s AS (SELECT scene, facing, min(place) AS lo, max(place) AS hi FROM p GROUP BY ALL HAVING count(*) >= 40 AND max(place) > min(place)),
 n AS (SELECT scene, facing, CAST(least(floor(round((place - lo) / ((hi - lo) / 60), 9)), 59) AS INT) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM p JOIN s USING (scene, facing) GROUP BY 1, 2, 3),
 k AS (SELECT a.scene, a.facing, a.bin, a.lo + (a.bin + 0.5::DOUBLE) * (a.hi - a.lo) / 60 AS centre FROM n a LEFT JOIN n b ON b.scene = a.scene AND b.facing = a.facing AND b.bin = a.bin - 1 LEFT JOIN n c ON c.scene = a.scene AND c.facing = a.facing AND c.bin = a.bin + 1
  JOIN (SELECT scene, facing, max(n) AS most FROM n GROUP BY ALL) m ON m.scene = a.scene AND m.facing = a.facing WHERE a.n >= 0.3 * most AND a.n >= coalesce(b.n, 0) AND a.n >= coalesce(c.n, 0)),
 l AS (SELECT k.scene, k.facing, k.bin, count(*) AS n, quantile_cont(h, 0.95) - quantile_cont(h, 0.05) AS tall, median(place) AS o FROM k JOIN p ON p.scene = k.scene AND p.facing = k.facing WHERE round(abs(place - centre) - 0.12::DOUBLE * greatest(abs(centre), 0.5), 9) < 0 GROUP BY ALL)
 SELECT scene, facing, round(o, 6) AS "offset", round(n / (greatest(abs(o), 0.3::DOUBLE) * greatest(abs(o), 0.3::DOUBLE)), 6) AS support FROM (SELECT *, row_number() OVER (PARTITION BY scene, facing ORDER BY round(n * tall, 6) DESC, bin DESC) AS r FROM l WHERE n >= 20) WHERE r = 1)""", "v_points")  # fmt: skip
def wall_layers(spark, d):
    p = points(spark, d).selectExpr("scene", "CAST(frame % 4 AS INT) AS facing", "floor(x * x * 50) / 100 + 0.001D * (frame % 3) AS at", "y AS h")
    return _rounded(tiers.wall_layers(p, "scene", "facing"), "offset", "support")


_CLOSURE = "SELECT o_orderkey AS loop, CAST(o_orderkey % 10 AS DOUBLE) / 12 AS share, CAST(o_custkey % 30 AS DOUBLE) / 1000 AS rms, CAST(o_orderkey % 7 AS DOUBLE) / 400 AS eigen, CAST(o_custkey % 50 AS DOUBLE) / 100 AS shift, CAST(o_orderkey % 17 AS DOUBLE) - 8 AS yaw, CAST(o_custkey % 90 AS DOUBLE) AS walked FROM orders"


@query(f"SELECT loop FROM ({_CLOSURE}) WHERE share >= 0.35 AND rms <= 0.02 AND eigen >= 0.008 AND abs(yaw) <= 6 AND shift <= least(3 * (0.012::DOUBLE * sqrt(greatest(walked, 1)) + 0.01::DOUBLE), 0.35)")
def loop_gate(spark, d):
    c = read(spark, d, "orders").selectExpr("o_orderkey AS loop", "CAST(o_orderkey % 10 AS DOUBLE) / 12 AS share", "CAST(o_custkey % 30 AS DOUBLE) / 1000 AS rms", "CAST(o_orderkey % 7 AS DOUBLE) / 400 AS eigen", "CAST(o_custkey % 50 AS DOUBLE) / 100 AS shift", "CAST(o_orderkey % 17 AS DOUBLE) - 8 AS yaw", "CAST(o_custkey % 90 AS DOUBLE) AS walked")
    return tiers.loop_gate(c).select("loop")


@query("""SELECT capture, round(largest, 6) AS largest, round(mean, 6) AS mean, round(residual, 6) AS residual FROM (SELECT capture, max(sqrt(x * x + z * z)) AS largest, avg(sqrt(x * x + z * z)) AS mean, median(sqrt(x * x / 4 + value * value / 1e6)) FILTER (pose % 4 = 0) AS residual FROM v_poses GROUP BY capture)""", "v_poses")
def loop_residuals(spark, d):
    p = poses(spark, d)
    closures = p.where("pose % 4 = 0").selectExpr("capture", "x / 2 AS ex", "value / 1e3 AS ey", "0.0D AS ez")
    return _rounded(tiers.loop_residuals(closures, p.selectExpr("capture", "x AS dx", "0.0D AS dy", "z AS dz"), "capture"), "largest", "mean", "residual")


_FORM = "CASE p_partkey % 5 WHEN 0 THEN '____' WHEN 1 THEN 'goal: ...' WHEN 2 THEN ' 2. ... ' WHEN 3 THEN 'done ...x' ELSE p_name END"


@query(f"""SELECT document, CAST(line_no AS INT) AS line_no, trim(raw) AS line FROM (SELECT document, unnest(range(len(l))) AS line_no, unnest(l) AS raw FROM (SELECT document, string_split(split_part(text, '## 4.', 1), chr(10)) AS l FROM (
 SELECT p_partkey AS document, '# 1' || chr(10) || {_FORM} || chr(10) || p_name || chr(10) || '## 4. ____' AS text FROM part))) WHERE regexp_matches(raw, '_{{4,}}|:\\s*\\.\\.\\.\\s*$|^\\s*(\\d+\\.)?\\s*\\.\\.\\.\\s*$')""")
def blank_lines(spark, d):
    docs = read(spark, d, "part").selectExpr("p_partkey AS document", f"concat_ws('\\n', '# 1', {_FORM}, p_name, '## 4. ____') AS text")
    return tiers.blank_lines(docs)


@query("SELECT site, room FROM v_plans p WHERE NOT EXISTS (SELECT 1 FROM v_plans q WHERE q.size % 4 = 1 AND q.site = p.site AND q.room = p.room)", "v_plans")
def reviewed_rooms(spark, d):
    p = plans(spark, d).select("site", "room", "size")
    return tiers.reviewed(p, p.where("size % 4 = 1"), "site", "room").select("site", "room")


@query("""SELECT capture, room, ref, truth, CASE WHEN capture <> 3 THEN CASE WHEN abs(10 + capture - truth) <= abs(30 - capture - truth) THEN 10 + capture ELSE 30 - capture END END::DOUBLE AS app_value FROM v_items WHERE kind = 'wall_length'""", "v_base", "v_items")
def nearest_extent(spark, d):
    walls = items(spark, d).where("kind = 'wall_length'").select("capture", "room", "ref", "truth")
    boxes = walls.select("capture").distinct().where("capture <> 3").selectExpr("capture", "CAST(10 + capture AS DOUBLE) AS width", "CAST(30 - capture AS DOUBLE) AS depth")
    return tiers.nearest_extent(walls, boxes, "capture").select("capture", "room", "ref", "truth", "app_value")


_LOOK = "SELECT site AS room, room AS photo, CAST(size % 4 AS INT) AS facing, CAST(part % 50 AS DOUBLE) / 10 - 2 AS offset, CAST(size AS DOUBLE) AS weight, CAST((part + site) % 4 AS INT) AS turns FROM v_plans"


@query(f"""SELECT room, photo, CAST(CASE WHEN abs(vx) > abs(vy) THEN CASE WHEN vx > 0 THEN 0 ELSE 1 END ELSE CASE WHEN vy > 0 THEN 2 ELSE 3 END END AS INT) AS wall, CAST(CASE WHEN abs(vx) > abs(vy) THEN 0 ELSE 1 END AS INT) AS axis, CASE WHEN abs(vx) > abs(vy) THEN ox ELSE oy END AS off, weight
 FROM (SELECT *, c * dx - s * dy AS vx, s * dx + c * dy AS vy, c * px - s * py AS ox, s * px + c * py AS oy FROM (SELECT *, [1, 0, -1, 0][1 + turns] AS c, [0, 1, 0, -1][1 + turns] AS s, [1, -1, 0, 0][1 + facing] AS dx, [0, 0, 1, -1][1 + facing] AS dy,
  CASE WHEN facing < 2 THEN "offset" ELSE 0 END AS px, CASE WHEN facing < 2 THEN 0 ELSE "offset" END AS py FROM ({_LOOK.replace('AS offset', 'AS "offset"')})))""", "v_plans")  # fmt: skip
def wall_equations(spark, d):
    p = plans(spark, d).selectExpr("site AS room", "room AS photo", "CAST(size % 4 AS INT) AS facing", "CAST(part % 50 AS DOUBLE) / 10 - 2 AS offset", "CAST(size AS DOUBLE) AS weight", "CAST((part + site) % 4 AS INT) AS turns")
    return tiers.rows_of_equations(p.drop("turns"), p.select("room", "photo", "turns"))


@query()
def structural_registration(spark, d):
    p = plans(spark, d).selectExpr("site AS room", "room AS photo", "CAST(size % 4 AS INT) AS facing", "CAST(part % 50 AS DOUBLE) / 10 + 1 AS offset", "CAST(size AS DOUBLE) AS weight", "CAST((part + site) % 4 AS INT) AS turns")
    both = p.unionByName(p.selectExpr("room", "photo", "(facing + 2) % 4 AS facing", "offset * 0.8D AS offset", "weight", "turns"))
    return registration.structures(tiers.rows_of_equations(both.drop("turns"), p.select("room", "photo", "turns")))


_LINK = """SELECT CAST(o_custkey AS INT) AS walk, o_orderkey % 7 AS a, o_orderkey % 7 + 1 + o_orderkey % 3 AS b, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS x, CAST(o_orderkey % 13 AS DOUBLE) / 10 AS z, CAST(o_orderkey % 6 AS DOUBLE) / 4 AS yaw,
 1 + CAST(o_orderkey % 5 AS DOUBLE) / 20 AS scale, CAST(o_orderkey AS DOUBLE) AS weight FROM orders"""


@query()
def spanning_poses(spark, d):
    links = read(spark, d, "orders").selectExpr("CAST(o_custkey AS INT) AS walk", "o_orderkey % 7 AS a", "o_orderkey % 7 + 1 + o_orderkey % 3 AS b", "CAST(o_orderkey % 11 AS DOUBLE) / 10 AS x",
                                               "CAST(o_orderkey % 13 AS DOUBLE) / 10 AS z", "CAST(o_orderkey % 6 AS DOUBLE) / 4 AS yaw", "1 + CAST(o_orderkey % 5 AS DOUBLE) / 20 AS scale", "CAST(o_orderkey AS DOUBLE) AS weight")
    return registration.spanning_poses(links, "walk")


@query(f"""SELECT * FROM (WITH RECURSIVE l AS MATERIALIZED (SELECT walk, a, b FROM ({_LINK}) UNION SELECT walk, b, a FROM ({_LINK})), r AS (SELECT walk, least(min(a), min(b)) AS node FROM l GROUP BY walk UNION SELECT l.walk, l.b FROM r JOIN l ON l.walk = r.walk AND l.a = r.node)
 SELECT walk, node FROM r)""")  # fmt: skip
def spanning_nodes(spark, d):
    return spanning_poses(spark, d).select("walk", "node")


@query()
def room_outlines(spark, d):
    p = points(spark, d)
    cell = lambda c: F.floor(F.round(F.col(c) / 0.1, 9))
    lines = edges(spark, d).select("scene", "axis", F.col("inward").alias("sign"), "off", "lo", "hi")
    return outlines.room_outlines(p.select("scene", cell("x").alias("ix"), cell("y").alias("iz")).distinct(), lines, 0.1)
