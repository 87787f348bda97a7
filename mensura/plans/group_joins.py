"""Catalogue: as-of, interpolation, nearest neighbours, rays, overlaps, similarity, assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, kernels, scoring
from .adapters import edges, openings, points, poses, rays, read, rooms, vectors, with_views

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


_LEFT, _RIGHT = "pose % 3 = 0", "pose % 3 <> 0"


@query(f"""SELECT capture, pose, rid, dt FROM (SELECT a.capture, a.pose, b.pose AS rid, abs(a.t - b.t) AS dt, row_number() OVER (PARTITION BY a.capture, a.pose ORDER BY abs(a.t - b.t), b.pose) AS k FROM (SELECT * FROM v_poses WHERE {_LEFT}) a JOIN (SELECT * FROM v_poses WHERE {_RIGHT}) b
 ON a.capture = b.capture AND abs(a.t - b.t) <= 86400) WHERE k = 1""", "v_poses")  # fmt: skip
def asof_nearest_tolerance(spark, d):
    p = poses(spark, d)
    right = p.where(_RIGHT).select("capture", "t", F.col("pose").alias("rid"))
    return joins.asof_nearest(p.where(_LEFT), right, "capture", 86400.0, "pose")


@query(f"""SELECT l.capture, l.pose, l.t, round(CASE WHEN p.t IS NULL THEN n.v WHEN n.t IS NULL OR n.t = p.t THEN p.v ELSE p.v + (l.t - p.t) / (n.t - p.t) * (n.v - p.v) END, 6) AS v
 FROM (SELECT * FROM v_poses WHERE {_LEFT}) l ASOF LEFT JOIN (SELECT capture, t, x AS v FROM v_poses WHERE {_RIGHT}) p ON l.capture = p.capture AND l.t >= p.t ASOF LEFT JOIN (SELECT capture, t, x AS v FROM v_poses WHERE {_RIGHT}) n ON l.capture = n.capture AND l.t <= n.t""", "v_poses")  # fmt: skip
def interp_asof(spark, d):
    p = poses(spark, d)
    return _rounded(joins.interpolated(p.where(_LEFT), p.where(_RIGHT).select("capture", "t", F.col("x").alias("v")), "capture", "pose"), "v")


_ONE = "SELECT scene, seq, max(x) AS x, max(y) AS y, max(z) AS z FROM v_points GROUP BY scene, seq"


def _one(spark, d):
    """A point for each number of a scene."""
    return points(spark, d).groupBy("scene", F.col("seq").alias("id")).agg(*[F.max(c).alias(c) for c in "xyz"])


_NN = f"""SELECT scene, id, rid, d2, row_number() OVER (PARTITION BY scene, id ORDER BY d2, rid) AS k FROM (
 SELECT a.scene, a.seq AS id, b.seq AS rid, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2
 FROM ({_ONE}) a JOIN ({_ONE}) b ON a.scene = b.scene AND a.seq % 2 = 0 AND b.seq % 2 = 1
 AND b.x BETWEEN a.x - {{0}} AND a.x + {{0}} AND b.y BETWEEN a.y - {{0}} AND a.y + {{0}} AND b.z BETWEEN a.z - {{0}} AND a.z + {{0}}) WHERE d2 <= {{0}}::DOUBLE * {{0}}::DOUBLE"""


def _cloud(spark, d, part):
    """The points of even (left) or odd (right) number."""
    return _one(spark, d).where(F.col("id") % 2 == part)


@query(f"SELECT scene, id, rid, sqrt(d2) AS distance, CAST(k AS INT) AS k FROM ({_NN.format(0.2)}) WHERE k <= 4", "v_points")
def knn_voxel_bucket(spark, d):
    return joins.nearest_points(_cloud(spark, d, 0), _cloud(spark, d, 1), 0.2, 4, "scene")


_HALF = f"SELECT scene, seq, {{x}} AS x, y, z FROM ({_ONE}) WHERE {{where}}"
_MIRROR = f"""SELECT l.scene, l.seq AS id, count(r.seq) AS hits FROM ({_HALF.format(x='5 - x', where='x < 2.5')}) l LEFT JOIN ({_HALF.format(x='x', where='x >= 2.5')}) r
 ON l.scene = r.scene AND r.x BETWEEN l.x - 0.15 AND l.x + 0.15 AND r.y BETWEEN l.y - 0.15 AND l.y + 0.15 AND r.z BETWEEN l.z - 0.15 AND l.z + 0.15
 AND (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z) <= 0.15::DOUBLE * 0.15::DOUBLE GROUP BY ALL"""


@query(f"SELECT scene, round(avg(CASE WHEN hits > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS share, avg(CASE WHEN hits > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) >= 0.6 AS mirror FROM ({_MIRROR}) GROUP BY scene", "v_points")
def mirror_nn_fraction(spark, d):
    planes = points(spark, d).select("scene", F.lit(0).alias("axis"), F.lit(2.5).alias("off")).distinct()
    return _rounded(joins.mirrored_share(_one(spark, d), planes, 0.15), "share")


_CROSS = """SELECT scene, ray, id, s, h FROM (SELECT *, CASE axis WHEN 0 THEN py + (qy - py) * share ELSE px + (qx - px) * share END AS s, pz + (qz - pz) * share AS h FROM (SELECT *, a0 / (a0 - a1) AS share FROM (SELECT *, (CASE axis WHEN 0 THEN px ELSE py END - off) * inward AS a0, (CASE axis WHEN 0 THEN qx ELSE qy END - off) * inward AS a1
 FROM v_rays JOIN v_edges USING (scene)) WHERE a0 > 0.02 AND a1 < -0.15)) WHERE s >= lo AND s <= hi"""


@query(f"SELECT scene, ray, id, round(s, 6) AS s, round(h, 6) AS h FROM ({_CROSS})", "v_rays", "v_edges")
def ray_plane_cross(spark, d):
    return _rounded(joins.ray_plane(rays(spark, d), edges(spark, d)), "s", "h")


@query(f"SELECT id, count(*) FILTER (h > top) AS over_top, count(*) AS through FROM ({_CROSS}) JOIN (SELECT id, top FROM v_edges) USING (id) GROUP BY id", "v_rays", "v_edges")
def rays_over_top(spark, d):
    e = edges(spark, d)
    return joins.rays_over(joins.ray_plane(rays(spark, d), e), e).withColumnRenamed("over", "over_top")


_PAIR = "SELECT a.id, a.room, b.room AS room2, a.lo, a.hi, a.top, b.top AS top2, a.inward, b.inward AS inward2, a.facing, a.off - b.off AS gap, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS shared FROM v_edges a JOIN v_edges b ON a.scene = b.scene AND a.id <> b.id AND {}"


@query(f"SELECT id, off FROM v_edges WHERE id NOT IN (SELECT id FROM ({_PAIR.format('a.facing = b.facing')}) WHERE gap * CASE WHEN facing % 2 = 0 THEN 1 ELSE -1 END BETWEEN 0.03 AND 1.2 AND shared >= 0.5 * (hi - lo) AND top2 >= top + 0.2)", "v_edges")
def occluder_self_anti(spark, d):
    return joins.without_occluders(edges(spark, d)).select("id", "off")


@query("""SELECT id, line, shared FROM (SELECT a.id, b.id AS line, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS shared, row_number() OVER (PARTITION BY a.id ORDER BY least(a.hi, b.hi) - greatest(a.lo, b.lo) DESC, b.id) AS k FROM v_edges a JOIN v_edges b ON a.scene = b.scene AND a.axis = b.axis AND a.id <> b.id AND abs(a.off - b.off) <= 0.04
 WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) > 0) WHERE k = 1""", "v_edges")  # fmt: skip
def best_overlap_edge(spark, d):
    e = edges(spark, d)
    return joins.best_overlap(e, e)


@query(f"SELECT room AS a, room2 AS b, max(shared) AS shared, count(*) AS candidates FROM ({_PAIR.format('a.axis = b.axis AND a.room < b.room AND a.inward = -b.inward')}) WHERE abs(gap) BETWEEN 0.03 AND 0.45 AND shared >= 0.3 GROUP BY ALL", "v_edges")
def shared_wall_pairs(spark, d):
    return joins.shared_walls(edges(spark, d))


_BOX = "SELECT id, scene, off AS x0, off + hi - lo AS x1, lo AS y0, lo + top AS y1 FROM v_edges"


def _boxes(spark, d):
    c = F.col
    return edges(spark, d).select("id", "scene", c("off").alias("x0"), (c("off") + c("hi") - c("lo")).alias("x1"), c("lo").alias("y0"), (c("lo") + c("top")).alias("y1"))


@query(f"""SELECT * FROM (SELECT p.scene, p.id AS a, q.id AS b, (least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.y1, q.y1) - greatest(p.y0, q.y0)) AS area FROM ({_BOX}) p JOIN ({_BOX}) q ON p.scene = q.scene AND p.id < q.id AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1) WHERE area > 0.01""", "v_edges")
def overlap_pairs(spark, d):
    return joins.overlapping(_boxes(spark, d), 0.01, "scene")


#: An L-shaped room, corners in order; a fixture of the query.
_CORNERS = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.5, 2.0), (2.5, 4.5), (0.0, 4.5)]
_SIDES = [(*a, *b) for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1])]
_SIDES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for a, b, c, e in _SIDES) + ") AS t(x1, y1, x2, y2)"


@query(f"""SELECT scene, id, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * ((x2 - x1) / nullif(y2 - y1, 0)) THEN 1 ELSE 0 END) % 2 = 1 AS inside
 FROM (SELECT scene, seq AS id, x, y FROM ({_ONE})), ({_SIDES_SQL}) GROUP BY ALL""", "v_points")  # fmt: skip
def point_in_polygon(spark, d):
    at = _one(spark, d).drop("z")
    sides = at.select("scene").distinct().withColumn("s", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(side, ("x1", "y1", "x2", "y2"))]) for side in _SIDES])))
    return joins.in_polygon(at, sides.select("scene", "s.*"), "scene")


@query("""SELECT scene, frame, label, n FROM (SELECT scene, frame, label, n, row_number() OVER (PARTITION BY scene, frame ORDER BY n DESC, label) AS k FROM (
 SELECT scene, frame, CAST(floor(round(x / 0.5::DOUBLE, 9)) AS BIGINT) AS label, count(*) AS n FROM v_points GROUP BY ALL) WHERE n >= 5 AND label <> frame % 10) WHERE k = 1""", "v_points")
def room_behind_mode(spark, d):
    hits = points(spark, d).select("scene", "frame", F.floor(F.round(F.col("x") / 0.5, 9)).alias("label"))
    return joins.mode_label(hits.where(F.col("label") != F.col("frame") % 10), 5, "scene", "frame")


_ANCHOR = "SELECT capture, part, t, x, z FROM (SELECT capture, CAST(row_number() OVER (PARTITION BY capture ORDER BY t, pose) AS INT) AS part, t, x, z FROM v_poses)"


@query(f"""SELECT capture, a, b, distance, CAST(k AS INT) AS k FROM (SELECT p.capture, p.part AS a, q.part AS b, sqrt((p.x - q.x) * (p.x - q.x) + (p.z - q.z) * (p.z - q.z)) AS distance, row_number() OVER (PARTITION BY p.capture, p.part ORDER BY sqrt((p.x - q.x) * (p.x - q.x) + (p.z - q.z) * (p.z - q.z)), q.part) AS k
 FROM ({_ANCHOR}) p JOIN ({_ANCHOR}) q ON p.capture = q.capture AND q.part - p.part >= 3 AND q.t - p.t >= 8 WHERE sqrt((p.x - q.x) * (p.x - q.x) + (p.z - q.z) * (p.z - q.z)) <= 0.5) WHERE k <= 3""", "v_poses")  # fmt: skip
def loop_candidates_topk(spark, d):
    from pyspark.sql import Window

    part = F.row_number().over(Window.partitionBy("capture").orderBy("t", "pose"))
    return joins.loop_candidates(poses(spark, d).select("capture", part.alias("part"), "t", "x", "z"), 3, 8.0, 0.5)


#: Frames are in sequences of two hundred, in which alone they are compared.
_UNIT = "SELECT id, label, list_transform(v, lambda x: x::DOUBLE / n) AS v FROM (SELECT id, CAST(id // 200 AS INT) AS label, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM v_vectors)"


def _sequences(spark, d):
    return joins.unit(vectors(spark, d)).withColumn("label", F.expr("CAST(id div 200 AS INT)"))


@query(f"""SELECT label, a, b, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS k FROM (SELECT *, quantile_cont(similarity, 0.97) OVER (PARTITION BY label) AS cut FROM (SELECT p.label, p.id AS a, q.id AS b, round(list_sum(list_transform(list_zip(p.v, q.v), lambda z: z[1] * z[2])), 9) AS similarity
 FROM ({_UNIT}) p JOIN ({_UNIT}) q ON p.label = q.label AND q.id - p.id >= 8)) WHERE similarity >= cut) WHERE k <= 3 ORDER BY similarity DESC, a, b LIMIT 600""", "v_vectors")  # fmt: skip
def revisit_pairs_topk(spark, d):
    return _rounded(joins.revisits(_sequences(spark, d), 8, 0.97, 3, 600), "similarity")


@query(f"""SELECT a, max(b) FILTER (k = 1) AS b, round(max(d) FILTER (k = 1), 6) AS d1, round(max(d) FILTER (k = 2), 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM (SELECT p.id AS a, q.id AS b, round(sqrt(greatest(2 - 2 * list_sum(list_transform(list_zip(p.v, q.v), lambda z: z[1] * z[2])), 0)), 9) AS d
 FROM ({_UNIT}) p JOIN ({_UNIT}) q ON p.label = q.label AND p.id % 2 = 0 AND q.id % 2 = 1)) WHERE k <= 2 GROUP BY a HAVING max(d) FILTER (k = 1) < 0.95 * max(d) FILTER (k = 2)""", "v_vectors")  # fmt: skip
def ratio_test_2nn(spark, d):
    v = _sequences(spark, d)
    return _rounded(joins.ratio_matches(v.where("id % 2 = 0"), v.where("id % 2 = 1"), 0.95), "d1", "d2")


_SURFACE = "SELECT id, scene, off AS sx, lo AS sy, top AS sz, CASE WHEN axis = 0 THEN CAST(inward AS DOUBLE) ELSE 0::DOUBLE END AS nx, CASE WHEN axis = 1 THEN CAST(inward AS DOUBLE) ELSE 0::DOUBLE END AS ny, 0::DOUBLE AS nz FROM v_edges"


@query(f"""SELECT ray, id, round(distance, 6) AS distance, round(cosine, 6) AS cosine, round(cosine / distance, 6) AS score FROM (SELECT *, -(dx * nx + dy * ny + dz * nz) / distance AS cosine FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS distance FROM (SELECT *, sx - px AS dx, sy - py AS dy, sz - pz AS dz FROM v_rays JOIN ({_SURFACE}) USING (scene)))
 WHERE distance > 0.2 AND distance <= 4) WHERE cosine >= 0.3""", "v_rays", "v_edges")  # fmt: skip
def view_visibility(spark, d):
    c = F.col
    normal = lambda k: F.when(c("axis") == k, c("inward").cast("double")).otherwise(F.lit(0.0))
    s = edges(spark, d).select("id", "scene", c("off").alias("sx"), c("lo").alias("sy"), c("top").alias("sz"), normal(0).alias("nx"), normal(1).alias("ny"), F.lit(0.0).alias("nz"))
    return _rounded(joins.visible(rays(spark, d), s).select("ray", "id", "distance", "cosine", "score"), "distance", "cosine", "score")


def _outline(spark, d, parity):
    """Rooms of sites, six each, with walls in order; found ones are off by a little and turned. Of every seventh site's truth, one room has no area."""
    base = read(spark, d, "customer").selectExpr("CAST(c_custkey div 30 AS INT) AS site", "CAST(c_custkey % 6 AS INT) AS room", "c_custkey AS wall", "2.0D + CAST(c_custkey * 7 % 31 AS DOUBLE) / 10.0D AS length")
    shifted = base if parity == 0 else base.selectExpr("site", "room", "CASE WHEN wall % 3 = 0 THEN wall + 1000000000 ELSE wall END AS wall", "length + CAST(wall % 5 AS DOUBLE) / 100.0D AS length")
    lists = shifted.groupBy("site", "room").agg(F.sort_array(F.collect_list(F.struct("wall", "length"))).alias("w"), F.round(F.sum("length"), 6).alias("area"))
    area = F.when((F.col("site") % 7 != 0) | (F.col("room") != 2), F.col("area")) if parity == 0 else F.col("area")
    return lists.select("site", "room", area.alias("area"), F.expr("transform(w, x -> x.length)").alias("lengths"))


_WALL = "SELECT CAST(c_custkey // 30 AS INT) AS site, CAST(c_custkey % 6 AS INT) AS room, c_custkey AS wall, 2::DOUBLE + CAST(c_custkey * 7 % 31 AS DOUBLE) / 10 AS length FROM customer"
_MOVED = f"SELECT site, room, CASE WHEN wall % 3 = 0 THEN wall + 1000000000 ELSE wall END AS wall, length + CAST(wall % 5 AS DOUBLE) / 100 AS length FROM ({_WALL})"
_PLACED = "SELECT site, room, length, CAST(row_number() OVER (PARTITION BY site, room ORDER BY wall) AS INT) AS k, CAST(row_number() OVER (PARTITION BY site, room ORDER BY length DESC) AS INT) AS by_length FROM ({})"
#: Wall by wall, with no lists: the four longest walls side by side, the first four true walls, and the nearest found wall of each true one.
_COST = f"""SELECT p.site, p.t, p.p, CASE WHEN p.site % 7 = 0 AND p.t = 2 THEN 4 * n.miss ELSE abs(f.area - a.area) / a.area + w.off / greatest(a.first, 1) END AS cost
 FROM (SELECT a.site, a.room AS t, b.room AS p FROM (SELECT DISTINCT site, room FROM ({_WALL})) a JOIN (SELECT DISTINCT site, room FROM ({_WALL})) b ON a.site = b.site) p
 JOIN (SELECT site, room, round(sum(length), 6) AS area, sum(length) FILTER (k <= 4) AS first FROM ({_PLACED.format(_WALL)}) GROUP BY ALL) a ON a.site = p.site AND a.room = p.t
 JOIN (SELECT site, room, round(sum(length), 6) AS area FROM ({_MOVED}) GROUP BY ALL) f ON f.site = p.site AND f.room = p.p
 JOIN (SELECT site, t, p, sum(abs(x - y)) AS off FROM (SELECT coalesce(x.site, y.site) AS site, x.t, y.p, coalesce(x.length, 0) AS x, coalesce(y.length, 0) AS y FROM
  (SELECT q.site, q.t, q.p, q.k, l.length FROM (SELECT a.site, a.room AS t, b.room AS p, k FROM (SELECT DISTINCT site, room FROM ({_WALL})) a JOIN (SELECT DISTINCT site, room FROM ({_WALL})) b ON a.site = b.site, (SELECT unnest([1, 2, 3, 4]) AS k)) q
   LEFT JOIN ({_PLACED.format(_WALL)}) l ON l.site = q.site AND l.room = q.t AND l.by_length = q.k) x
  JOIN (SELECT q.site, q.t, q.p, q.k, l.length FROM (SELECT a.site, a.room AS t, b.room AS p, k FROM (SELECT DISTINCT site, room FROM ({_WALL})) a JOIN (SELECT DISTINCT site, room FROM ({_WALL})) b ON a.site = b.site, (SELECT unnest([1, 2, 3, 4]) AS k)) q
   LEFT JOIN ({_PLACED.format(_MOVED)}) l ON l.site = q.site AND l.room = q.p AND l.by_length = q.k) y ON x.site = y.site AND x.t = y.t AND x.p = y.p AND x.k = y.k) GROUP BY ALL) w ON w.site = p.site AND w.t = p.t AND w.p = p.p
 JOIN (SELECT site, t, p, avg(miss) AS miss FROM (SELECT a.site, a.room AS t, b.room AS p, a.wall, min(abs(a.length - b.length)) / min(a.length) AS miss FROM ({_WALL}) a JOIN ({_MOVED}) b ON a.site = b.site GROUP BY ALL) GROUP BY ALL) n ON n.site = p.site AND n.t = p.t AND n.p = p.p"""


@query(f"SELECT site, t, p, round(cost, 6) AS cost FROM ({_COST})")
def room_assignment_cost(spark, d):
    return _rounded(joins.assignment_cost(_outline(spark, d, 0), _outline(spark, d, 1)), "cost")


@query(f"""SELECT * FROM (WITH RECURSIVE c AS MATERIALIZED ({_COST}), need AS (SELECT site, count(DISTINCT t) AS n FROM c GROUP BY site),
 ways AS (SELECT DISTINCT site, -1 AS last, []::INT[] AS ts, []::INT[] AS ps, 0::DOUBLE AS total FROM c UNION ALL
  SELECT w.site, c.t, list_append(w.ts, c.t), list_append(w.ps, c.p), w.total + c.cost FROM ways w JOIN c ON c.site = w.site AND NOT list_contains(w.ps, c.p)
  AND c.t = (SELECT min(t) FROM c z WHERE z.site = w.site AND z.t > w.last)),
 best AS (SELECT site, arg_min(ts, total) AS ts, arg_min(ps, total) AS ps FROM ways JOIN need USING (site) WHERE len(ts) = n GROUP BY site)
 SELECT site, t, p, round(cost, 6) AS cost FROM (SELECT site, unnest(ts) AS t, unnest(ps) AS p FROM best) JOIN c USING (site, t, p) WHERE cost < 0.8)""")  # fmt: skip
def room_assignment(spark, d):
    costs = joins.assignment_cost(_outline(spark, d, 0), _outline(spark, d, 1))
    return _rounded(kernels.assign(costs, "site", "t", "p", "cost", 0.8), "cost")


_ROUND = f"""SELECT t.site, t.room, dir, CAST(shift AS INT) AS shift, round(sum(abs(t.length - f.length)), 9) AS cost, CAST(any_value(t.n) AS INT) AS n
 FROM (SELECT *, count(*) OVER (PARTITION BY site, room) AS n FROM ({_PLACED.format(_WALL)})) t, (SELECT unnest([1, -1]) AS dir), (SELECT unnest(range(64)) AS shift)
 JOIN ({_PLACED.format(_MOVED)}) f ON f.site = t.site AND f.room = t.room AND f.k - 1 = ((shift + dir * (t.k - 1)) % t.n + t.n) % t.n WHERE shift < t.n GROUP BY ALL"""


@query(f"SELECT *, cost <= min(cost) OVER (PARTITION BY site, room) + 0.02::DOUBLE * n AS near FROM ({_ROUND})")
def cyclic_alignment(spark, d):
    t = _outline(spark, d, 0).select("site", "room", F.col("lengths").alias("tl"))
    p = _outline(spark, d, 1).select("site", "room", F.col("lengths").alias("pl"))
    return joins.cyclic_alignments(t, p)


_FOUND = """SELECT opening + 1000000000 AS opening, room, face, CASE WHEN opening % 11 = 0 AND kind = 'door' THEN 'open_passage' ELSE kind END AS kind, off + CAST(opening % 5 AS DOUBLE) / 20 AS off,
 width + CAST(opening % 7 AS DOUBLE) / 50 AS width FROM v_openings WHERE opening % 9 <> 0"""


def _found(spark, d):
    return openings(spark, d).where("opening % 9 <> 0").selectExpr(
        "opening + 1000000000 AS opening", "room", "face", "CASE WHEN opening % 11 = 0 AND kind = 'door' THEN 'open_passage' ELSE kind END AS kind",
        "off + CAST(opening % 5 AS DOUBLE) / 20.0D AS off", "width + CAST(opening % 7 AS DOUBLE) / 50.0D AS width")


#: One true opening of each room a step, with the found ones that are taken: no more than 16 openings a room.
_GREEDY = f"""WITH RECURSIVE f AS MATERIALIZED ({_FOUND}), t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY room ORDER BY opening) AS k FROM v_openings),
 o AS MATERIALIZED (SELECT t.room, t.k, t.opening AS truth, f.opening AS found, abs(f.width - t.width) + 0.5::DOUBLE * abs(f.off - t.off) AS cost, abs(f.width - t.width) <= greatest(0.25::DOUBLE, 0.35::DOUBLE * t.width) AS fits
  FROM t JOIN f ON f.room = t.room AND f.face = t.face AND (f.kind = t.kind OR (f.kind = 'open_passage' AND t.kind = 'door'))),
 g AS (SELECT room, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS truth, NULL::BIGINT AS found, NULL::DOUBLE AS cost FROM t GROUP BY room UNION ALL
  SELECT room, k, CASE WHEN fits THEN list_append(used, found) ELSE used END, truth, CASE WHEN fits THEN found END, CASE WHEN fits THEN cost END FROM (
   SELECT g.room, t.k, g.used, t.opening AS truth, o.found, o.cost, coalesce(o.fits, false) AS fits, row_number() OVER (PARTITION BY g.room ORDER BY o.cost, o.found) AS best
   FROM g JOIN t ON t.room = g.room AND t.k = g.k + 1 LEFT JOIN o ON o.room = t.room AND o.k = t.k AND NOT list_contains(g.used, o.found)) WHERE best = 1)
 SELECT room, truth, found, cost FROM g WHERE k > 0 UNION ALL SELECT room, NULL, opening, NULL FROM f WHERE opening NOT IN (SELECT found FROM g WHERE found IS NOT NULL)"""


@query(f"SELECT room, truth, found, round(cost, 6) AS cost FROM ({_GREEDY})", "v_openings")
def opening_match(spark, d):
    return _rounded(kernels.match_openings(openings(spark, d), _found(spark, d)), "cost")


_COUNTERS = f"""SELECT CAST(room // 100 AS INT) AS capture, CASE room // 100 % 3 WHEN 0 THEN 'lidar' WHEN 1 THEN 'video' ELSE 'photo' END AS tier, count(truth) AS openings_gt, count(*) FILTER (abs(f.width - t.width) <= 0.02::DOUBLE + 1e-9) AS within,
 count(*) FILTER (truth IS NOT NULL AND found IS NULL) AS missed, count(*) FILTER (truth IS NULL) AS phantom
 FROM ({_GREEDY}) m LEFT JOIN (SELECT opening AS truth, width FROM v_openings) t USING (truth) LEFT JOIN (SELECT opening AS found, width FROM ({_FOUND})) f USING (found) GROUP BY ALL"""


def _counters(spark, d):
    t, f = (o.select(F.col("opening").alias(n), F.col("width").alias(f"{n[0]}_width")) for o, n in ((openings(spark, d), "truth"), (_found(spark, d), "found")))
    pairs = kernels.match_openings(openings(spark, d), _found(spark, d)).join(t, "truth", "left").join(f, "found", "left")
    tier = F.expr("CASE room div 100 % 3 WHEN 0 THEN 'lidar' WHEN 1 THEN 'video' ELSE 'photo' END")
    return scoring.capture_counters(pairs.withColumns({"capture": F.expr("CAST(room div 100 AS INT)"), "tier": tier}), "capture", "tier")


@query(_COUNTERS, "v_openings")
def capture_counters(spark, d):
    return _counters(spark, d)


@query(f"""SELECT *, rate >= 0.85 AS passed, round(least(1::DOUBLE, rate / 0.85::DOUBLE), 6) AS score FROM (SELECT tier, CAST(sum(openings_gt) AS BIGINT) AS openings_gt, CAST(sum(within) AS BIGINT) AS within, CAST(sum(missed) AS BIGINT) AS missed,
 CAST(sum(phantom) AS BIGINT) AS phantom, CAST(sum(within) AS DOUBLE) / nullif(sum(openings_gt) + sum(phantom), 0) AS rate FROM ({_COUNTERS}) GROUP BY tier)""", "v_openings")  # fmt: skip
def opening_gate(spark, d):
    return _rounded(scoring.opening_gate(_counters(spark, d)), "score")


@query()
def plan_match(spark, d):
    """Walls of rooms from customers, openings from parts: all that scoring matches, site by site."""
    t, f = _outline(spark, d, 0), _outline(spark, d, 1)
    rooms_of = kernels.assign(joins.assignment_cost(t, f), "site", "t", "p", "cost", 0.8)
    def walls(side, df):
        each = df.select(F.lit(side).alias("side"), "site", "room", F.posexplode("lengths").alias("id", "value"))
        return each.select("side", "site", "room", F.lit("wall").alias("what"), F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("wall"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("off"), "value")

    def doors(side, df):
        place = df.withColumns({"site": F.expr("CAST(room div 6 AS INT)"), "in_site": F.expr("CAST(room % 6 AS INT)")})
        return place.select(F.lit(side).alias("side"), "site", F.col("in_site").alias("room"), F.lit("opening").alias("what"), F.col("opening").cast("long").alias("id"), F.col("face").cast("long").alias("wall"), "kind", "off", F.col("width").alias("value"))

    parts = walls("truth", t).unionByName(walls("found", f)).unionByName(doors("truth", openings(spark, d))).unionByName(doors("found", _found(spark, d)))
    return kernels.match_plans(rooms_of, parts.join(t.select("site").distinct(), "site", "left_semi"))


_DOOR = "SELECT CAST(room // 8 AS INT) AS scene, opening, room, width FROM v_openings WHERE kind = 'door'"


@query(f"""SELECT scene, a, b, round((g / 0.05::DOUBLE) * (g / 0.05::DOUBLE), 6) AS score FROM (SELECT p.scene, p.opening AS a, q.opening AS b, abs(p.width - q.width) AS g FROM ({_DOOR}) p JOIN ({_DOOR}) q ON p.scene = q.scene AND p.room < q.room WHERE abs(p.width - q.width) <= greatest(0.15::DOUBLE, 0.18::DOUBLE * greatest(p.width, q.width)))""", "v_openings")
def door_pair_candidates(spark, d):
    doors = openings(spark, d).where("kind = 'door'").select(F.expr("CAST(room div 8 AS INT)").alias("scene"), "opening", "room", "width")
    return _rounded(joins.door_pairs(doors), "score")
