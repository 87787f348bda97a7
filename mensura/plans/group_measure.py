"""Catalogue: measured rooms, rasters, shapes, boxes, cues, formatting, files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measure, text
from ..operators import measures, scoring
from ..sources import captures
from .adapters import edges, items, openings, points, poses, rays, read, regions, rooms, with_views

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


def _corners(spark, d):
    return edges(spark, d).select("room", F.col("id").alias("seq"), F.col("off").alias("x"), F.col("lo").alias("y"), (F.col("top") / 100).alias("sigma"))


_W = "WINDOW w AS (PARTITION BY room ORDER BY seq), a AS (PARTITION BY room ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"""SELECT room, seq, round(sqrt(dx * dx + dy * dy), 6) AS length, round(sqrt(ps * ps + ns * ns + 0.003::DOUBLE * 0.003::DOUBLE), 6) AS sigma, round(az - 360 * floor(az / 360), 5) AS azimuth FROM (SELECT *, degrees(atan2(-dx, dy)) AS az FROM (SELECT room, seq, coalesce(lead(x) OVER w, first_value(x) OVER a) - x AS dx, coalesce(lead(y) OVER w, first_value(y) OVER a) - y AS dy,
 coalesce(lead(sigma) OVER w, first_value(sigma) OVER a) AS ns, coalesce(lag(sigma) OVER w, last_value(sigma) OVER a) AS ps FROM (SELECT room, id AS seq, off AS x, lo AS y, top / 100 AS sigma FROM v_edges) {_W}))""", "v_edges")  # fmt: skip
def wall_length_sigma(spark, d):
    out = _rounded(measures.walls_of(_corners(spark, d), 0.003), "length", "sigma")
    return out.withColumn("azimuth", F.round("azimuth", 5))


@query("SELECT id, length * height AS area, round(sqrt((length * sh) ** 2 + (height * sl) ** 2), 6) AS sigma FROM (SELECT id, hi - lo AS length, top AS height, 0.01::DOUBLE AS sl, off / 100 AS sh FROM v_edges)", "v_edges")
def wall_area_sigma(spark, d):
    c = F.col
    w = edges(spark, d).select("id", (c("hi") - c("lo")).alias("length"), c("top").alias("height"), F.lit(0.01).alias("sigma_l"), (c("off") / 100).alias("sigma_h"), F.lit(0.0).alias("sigma_log"))
    return _rounded(measures.wall_areas(w).select("id", "area", "sigma"), "sigma")


@query("SELECT room, least(width / 2, length) < 1.5 AND greatest(width / 2, length) / least(width / 2, length) > 2.2 AS connector FROM v_rooms", "v_rooms")
def connector_rooms(spark, d):
    return measures.connectors(rooms(spark, d).withColumn("width", F.col("width") / 2)).select("room", "connector")


@query("""SELECT room, CASE WHEN c IS NULL THEN greatest(2.2, coalesce(g, 0)) ELSE c - 0.02::DOUBLE END AS lo, CASE WHEN c IS NULL THEN greatest(3.4, coalesce(g, 0)) ELSE c + 0.02::DOUBLE END AS hi, coalesce(c, (greatest(2.2::DOUBLE, coalesce(g, 0)) + greatest(3.4::DOUBLE, coalesce(g, 0))) / 2) AS value, c IS NOT NULL AS observed
 FROM (SELECT room, CASE WHEN room % 3 > 0 THEN height END AS c, CASE WHEN room % 4 > 0 THEN length END AS g FROM v_rooms)""", "v_rooms")  # fmt: skip
def ceiling_or_prior(spark, d):
    r = rooms(spark, d).select("room", F.when(F.col("room") % 3 > 0, F.col("height")).alias("ceiling"), F.when(F.col("room") % 4 > 0, F.col("length")).alias("highest"), F.lit(0.02).alias("spread"))
    return measures.ceilings(r).select("room", "lo", "hi", "value", "observed")


@query("""SELECT room, coalesce(CASE WHEN room % 5 = 0 THEN length * width END, CASE WHEN n = 4 THEN a * b END) AS area FROM v_rooms LEFT JOIN (SELECT room, count(*) AS n, avg(CASE WHEN id % 2 = 0 THEN top END) AS a, avg(CASE WHEN id % 2 = 1 THEN top END) AS b FROM (SELECT room, id, top FROM v_edges WHERE id % 5 > 0 OR room % 2 = 0) GROUP BY room) USING (room)""", "v_rooms", "v_edges")
def gt_room_area(spark, d):
    w = edges(spark, d).where("id % 5 > 0 or room % 2 = 0").select("room", F.col("id").alias("seq"), F.col("top").alias("length"))
    given = rooms(spark, d).select("room", F.when(F.col("room") % 5 == 0, F.col("length") * F.col("width")).alias("floor_area"))
    return measures.truth_area(w, given)


@query("""SELECT site, CASE WHEN count(*) = count(area) THEN round(sum(area), 6) END AS area, round(sqrt(sum(sigma * sigma)), 6) AS sigma, round(sqrt(sum(sigma * sigma) + sum((area * 0.01::DOUBLE) * (area * 0.01::DOUBLE))), 6) AS sigma_stitched FROM (SELECT room % 50 AS site, CASE WHEN room <> 7 THEN length * width END AS area, height / 100 AS sigma FROM v_rooms) GROUP BY site""", "v_rooms")
def footprint_area(spark, d):
    c = F.col
    r = rooms(spark, d).select((c("room") % 50).alias("site"), F.when(c("room") != 7, c("length") * c("width")).alias("area"), (c("height") / 100).alias("sigma"), F.lit(0.01).alias("sigma_log"))
    return _rounded(measures.footprint(r, "site"), "area", "sigma", "sigma_stitched")


@query("SELECT room, round(sum((hi - lo) * (id % 10) / 10) / nullif(sum(hi - lo), 0), 6) AS observed FROM v_edges GROUP BY room", "v_edges")
def observed_share(spark, d):
    e = edges(spark, d).select("room", (F.col("hi") - F.col("lo")).alias("length"), (F.col("id") % 10 / 10).alias("observed"))
    return _rounded(measures.observed_share(e, "room"), "observed")


@query("SELECT capture, round(atan2(avg(sin(t)), avg(cos(t))), 5) AS theta FROM (SELECT capture, heading * pi() / 720 AS t FROM v_poses) GROUP BY capture", "v_poses")
def circular_mean_heading(spark, d):
    return _rounded(measures.mean_heading(poses(spark, d).select("capture", (F.col("heading") * F.pi() / 720).alias("theta")), "capture"), "theta", places=5)


_DEPTH = "SELECT CAST(p_partkey // 400 AS INT) AS frame, CAST(p_partkey % 400 // 20 AS INT) AS r, CAST(p_partkey % 20 AS INT) AS c, 1::DOUBLE + CAST(p_partkey * p_partkey % 89 AS DOUBLE) / 1000 AS d FROM part"


def _depth(spark, d):
    return read(spark, d, "part").selectExpr("CAST(p_partkey div 400 AS INT) AS frame", "CAST(p_partkey % 400 div 20 AS INT) AS r", "CAST(p_partkey % 20 AS INT) AS c", "1.0D + CAST(p_partkey * p_partkey % 89 AS DOUBLE) / 1000 AS d")


@query(f"SELECT p.frame, p.r, p.c, coalesce(max(abs(p.d - q.d)), 0) > 0.04::DOUBLE * greatest(max(p.d), 0.001) AS flying FROM ({_DEPTH}) p LEFT JOIN ({_DEPTH}) q ON p.frame = q.frame AND q.r BETWEEN p.r - 1 AND p.r + 1 AND q.c BETWEEN p.c - 1 AND p.c + 1 AND (q.r <> p.r OR q.c <> p.c) GROUP BY ALL")
def flying_pixel_mask(spark, d):
    return measures.flying_pixels(_depth(spark, d))


_CAM = f"SELECT frame, r, c, (c - 10)::DOUBLE / 20 * d AS x, (r - 10)::DOUBLE / 20 * d AS y, d AS z FROM ({_DEPTH})"


@query(f"""SELECT frame, r, c, round(nx / s, 6) AS nx, round(ny / s, 6) AS ny, round(nz / s, 6) AS nz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) * CASE WHEN nx * x + ny * y + nz * z > 0 THEN -1 ELSE 1 END AS s FROM (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM (SELECT p.*, a.x - b.x AS ux, a.y - b.y AS uy, a.z - b.z AS uz, e.x - f.x AS vx, e.y - f.y AS vy, e.z - f.z AS vz
 FROM ({_CAM}) p JOIN ({_CAM}) a ON a.frame = p.frame AND a.r = p.r AND a.c = p.c + 2 JOIN ({_CAM}) b ON b.frame = p.frame AND b.r = p.r AND b.c = p.c - 2 JOIN ({_CAM}) e ON e.frame = p.frame AND e.r = p.r + 2 AND e.c = p.c JOIN ({_CAM}) f ON f.frame = p.frame AND f.r = p.r - 2 AND f.c = p.c))) WHERE s <> 0""")  # fmt: skip
def image_normals(spark, d):
    c = F.col
    pts = _depth(spark, d).select("frame", "r", "c", ((c("c") - 10).cast("double") / 20 * c("d")).alias("x"), ((c("r") - 10).cast("double") / 20 * c("d")).alias("y"), c("d").alias("z"))
    return _rounded(measures.normals(pts), "nx", "ny", "nz")


_REG = "SELECT CAST(l_suppkey AS INT) AS region, CAST(l_quantity AS INT) AS u, CAST(l_partkey % 37 AS INT) AS v FROM lineitem"


@query(f"""SELECT region, n, round(n * 0.006::DOUBLE * 0.006::DOUBLE, 8) AS area, round(du * 0.006::DOUBLE, 6) AS width, round(dv * 0.006::DOUBLE, 6) AS height, round(sqrt((m + g) / greatest(m - g, 1e-6)), 4) AS elongation FROM (SELECT *, (uu + vv) / 2 AS m, sqrt((uu - vv) * (uu - vv) / 4 + uv * uv) AS g FROM (SELECT region, count(*) AS n, max(u) - min(u) + 1 AS du, max(v) - min(v) + 1 AS dv, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv FROM ({_REG}) GROUP BY region))""")
def region_shapes(spark, d):
    pix = read(spark, d, "lineitem").selectExpr("CAST(l_suppkey AS INT) AS region", "CAST(l_quantity AS INT) AS u", "CAST(l_partkey % 37 AS INT) AS v")
    out = measures.shapes(pix, 0.006, "region")
    return out.withColumns({"area": F.round("area", 8), "width": F.round("width", 6), "height": F.round("height", 6), "elongation": F.round("elongation", 4)})


_CELLS = "SELECT DISTINCT scene, CAST(floor(round(x / 0.2::DOUBLE, 9)) AS BIGINT) AS ix, CAST(floor(round(y / 0.2::DOUBLE, 9)) AS BIGINT) AS iz FROM v_points"
_BOXES = "SELECT scene, id AS box, id % 20 AS x0, id % 20 + 4 AS x1, id % 15 AS z0, id % 15 + 3 AS z1 FROM v_edges"


@query(f"SELECT * FROM (SELECT scene, box, count(*) AS n, count(*) / 12::DOUBLE AS share FROM ({_BOXES}) JOIN ({_CELLS}) USING (scene) WHERE ix >= x0 AND ix < x1 AND iz >= z0 AND iz < z1 GROUP BY ALL) WHERE share >= 0.5", "v_points", "v_edges")
def cell_coverage(spark, d):
    cells = points(spark, d).selectExpr("scene", "floor(round(x / 0.2D, 9)) AS ix", "floor(round(y / 0.2D, 9)) AS iz").distinct()
    boxes = edges(spark, d).selectExpr("scene", "id AS box", "id % 20 AS x0", "id % 20 + 4 AS x1", "id % 15 AS z0", "id % 15 + 3 AS z1")
    return measures.covered_cells(cells, boxes)


_SOLID = "SELECT scene, id AS box, off AS x0, off + 0.4::DOUBLE AS x1, lo AS y0, hi AS y1, 0::DOUBLE AS z0, top AS z1 FROM v_edges"


def _solids(spark, d):
    c = F.col
    return edges(spark, d).select("scene", c("id").alias("box"), c("off").alias("x0"), (c("off") + 0.4).alias("x1"), c("lo").alias("y0"), c("hi").alias("y1"), F.lit(0.0).alias("z0"), c("top").alias("z1"))


def _slab(k):
    run = f"(CASE WHEN abs(q{k} - p{k}) < 1e-12 THEN 1e-12 ELSE q{k} - p{k} END)"
    return f"({k}0 - p{k}) / {run}", f"({k}1 - p{k}) / {run}"


_LO = ", ".join(f"least({a}, {b})" for a, b in map(_slab, "xyz"))
_HI = ", ".join(f"greatest({a}, {b})" for a, b in map(_slab, "xyz"))


@query(f"SELECT scene, ray, round(t, 6) AS t, box FROM (SELECT *, row_number() OVER (PARTITION BY scene, ray ORDER BY t, box) AS k FROM (SELECT *, greatest(t0, 0) AS t FROM (SELECT scene, ray, box, greatest({_LO}) AS t0, least({_HI}) AS t1 FROM v_rays JOIN ({_SOLID}) USING (scene)) WHERE t1 >= t0 AND t1 >= 0 AND t0 <= 1)) WHERE k = 1", "v_rays", "v_edges")
def raycast_boxes(spark, d):
    return _rounded(measures.ray_boxes(rays(spark, d), _solids(spark, d)), "t")


@query(f"""WITH b AS (SELECT *, x0 < 3 AND 2 < x1 AND y0 < 2 AND 1 < y1 AND z0 < 1.5 AND 0.5 < z1 AS clash, greatest(x0, 2) AS i0, least(x1, 3) AS i1, greatest(y0, 1) AS j0, least(y1, 2) AS j1, greatest(z0, 0.5) AS k0, least(z1, 1.5) AS k1 FROM ({_SOLID}))
 SELECT scene, count(*) AS parts, round(sum((bx1 - bx0) * (by1 - by0) * (bz1 - bz0)), 4) AS volume FROM (SELECT scene, x0 AS bx0, x1 AS bx1, y0 AS by0, y1 AS by1, z0 AS bz0, z1 AS bz1 FROM b WHERE NOT clash UNION ALL SELECT scene, x0, i0, y0, y1, z0, z1 FROM b WHERE clash UNION ALL SELECT scene, i1, x1, y0, y1, z0, z1 FROM b WHERE clash UNION ALL SELECT scene, i0, i1, y0, j0, z0, z1 FROM b WHERE clash
 UNION ALL SELECT scene, i0, i1, j1, y1, z0, z1 FROM b WHERE clash UNION ALL SELECT scene, i0, i1, j0, j1, z0, k0 FROM b WHERE clash UNION ALL SELECT scene, i0, i1, j0, j1, k1, z1 FROM b WHERE clash) WHERE bx1 - bx0 > 1e-9 AND by1 - by0 > 1e-9 AND bz1 - bz0 > 1e-9 GROUP BY scene""".replace("WITH b AS", "SELECT * FROM (WITH b AS") + ")", "v_edges")  # fmt: skip
def box_difference(spark, d):
    cutter = edges(spark, d).select("scene").distinct().selectExpr("scene", "2.0D AS x0", "3.0D AS x1", "1.0D AS y0", "2.0D AS y1", "0.5D AS z0", "1.5D AS z1")
    parts = measures.cut_boxes(_solids(spark, d), cutter)
    volume = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (F.col("z1") - F.col("z0"))
    return parts.groupBy("scene").agg(F.count("*").alias("parts"), F.round(F.sum(volume), 4).alias("volume"))


@query("""SELECT capture, name, round(ln(CASE name WHEN 'ceiling' THEN 2.60::DOUBLE WHEN 'door' THEN 2.04::DOUBLE ELSE 1.45::DOUBLE END / m), 6) AS log_scale, CASE name WHEN 'ceiling' THEN 0.08::DOUBLE WHEN 'door' THEN 0.035::DOUBLE ELSE 0.10::DOUBLE END AS sigma FROM (SELECT capture, CASE kind WHEN 'ceiling_height' THEN 'ceiling' WHEN 'opening_width' THEN 'door' ELSE 'camera' END AS name, median(value) AS m FROM v_items WHERE kind IN ('ceiling_height', 'opening_width', 'damage_extent') AND value > 0 GROUP BY ALL)""", "v_base", "v_items")
def scale_cues(spark, d):
    name = F.when(F.col("kind") == "ceiling_height", "ceiling").when(F.col("kind") == "opening_width", "door").otherwise("camera")
    rows = items(spark, d).where(F.col("kind").isin("ceiling_height", "opening_width", "damage_extent")).select("capture", name.alias("name"), "value")
    return _rounded(measures.scale_cues(rows, "capture"), "log_scale")


@query("SELECT scene, " + ", ".join(f"median(y) FILTER (abs(y - m) <= {b}::DOUBLE) AS within_{int(b * 100)}cm" for b in (0.06, 0.04, 0.02, 0.01)) + " FROM v_points JOIN (SELECT scene, median(y) AS m FROM v_points GROUP BY scene) USING (scene) GROUP BY scene", "v_points")
def level_band_evidence(spark, d):
    return measures.band_evidence(points(spark, d), "scene")


@query("SELECT room, face, room % 2 = 0 AS floor_level, CASE WHEN kind = 'door' THEN 'door' WHEN sill <= 0.15 THEN 'open_passage' ELSE 'window' END AS kind, width >= 0.4 AND height >= 0.4 AND width <= 3.2 AS plausible FROM v_openings", "v_openings")
def opening_shape_rules(spark, d):
    c = F.col
    kind = F.when(c("kind") == "door", "door").when(c("sill") <= 0.15, "open_passage").otherwise("window")
    return openings(spark, d).select("room", "face", (c("room") % 2 == 0).alias("floor_level"), kind.alias("kind"), ((c("width") >= 0.4) & (c("height") >= 0.4) & (c("width") <= 3.2)).alias("plausible"))


@query("SELECT tier, printf('%d of %d', within, n) AS shown, CASE WHEN within = n THEN 'pass' ELSE 'fail' END AS result FROM (SELECT tier, count(*) AS n, count(*) FILTER (abs(value - truth) <= 0.015::DOUBLE + 1e-9) AS within FROM v_items WHERE kind = 'ceiling_height' GROUP BY tier)", "v_base", "v_items")
def gate_text(spark, d):
    g = scoring.ceiling_gate(items(spark, d))
    return g.select("tier", F.format_string("%d of %d", "within", "n").alias("shown"), text.pass_text(F.col("passed")).alias("result"))


@query("SELECT region, printf('%.2f [%.2f, %.2f] %s', u1 + 0.001, u0 + 0.001, v1 + 0.001, 'm') AS shown FROM v_regions", "v_regions")
def interval_text(spark, d):
    c = F.col
    return regions(spark, d).select("region", measure.shown(c("u1") + 0.001, c("u0") + 0.001, c("v1") + 0.001, F.lit("m")).alias("shown"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT CAST(n_regionkey AS INT) AS visit, list_sort(list(n_name)) AS \"values\" FROM nation GROUP BY 1")
def metadata_multimap(spark, d):
    return captures.multimap(read(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("visit"), "n_name"), "visit", "n_name")


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, to_base64(encode(url)) AS encoded FROM pages""")
def html_escape_base64(spark, d):
    return read(spark, d, "pages").select("page_id", text.escaped_html(F.col("html")).alias("escaped"), text.encoded_base64(F.col("url")).alias("encoded"))
