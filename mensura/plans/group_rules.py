"""Catalogue: rules, scope, geometry expressions, model outputs, names, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import joins, kernels, models, rules, scope
from .adapters import edges, openings, points, poses, read, regions, rooms, vectors, with_views

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


# ---- rules and scope ---------------------------------------------------------------------------

_NEAR = """SELECT region, min(CASE WHEN kind = 'window' THEN along END) AS to_window, min(least(corner0, corner1)) AS to_head FROM (SELECT region, kind, greatest(o0 - u1, u0 - o1, 0) AS along, sqrt(greatest(u0 - o0, 0, o0 - u1) ** 2 + up * up) AS corner0, sqrt(greatest(u0 - o1, 0, o1 - u1) ** 2 + up * up) AS corner1 FROM (
 SELECT r.*, o.kind, o.off AS o0, o.off + o.width AS o1, greatest(o.sill + o.height - v1, v0 - (o.sill + o.height), 0) AS up FROM v_regions r JOIN v_openings o ON r.room = o.room AND r.face = o.face WHERE r.surface = 'wall')) GROUP BY region"""


def _array(values):
    return "NULL::VARCHAR[]" if values is None else "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _number(v):
    return "NULL::DOUBLE" if v is None else f"{v}::DOUBLE"


_RULES = "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {_array(c)}, {_array(s)}, {_number(b)}, {_array(t)}, {_number(w)}, {_number(h)}, {_number(a)}, '{sev}')" for r, _, c, s, b, t, w, h, a, sev in rules.RULES) + ") AS t(rule, classes, surfaces, bottom_below, room_types, near_window, near_head, least_area, severity)"
_FIRED = f"""SELECT region, room, rule, severity FROM (SELECT g.*, m.room_type, n.to_window, n.to_head FROM v_regions g LEFT JOIN v_rooms m USING (room) LEFT JOIN ({_NEAR}) n USING (region)) JOIN ({_RULES}) ON list_contains(classes, class)
 WHERE (surfaces IS NULL OR list_contains(surfaces, surface)) AND (bottom_below IS NULL OR (surface = 'wall' AND v0 <= bottom_below)) AND (room_types IS NULL OR coalesce(list_contains(room_types, room_type), false)) AND (least_area IS NULL OR (u1 - u0) * (v1 - v0) >= least_area)
 AND (near_window IS NULL OR coalesce(surface = 'wall' AND round(to_window, 6) <= near_window, false)) AND (near_head IS NULL OR coalesce(surface = 'wall' AND round(to_head, 6) <= near_head, false))"""
_PLAN = ("v_regions", "v_rooms", "v_openings")


def _fired(spark, d):
    return rules.evaluate(regions(spark, d), rooms(spark, d), openings(spark, d), rules.table(spark))


@query(_FIRED, *_PLAN)
def rules_theta(spark, d):
    return _fired(spark, d).drop("condition")


@query(f"SELECT region, round(to_window, 6) AS to_window, round(to_head, 6) AS to_head FROM ({_NEAR})", *_PLAN)
def rule_window_proximity(spark, d):
    return _rounded(rules.near_openings(regions(spark, d), openings(spark, d)), "to_window", "to_head")


@query("""SELECT w.room, w.region AS wall_region, c.region AS ceiling_region, 'CDR-12' AS rule, 'high' AS severity FROM v_regions w JOIN v_rooms m ON m.room = w.room JOIN v_regions c ON c.room = w.room WHERE w.surface = 'wall' AND c.surface = 'ceiling' AND w.class IN ('water_stain', 'mold') AND c.class IN ('water_stain', 'mold')
 AND m.height - w.v1 <= 0.3 AND sqrt(greatest(c.u0 - w.u1, w.u0 - c.u1, 0) ** 2 + c.v0 * c.v0) <= 0.3""", "v_regions", "v_rooms")  # fmt: skip
def pair_rules(spark, d):
    return rules.pair_flags(regions(spark, d), rooms(spark, d))


@query(f"""SELECT * FROM (SELECT 'region without room' AS check, region AS id FROM v_regions WHERE room NOT IN (SELECT room FROM v_rooms WHERE room <> 7) UNION ALL SELECT 'opening without room', opening FROM v_openings WHERE room NOT IN (SELECT room FROM v_rooms WHERE room <> 7)
 UNION ALL SELECT 'flag without region', region FROM ({_FIRED}) WHERE region NOT IN (SELECT region FROM v_regions) UNION ALL SELECT 'region without extent', region FROM v_regions WHERE u1 <= u0 OR v1 <= v0 UNION ALL SELECT 'opening without extent', opening FROM v_openings WHERE width <= 0 OR height <= 0
 UNION ALL SELECT 'region over the ceiling', region FROM v_regions JOIN v_rooms USING (room) WHERE surface = 'wall' AND v1 > height AND room <> 7)""".replace("AS check", 'AS "check"'), *_PLAN)  # fmt: skip
def integrity_anti_joins(spark, d):
    return rules.integrity_errors(regions(spark, d), rooms(spark, d).where("room <> 7"), openings(spark, d), _fired(spark, d))


_KNOWN = "SELECT room FROM v_rooms WHERE room % 17 <> 0"
_SURFACES = f"SELECT room * 10 + face AS surface FROM ({_KNOWN}), (SELECT unnest(range(6)) AS face) WHERE (room + face) % 23 <> 0"
_CITED = "SELECT region AS flag, region + CASE WHEN region % 50 = 0 THEN 1000000000 ELSE 0 END AS region FROM v_regions WHERE region % 3 = 0"
_ITEM = "SELECT region AS item, room * 10 + face AS surface, CASE WHEN region % 4 > 0 THEN region + CASE WHEN region % 40 = 1 THEN 1000000000 ELSE 0 END END AS region, CASE WHEN region % 2 = 0 THEN region END AS flag FROM v_regions"


def _dangling(check: str, rows: str, ident: str, ref: str, target: str) -> str:
    return f"SELECT DISTINCT '{check}' AS \"check\", CAST({ident} AS BIGINT) AS id, CAST({ref} AS BIGINT) AS missing FROM ({rows}) WHERE {ref} NOT IN (SELECT * FROM ({target}))"


@query(" UNION ALL ".join([
    _dangling("wall on unknown surface", "SELECT id, room * 10 + facing AS surface FROM v_edges", "id", "surface", _SURFACES),
    _dangling("opening to unknown room", "SELECT opening, CASE WHEN opening % 5 > 0 THEN opening END AS t FROM v_openings", "opening", "t", _KNOWN),
    _dangling("adjacency with unknown room", "SELECT room AS id, unnest([room, room + 1]) AS end_room FROM v_openings", "id", "end_room", _KNOWN),
    _dangling("region on unknown surface", "SELECT region, room * 10 + face AS surface FROM v_regions", "region", "surface", _SURFACES),
    _dangling("flag on unknown region", _CITED, "flag", "region", "SELECT region FROM v_regions"),
    _dangling("scope on unknown surface", _ITEM, "item", "surface", _SURFACES),
    _dangling("scope on unknown region", _ITEM, "item", "region", "SELECT region FROM v_regions"),
    _dangling("scope on unknown flag", _ITEM, "item", "flag", f"SELECT flag FROM ({_CITED})")]), *_PLAN, "v_edges")
def semantic_errors(spark, d):
    c, far = F.col, 1_000_000_000
    known = rooms(spark, d).where("room % 17 <> 0").select("room")
    faces = F.explode(F.sequence(F.lit(0), F.lit(5)))
    surfaces = known.withColumn("face", faces).where("(room + face) % 23 <> 0").select((c("room") * 10 + c("face")).alias("surface"))
    r, o = regions(spark, d).withColumn("surface", c("room") * 10 + c("face")), openings(spark, d)
    flags = r.where("region % 3 = 0").select(c("region").alias("flag"), (c("region") + F.when(c("region") % 50 == 0, far).otherwise(0)).alias("region"))
    cited = F.when(c("region") % 4 > 0, c("region") + F.when(c("region") % 40 == 1, far).otherwise(0))
    scope_of = r.select(c("region").alias("item"), "surface", cited.alias("region"), F.when(c("region") % 2 == 0, c("region")).alias("flag"))
    walls = edges(spark, d).select("id", (c("room") * 10 + c("facing")).alias("surface"))
    beside = o.select(c("room").alias("id"), F.explode(F.array(c("room"), c("room") + 1)).alias("room"))
    return rules.semantic_errors(known, surfaces, walls, o.select("opening", F.when(c("opening") % 5 > 0, c("opening")).alias("to")), beside, r.select("region", "surface"), flags, scope_of)


@query(f"SELECT 'F' || row_number() OVER (ORDER BY region, rule) AS flag, region, rule FROM ({_FIRED})", *_PLAN)
def flag_numbers(spark, d):
    return rules.flagged(_fired(spark, d)).select("flag", "region", "rule")


_SCOPE = f"""WITH b AS (SELECT g.*, m.height, m.length, m.width, g.u1 - g.u0 AS w, g.v1 - g.v0 AS h, row_number() OVER (PARTITION BY g.room, face ORDER BY region) = 1 AS one, region IN (SELECT region FROM ({_FIRED}) WHERE rule = 'CDR-02') AND g.surface = 'wall' AND g.class = 'water_stain' AS base, CASE WHEN g.v1 + 0.3::DOUBLE <= 0.6 THEN 0.6::DOUBLE ELSE 1.2::DOUBLE END AS cut FROM v_regions g JOIN v_rooms m USING (room))
 SELECT region, room, 'WTR-FLDCUT' AS code, length AS quantity, 'm' AS unit FROM b WHERE base UNION ALL SELECT region, room, 'DRY-INST', length * cut, 'm2' FROM b WHERE base UNION ALL SELECT region, room, 'FC-BASE', length, 'm' FROM b WHERE base
 UNION ALL SELECT region, room, CASE class WHEN 'water_stain' THEN 'PNT-SEAL' ELSE 'PNT-PREP' END, (w + 0.3::DOUBLE) * (h + 0.3::DOUBLE), 'm2' FROM b WHERE surface = 'wall' AND NOT base AND class IN ('water_stain', 'peeling_paint') UNION ALL SELECT region, room, 'MLD-REM', (w + 1.2::DOUBLE) * least(h + 1.2::DOUBLE, height), 'm2' FROM b WHERE surface = 'wall' AND class = 'mold'
 UNION ALL SELECT region, room, 'DRY-CRACK', sqrt(w * w + h * h) + 0.3::DOUBLE, 'm' FROM b WHERE surface <> 'floor' AND class = 'crack' UNION ALL SELECT region, room, 'DRY-PATCH', 1::DOUBLE, 'ea' FROM b WHERE surface = 'wall' AND class = 'hole' AND greatest(w, h) <= 0.3 UNION ALL SELECT region, room, 'DRY-SECT', (w + 0.4::DOUBLE) * (h + 0.4::DOUBLE), 'm2' FROM b WHERE surface = 'wall' AND class = 'hole' AND greatest(w, h) > 0.3
 UNION ALL SELECT region, room, 'PNT-WALL', length * height, 'm2' FROM b WHERE surface = 'wall' AND one UNION ALL SELECT region, room, unnest(['DRY-CEIL', 'INS-RR']), (w + 0.8::DOUBLE) * (h + 0.8::DOUBLE), 'm2' FROM b WHERE surface = 'ceiling' AND class IN ('water_stain', 'mold') AND w * h > 0.1 UNION ALL SELECT region, room, 'PNT-CEIL', length * width, 'm2' FROM b WHERE surface = 'ceiling' AND one
 UNION ALL SELECT region, room, 'WTR-FLOOR', w * h * 4, 'm2' FROM b WHERE surface = 'floor' AND class IN ('water_stain', 'mold') UNION ALL SELECT region, room, 'FLR-REP', w * h + 0.1::DOUBLE, 'm2' FROM b WHERE surface = 'floor' AND class NOT IN ('water_stain', 'mold')"""


@query(f"SELECT region, room, code, round(quantity, 6) AS quantity, unit FROM ({_SCOPE})", *_PLAN)
def scope_lines(spark, d):
    return _rounded(scope.lines(regions(spark, d), rooms(spark, d), _fired(spark, d)), "quantity")


@query(f"SELECT code, unit, count(*) AS n, round(sum(quantity), 4) AS quantity FROM ({_SCOPE}) GROUP BY ALL", *_PLAN)
def scope_totals(spark, d):
    rows = scope.lines(regions(spark, d), rooms(spark, d), _fired(spark, d))
    return rows.groupBy("code", "unit").agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 4).alias("quantity"))


@query("SELECT DISTINCT room, 'WTR-DRY' AS code, 1::DOUBLE AS quantity, 'ea' AS unit FROM v_regions WHERE class IN ('water_stain', 'mold')", "v_regions")
def drying_line_per_room(spark, d):
    return scope.drying(regions(spark, d))


# ---- geometry ----------------------------------------------------------------------------------

_QUAT = "SELECT capture, pose, x, z, t, heading * pi() / 360 AS half FROM v_poses"


@query(f"SELECT capture, pose, round(cos(2 * half) * x + sin(2 * half) * z + 1, 6) AS wx, round(-sin(2 * half) * x + cos(2 * half) * z + 2, 6) AS wz FROM ({_QUAT})", "v_poses")
def pose_rigid_transform(spark, d):
    p = poses(spark, d).withColumn("half", F.col("heading") * F.pi() / 360)
    r = geometry.rotation(F.lit(0.0), F.sin("half"), F.lit(0.0), F.cos("half"))
    x, _, z = geometry.moved(r, (F.col("x"), F.lit(0.0), F.col("z")), (F.lit(1.0), F.lit(0.0), F.lit(2.0)))
    return p.select("capture", "pose", F.round(x, 6).alias("wx"), F.round(z, 6).alias("wz"))


@query("SELECT capture, pose, round(x, 6) AS bx, round(z, 6) AS bz FROM v_poses", "v_poses")
def plan_frame_round_trip(spark, d):
    yaw, zero = F.lit(0.3), F.lit(0.5)
    p = poses(spark, d).withColumns(dict(zip(("u", "v"), geometry.to_plan(F.col("x"), F.col("z"), yaw, zero, zero))))
    back = geometry.from_plan(F.col("u"), F.col("v"), yaw, zero, zero)
    return p.select("capture", "pose", F.round(back[0], 6).alias("bx"), F.round(back[1], 6).alias("bz"))


@query("SELECT seq, (x * 100 - 128) / 200 * (y + 1) AS cx, (z * 100 - 96) / 200 * (y + 1) AS cy, round(x * 100, 6) AS u, round(z * 100, 6) AS v FROM v_points", "v_points")
def pinhole_round_trip(spark, d):
    k = [F.lit(v) for v in (200.0, 200.0, 128.0, 96.0)]
    p = points(spark, d)
    cam = geometry.unprojected(F.col("x") * 100, F.col("z") * 100, F.col("y") + 1, *k)
    p = p.withColumns(dict(zip(("cx", "cy", "cz"), cam)))
    u, v = geometry.projected(F.col("cx"), F.col("cy"), F.col("cz"), *k)
    return p.select("seq", "cx", "cy", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("SELECT capture, pose, round(m - floor(m / (pi() / 2)) * (pi() / 2) - pi() / 4, 6) AS wrapped FROM (SELECT capture, pose, heading / 50 + pi() / 4 AS m FROM v_poses)", "v_poses")
def quarter_wrap(spark, d):
    return poses(spark, d).select("capture", "pose", F.round(geometry.wrapped_quarter(F.col("heading") / 50), 6).alias("wrapped"))


@query("""SELECT seq, x, z, CAST(CASE WHEN greatest(x - 2.5, 2.5 - x, z - 1, 1 - z) < 0.85 THEN -1 WHEN x - 2.5 = greatest(x - 2.5, 2.5 - x, z - 1, 1 - z) THEN 0 WHEN 2.5 - x = greatest(x - 2.5, 2.5 - x, z - 1, 1 - z) THEN 1 WHEN z - 1 = greatest(x - 2.5, 2.5 - x, z - 1, 1 - z) THEN 2 ELSE 3 END AS INT) AS facing FROM v_points""", "v_points")
def facing_index(spark, d):
    return points(spark, d).select("seq", "x", "z", geometry.facing(F.col("x") - 2.5, F.col("z") - 1).alias("facing"))


@query("SELECT p_partkey AS photo, round(p_size * sqrt(4032::DOUBLE ** 2 + 3024::DOUBLE ** 2) / sqrt(36::DOUBLE ** 2 + 24::DOUBLE ** 2), 6) AS fx, (p_size::DOUBLE + 0.5) * 0.25 - 0.5 AS cx FROM part")
def exif_focal(spark, d):
    size = F.col("p_size").cast("double")
    return read(spark, d, "part").select(F.col("p_partkey").alias("photo"), F.round(geometry.focal_pixels(size, F.lit(4032.0), F.lit(3024.0)), 6).alias("fx"), geometry.rescaled_centre(size, F.lit(0.25)).alias("cx"))


# ---- model outputs -----------------------------------------------------------------------------

_U = "SELECT id, label, list_transform(v, lambda x: x::DOUBLE / n) AS v FROM (SELECT id, label, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM v_vectors)"


@query(f"""SELECT id, class, round(sum(e / whole), 6) AS p FROM (SELECT *, sum(e) OVER (PARTITION BY id) AS whole FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM (SELECT i.id, p.label AS class, round(100 * list_sum(list_transform(list_zip(i.v, p.v), lambda z: z[1] * z[2])), 6) AS s FROM ({_U}) i, ({_U}) p WHERE p.id < 30))) GROUP BY ALL""", "v_vectors")
def softmax_class_probs(spark, d):
    v = joins.unit(vectors(spark, d))
    return _rounded(models.class_probabilities(v, v.where("id < 30").withColumnRenamed("label", "class")), "p")


@query(f"""SELECT id, class, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 6) DESC, class) AS k FROM (SELECT id, class, sum(e / whole) AS p FROM (SELECT *, sum(e) OVER (PARTITION BY id) AS whole FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY id)) AS e
 FROM (SELECT i.id, p.label AS class, round(100 * list_sum(list_transform(list_zip(i.v, p.v), lambda z: z[1] * z[2])), 6) AS s FROM ({_U}) i, ({_U}) p WHERE p.id < 30))) GROUP BY ALL)) WHERE k = 1""", "v_vectors")  # fmt: skip
def best_class_per_image(spark, d):
    v = joins.unit(vectors(spark, d))
    return _rounded(models.best_class(models.class_probabilities(v, v.where("id < 30").withColumnRenamed("label", "class"))), "p")


_PIX = "SELECT l_suppkey AS surface, CAST(l_partkey % 4 AS INT) AS r, CAST(l_linenumber % 3 AS INT) AS c, l_orderkey * 8 + l_linenumber AS view, l_discount AS score, l_quantity AS l FROM lineitem"


@query(f"SELECT surface, r, c, median(l) AS l, count(*) AS views FROM (SELECT *, row_number() OVER (PARTITION BY surface, r, c ORDER BY score DESC, view, l) AS k FROM (SELECT surface, r, c, view, max(score) AS score, max(l) AS l FROM ({_PIX}) GROUP BY ALL)) WHERE k <= 3 GROUP BY ALL")
def topk_colour_median(spark, d):
    pix = read(spark, d, "lineitem").selectExpr("l_suppkey AS surface", "CAST(l_partkey % 4 AS INT) AS r", "CAST(l_linenumber % 3 AS INT) AS c", "l_orderkey * 8 + l_linenumber AS view", "l_discount AS score", "l_quantity AS l")
    return models.top_views_median(pix.groupBy("surface", "r", "c", "view").agg(F.max("score").alias("score"), F.max("l").alias("l")))


_LAB = "SELECT CAST(p_size AS INT) AS surface, p_partkey AS id, p_retailprice / 20 AS l, CAST(p_partkey % 23 AS DOUBLE) AS a, CAST(p_partkey % 31 AS DOUBLE) AS b FROM part"


@query(f"""WITH f AS (SELECT p.surface, id, round(sqrt((0.7::DOUBLE * (l - l0)) * (0.7::DOUBLE * (l - l0)) + (a - a0) * (a - a0) + (b - b0) * (b - b0)), 6) AS distance FROM ({_LAB}) p JOIN (SELECT surface, median(l) AS l0, median(a) AS a0, median(b) AS b0 FROM ({_LAB}) GROUP BY surface) USING (surface)), m AS (SELECT surface, median(distance) AS m FROM f GROUP BY surface)
 SELECT surface, id, distance FROM f JOIN m USING (surface) JOIN (SELECT surface, median(abs(distance - m)) AS mad FROM f JOIN m USING (surface) GROUP BY surface) USING (surface) WHERE distance >= greatest(9, round(m + 1.0::DOUBLE * 1.4826::DOUBLE * mad, 6))""")  # fmt: skip
def colour_distance_mask(spark, d):
    pix = read(spark, d, "part").selectExpr("CAST(p_size AS INT) AS surface", "p_partkey AS id", "p_retailprice / 20 AS l", "CAST(p_partkey % 23 AS DOUBLE) AS a", "CAST(p_partkey % 31 AS DOUBLE) AS b")
    return models.outlier_mask(pix, "surface", 9.0, 1.0)


@query("""WITH i AS (SELECT DISTINCT sha256('model@1|' || event_type || '|' || CAST(user_id AS VARCHAR)) AS key, length(event_type) AS n FROM events), s AS (SELECT key, -1::BIGINT AS output FROM i WHERE key < '8') SELECT i.key, coalesce(s.output, n) AS output FROM i LEFT JOIN s USING (key)""")
def sha_cache_antijoin(spark, d):
    events = read(spark, d, "events").select(text.cache_key(F.lit("model@1"), F.concat_ws("|", "event_type", F.col("user_id").cast("string"))).alias("key"), F.length("event_type").cast("long").alias("n"))
    store = events.where("key < '8'").select("key", F.lit(-1).cast("long").alias("output")).distinct()
    return models.cached(events, store, lambda missing: missing.select("key", F.col("n").alias("output")))


# ---- names, documents, dates -------------------------------------------------------------------


@query("""SELECT p_partkey AS id, name, CASE WHEN contains(name, 'bath') OR contains(name, 'toilet') OR contains(name, 'wc') THEN 'bathroom' WHEN contains(name, 'kitchen') THEN 'kitchen' WHEN contains(name, 'laundry') THEN 'laundry' WHEN contains(name, 'bed') THEN 'bedroom' WHEN contains(name, 'living') THEN 'living_room'
 WHEN contains(name, 'hall') OR contains(name, 'corridor') THEN 'hallway' ELSE 'room' END AS room_type FROM (SELECT p_partkey, ['bath ', 'small kitchen ', 'bedroom ', 'hall ', 'study '][1 + p_partkey % 5] || lower(p_name) AS name FROM part)""")  # fmt: skip
def room_type_keywords(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("bath ", "small kitchen ", "bedroom ", "hall ", "study ")])
    name = F.concat(F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")), F.lower("p_name"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name")).withColumn("room_type", text.room_type(F.col("name")))


@query(r"SELECT p_partkey AS id, regexp_replace(CAST(p_partkey AS VARCHAR) || ['_', ' - ', '. ', ''][1 + p_partkey % 4] || p_name, '^[0-9]+[\s_.-]*', '') AS name FROM part")
def strip_ordinal(spark, d):
    gap = F.element_at(F.array(*[F.lit(k) for k in ("_", " - ", ". ", "")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.without_ordinal(F.concat(F.col("p_partkey").cast("string"), gap, F.col("p_name"))).alias("name"))


@query("""SELECT p_partkey AS id, '{"room":"R' || p_size || '","wall":"R' || p_size || '-W' || p_partkey || '","note":"R1' || p_size || ' ' || p_name || '"}' AS document FROM part""")
def relabel_ids(spark, d):
    doc = F.format_string('{"room":"R1","wall":"R1-W%d","note":"R1%d %s"}', "p_partkey", "p_size", "p_name")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.relabelled(doc, "R1", F.concat(F.lit("R"), F.col("p_size").cast("string"))).alias("document"))


@query(r"SELECT page_id, trim(regexp_replace(html, '[ \t\n\f\r\x0b]+', ' ', 'g')) AS plain FROM pages")
def collapsed_space(spark, d):
    return read(spark, d, "pages").select("page_id", text.collapsed(F.col("html")).alias("plain"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_props_extract(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("SELECT o_orderkey AS photo, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS seconds FROM orders")
def exif_datetime_parse(spark, d):
    at = text.exif_time(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', at)")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("photo"), at.alias("at")).select("photo", seconds.alias("seconds"))


@query("SELECT user_id AS capture, round(list_sum(list_transform(map_values(m), lambda x: x)), 4) AS total, CAST(cardinality(m) AS INT) AS stages FROM (SELECT user_id, map_from_entries(list((event_type, v))) AS m FROM (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL) GROUP BY user_id)")
def stage_map_aggregate(spark, d):
    stages = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    m = stages.groupBy(F.col("user_id").alias("capture")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return m.select("capture", F.round(F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.size("m").alias("stages"))


# ---- kernels -----------------------------------------------------------------------------------


def _huber_sql(rounds: int = 10) -> str:
    """The iteration written out, a step a view; each step stops changing once it has moved by less than 1e-7."""
    steps = ["h0 AS (SELECT scene, median(y) AS loc, false AS done FROM v_points GROUP BY scene)",
             "sc AS (SELECT scene, 2.5::DOUBLE * (1.4826::DOUBLE * median(abs(y - loc)) + 1e-6) AS scale FROM v_points JOIN h0 USING (scene) GROUP BY scene)"]
    for k in range(rounds):
        w = "least(1, scale / greatest(abs(y - loc), 1e-9 * scale))"
        new = f"SELECT scene, any_value(loc) AS last, any_value(done) AS done, sum({w} * y) / sum({w}) AS new FROM v_points JOIN h{k} USING (scene) JOIN sc USING (scene) GROUP BY scene"
        steps.append(f"h{k + 1} AS MATERIALIZED (SELECT scene, CASE WHEN done THEN last ELSE new END AS loc, done OR abs(new - last) < 1e-7 AS done FROM ({new}))")
    end = f"h{rounds}"
    return f"""WITH {', '.join(steps)}, sp AS (SELECT scene, 1.4826::DOUBLE * median(abs(y - loc)) + 1e-6 AS spread, count(*) AS n FROM v_points JOIN {end} USING (scene) GROUP BY scene),
 g AS (SELECT scene, frame, avg(y) AS m FROM v_points GROUP BY ALL), gs AS (SELECT scene, 1.4826::DOUBLE * median(abs(m - mm)) + 1e-6 AS gspread, count(*) AS groups FROM g JOIN (SELECT scene, median(m) AS mm FROM g GROUP BY scene) USING (scene) GROUP BY scene)
 SELECT scene, round(loc, 6) AS location, round(CASE WHEN groups >= 3 THEN greatest(gspread / sqrt(groups), spread / sqrt(n)) ELSE spread / sqrt(groups) END, 6) AS error, round(spread, 6) AS spread, n FROM {end} JOIN sp USING (scene) JOIN gs USING (scene)"""


@query("SELECT * FROM (" + _huber_sql() + ")", "v_points")
def huber_location(spark, d):
    return kernels.robust_location(points(spark, d), "scene", "y", "frame")


@query()
def plane_fit(spark, d):
    return kernels.planes(points(spark, d), "scene")


@query()
def segment_rooms(spark, d):
    cells = points(spark, d).select("scene", F.floor(F.round(F.col("x") / 0.1, 9)).alias("ix"), F.floor(F.round(F.col("y") / 0.1, 9)).alias("iz")).distinct()
    return kernels.rooms_of(cells, 0.1)


@query("""SELECT * FROM (WITH RECURSIVE b AS MATERIALIZED (SELECT scene, id, lo, hi, top AS strength, row_number() OVER (PARTITION BY scene ORDER BY top DESC, id) AS k FROM v_edges),
 s AS (SELECT DISTINCT scene, 0::BIGINT AS k, []::BIGINT[] AS kept FROM b UNION ALL SELECT s.scene, b.k, CASE WHEN count(o.id) = 0 THEN list_append(any_value(s.kept), any_value(b.id)) ELSE any_value(s.kept) END FROM s JOIN b ON b.scene = s.scene AND b.k = s.k + 1
  LEFT JOIN b o ON o.scene = s.scene AND list_contains(s.kept, o.id) AND least(o.hi, b.hi) - greatest(o.lo, b.lo) >= 0.5 * least(b.hi - b.lo, o.hi - o.lo) GROUP BY s.scene, b.k)
 SELECT b.scene, id, lo, hi, strength FROM b JOIN (SELECT scene, arg_max(kept, k) AS kept FROM s GROUP BY scene) USING (scene) WHERE list_contains(kept, id))""", "v_edges")  # fmt: skip
def opening_suppression(spark, d):
    e = edges(spark, d).select("scene", "id", "lo", "hi", F.col("top").alias("strength"))
    return kernels.suppressed(e, "scene")


@query("""SELECT * FROM (WITH RECURSIVE b AS MATERIALIZED (SELECT scene, id, off, hi - lo AS weight, row_number() OVER (PARTITION BY scene ORDER BY off, id) AS k FROM v_edges),
 s AS (SELECT DISTINCT scene, 0::BIGINT AS k, NULL::BIGINT AS id, -1 AS cluster, 0::DOUBLE AS mean, 0::DOUBLE AS total FROM b UNION ALL SELECT scene, k, id, CASE WHEN fresh THEN cluster + 1 ELSE cluster END,
  CASE WHEN fresh THEN off ELSE mean + (off - mean) * weight / (total + weight) END, CASE WHEN fresh THEN weight ELSE total + weight END FROM (
   SELECT s.scene, b.k, b.id, s.cluster, s.mean, s.total, b.off, b.weight, s.cluster < 0 OR b.off - s.mean > 0.04 AS fresh FROM s JOIN b ON b.scene = s.scene AND b.k = s.k + 1))
 SELECT scene, id, CAST(cluster AS INT) AS cluster FROM s WHERE k > 0)""", "v_edges")  # fmt: skip
def segment_clusters(spark, d):
    e = edges(spark, d).select("scene", "id", "off", (F.col("hi") - F.col("lo")).alias("weight"))
    return kernels.wall_clusters(e, "scene", 0.04)


@query()
def monte_carlo_area(spark, d):
    return kernels.area_spread(rooms(spark, d), 0.01)


@query()
def pose_graph(spark, d):
    return kernels.corrected_paths(poses(spark, d))


@query()
def view_cover(spark, d):
    seen = edges(spark, d).select("scene", F.col("room").cast("long").alias("view"), (F.col("id") % 17).alias("part")).distinct()
    return kernels.covering_views(seen, "scene")
