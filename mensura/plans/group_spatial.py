"""Catalogue: voxels, grids, histograms, levels, paths, islands, runs, polygons, picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spatial, windows
from .adapters import edges, points, poses, rays, read, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _cell(x: str, size: float) -> str:
    return f"CAST(floor(round({x} / {size}::DOUBLE, 9)) AS BIGINT)"


_NORMALS = "CAST(frame % 5 AS DOUBLE) - 2 AS nx, CAST(seq % 7 AS DOUBLE) - 3 AS ny, CAST(frame % 3 AS DOUBLE) AS nz"


@query(f"""SELECT scene, ix, iy, iz, x, y, z, n, round(nx / l, 6) + 0 AS nx, round(ny / l, 6) + 0 AS ny, round(nz / l, 6) + 0 AS nz FROM (SELECT *, greatest(sqrt(nx * nx + ny * ny + nz * nz), 1e-12) AS l FROM (
 SELECT scene, {_cell('x', 0.5)} AS ix, {_cell('y', 0.5)} AS iy, {_cell('z', 0.5)} AS iz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT *, {_NORMALS} FROM v_points) GROUP BY scene, 2, 3, 4))""", "v_points")  # fmt: skip
def voxel_fuse(spark, d):
    p = points(spark, d).selectExpr("*", *_NORMALS.split(", "))
    fused = _rounded(spatial.voxel_fuse(p, 0.5, "scene").drop("first_frame"), "x", "y", "z", "nx", "ny", "nz")
    return fused.withColumns({c: F.col(c) + 0 for c in ("nx", "ny", "nz")})


@query(f"SELECT scene, {_cell('x', 0.5)} AS ix, {_cell('y', 0.5)} AS iy, {_cell('z', 0.5)} AS iz, CAST(min(seq) // 8 % 64 AS INT) AS first_frame FROM v_points GROUP BY scene, 2, 3, 4", "v_points")
def voxel_first_frame(spark, d):
    return spatial.voxel_fuse(points(spark, d), 0.5, "scene").select("scene", "ix", "iy", "iz", "first_frame")


@query(f"SELECT scene, {_cell('x', 0.2)} AS ix, {_cell('z', 0.2)} AS iz, round(sum(y), 4) AS weight FROM v_points GROUP BY scene, 2, 3", "v_points")
def grid_count(spark, d):
    return spatial.grid_count(points(spark, d), 0.2, F.col("y"), "scene").withColumn("weight", F.round("weight", 4))


@query(f"""SELECT *, span >= 0.9 AND n >= 3 AS is_wall FROM (SELECT scene, {_cell('x', 0.2)} AS ix, {_cell('z', 0.2)} AS iz, count(*) AS n, max(y) - min(y) AS span, max(y) AS top FROM v_points GROUP BY scene, 2, 3)""", "v_points")
def wall_evidence(spark, d):
    return spatial.wall_evidence(points(spark, d), 0.2, "scene")


@query("""SELECT scene, ix, iy, count(DISTINCT ray) AS rays FROM (SELECT scene, ray, CAST(floor(round((px + dx * (k * (0.9::DOUBLE * 0.25::DOUBLE) / length)) / 0.25::DOUBLE, 9)) AS BIGINT) AS ix, CAST(floor(round((py + dy * (k * (0.9::DOUBLE * 0.25::DOUBLE) / length)) / 0.25::DOUBLE, 9)) AS BIGINT) AS iy
 FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS k FROM (SELECT *, greatest(ceil(round((length - 0.06::DOUBLE) / (0.9::DOUBLE * 0.25::DOUBLE), 9)), 0) AS n FROM (SELECT *, sqrt(dx * dx + dy * dy) AS length FROM (SELECT *, qx - px AS dx, qy - py AS dy FROM v_rays)) WHERE length > 0))) GROUP BY ALL""", "v_rays")  # fmt: skip
def ray_carve_distinct(spark, d):
    return spatial.ray_carve(rays(spark, d), 0.25)


_HIST = "SELECT scene, CAST(least(floor(round(y / 0.05::DOUBLE, 9)), 99) AS INT) AS bin, count(*) AS n FROM v_points WHERE y >= 0 AND y <= 0.05::DOUBLE * 100 GROUP BY scene, 2"


def _hist(spark, d):
    return spatial.histogram(points(spark, d), F.col("y"), 0.0, 0.05, 100, "scene")


@query(_HIST, "v_points")
def histogram_fixed_bins(spark, d):
    return _hist(spark, d)


_SMOOTH = " + ".join(f"coalesce({'n' if j == 0 else f'lag(n, {-j}) OVER w' if j < 0 else f'lead(n, {j}) OVER w'}, 0) * {spatial.TAPS[j + 3]}::DOUBLE" for j in range(-3, 4))


@query(f"""SELECT scene, bin, n, s FROM (SELECT *, coalesce(lag(s) OVER w, 0) AS l, coalesce(lead(s) OVER w, 0) AS r FROM (SELECT *, round({_SMOOTH}, 6) AS s FROM (SELECT scene, bin, coalesce(n, 0) AS n FROM (FROM (SELECT DISTINCT scene FROM v_points), (SELECT CAST(unnest(range(100)) AS INT) AS bin)) LEFT JOIN ({_HIST}) USING (scene, bin))
 WINDOW w AS (PARTITION BY scene ORDER BY bin)) WINDOW w AS (PARTITION BY scene ORDER BY bin)) WHERE s >= l AND s > r""", "v_points")  # fmt: skip
def local_peaks(spark, d):
    return spatial.peaks(_hist(spark, d), 100, "scene")


@query(f"""WITH near AS (SELECT v.* FROM v_points v JOIN (SELECT scene, median(y) AS m FROM v_points GROUP BY scene) USING (scene) WHERE abs(y - m) <= 1), c AS (SELECT scene, median(y) AS height, count(DISTINCT ({_cell('x', 0.1)}, {_cell('z', 0.1)})) AS cells FROM near GROUP BY scene)
 SELECT scene, round(height, 6) AS height, cells, round(spread, 6) AS spread, round(cells * 0.01::DOUBLE, 6) AS area FROM c JOIN (SELECT scene, median(abs(y - height)) * 1.4826::DOUBLE AS spread FROM near JOIN c USING (scene) GROUP BY scene) USING (scene)""".replace("WITH near", "SELECT * FROM (WITH near") + ")", "v_points")  # fmt: skip
def level_median_mad(spark, d):
    return _rounded(spatial.level(points(spark, d), 1.0, "scene"), "height", "spread", "area")


@query(f"SELECT scene, round(sum(-p * ln(p)), 6) AS entropy FROM (SELECT scene, n / CAST(sum(n) OVER (PARTITION BY scene) AS DOUBLE) AS p FROM ({_HIST})) GROUP BY scene", "v_points")
def map_entropy(spark, d):
    return _rounded(spatial.entropy(_hist(spark, d), "scene"), "entropy")


_FOLD = "SELECT scene, theta, w, theta - (pi() / 2) * floor(theta / (pi() / 2)) AS f FROM (SELECT scene, y / 2 AS theta, x AS w FROM v_points)"


@query(f"""SELECT * FROM (WITH r AS MATERIALIZED (SELECT *, CAST(least(floor(round(f / (pi() / 2) * 180, 9)), 179) AS INT) AS b FROM ({_FOLD})), h AS (SELECT scene, b, sum(w) AS w FROM r GROUP BY ALL),
 s AS (SELECT h.scene, ((h.b + d) % 180 + 180) % 180 AS b, round(sum(h.w * exp(-0.5 * (d / 2.0::DOUBLE) ** 2)), 6) AS s FROM h, (SELECT unnest(range(-6, 7)) AS d) GROUP BY ALL),
 p AS (SELECT scene, (b + 0.5::DOUBLE) * (pi() / 2) / 180 AS peak FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY s DESC, b) AS k FROM s) WHERE k = 1),
 n AS (SELECT r.*, round(abs(f - peak + pi() / 4 - (pi() / 2) * floor((f - peak + pi() / 4) / (pi() / 2)) - pi() / 4), 9) < radians(8) AS near FROM r JOIN p USING (scene))
 SELECT scene, round(atan2(sum(w * sin(4 * theta)) FILTER (near), sum(w * cos(4 * theta)) FILTER (near)) / 4, 5) AS yaw, round(sqrt(sum(w * sin(4 * theta)) ** 2 + sum(w * cos(4 * theta)) ** 2) / greatest(sum(w), 1e-9), 5) AS strength FROM n GROUP BY scene)""", "v_points")  # fmt: skip
def dominant_yaw(spark, d):
    out = spatial.dominant_yaw(points(spark, d).select("scene", (F.col("y") / 2).alias("theta"), F.col("x").alias("w")), "scene")
    return out.withColumns({n: F.round(n, 5) for n in ("yaw", "strength")})


_LABELS = f"SELECT {_cell('x', 0.2)} AS ix, {_cell('z', 0.2)} AS iz, max(frame) % 4 AS label FROM v_points GROUP BY 1, 2"


@query(f"""SELECT least(label, other) AS a, greatest(label, other) AS b, round(count(*) * 0.2::DOUBLE, 6) AS length FROM (SELECT p.label, q.label AS other FROM ({_LABELS}) p JOIN ({_LABELS}) q ON (q.ix = p.ix + 1 AND q.iz = p.iz) OR (q.ix = p.ix AND q.iz = p.iz + 1) WHERE p.label <> q.label) GROUP BY 1, 2""", "v_points")
def boundary_lengths(spark, d):
    cells = points(spark, d).groupBy(spatial.cell(F.col("x"), 0.2).alias("ix"), spatial.cell(F.col("z"), 0.2).alias("iz")).agg((F.max("frame") % 4).alias("label"))
    return _rounded(spatial.boundary_lengths(cells, 0.2), "length")


@query("SELECT scene, axis, min(lo) AS lo, max(hi) AS hi, max(hi) - min(lo) AS extent FROM v_edges GROUP BY ALL", "v_edges")
def union_extent(spark, d):
    return spatial.extent(edges(spark, d), "scene", "axis")


# ---- windows -----------------------------------------------------------------------------------

_STEP = "SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)), 0) AS step FROM v_poses WINDOW w AS (PARTITION BY capture ORDER BY t, pose)"


@query(f"SELECT capture, pose, round(step, 6) AS step, round(sum(step) OVER (PARTITION BY capture ORDER BY t, pose ROWS UNBOUNDED PRECEDING), 6) AS walked FROM ({_STEP})", "v_poses")
def path_cumsum(spark, d):
    return _rounded(windows.path_length(poses(spark, d)).select("capture", "pose", "step", "walked"), "step", "walked")


@query("""SELECT capture, pose, round(abs(m - 180) / nullif(t - before, 0), 6) AS omega FROM (SELECT *, heading - lag(heading) OVER w + 180 AS raw, raw - 360 * floor(raw / 360) AS m, lag(t) OVER w AS before FROM v_poses WINDOW w AS (PARTITION BY capture ORDER BY t, pose))""", "v_poses")
def angular_velocity_lag(spark, d):
    return _rounded(windows.angular_velocity(poses(spark, d)).select("capture", "pose", "omega"), "omega")


_ORDERED = "SELECT *, row_number() OVER (PARTITION BY capture ORDER BY t, pose) AS i, pose % 13 <> 0 AS usable FROM v_poses"
_TURN = "abs((({0} - {1} + 180) - 360 * floor(({0} - {1} + 180) / 360)) - 180)"


def _keyframes_sql(distance: float, angle: float, seconds: float, fastest: float) -> str:
    """A pose of each capture a step; what is carried along is the last pose kept."""
    slow = f"(b.i IS NULL OR {_TURN.format('p.heading', 'b.heading')} / greatest(p.t - b.t, 0.001) <= {fastest})"
    far = f"(s.kept IS NULL OR sqrt((p.x - s.x) ** 2 + (p.z - s.z) ** 2) >= {distance} OR {_TURN.format('p.heading', 's.heading')} >= {angle} OR p.t - s.t >= {seconds})"
    return f"""SELECT * FROM (WITH RECURSIVE o AS MATERIALIZED ({_ORDERED}), p AS MATERIALIZED (SELECT p.*, p.usable AND {slow} AS open FROM o p LEFT JOIN o b ON b.capture = p.capture AND b.i = p.i - 1),
 s AS (SELECT DISTINCT capture, 0::BIGINT AS i, false AS kept_now, NULL::BIGINT AS kept, NULL::DOUBLE AS x, NULL::DOUBLE AS z, NULL::DOUBLE AS heading, NULL::DOUBLE AS t FROM o UNION ALL
  SELECT capture, i, take, CASE WHEN take THEN pose ELSE kept END, CASE WHEN take THEN px ELSE x END, CASE WHEN take THEN pz ELSE z END, CASE WHEN take THEN ph ELSE heading END, CASE WHEN take THEN pt ELSE t END FROM (
   SELECT s.*  EXCLUDE (i, kept_now), p.i, p.pose, p.x AS px, p.z AS pz, p.heading AS ph, p.t AS pt, p.open AND {far} AS take FROM s JOIN p ON p.capture = s.capture AND p.i = s.i + 1))
 SELECT capture, kept AS pose, t FROM s WHERE kept_now)"""


@query(_keyframes_sql(0.04, 4.0, 0.6, 90.0), "v_poses")
def keyframe_select(spark, d):
    return windows.select_keyframes(poses(spark, d).withColumn("usable", F.col("pose") % 13 != 0))


@query(_keyframes_sql(0.9, 45.0, 100000.0, 0.01), "v_poses")
def keyframe_select_wide(spark, d):
    """Thresholds of the size of these poses' steps, so that each condition decides for some of them."""
    return windows.select_keyframes(poses(spark, d).withColumn("usable", F.col("pose") % 13 != 0), 0.9, 45.0, 100000.0, 0.01)


@query(f"""SELECT * FROM (WITH RECURSIVE o AS MATERIALIZED ({_ORDERED}),
 s AS (SELECT DISTINCT capture, 0::BIGINT AS i, NULL::BIGINT AS pose, -1 AS submap, 0 AS size, NULL::DOUBLE AS x, NULL::DOUBLE AS z, NULL::DOUBLE AS heading FROM o UNION ALL
  SELECT capture, i, pose, CASE WHEN fresh THEN submap + 1 ELSE submap END, CASE WHEN fresh THEN 1 ELSE size + 1 END, CASE WHEN fresh THEN px ELSE x END, CASE WHEN fresh THEN pz ELSE z END, CASE WHEN fresh THEN ph ELSE heading END FROM (
   SELECT s.* EXCLUDE (i, pose), p.i, p.pose, p.x AS px, p.z AS pz, p.heading AS ph, s.size = 0 OR s.size >= 30 OR sqrt((p.x - s.x) ** 2 + (p.z - s.z) ** 2) > 1 OR {_TURN.format('p.heading', 's.heading')} > 40 AS fresh
   FROM s JOIN o p ON p.capture = s.capture AND p.i = s.i + 1))
 SELECT capture, pose, CAST(submap AS INT) AS submap FROM s WHERE i > 0)""", "v_poses")  # fmt: skip
def submap_sessions(spark, d):
    return windows.submaps(poses(spark, d))


_LINE = f"SELECT DISTINCT scene, frame, {_cell('y', 0.02)} AS k FROM v_points"


def _line(spark, d):
    return points(spark, d).select("scene", "frame", spatial.cell(F.col("y"), 0.02).alias("k")).distinct()


@query(f"""SELECT *, round((last - first + 1) * 0.02::DOUBLE, 6) AS length FROM (SELECT scene, frame, CAST(island AS BIGINT) AS island, min(k) AS first, max(k) AS last, count(*) AS cells FROM (SELECT *, sum(b) OVER (PARTITION BY scene, frame ORDER BY k) AS island FROM (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY scene, frame ORDER BY k) > 16 THEN 1 ELSE 0 END AS b FROM ({_LINE}))) GROUP BY ALL)
 WHERE (last - first + 1) * 0.02::DOUBLE >= 0.25 AND cells >= 0.1 * (last - first + 1)""", "v_points")  # fmt: skip
def wall_segments_islands(spark, d):
    return _rounded(windows.islands(_line(spark, d), 15, 0.25, 0.1, 0.02, "scene", "frame"), "length")


_PROFILE = "SELECT CAST(l_suppkey % 50 AS INT) AS edge, CAST(l_quantity AS INT) AS bin, round(avg(l_discount) * 10, 6) AS share FROM lineitem GROUP BY 1, 2"


def _profile(spark, d):
    return read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).cast("int").alias("edge"), F.col("l_quantity").cast("int").alias("bin")).agg(F.round(F.avg("l_discount") * 10, 6).alias("share"))


@query(f"SELECT edge, min(bin) AS bin FROM (SELECT edge, bin, share >= 0.55 AS h, lead(share >= 0.55) OVER w AS n, lead(bin) OVER w AS b FROM ({_PROFILE}) WINDOW w AS (PARTITION BY edge ORDER BY bin)) WHERE h AND n AND b = bin + 1 GROUP BY edge")
def profile_first_run(spark, d):
    return windows.first_run(_profile(spark, d), 0.55, "edge")


@query(f"SELECT edge, max(bin) AS bin FROM (SELECT *, sum(b) OVER (PARTITION BY edge ORDER BY bin) AS i FROM (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY edge ORDER BY bin) > 4 THEN 1 ELSE 0 END AS b FROM ({_PROFILE}) WHERE share < 0.45)) WHERE i = 0 GROUP BY edge")
def profile_last_open(spark, d):
    return windows.last_open(_profile(spark, d), 0.45, 4, "edge")


@query(f"""SELECT edge, round(min(bin - 1 + (half - before) / (s - before)), 5) AS at FROM (SELECT *, max(s) OVER (PARTITION BY edge) / 2 AS half, lag(s) OVER (PARTITION BY edge ORDER BY bin) AS before FROM (SELECT *, avg(share) OVER (PARTITION BY edge ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM (SELECT edge, bin, share * bin AS share FROM ({_PROFILE})))) WHERE before < half AND s >= half GROUP BY edge""")
def half_max_crossing(spark, d):
    return windows.half_maximum(_profile(spark, d).withColumn("share", F.col("share") * F.col("bin")), "edge").withColumn("at", F.round("at", 5))


@query("""SELECT scene, round(sum(x * ny - nx * y) / 2, 6) AS area, round(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 6) AS perimeter FROM (SELECT scene, lo AS x, off AS y, coalesce(lead(lo) OVER w, first_value(lo) OVER (PARTITION BY scene ORDER BY id)) AS nx, coalesce(lead(off) OVER w, first_value(off) OVER (PARTITION BY scene ORDER BY id)) AS ny FROM v_edges WINDOW w AS (PARTITION BY scene ORDER BY id)) GROUP BY scene""", "v_edges")
def polygon_area_circular(spark, d):
    v = edges(spark, d).select("scene", F.col("id").alias("seq"), F.col("lo").alias("x"), F.col("off").alias("y"))
    return _rounded(windows.polygon_area(v, "scene"), "area", "perimeter")


@query("SELECT scene, id, area, CAST(row_number() OVER (PARTITION BY scene ORDER BY area DESC, id) AS INT) AS rank FROM (SELECT scene, id, (hi - lo) * off AS area FROM v_edges)", "v_edges")
def rank_rooms_by_area(spark, d):
    return windows.rank_by_area(edges(spark, d).select("scene", "id", ((F.col("hi") - F.col("lo")) * F.col("off")).alias("area")), "scene")


@query("""SELECT capture, pose FROM (SELECT capture, pose, row_number() OVER (PARTITION BY capture ORDER BY t, pose) - 1 AS i, count(*) OVER (PARTITION BY capture) AS n FROM v_poses) WHERE n <= 7 OR list_contains(list_transform(range(7), lambda k: CAST(round_even(k * (n - 1) / 6::DOUBLE, 0) AS BIGINT)), i)""", "v_poses")
def even_spread_sample(spark, d):
    return windows.even_spread(poses(spark, d), 7, ["t", "pose"], "capture").select("capture", "pose")


@query("SELECT capture, sector, pose FROM (SELECT capture, CAST(floor(heading * 8 / 360) AS INT) AS sector, pose, row_number() OVER (PARTITION BY capture, floor(heading * 8 / 360) ORDER BY heading, pose) AS k, count(*) OVER (PARTITION BY capture, floor(heading * 8 / 360)) AS n FROM v_poses) WHERE k = n // 2 + 1", "v_poses")
def sector_middle_pick(spark, d):
    return windows.sector_middle(poses(spark, d), 8, "capture").select("capture", "sector", "pose")


@query("SELECT room, face, min(region) AS region FROM v_regions GROUP BY ALL", "v_regions")
def first_paint_per_surface(spark, d):
    from .adapters import regions

    return windows.first_of(regions(spark, d), ["region"], "room", "face").select("room", "face", "region")


@query("SELECT event_type AS warning, min(event_id) AS first_at FROM events GROUP BY 1")
def ordered_distinct_warnings(spark, d):
    return windows.ordered_distinct(read(spark, d, "events").select(F.col("event_type").alias("warning"), "event_id"), "warning", "event_id")


@query("""SELECT * FROM (WITH RECURSIVE f AS (SELECT capture, list(pose ORDER BY pose) AS ids, list(x ORDER BY pose) AS m FROM v_poses GROUP BY capture UNION ALL
  SELECT capture, list_concat(ids[:k - 1], ids[k + 1:]), list_concat(list_concat(m[:k - 1], [m[k] + m[k + 1]]), m[k + 2:]) FROM (
   SELECT capture, ids, m, 1 + list_position(m[2:len(m) - 1], list_min(m[2:len(m) - 1])) AS k FROM f WHERE len(ids) > 5))
 SELECT capture, unnest(ids) AS seq, unnest(m) AS motion FROM f WHERE len(ids) <= 5)""", "v_poses")  # fmt: skip
def thin_frames(spark, d):
    frames = poses(spark, d).select("capture", F.col("pose").alias("seq"), F.col("x").alias("motion"))
    return windows.thinned(frames, 5, "capture")
