"""Matching, outlines, openings, registration, drift and commands, on small problems with known answers."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura import __main__ as commands
from mensura.operators import assembly, drift, openings, order, outlines, registration
from mensura.operators import kernels as K
from mensura.sinks import documents as sinks
from mensura.sources import captures as src


def test_pair_openings_goes_by_truth():
    truth = [(1, 0, "door", 1.0, 0.9), (2, 0, "door", 1.05, 0.9), (3, 0, "window", None, 1.2), (4, 0, "door", 0.0, 0.6)]
    found = [(11, 0, "open_passage", 1.04, 0.9), (12, 0, "door", 1.3, 0.9), (13, 1, "window", 0.0, 1.2), (14, 0, "door", 0.0, 1.2)]
    got = [(a and a[0], b and b[0]) for a, b, _ in K.pair_openings(truth, found)]
    assert got == [(1, 11), (2, 12), (3, None), (4, None), (None, 13), (None, 14)]
    assert [(a and a[0], b and b[0]) for a, b, _ in K.pair_openings(truth[2:3], found, {0: 1})][0] == (3, 13)


def test_align_walls():
    truth = [4.0, 3.0, 4.0, 3.0]
    assert K.align_walls(truth, [3.01, 4.0, 3.0, 4.02]) in ([1, 2, 3, 0], [3, 0, 1, 2], [1, 0, 3, 2], [3, 2, 1, 0])
    assert K.align_walls(truth, [4.0, 3.0, 4.0, 3.0], lambda way: way == [2, 1, 0, 3]) == [2, 1, 0, 3]
    assert K.align_walls([4.0, 3.0], [3.1, 9.0, 4.2]) == [2, 0]
    for n in (1, 3, 5):
        x = list(np.random.default_rng(n).random(n))
        ways = [[(s + d * i) % n for i in range(n)] for d in (1, -1) for s in range(n)]
        assert sorted(set(map(tuple, ways))) and sum(abs(x[k] - t) for k, t in zip(K.align_walls(x, x[::-1]), x[::-1])) <= 1e-9 + min(sum(abs(x[k] - t) for k, t in zip(w, x[::-1])) for w in ways) + 0.02 * n


def region(*boxes, shape=(80, 120)):
    out = np.zeros(shape, bool)
    for x0, x1, y0, y1 in boxes:
        out[y0:y1, x0:x1] = True
    return out


def test_outline_of_an_l():
    r = region((10, 90, 10, 50), (10, 50, 50, 70))
    lines = [(0, 1, 0.5, 0.5, 3.5), (0, -1, 4.5, 0.5, 2.5), (1, 1, 0.5, 0.5, 4.5), (1, -1, 2.5, 2.5, 4.5), (0, -1, 2.5, 2.5, 3.5), (1, -1, 3.5, 0.5, 2.5)]
    p = outlines.outline(r, 0.05, lines)
    assert len(p) == 6 and outlines._area(p) == pytest.approx(4 * 2 + 2 * 1)
    assert outlines.outline(np.zeros((5, 5), bool), 0.05, []).shape == (0, 2)


def test_hidden_strip_belongs_to_the_room():
    r = region((10, 70, 10, 50))
    lines = [(0, -1, 4.1, 0.5, 2.5), (0, 1, 0.5, 0.5, 2.5), (1, 1, 0.5, 0.5, 4.1), (1, -1, 2.5, 0.5, 4.1)]
    p = outlines.outline(r, 0.05, lines)
    assert outlines._area(p) == pytest.approx(3.6 * 2.0) and len(p) == 4
    assert outlines._area(outlines.outline(r, 0.05, lines[1:])) == pytest.approx(3.0 * 2.0)


def test_around_is_the_area_of_its_cells():
    rng = np.random.default_rng(1)
    for _ in range(30):
        cells = rng.random((5, 6)) < 0.6
        parts = K.label(cells)
        if not parts.max():
            continue
        cells = K.fill_holes(np.pad(parts == np.bincount(parts.ravel())[1:].argmax() + 1, 1))[1:-1, 1:-1]
        p = outlines.around(cells, [float(v) for v in range(7)], [float(v) for v in range(6)])
        assert outlines._area(p) == cells.sum()


def test_joined_corners():
    square = np.array([(0, 0), (4, 0), (4, 3), (0, 3)], float)
    moved = outlines.joined_corners([(1, 0.1), (0, 4.2), (1, 3.0), (0, -0.1)], square)
    assert moved.tolist() == [[-0.1, 0.1], [4.2, 0.1], [4.2, 3.0], [-0.1, 3.0]]


def wall_with(*holes, length=5.0, height=2.5, step=0.012):
    s, h = np.meshgrid(np.arange(0.005, length, step), np.arange(0.005, height, step))
    points = np.column_stack([s.ravel(), h.ravel()])
    inside = np.zeros(len(points), bool)
    for s0, s1, h0, h1 in holes:
        inside |= (points[:, 0] > s0) & (points[:, 0] < s1) & (points[:, 1] > h0) & (points[:, 1] < h1)
    return points[~inside], points[inside]


def test_openings_of_a_wall():
    solid, through = wall_with((0.6, 1.5, 0.0, 2.0), (2.4, 3.6, 0.9, 2.1))
    got = openings.detect(5.0, 2.5, solid, through)
    assert [g[0] for g in got] == ["door", "window"]
    assert got[0][1:5] == pytest.approx((0.6, 1.5, 0.0, 2.0), abs=0.02) and got[1][1:5] == pytest.approx((2.4, 3.6, 0.9, 2.1), abs=0.02)
    assert openings.detect(5.0, 2.5, *wall_with()) == []
    assert [g[0] for g in openings.detect(5.0, 2.5, *wall_with((1.0, 3.0, 0.0, 2.5)))] == ["open_passage"]


def test_openings_of_scenes(spark):
    rows = {0: wall_with((0.6, 1.5, 0.0, 2.0), step=0.02), 1: wall_with(step=0.05)}
    frame = lambda k: spark.createDataFrame([(1, w, float(s), float(h)) for w in rows for s, h in rows[w][k]], "scene int, wall int, s double, h double")
    walls = spark.createDataFrame([(1, 0, 5.0, 2.5), (1, 1, 5.0, 2.5), (2, 0, 3.0, 2.5)], "scene int, wall int, length double, height double")
    got = openings.openings(walls, frame(0), frame(1)).collect()
    assert [(r.scene, r.wall, r.kind) for r in got] == [(1, 0, "door")] and got[0].s1 - got[0].s0 == pytest.approx(0.9, abs=0.04)


def test_structure_is_recovered():
    walls = np.array([3.0, -1.0, 2.0, -2.5])
    true = {0: (0.0, 0.0, 1.0), 1: (0.7, -0.4, 1.2), 2: (-0.3, 0.5, 0.9)}
    seen = [(p, w, w // 2, (walls[w] - true[p][w // 2]) / true[p][2], 1.0) for p in true for w in range(4)]
    places, found, rms, whole = registration.solve_structure([0, 1, 2], seen)
    assert whole and rms < 1e-6 and found == pytest.approx(walls, abs=1e-4)
    assert all(places[p] == pytest.approx(true[p], abs=1e-4) for p in true)
    assert not registration.solve_structure([0, 1], seen[:4] + seen[4:5])[3]


def test_spanning_tree():
    true = {0: (0.0, 0.0, 0.0, 1.0), 1: (1.0, 0.5, 0.4, 1.1), 2: (2.0, -0.3, -0.2, 0.8), 3: (0.5, 2.0, 1.0, 1.0)}

    def link(w, a, b):
        (ax, az, ay, s), (bx, bz, by, t) = true[a], true[b]
        c, n = np.cos(-ay), np.sin(-ay)
        return (w, a, b, (c * (bx - ax) - n * (bz - az)) / s, (n * (bx - ax) + c * (bz - az)) / s, by - ay, t / s)

    for order_ in itertools.permutations([(0, 1), (2, 1), (3, 2)]):
        got = registration.along_tree([0, 1, 2, 3, 9], [link(1.0, a, b) for a, b in order_])
        assert set(got) == {0, 1, 2, 3} and all(got[k] == pytest.approx(true[k]) for k in true)


def test_h_maxima_and_wide_boundaries():
    g = np.zeros((60, 100), bool)
    g[2:58, 2:98] = True
    g[2:20, 48:52] = g[28:58, 48:52] = False
    assert K.segment_rooms(g, 0.05).max() == 2
    assert K.segment_rooms(g, 0.25, least=1.0).max() == 1
    free = np.where(g, 3.0, 0.0)
    walls = ~K.dilate(g, 1)
    inside = K.interior(free, np.zeros_like(free), walls, 0.05)
    assert inside[10, 10] and not inside[0, 0] and inside.sum() <= g.sum() + 200


def test_drift_is_taken_up(spark):
    """Two rooms' worth of walls seen twice; the second visit is off by a few centimetres."""
    rng = np.random.default_rng(4)

    def cloud(shift):
        n = 300
        faces = [(0, np.column_stack([np.zeros(n), rng.uniform(0, 2.5, n), rng.uniform(0, 3, n)]), (1, 0, 0)), (1, np.column_stack([rng.uniform(0, 4, n), rng.uniform(0, 2.5, n), np.zeros(n)]), (0, 0, 1)), (2, np.column_stack([rng.uniform(0, 4, n), np.zeros(n), rng.uniform(0, 3, n)]), (0, 1, 0))]
        return [(*(p + shift).tolist(), *map(float, normal)) for _, ps, normal in faces for p in ps]

    off = np.array([0.05, 0.0, -0.04])
    parts = [("c", k, 4.0 * k, 1.0 + float(off[0] if k == 5 else 0), 1.2, 1.0 + float(off[2] if k == 5 else 0), 2.0 * k) for k in range(6)]
    points = [("c", 0, *p) for p in cloud(np.zeros(3))] + [("c", 5, *p) for p in cloud(off)]
    parts = spark.createDataFrame(parts, "capture string, part int, t double, x double, y double, z double, walked double")
    points = spark.createDataFrame(points, "capture string, part int, x double, y double, z double, nx double, ny double, nz double")
    found = drift.closures(parts, points)
    row = found.collect()[0]
    assert (row.a, row.b) == (0, 5) and (row.dx, row.dz) == pytest.approx((-0.05, 0.04), abs=0.01) and row.rms < 0.02
    fixed = {r.part: r for r in drift.corrections(parts, drift.gated(found)).collect()}
    assert fixed[0].tx == 0 and (fixed[5].tx, fixed[5].tz) == pytest.approx((-0.05, 0.04), abs=0.012)
    walls = points.select("capture", "nx", "nz", "x", "z", "part")
    moved = walls.withColumn("x", F.col("x") - F.when(F.col("part") == 5, 0.05).otherwise(0.0)).withColumn("z", F.col("z") + F.when(F.col("part") == 5, 0.04).otherwise(0.0))
    assert drift.sharper(walls, moved).first().kept and not drift.sharper(moved, walls).first().kept


def test_ranks_and_medians(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 400), np.round(rng.normal(0, 2, 400), 1))] + [(7, 1.5)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r.m for r in order.medians(df, "v", "m", "k").collect()}
    assert got == pytest.approx({k: float(np.median([v for j, v in rows if j == k])) for k in got}) and set(got) == {0, 1, 2, 7}
    placed = order.ranked(df, "v", "r", "k").collect()
    for k in got:
        own = sorted((r.r, r.v) for r in placed if r.k == k)
        assert [r for r, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for _, v in own)
    held = df.withColumn("h", F.col("v") > 1)
    for r in order.others_ranks(held, "v", "h", F.expr("n div 2 + 1"), "k").where("n > 0").collect():
        others = sorted(v for k, v in rows if k == r.k and (v > 1) != r.h)
        assert sorted(v for k, v in rows if k == r.k)[r["rank"] - 1] == others[len(others) // 2]


def test_documents_come_back(spark, tmp_path):
    rooms = spark.createDataFrame([("s", "hall", 2.5, None, False, True)], "site string, room string, ceiling double, floor_area double, connector boolean, openings_assessed boolean")
    walls = spark.createDataFrame([("s", "hall", "S", 4.0), ("t", "x", "S", 1.0)], "site string, room string, id string, length double")
    doors = spark.createDataFrame([("s", "hall", "D1", "S", "door", 0.9, 2.0)], "site string, room string, id string, wall string, kind string, width double, height double")
    beside = spark.createDataFrame([("s", "hall", "kitchen")], "site string, a string, b string")
    (tmp_path / "t.yaml").write_text(sinks.truth_document("s", rooms, walls, doors, beside))
    back = src.truth(spark, src.yaml_documents(spark, str(tmp_path / "t.yaml")))
    assert [tuple(r) for r in back["wall"].collect()] == [("s", "hall", "S", 4.0)] and back["opening"].first().width == 0.9 and back["room"].first().ceiling == 2.5
    caps = spark.createDataFrame([("c1", "s", "lidar", "p", None, {"R1": "hall"})], "id string, site string, tier string, path string, repeat_of string, room_map map<string,string>")
    import yaml

    assert src.manifest(spark, yaml.safe_load(sinks.manifest_document(caps))).first().room_map == {"R1": "hall"}
    prior = json.dumps({"version": "p", "source": "s", "tiers": {"lidar": {"default": {"abs_mult": 1.5, "log_mult": 1.0, "abs_floor": 0.0, "log_floor": 0.0}}}})
    folded = json.loads(sinks.folded_calibration(prior, {}, "x", "d", 1.01))
    assert folded["history"][0]["tiers"]["lidar"]["default"]["abs_mult"] == 1.5 and folded["corrections"]["lidar"]["depth_scale"] == 1.01
    assert json.loads(sinks.folded_calibration(prior, {}, "x", "d"))["fitted"] is False


def test_archives_digests_and_dimensions(spark, tmp_path):
    import hashlib
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/odometry.csv", "x")
    got = src.unpacked(spark, str(tmp_path), "/out").collect()
    assert [(r.path, bytes(r.content)) for r in got] == [("/out/a/in/odometry.csv", b"x")]
    files = src.unpacked(spark, str(tmp_path), "/out")
    stated = spark.createDataFrame([("/out/a/in/odometry.csv", hashlib.sha256(b"x").hexdigest().upper())], "path string, sha256 string")
    assert src.verified(files, stated).first().ok
    (tmp_path / "d.csv").write_text("Room, Dimension,Value\nhall,W1, 3.5\nhall,W2,none\n")
    assert [tuple(r) for r in src.app_dimensions(spark, str(tmp_path / "d.csv")).collect()] == [("hall", "W1", 3.5)]
    rule = {"rules": [{"rule": "X-1", "name": "n", "classes": ["mold"], "near_window": 1, "severity": "high"}]}
    row = src.rule_file(spark, rule).first()
    assert row.classes == ["mold"] and row.near_window == 1.0 and row.surfaces is None


def test_crops_are_pictures(spark):
    from mensura.sources.binary import png

    pixels = spark.createDataFrame([(1, r, c, float(r * 10 + c)) for r in range(9) for c in range(9)], "surface int, r int, c int, l double")
    regions = spark.createDataFrame([(5, 1, 3, 4, 3, 5)], "region long, surface int, r0 int, r1 int, c0 int, c1 int")
    grid = png(bytes(sinks.evidence_crops(pixels, regions, 1).first().png))
    assert grid.shape == (4, 5) and grid[0, 0] == 22 and grid[-1, -1] == 56


def test_commands(spark, tmp_path, capsys):
    items = spark.createDataFrame([(c, "lidar", k, 1, i, 2.0 + i, 2.0 + i + 0.01, 1.9 + i, 2.2 + i) for c in range(3) for i in range(4) for k in ("wall_length", "ceiling_height")],
                                  "capture int, tier string, kind string, room int, ref long, truth double, value double, lo double, hi double")
    items.write.parquet(str(tmp_path / "items"))
    assert commands.main(["score", str(tmp_path / "items")]) == 0
    assert "| wall lengths | lidar | 12 of 12 | PASS |" in capsys.readouterr().out
    assert commands.main(["validate", str(tmp_path / "items")]) == 0
    (tmp_path / "p.json").write_text(json.dumps({"version": "p", "tiers": {"lidar": {"default": {"abs_mult": 1.0, "log_mult": 1.0, "abs_floor": 0.0, "log_floor": 0.0}}}}))
    capsys.readouterr()
    assert commands.main(["calibrate", str(tmp_path / "items"), str(tmp_path / "p.json"), "d"]) == 0
    assert json.loads(capsys.readouterr().out)["fitted"] is True
    assert commands.main(["schema", str(tmp_path / "items"), "Items"]) == 0


def test_line_tops_takes_the_greatest_around(spark):
    """Heights in the 3 x 3 cells around each place, of the line's own facing; a line with two faces has one height a place."""
    tops = spark.createDataFrame([(1, 0, 0, 0, 2.0), (1, 0, 5, 1, 3.0), (1, 1, 0, 1, 9.0), (1, 0, 2, 9, -1.0), (2, 0, 0, 0, 7.0)], "scene int, facing int, ix long, iy long, top double")
    lines = [(1, 10, 0, 1, 0.0, 0.0, 0.5), (1, 11, 0, 1, 0.1, 0.0, 1.5), (1, 12, 1, 0, 0.1, 0.0, 0.1), (1, 13, 0, 0, 0.5, 2.25, 2.3), (1, 14, 0, 1, 0.0, 0.0, 0.1), (1, 14, 1, 1, 0.0, 0.0, 0.1), (3, 15, 0, 0, 0.0, 0.0, 1.0)]
    lines = spark.createDataFrame(lines, "scene int, line int, facing int, axis int, off double, lo double, hi double")
    got = {r.line: r.top for r in assembly.line_tops(lines, tops, "scene", 0.25).collect()}
    assert got == {10: 2.0, 11: 2.5, 12: 9.0, 13: 0.0, 14: 9.0, 15: 0.0}


def test_line_tops_broadcasts_no_exploded_lines(spark):
    """Spark estimates exploded lines by the lines, whose bytes are few."""
    tops = spark.range(10**6).selectExpr("CAST(id % 9 AS INT) AS scene", "0 AS facing", "id AS ix", "id AS iy", "1.0D AS top")
    lines = spark.range(100).selectExpr("CAST(id % 9 AS INT) AS scene", "id AS line", "0 AS facing", "0 AS axis", "0.0D AS off", "0.0D AS lo", "1000.0D AS hi")
    plan = assembly.line_tops(lines, tops, "scene", 0.25)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan, plan
