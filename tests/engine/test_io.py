"""Sources, sinks and streams."""

import base64
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.functions import text
from mensura.operators import calibration, scoring, windows
from mensura.sinks import documents as sinks
from mensura.sources import binary
from mensura.sources import captures as src
from mensura.streaming import captures as streams


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_detect_and_presence(spark, tmp_path):
    for f in ("a/odometry.csv", "a/depth/000001.png", "b/odometry.csv", "c/clip.MOV", "d/01_Kitchen/1.jpg", "d/01_Kitchen/0.jpg", "d/hall/3.jpg", "e/notes.txt"):
        put(tmp_path / f, "x")
    files = src.listing(spark, str(tmp_path))
    got = {r.capture: r.tier for r in src.detect(files, f"file:{tmp_path}").collect()}
    assert got == {"a": "lidar", "b": "video", "c": "video", "d": "photo", "e": "error"}
    frames = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "capture string, frame int")
    there = src.with_presence(frames, files, "depth")
    assert {(r.capture, r.frame): r.has_depth for r in there.collect()} == {("a", 1): True, ("a", 2): False, ("b", 1): False}
    assert {r.capture: r.note for r in src.missing_notes(there, "depth").collect()} == {"a": "1 of 2 frames without depth", "b": "1 of 1 frames without depth"}
    photos = src.photo_rooms(files.where("path like '%/d/%'")).collect()
    assert {(r.room, r.place) for r in photos} == {("Kitchen", 1), ("Kitchen", 2), ("hall", 1)}
    assert src.nested_root(files, f"file:{tmp_path}").count() == 2


def test_odometry(spark, tmp_path):
    put(tmp_path / "o.csv", "timestamp, frame, x, y, z, qx, qy, qz, qw, fx, fy\n0.1,0,1,2,3,0,0,0,1,500,501\n0.2,1,1,2,3,0,0,0,1,,\n0.3,2,1,2\n")
    got = src.odometry(spark, str(tmp_path / "o.csv"), (400.0, 401.0, 320.0, 240.0)).orderBy("frame").collect()
    assert [(r.frame, r.fx, r.fy, r.cx) for r in got] == [(0, 500.0, 501.0, 320.0), (1, 400.0, 401.0, 320.0)]


def test_trajectory(spark, tmp_path):
    put(tmp_path / "t.txt", "1.0 0 0 0 1 2 3\nbad line\n2.0 0 0 1.5707963267948966 1 0 0\n")
    got = src.trajectory(spark, str(tmp_path / "t.txt")).orderBy("t").collect()
    assert tuple(got[0])[1:] == pytest.approx((-1, -3, 2)) and tuple(got[1])[1:] == pytest.approx((0, 0, -1), abs=1e-9)


def test_truth_manifest_calibration(spark, tmp_path):
    doc = {"site": "s", "rooms": [{"name": "r", "ceiling": [2.5, 2.7], "walls": [{"id": "W1", "length": {"readings": [3.0, 3.2]}}, {"id": "W2", "length": {"value": 2}}, {"id": "W3"}], "openings": [{"id": "O1", "width": 0.9}]},
           {"name": "q", "openings_assessed": False, "openings": [{"id": "O2"}]}], "adjacency": [["r", "q"]]}
    t = src.truth(spark, [doc, {"site": "none"}])
    assert {r.room: r.ceiling for r in t["room"].collect()} == {"r": 2.6, "q": None}
    assert [r.length for r in t["wall"].orderBy("id").collect()] == [pytest.approx(3.1), 2.0, None]
    assert t["opening"].count() == 1 and tuple(t["adjacency"].first()) == ("s", "q", "r")
    put(tmp_path / "m.yaml", "captures:\n  - {id: c1, site: s, tier: lidar, path: p, room_map: {R1: r}}\n")
    m = src.manifest(spark, src.yaml_documents(spark, str(tmp_path / "m.yaml"))[0]).first()
    assert m.id == "c1" and m.room_map == {"R1": "r"}
    text = json.dumps({"version": "prior", "tiers": {"lidar": {"default": {"abs_mult": 1.5, "log_mult": 1.0, "abs_floor": 0.004, "log_floor": 0.0}}}, "corrections": {"lidar": {"depth_scale": 1.0}}})
    table, fixes = src.calibration(spark, text)
    assert table.count() == 1 and fixes.first().value == 1.0
    folded = json.loads(sinks.folded_calibration(text, {("lidar", "wall_length"): 2.0}, "run", "2024-01-01"))
    assert folded["tiers"]["lidar"]["wall_length"]["abs_mult"] == 3.0 and folded["history"][0]["version"] == "prior" and folded["fitted"]


def test_png_and_ply(spark, tmp_path):
    rng = np.random.default_rng(0)
    for dtype in (np.uint8, np.uint16):
        grid = rng.integers(0, np.iinfo(dtype).max, (13, 9)).astype(dtype)
        assert np.array_equal(binary.png(binary.write_png(grid)), grid)
    (tmp_path / "cap/depth").mkdir(parents=True)
    (tmp_path / "cap/depth/000007.png").write_bytes(binary.write_png(np.array([[0, 1500], [2500, 3]], np.uint16)))
    rows = binary.depth_frames(spark, str(tmp_path)).collect()
    assert {r.capture for r in rows} == {"cap"}
    got = {(r.r, r.c): r.depth for r in rows}
    assert got == {(0, 0): None, (0, 1): 1.5, (1, 0): 2.5, (1, 1): 0.003}
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty double x\nproperty double y\nproperty double z\nproperty uchar red\nend_header\n"
    (tmp_path / "a.ply").write_bytes(head + struct.pack("<dddB", 1, 2, 3, 4) + struct.pack("<dddB", 5, 6, 7, 8))
    assert {(r.x, r.y, r.z) for r in binary.ply_points(spark, str(tmp_path)).collect()} == {(1, 2, 3), (5, 6, 7)}


def test_documents(spark, tmp_path):
    caps = spark.createDataFrame([("c1", "lidar")], "capture string, tier string")
    rooms = spark.createDataFrame([("c1", "R1", 12.0)], "capture string, room string, area double")
    walls = spark.createDataFrame([("c1", "R1", "R1-W1", 4.0, 3.9, 4.1)], "capture string, room string, id string, length double, lo double, hi double")
    ops = spark.createDataFrame([], "capture string, room string, id string, kind string, width double")
    plan = sinks.plan_documents(caps, rooms, walls, ops)
    sinks.write_json(plan, str(tmp_path / "plans"))
    back = spark.read.schema(plan.schema).json(str(tmp_path / "plans")).first()
    assert back.rooms[0].walls[0].length == 4.0
    schema = sinks.json_schema(plan.schema, "Plan")
    assert schema["properties"]["rooms"]["items"]["properties"]["area"] == {"type": "number"} and schema["additionalProperties"] is False
    assert "| c1 | lidar |" in sinks.markdown(caps, ["capture"])
    assert "<td>&lt;b&gt;</td>" in sinks.report("t", {"x": spark.createDataFrame([("<b>",)], "a string")})
    assert sinks.svg({"R1": [(0, 0), (4, 0), (4, 3), (0, 3)]}).count("4.00") == 2


def test_conformal_factor_closed_form(spark):
    rows = spark.createDataFrame([("k", i / 10) for i in range(1, 20)], "tier string, s double")
    assert calibration.conformal_factor(rows, "tier").first().factor == pytest.approx(1.8)
    few = spark.createDataFrame([("k", 1.0), ("k", 2.0)], "tier string, s double")
    assert calibration.conformal_factor(few, "tier").first().factor == pytest.approx(2.5)


def test_empty_items(spark):
    items = spark.createDataFrame([], "capture int, tier string, kind string, room int, ref long, truth double, value double, lo double, hi double")
    for f in (scoring.calibration_table, scoring.wall_gate, scoring.ceiling_gate, calibration.factors, calibration.leave_one_out, calibration.pooled_counts):
        assert f(items).count() == 0


def test_outlier_cue_is_rejected(spark):
    cues = spark.createDataFrame([("c", "a", 0.0, 0.1), ("c", "b", 0.02, 0.1), ("c", "d", 0.9, 0.1), ("e", "a", 0.0, 0.1), ("e", "b", 0.9, 0.1)], "capture string, name string, log_scale double, sigma double")
    left = {(r.capture, r.name) for r in calibration.reject_outliers(cues, "capture").collect()}
    assert left == {("c", "a"), ("c", "b"), ("e", "a"), ("e", "b")}


def test_streams_match_batch(spark, tmp_path):
    poses = spark.range(60).select((F.col("id") % 2).alias("capture"), F.col("id").alias("pose"), (F.col("id") / 10).alias("t"), F.sin(F.col("id") / 7).alias("x"), F.lit(0.0).alias("z"), (F.col("id") * 3.0).alias("heading"))
    for k in range(3):
        poses.where((F.col("pose") >= 20 * k) & (F.col("pose") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(poses.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.keyframes(stream, 0.2, 30.0, 10.0).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.capture, r.pose) for r in spark.table("kept").collect()}
    assert got == {(r.capture, r.pose) for r in windows.select_keyframes(poses, 0.2, 30.0, 10.0).collect()}


def test_stream_windows(spark, tmp_path):
    frames = spark.range(30).select(F.lit("c").alias("capture"), F.col("id").alias("frame"), (F.col("id") * 7 % 5).cast("double").alias("sharpness"), F.timestamp_seconds(F.col("id") / 3).alias("ts"))
    frames.coalesce(1).write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "f"))
    for name, df in (("sharp", streams.sharpest_frames(stream)), ("sess", streams.sessions(stream)), ("vox", streams.running_voxels(stream.selectExpr("cast(frame as double) x", "0D y", "0D z"), 5.0))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
    best = {r.frame for r in spark.table("sharp").collect()}
    rows = frames.collect()
    want = {max((r for r in rows if int(r.frame / 3) == s), key=lambda r: (r.sharpness, -r.frame)).frame for s in range(10)}
    assert best == want and spark.table("sess").first().n == 30 and spark.table("vox").count() == 6


def test_layout_of_a_simulated_flat(spark):
    from mensura.plans.layout import layout
    from mensura.sources.simulate import flat

    rooms = [(1, 1, 0.0, 0.0, 3.4, 2.9, 2.55), (1, 2, 3.5, 0.0, 6.1, 2.9, 2.55), (2, 1, 0.0, 0.0, 4.0, 3.0, 2.6)]
    cloud = flat(spark, rooms, [(1, 0, 3.45, 1.0, 1.85, 2.05)]).cache()
    got = layout(cloud)
    heights = {r.scene: r.height for r in got["levels"].collect()}
    assert heights == {1: pytest.approx(2.55, abs=0.001), 2: pytest.approx(2.6, abs=0.001)}
    areas = {(r.scene, r.room): r.area for r in got["rooms"].collect()}
    assert areas == {(1, 1): pytest.approx(3.4 * 2.9, rel=0.01), (1, 2): pytest.approx(2.6 * 2.9, rel=0.01), (2, 1): pytest.approx(12.0, rel=0.01)}
    shapes = {(r.scene, r.room): r.area for r in got["outlines"].where("seq = 0").collect()}
    assert shapes == {k: pytest.approx(v, rel=0.03) for k, v in areas.items()} and got["outlines"].where("scene = 2").count() == 4
    lengths = sorted(r.length for r in got["lines"].where("scene = 2").collect())
    assert lengths == pytest.approx([3.0, 3.0, 4.0, 4.0], abs=0.06)
    assert layout(cloud.where("scene = 9"))["rooms"].count() == 0


def test_base64_of_long_texts_is_one_line(spark):
    texts = ["", "https://a", "x" * 57, "ü" * 29, "x" * 58, "https://example.org/" + "x" * 300, None]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, s string").select("i", text.encoded_base64(F.col("s")).alias("b")).collect()
    assert {r.i: r.b for r in got} == {i: None if s is None else base64.b64encode(s.encode()).decode() for i, s in enumerate(texts)}
