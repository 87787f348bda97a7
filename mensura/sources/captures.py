"""Capture sources: listings, odometry, trajectories, truth, manifests, calibration, saved plans."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ODOMETRY = T.StructType([T.StructField("timestamp", T.DoubleType()), T.StructField("frame", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "qx", "qy", "qz", "qw", "fx", "fy", "cx", "cy")]])
VIDEOS, IMAGES = ("mp4", "mov", "m4v"), ("jpg", "jpeg", "png", "heic")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below a path; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def detect(files: DataFrame, root: str) -> DataFrame:
    """(capture, tier) of each folder below root by what it holds: odometry with depth is LiDAR, without is video, as is a
    video file; folders of images, or images, are photos; anything else is an error."""
    rest = F.split(F.element_at(F.split("path", root.rstrip("/") + "/"), -1), "/")
    f = files.select(rest.alias("p")).where(F.size("p") > 1).select(F.col("p")[0].alias("capture"), F.element_at("p", -1).alias("name"), F.size("p").alias("depth"), F.array_contains("p", "depth").alias("in_depth"))
    ext = F.lower(F.substring_index("name", ".", -1))
    seen = f.groupBy("capture").agg(
        F.bool_or(F.col("name") == "odometry.csv").alias("odometry"), F.bool_or("in_depth").alias("depth"), F.bool_or(ext.isin(*VIDEOS)).alias("video"),
        F.bool_or(ext.isin(*IMAGES) & (F.col("depth") > 2) & ~F.col("in_depth")).alias("rooms"), F.bool_or(ext.isin(*IMAGES)).alias("images"))
    tier = F.when(F.col("odometry") & F.col("depth"), "lidar").when(F.col("odometry") | F.col("video"), "video").when(F.col("rooms") | F.col("images"), "photo").otherwise("error")
    return seen.select("capture", tier.alias("tier"))


def nested_root(files: DataFrame, root: str) -> DataFrame:
    """(capture, root): where a capture's one odometry file lies, at the top of its folder or one folder below; captures with none or several go."""
    base = root.rstrip("/") + "/"
    hits = files.where(F.col("path").endswith("/odometry.csv")).withColumn("rest", F.split(F.element_at(F.split("path", F.lit(base)), -1), "/"))
    near = hits.where(F.size("rest").between(2, 3)).withColumn("root", F.regexp_replace("path", "/odometry\\.csv$", ""))
    return near.groupBy(F.col("rest")[0].alias("capture")).agg(F.count("*").alias("n"), F.min("root").alias("root")).where("n = 1").select("capture", "root")


def odometry(spark: SparkSession, path: str, intrinsics: tuple[float, float, float, float]) -> DataFrame:
    """Poses by header name; rows without the first nine fields go, missing intrinsics are those of the capture."""
    raw = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
    clean = raw.toDF(*[c.strip() for c in raw.columns])
    for f in ODOMETRY.fields:
        value = F.expr(f"try_cast(trim(`{f.name}`) AS {f.dataType.simpleString()})") if f.name in clean.columns else F.lit(None).cast(f.dataType)
        clean = clean.withColumn(f.name, value)
    whole = clean.dropna(subset=[f.name for f in ODOMETRY.fields[:9]])
    return whole.select(*[F.coalesce(f.name, F.lit(k)).alias(f.name) if f.name in ("fx", "fy", "cx", "cy") else F.col(f.name) for f, k in zip(ODOMETRY.fields, [None] * 9 + list(intrinsics))])


def with_presence(frames: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """Whether a raster of this kind exists for each (capture, frame); a file's capture is the folder that holds the folder of its kind."""
    parts = files.select(F.regexp_extract("path", rf"([^/]+)/{kind}/([0-9]+)\.png$", 1).alias("capture"), F.regexp_extract("path", rf"/{kind}/([0-9]+)\.png$", 1).alias("n"))
    have = parts.where("n <> ''").select("capture", F.col("n").cast("int").alias("frame")).distinct().withColumn(f"has_{kind}", F.lit(True))
    return frames.join(have, ["capture", "frame"], "left").fillna(False, [f"has_{kind}"])


def missing_notes(frames: DataFrame, kind: str) -> DataFrame:
    """(capture, note): how many frames of a capture lack a raster; none for whole captures."""
    n = frames.groupBy("capture").agg(F.count_if(~F.col(f"has_{kind}")).alias("missing"), F.count("*").alias("n")).where("missing > 0")
    return n.select("capture", F.format_string(f"%d of %d frames without {kind}", "missing", "n").alias("note"))


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """`t rx ry rz tx ty tz` lines, world to camera as an axis-angle; others are skipped. Gives camera positions, y up."""
    p = F.split(F.trim("value"), r"\s+")
    n = spark.read.text(path).select(p.alias("p")).where(F.size("p") == 7)
    c = n.select(*[F.expr(f"try_cast(p[{i}] AS double)").alias(k) for i, k in enumerate(("t", "rx", "ry", "rz", "tx", "ty", "tz"))]).dropna()
    a = F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("rz") * F.col("rz"))
    c = c.withColumn("a", a).withColumns({k: F.coalesce(F.try_divide(F.col(f"r{k}"), F.col("a")), F.lit(0.0)) for k in "xyz"})
    along = F.col("x") * F.col("tx") + F.col("y") * F.col("ty") + F.col("z") * F.col("tz")
    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    # the camera's place is -R' t, R' turning by -a
    place = {k: -(F.col(f"t{k}") * F.cos("a") - (F.col(i) * F.col(f"t{j}") - F.col(j) * F.col(f"t{i}")) * F.sin("a") + F.col(k) * along * (1 - F.cos("a"))) for k, (i, j) in cross.items()}
    return c.select("t", place["x"].alias("px"), place["z"].alias("py"), (-place["y"]).alias("pz"))


def truth(spark: SparkSession, documents: list[dict]) -> dict[str, DataFrame]:
    """Tables of ground truth from parsed documents. A reading is a number, a list, `{readings: [...]}` or `{value: x}`; lists are averaged."""
    def value(v):
        if v is None or isinstance(v, (int, float)):
            return None if v is None else float(v)
        if isinstance(v, dict):
            return value(v.get("value", v.get("readings")))
        return sum(map(float, v)) / len(v) if v else None

    rooms, walls, openings, adjacency = [], [], [], []
    for d in documents:
        site = str(d.get("site"))
        for r in d.get("rooms") or []:
            assessed = bool(r.get("openings_assessed", True))
            rooms.append((site, r["name"], value(r.get("ceiling")), value(r.get("floor_area")), bool(r.get("connector", False)), assessed))
            walls += [(site, r["name"], w["id"], value(w.get("length"))) for w in r.get("walls") or []]
            openings += [(site, r["name"], o["id"], o.get("wall"), o.get("kind"), value(o.get("width")), value(o.get("height"))) for o in (r.get("openings") or []) if assessed]
        adjacency += [(site, *sorted(map(str, pair))) for pair in d.get("adjacency") or []]
    return {
        "room": spark.createDataFrame(rooms, "site string, room string, ceiling double, floor_area double, connector boolean, openings_assessed boolean"),
        "wall": spark.createDataFrame(walls, "site string, room string, id string, length double"),
        "opening": spark.createDataFrame(openings, "site string, room string, id string, wall string, kind string, width double, height double"),
        "adjacency": spark.createDataFrame(adjacency, "site string, a string, b string"),
    }


def yaml_documents(spark: SparkSession, path: str) -> list[dict]:
    """Parsed YAML files of a folder; they are hand-written and few."""
    import yaml

    return [yaml.safe_load(r[0]) for r in spark.read.text(path, wholetext=True).collect()]


def manifest(spark: SparkSession, document: dict) -> DataFrame:
    rows = [(c["id"], c.get("site"), c.get("tier"), c.get("path"), c.get("repeat_of"), {str(k): str(v) for k, v in (c.get("room_map") or {}).items()}) for c in document.get("captures") or []]
    return spark.createDataFrame(rows, "id string, site string, tier string, path string, repeat_of string, room_map map<string,string>")


def calibration(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(multipliers, corrections) of a calibration document."""
    d = json.loads(text)
    names = ("abs_mult", "log_mult", "abs_floor", "log_floor")
    rows = [(t, k, *(float(m[n]) for n in names)) for t, kinds in d["tiers"].items() for k, m in kinds.items()]
    fixes = [(t, k, float(v)) for t, c in d.get("corrections", {}).items() for k, v in c.items()]
    return spark.createDataFrame(rows, "tier string, kind string, abs_mult double, log_mult double, abs_floor double, log_floor double"), spark.createDataFrame(fixes, "tier string, name string, value double")


def photo_rooms(files: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """(room, path, place) of photo folders: names lose a leading number, photos are in order of their time (path, taken), if it is known, then name."""
    from ..functions.text import without_ordinal

    p = F.split("path", "/")
    f = files.where(F.lower(F.substring_index("path", ".", -1)).isin(*IMAGES)).select("path", F.element_at(p, -2).alias("folder"), F.element_at(p, -1).alias("name"))
    f = f.join(times.select("path", "taken"), "path", "left") if times is not None else f.withColumn("taken", F.lit(None).cast("timestamp_ntz"))
    place = F.row_number().over(Window.partitionBy("folder").orderBy(F.col("taken").asc_nulls_last(), "name"))
    return f.select(without_ordinal(F.col("folder")).alias("room"), "path", place.alias("place"))


def unpacked(spark: SparkSession, path: str, target: str) -> DataFrame:
    """(path, content) of the files in all ZIP archives below a path, under target/archive/name; parts of a name that leave the folder are refused.

    An archive is one row and is opened in one task; what comes out is written by the caller.
    """
    import io
    import zipfile

    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for item in z.infolist():
                        if item.is_dir():
                            continue
                        if item.filename.startswith("/") or ".." in item.filename.split("/"):
                            raise ValueError(f"{name}: {item.filename} leaves its folder")
                        yield pd.DataFrame({"path": [f"{target.rstrip('/')}/{stem}/{item.filename}"], "content": [z.read(item)]})

    return files.mapInPandas(run, "path string, content binary")


def verified(files: DataFrame, digests: DataFrame) -> DataFrame:
    """(path, ok): whether the SHA-256 of a file (path, content) is the one that is stated (path, sha256); ok is null for files that none is stated for."""
    return files.select("path", F.sha2("content", 256).alias("found")).join(digests, "path", "left").select("path", (F.col("found") == F.lower("sha256")).alias("ok"))


def app_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """(room, dimension, app_value) of another app's CSV, in metres; rows without a number go."""
    raw = spark.read.option("header", "true").csv(path)
    clean = raw.toDF(*[c.strip().lower() for c in raw.columns])
    value = F.expr("try_cast(trim(value) AS double)")
    return clean.select(F.trim("room").alias("room"), F.trim("dimension").alias("dimension"), value.alias("app_value")).where("app_value is not null")


def saved_plans(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Saved plans or metrics, a document a file, read by a stated schema; what it doesn't name is left out, broken documents are refused."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)


def rule_file(spark: SparkSession, document: dict) -> DataFrame:
    """Rules of a parsed rule file as rows of `operators.rules.SCHEMA`; conditions that a rule doesn't set are null."""
    from ..operators.rules import SCHEMA

    kind = T._parse_datatype_string(SCHEMA)
    rows = [tuple(list(v) if isinstance(v := r.get(f.name), tuple) else float(v) if isinstance(v, int) and f.dataType == T.DoubleType() else v for f in kind.fields) for r in document.get("rules") or []]
    return spark.createDataFrame(rows, kind)


def multimap(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))
