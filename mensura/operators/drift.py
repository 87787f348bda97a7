"""Drift of a walk: parts that come near each other again are laid over each other, and a graph of all parts takes up what they miss by."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins, kernels, tiers

#: Points a part needs, points of it that are laid over others, spread of an odometry step (m, m a metre, degrees a metre) and of a closure.
LEAST, MOST, STEP_FLOOR, STEP, TURN, CLOSURE = 200, 2500, 0.002, 0.01, 0.25, 0.005


def _thinned(xyz: np.ndarray, normals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every n-th point, in an order that depends on the points alone."""
    order = np.lexsort(xyz.T)[:: max(1, len(xyz) // MOST)]
    return xyz[order], normals[order]


def closures(parts: DataFrame, points: DataFrame, reach: float = 2.5, gap: int = 3, seconds: float = 8.0) -> DataFrame:
    """(capture, a, b, cx, cy, cz, yaw, dx, dy, dz, share, rms, eigen, shift, walked) of parts that were laid over each other, before any gate.

    parts: capture, part, t, x, y, z (their middle), walked; points: capture, part, x, y, z, nx, ny, nz. The motion takes part b onto part a: a turn by
    yaw about b's middle (cx, cy, cz), then a shift.
    """
    near = joins.loop_candidates(parts.select("capture", "part", "t", "x", "z"), gap, seconds, reach)
    cloud = points.groupBy("capture", "part").agg(F.collect_list(F.struct("x", "y", "z", "nx", "ny", "nz")).alias("cloud")).where(F.size("cloud") >= LEAST)
    a = parts.select("capture", F.col("part").alias("a"), F.col("walked").alias("walked_a")).join(cloud.withColumnsRenamed({"part": "a", "cloud": "cloud_a"}), ["capture", "a"])
    b = parts.select("capture", F.col("part").alias("b"), *"xyz", F.col("walked").alias("walked_b")).join(cloud.withColumnsRenamed({"part": "b", "cloud": "cloud_b"}), ["capture", "b"])
    both = near.select("capture", "a", "b").join(a, ["capture", "a"]).join(b, ["capture", "b"])

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                p, q = (np.array([list(v.values()) if isinstance(v, dict) else list(v) for v in c], float) for c in (r.cloud_a, r.cloud_b))
                target, normals = _thinned(p[:, :3], p[:, 3:])
                source, _ = _thinned(q[:, :3], q[:, 3:])
                centre = np.array([r.x, r.y, r.z])
                yaw, shift, share, rms = kernels.icp(source - centre, target - centre, normals, 0.3)
                scatter = np.linalg.eigvalsh(normals.T @ normals / len(normals))[0]
                rows.append((r.capture, r.a, r.b, *centre, yaw, *shift, share, rms, float(scatter), float(np.linalg.norm(shift)), abs(r.walked_b - r.walked_a)))
            yield pd.DataFrame(rows, columns=["capture", "a", "b", "cx", "cy", "cz", "yaw", "dx", "dy", "dz", "share", "rms", "eigen", "shift", "walked"])

    kind, part = (parts.schema[c].dataType.simpleString() for c in ("capture", "part"))
    numbers = ", ".join(f"{c} double" for c in ("cx", "cy", "cz", "yaw", "dx", "dy", "dz", "share", "rms", "eigen", "shift", "walked"))
    return both.mapInPandas(run, f"capture {kind}, a {part}, b {part}, {numbers}")


def gated(found: DataFrame) -> DataFrame:
    """Closures that a walk's likely drift allows."""
    return tiers.loop_gate(found.withColumnsRenamed({"yaw": "_radians"}).withColumn("yaw", F.degrees("_radians"))).drop("yaw").withColumnRenamed("_radians", "yaw")


def corrections(parts: DataFrame, closed: DataFrame) -> DataFrame:
    """(capture, part, cx, cy, cz, yaw, tx, ty, tz): how each part's middle moves, by a graph of all parts of a capture, from steps and closures. A false
    closure loses its weight; the first part stays where it is. A capture is one problem, and has as many unknowns as parts."""
    columns = ["capture", "part", "cx", "cy", "cz", "yaw", "tx", "ty", "tz"]

    def run(key, own: pd.DataFrame, loops: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=columns)
        own = own.sort_values("part").reset_index(drop=True)
        xz, place = own[["x", "z"]].to_numpy(), {p: k for k, p in enumerate(own["part"])}
        n, walked = len(own), own["walked"].to_numpy()
        edges = []
        for k in range(n - 1):
            d = max(walked[k + 1] - walked[k], 0.05)
            edges.append((k, k + 1, *(xz[k + 1] - xz[k]), 0.0, STEP_FLOOR + STEP * d))
        for r in loops.sort_values(["a", "b"]).itertuples(index=False):
            i, j = place[r.a], place[r.b]
            # where part b's middle belongs, as part a sees it; plan angles turn from x to z, yaw the other way
            edges.append((i, j, *(xz[j] + [r.dx, r.dz] - xz[i]), -r.yaw, CLOSURE))
        p = kernels.pose_graph(n, edges) if n > 1 else np.zeros((1, 3))
        moved = p[:, :2] + xz[0] - xz
        rows = {"capture": key[0], "part": own["part"], "cx": own["x"], "cy": own["y"], "cz": own["z"], "yaw": -p[:, 2], "tx": moved[:, 0], "ty": 0.0, "tz": moved[:, 1]}
        return pd.DataFrame(rows)[columns].round({c: 9 for c in columns[5:]})

    kind, part = (parts.schema[c].dataType.simpleString() for c in ("capture", "part"))
    schema = f"capture {kind}, part {part}, " + ", ".join(f"{c} double" for c in columns[2:])
    return parts.groupBy("capture").cogroup(closed.select("capture", "a", "b", "yaw", "dx", "dz").groupBy("capture")).applyInPandas(run, schema)


def sharper(points: DataFrame, moved: DataFrame, size: float = 0.01, gain: float = 0.005) -> DataFrame:
    """(capture, before, after, kept): entropy of the coordinates of wall points (capture, nx, nz, x, z), as they were and as moved; a correction is kept
    if it makes the walls' layers sharper. Walls have to lie along the axes."""
    def entropy(rows, name):
        axis = F.when(F.abs("nx") > 0.9, 0).when(F.abs("nz") > 0.9, 1)
        at = F.floor(F.round(F.when(F.abs("nx") > 0.9, F.col("x")).otherwise(F.col("z")) / size, 9))
        n = rows.withColumn("axis", axis).where("axis is not null").groupBy("capture", "axis", at.alias("bin")).agg(F.count("*").alias("n"))
        whole = n.groupBy("capture", "axis").agg(F.sum("n").alias("all"))
        p = F.col("n") / F.col("all")
        return n.join(whole, ["capture", "axis"]).groupBy("capture").agg(F.sum(-p * F.log(p)).alias(name))

    both = entropy(points, "before").join(entropy(moved, "after"), "capture")
    return both.withColumn("kept", F.col("after") < F.col("before") - gain)
