"""Structured Streaming forms of the order-dependent operators: sharpest frame a window, sessions, keyframes, running voxels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sharpest_frames(frames: DataFrame, window: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Per capture and tumbling window the frame of most sharpness, the least number on ties; frames later than `late` are dropped."""
    best = F.max(F.struct("sharpness", (-F.col("frame")).alias("n")))
    return frames.withWatermark("ts", late).groupBy("capture", F.window("ts", window)).agg(best.alias("b")).select("capture", F.col("window.start").alias("start"), (-F.col("b.n")).alias("frame"), F.col("b.sharpness").alias("sharpness"))


def sessions(frames: DataFrame, gap: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Runs of frames without a pause of `gap`."""
    return frames.withWatermark("ts", late).groupBy("capture", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("capture", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def keyframes(poses: DataFrame, distance: float = 0.04, angle: float = 4.0, seconds: float = 0.6, fastest: float = 90.0) -> DataFrame:
    """Keyframes by the last one kept and the pose before, which are each capture's state; rows of a batch are taken in order of time. Poses that turn
    faster than `fastest` degrees a second are passed over."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, z, heading, t, last_heading, last_t = state.get if state.exists else (None,) * 6
        rows = pd.concat(list(batches)).sort_values(["t", "pose"])
        turned = lambda a, b: abs((a - b + 180) % 360 - 180)
        kept = []
        for r in rows.itertuples():
            slow = last_t is None or turned(r.heading, last_heading) / max(r.t - last_t, 1e-3) <= fastest
            last_heading, last_t = float(r.heading), float(r.t)
            if slow and (t is None or np.hypot(r.x - x, r.z - z) >= distance or turned(r.heading, heading) >= angle or r.t - t >= seconds):
                x, z, heading, t = float(r.x), float(r.z), float(r.heading), float(r.t)
                kept.append((r.capture, r.pose, r.t))
        state.update((x, z, heading, t, last_heading, last_t))
        yield pd.DataFrame(kept, columns=["capture", "pose", "t"])

    held = "x double, z double, heading double, t double, last_heading double, last_t double"
    return poses.groupBy("capture").applyInPandasWithState(run, "capture long, pose long, t double", held, "append", GroupStateTimeout.NoTimeout)


def running_voxels(points: DataFrame, size: float) -> DataFrame:
    """Counts and means of voxels, kept up to date as points arrive."""
    cell = [F.floor(F.round(F.col(c) / size, 9)).alias(f"i{c}") for c in "xyz"]
    return points.groupBy(*cell).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"])
