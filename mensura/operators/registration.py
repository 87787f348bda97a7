"""Photos of one room put together: places and scales from the walls they see, and poses along a spanning tree. One room is one problem."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def solve_structure(photos: list[int], seen: list[tuple[int, int, int, float, float]], heights: dict[int, float] | None = None) -> tuple[dict, np.ndarray, float, bool]:
    """({photo: (x, y, scale)}, offsets of the four walls, rms, whether all is determined).

    seen: (photo, wall, axis, offset, weight); the photo's place along the axis, plus the offset by its scale, is the wall's. The first photo
    stands at the origin with scale 1. Photos that know the room's height have scales that agree on it. A weak wish for scales of 1 and
    walls at 0 keeps the system solvable; the rank without it says whether it was needed.
    """
    others = {p: k for k, p in enumerate(photos[1:])}
    n, top = len(others), max((w for *_, w in seen), default=1.0)
    rows, right, weight = [], [], []

    def equation(terms, value, w):
        row = np.zeros(3 * n + 4)
        for at, factor in terms:
            row[at] += factor
        rows.append(row)
        right.append(value)
        weight.append(w)

    for p, wall, axis, off, w in seen:
        own = [(axis * n + others[p], 1.0), (2 * n + others[p], off)] if p in others else []
        equation([*own, (3 * n + wall, -1.0)], 0.0 if own else -off, w)
    measured = len(rows)
    if heights and photos[0] in heights:
        h0 = heights[photos[0]]
        for p, k in others.items():
            if p in heights:
                equation([(2 * n + k, heights[p])], h0, top * (0.05 / (0.03 * h0)) ** 2)
    a = np.array(rows).reshape(-1, 3 * n + 4)
    used = [k for k in range(3 * n + 4) if k < 3 * n or any(w == k - 3 * n for _, w, *_ in seen)]
    determined = len(rows) > 0 and np.linalg.matrix_rank(a[:, used]) == len(used)
    for k in range(n):
        equation([(2 * n + k, 1.0)], 1.0, top * 1e-6)
    for wall in range(4):
        equation([(3 * n + wall, 1.0)], 0.0, top * 1e-9)
    a, b, w = np.array(rows), np.array(right), np.sqrt(np.array(weight) / top)
    x = np.linalg.lstsq(a * w[:, None], b * w, rcond=None)[0]
    rms = float(np.sqrt(np.mean((a @ x - b)[:measured] ** 2))) if measured else float("inf")
    places = {photos[0]: (0.0, 0.0, 1.0)} | {p: (float(x[k]), float(x[n + k]), float(x[2 * n + k])) for p, k in others.items()}
    return places, x[3 * n :], rms, bool(determined)


def structures(equations: DataFrame) -> DataFrame:
    """(room, photo, x, y, scale, rms, determined) from rows (room, photo, wall, axis, off, weight)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["photo", "wall", "off"])
        places, _, rms, whole = solve_structure(sorted(pdf["photo"].unique().tolist()), list(pdf[["photo", "wall", "axis", "off", "weight"]].itertuples(index=False, name=None)))
        rows = [(pdf["room"].iloc[0], p, *np.round(v, 6), round(rms, 6), whole) for p, v in sorted(places.items())]
        return pd.DataFrame(rows, columns=["room", "photo", "x", "y", "scale", "rms", "determined"])

    kind = equations.schema["room"].dataType.simpleString()
    return equations.select("room", "photo", "wall", "axis", "off", "weight").groupBy("room").applyInPandas(run, f"room {kind}, photo int, x double, y double, scale double, rms double, determined boolean")


def along_tree(nodes: list[int], links: list[tuple[float, int, int, float, float, float, float]]) -> dict[int, tuple[float, float, float, float]]:
    """{node: (x, z, yaw, scale)} of all nodes that links reach from the first one. A link (weight, a, b, x, z, yaw, scale) puts b into a's frame; the
    heaviest one that leads from a placed node to another is taken next, ties by numbers."""
    if not nodes:
        return {}
    done = {nodes[0]: (0.0, 0.0, 0.0, 1.0)}
    while True:
        open_ = [(-w, a, b, k) for k, (w, a, b, *_) in enumerate(links) if (a in done) != (b in done)]
        if not open_:
            return done
        _, a, b, k = min(open_)
        x, z, yaw, scale = links[k][3:]
        if b in done:
            # the link read backwards
            a, b = b, a
            c, s = np.cos(-yaw), np.sin(-yaw)
            x, z, yaw, scale = -(c * x - s * z) / scale, -(s * x + c * z) / scale, -yaw, 1 / scale
        px, pz, py, ps = done[a]
        c, s = np.cos(py), np.sin(py)
        done[b] = (float(px + ps * (c * x - s * z)), float(pz + ps * (s * x + c * z)), float(py + yaw), float(ps * scale))


def spanning_poses(links: DataFrame, key: str) -> DataFrame:
    """(key, node, x, z, yaw, scale) of the nodes that hang together with the least one of each key; links: key, a, b, x, z, yaw, scale, weight."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        nodes = sorted(set(pdf["a"]) | set(pdf["b"]))
        placed = along_tree(nodes, list(pdf[["weight", "a", "b", "x", "z", "yaw", "scale"]].itertuples(index=False, name=None)))
        rows = [(pdf[key].iloc[0], n, *np.round(v, 6)) for n, v in sorted(placed.items())]
        return pd.DataFrame(rows, columns=[key, "node", "x", "z", "yaw", "scale"])

    kind = links.schema[key].dataType.simpleString()
    return links.select(key, "a", "b", "x", "z", "yaw", "scale", "weight").groupBy(key).applyInPandas(run, f"{key} {kind}, node long, x double, z double, yaw double, scale double")
