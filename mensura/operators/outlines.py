"""Outlines of rooms: the cells that wall lines cut the plan into, those that a room covers, and the polygon around them. One scene is one problem."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import dedupe_sorted, fill_holes, label, segment_rooms

#: Fixed values, in metres and shares: cover of a cell, reach of lines around a room, lines that are one, depth of a hidden strip, snap of a line.
COVER, SEARCH, SLACK, SAME, HIDDEN, SNAP = 0.5, 0.6, 0.2, 0.03, 1.2, 0.035

#: A line is (axis, sign, offset, lo, hi): axis 0 has one x, and faces towards `sign` along the axis.
Line = tuple[int, int, float, float, float]


def _cuts(lo: float, hi: float, a_lo: float, a_hi: float, lines: list[Line], axis: int) -> list[float]:
    near = [off for ax, _, off, b, e in lines if ax == axis and lo - SEARCH <= off <= hi + SEARCH and e >= a_lo - SLACK and b <= a_hi + SLACK]
    return dedupe_sorted([lo, hi, *near], SAME)


def _cover(region: np.ndarray, size: float, xs: list[float], ys: list[float]) -> np.ndarray:
    """Share of each cell between the cuts that the region fills; by sums over rectangles."""
    sums = np.zeros((region.shape[0] + 1, region.shape[1] + 1))
    sums[1:, 1:] = region.cumsum(0).cumsum(1)
    place = lambda v, n: np.clip(np.round(np.array(v) / size).astype(int), 0, n)
    ix, iy = place(xs, region.shape[1]), place(ys, region.shape[0])
    filled = np.diff(np.diff(sums[np.ix_(iy, ix)], axis=0), axis=1)
    return filled / np.maximum(np.outer(np.diff(iy), np.diff(ix)), 1)


def _strips(cells: np.ndarray, xs: list[float], ys: list[float], lines: list[Line]) -> np.ndarray:
    """Adds cells beside the room whose far side is a wall that looks back at it: the floor there was hidden by furniture."""
    def wall(axis, off, sign, lo, hi):
        return any(ax == axis and s == sign and abs(o - off) <= SNAP and min(hi, e) - max(lo, b) >= 0.5 * (hi - lo) for ax, s, o, b, e in lines)

    out = cells.copy()
    for j, i in np.argwhere(~cells):
        x0, x1, y0, y1 = xs[i], xs[i + 1], ys[j], ys[j + 1]
        beside = [
            (i > 0 and cells[j, i - 1], x1 - x0, (0, x1, -1, y0, y1)), (i + 1 < cells.shape[1] and cells[j, i + 1], x1 - x0, (0, x0, 1, y0, y1)),
            (j > 0 and cells[j - 1, i], y1 - y0, (1, y1, -1, x0, x1)), (j + 1 < cells.shape[0] and cells[j + 1, i], y1 - y0, (1, y0, 1, x0, x1))]
        out[j, i] = any(inside and depth <= HIDDEN and wall(*far) for inside, depth, far in beside)
    return out


def around(cells: np.ndarray, xs: list[float], ys: list[float]) -> np.ndarray:
    """The outer boundary of cells, counter-clockwise, without corners on straight sides: sides that two cells share cancel out, the others make loops."""
    sides = set()
    for j, i in np.argwhere(cells):
        ring = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
        for a, b in zip(ring, ring[1:] + ring[:1]):
            if (b, a) in sides:
                sides.discard((b, a))
            else:
                sides.add((a, b))
    best = np.empty((0, 2))
    while sides:
        first = min(sides)
        sides.discard(first)
        path = [*first]
        while path[-1] != path[0]:
            (ax, ay), (bx, by) = path[-2], path[-1]
            # where two corners touch, the sharpest turn to the left stays on this loop's own cells
            onward = max((s for s in sides if s[0] == path[-1]), key=lambda s: (bx - ax) * (s[1][1] - by) - (by - ay) * (s[1][0] - bx))
            sides.discard(onward)
            path.append(onward[1])
        p = np.array([(xs[i], ys[j]) for i, j in path[:-1]])
        before, after = p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p
        p = p[np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 1e-12]
        if _area(p) > _area(best):
            best = p
    return best


def _area(p: np.ndarray) -> float:
    return float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum() / 2) if len(p) else 0.0


def outline(region: np.ndarray, size: float, lines: list[Line]) -> np.ndarray:
    """Corners of a room (rows of x, y), from its cells (row y, column x, the first at 0) and the wall lines; none for an empty region."""
    ys_, xs_ = np.nonzero(region)
    if not len(xs_):
        return np.empty((0, 2))
    x0, x1, y0, y1 = xs_.min() * size, (xs_.max() + 1) * size, ys_.min() * size, (ys_.max() + 1) * size
    xs, ys = _cuts(x0, x1, y0, y1, lines, 0), _cuts(y0, y1, x0, x1, lines, 1)
    cells = _cover(region, size, xs, ys) >= COVER
    parts = label(cells)
    if not parts.max():
        return np.empty((0, 2))
    cells = parts == np.bincount(parts.ravel())[1:].argmax() + 1
    cells = fill_holes(np.pad(_strips(cells, xs, ys, lines), 1))[1:-1, 1:-1]
    return around(cells, xs, ys)


def joined_corners(edges: list[tuple[int, float]], corners: np.ndarray) -> np.ndarray:
    """Corners of an outline whose sides (axis, offset) have moved: each is where the side before meets the one after; parallel ones leave it as it is."""
    out = corners.astype(float).copy()
    for k, ((a, a_off), (b, b_off)) in enumerate(zip([edges[-1], *edges[:-1]], edges)):
        if a != b:
            out[k] = (a_off, b_off) if a == 0 else (b_off, a_off)
    return out


def room_outlines(floor: DataFrame, lines: DataFrame, size: float) -> DataFrame:
    """(scene, room, seq, x, z, area): corners of the rooms of each scene. floor: (scene, ix, iz) cells; lines: (scene, axis, sign, off, lo, hi) in metres."""
    columns = ["scene", "room", "seq", "x", "z", "area"]

    def run(key, cells: pd.DataFrame, walls: pd.DataFrame) -> pd.DataFrame:
        if not len(cells):
            return pd.DataFrame(columns=columns)
        ix0, iz0 = cells["ix"].min() - 1, cells["iz"].min() - 1
        grid = np.zeros((cells["iz"].max() - iz0 + 2, cells["ix"].max() - ix0 + 2), bool)
        grid[cells["iz"] - iz0, cells["ix"] - ix0] = True
        base = (ix0 * size, iz0 * size)
        moved = [(int(w.axis), int(w.sign), w.off - base[w.axis], w.lo - base[1 - w.axis], w.hi - base[1 - w.axis]) for w in walls.itertuples()]
        rooms, rows = segment_rooms(fill_holes(grid, 4), size, least=0.05), []
        for room in range(1, rooms.max() + 1):
            p = outline(rooms == room, size, moved)
            rows += [(*key, room, k, round(x + base[0], 6), round(y + base[1], 6), round(_area(p), 6)) for k, (x, y) in enumerate(p)]
        return pd.DataFrame(rows, columns=columns)

    # an alias of their own for the keys: both tables may come from one
    own = lines.select(F.col("scene").alias("scene"), "axis", "sign", "off", "lo", "hi")
    return floor.select(F.col("scene").alias("scene"), "ix", "iz").groupBy("scene").cogroup(own.groupBy("scene")).applyInPandas(run, "scene int, room int, seq int, x double, z double, area double")
