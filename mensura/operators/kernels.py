"""Iterative and greedy operators as keyed kernels in numpy: one key's rows are one problem."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost, for rows <= columns; shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        dist, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        j, row, low = -1, i, 0.0
        while True:
            free = ~done
            through = cost[row] - u[row] - v + low
            better = free & (through < dist)
            dist[better], prev[better] = through[better], j
            j = int(np.argmin(np.where(free, dist, np.inf)))
            low = dist[j]
            done[j] = True
            if row_of[j] < 0:
                break
            row = row_of[j]
        used = done & (row_of >= 0)
        u[row_of[used]] += low - dist[used]
        u[i] += low
        v[done] -= low - dist[done]
        while j >= 0:
            k = prev[j]
            row_of[j] = row_of[k] if k >= 0 else i
            j = k
    out = np.full(n, -1)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def assign(costs: DataFrame, key: str, left: str, right: str, cost: str, below: float) -> DataFrame:
    """Optimal one-to-one pairs of each key, kept where their cost is under `below`."""
    kinds = {f.name: f.dataType.simpleString() for f in costs.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index=left, columns=right, values=cost, aggfunc="min").sort_index().sort_index(axis=1).fillna(1e9)
        flip = table.shape[0] > table.shape[1]
        m = table.to_numpy().T if flip else table.to_numpy()
        pairs = [(j, i) if flip else (i, j) for i, j in enumerate(hungarian(m))]
        rows = [(pdf[key].iloc[0], table.index[i], table.columns[j], table.iat[i, j]) for i, j in pairs if table.iat[i, j] < below]
        return pd.DataFrame(rows, columns=[key, left, right, cost])

    return costs.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {left} {kinds[left]}, {right} {kinds[right]}, {cost} double")


def alike(a: str, b: str) -> bool:
    """Doors and open passages stand for each other."""
    return a == b or {a, b} <= {"door", "open_passage"}


def pair_openings(truth: list, found: list, wall_of: dict | None = None) -> list[tuple]:
    """(true opening, found one, cost): true ones in order each take the nearest free one of their wall and kind, unless its width is too far
    off; what is left of either side stands alone. Openings are (id, wall, kind, offset or None, width); wall_of maps true walls to
    found ones, and an opening whose wall isn't in it may be on any. Without a map, walls have the same names."""
    free, out = list(found), []
    for t in truth:
        on = [f for f in free if alike(f[2], t[2]) and (f[1] == t[1] if wall_of is None else t[1] not in wall_of or wall_of[t[1]] == f[1])]
        near = [(abs(f[4] - t[4]) + (0.0 if t[3] is None else 0.5 * abs(f[3] - t[3])), k) for k, f in enumerate(on)]
        best = on[min(near)[1]] if near else None
        if best is None or abs(best[4] - t[4]) > max(0.25, 0.35 * t[4]):
            out.append((t, None, None))
        else:
            free.remove(best)
            out.append((t, best, min(near)[0]))
    return out + [(None, f, None) for f in free]


def match_openings(truth: DataFrame, found: DataFrame) -> DataFrame:
    """pair_openings in each room (room, opening, face, kind, off, width), in order of the openings' numbers."""
    columns = ["opening", "face", "kind", "off", "width"]

    def rows(pdf: pd.DataFrame) -> list:
        return [(o, f, k, None if pd.isna(off) else off, w) for o, f, k, off, w in pdf.sort_values("opening")[columns].itertuples(index=False)]

    def run(key, t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        pairs = [(*key, a and a[0], b and b[0], c) for a, b, c in pair_openings(rows(t), rows(p))]
        return pd.DataFrame(pairs, columns=["room", "truth", "found", "cost"]).astype({"truth": "Int64", "found": "Int64", "cost": "Float64"})

    return truth.select("room", *columns).groupBy("room").cogroup(found.select("room", *columns).groupBy("room")).applyInPandas(run, "room int, truth long, found long, cost double")


def align_walls(truth: list[float], found: list[float], agreement=None) -> list[int]:
    """The found wall of each true one. Outlines of equal length are read around in one of 2n ways: of those whose walls differ by little
    more than the best way's, the one under which most openings agree. Otherwise true walls in order take the nearest free one."""
    n = len(truth)
    if n != len(found):
        free, out = set(range(len(found))), []
        for t in truth:
            if not free:
                break
            out.append(min(free, key=lambda i: (abs(found[i] - t), i)))
            free.discard(out[-1])
        return out
    ways = [[(shift + step * i) % n for i in range(n)] for step, shifts in ((1, range(n)), (-1, range(n - 1, -1, -1))) for shift in shifts]
    off = [sum(abs(found[k] - t) for k, t in zip(way, truth)) for way in ways]
    near = [k for k in range(len(ways)) if off[k] <= min(off) + 0.02 * n]
    return ways[max(near, key=lambda k: (agreement(ways[k]) if agreement else 0, -off[k]))] if n else []


def match_room(truth_walls: list, found_walls: list, truth_openings: list, found_openings: list) -> tuple[list, list]:
    """(pairs of walls, pairs of openings) of a room and the found room that stands for it. Walls are (id, length), in order around the room."""
    def mapped(way):
        return {t[0]: found_walls[k][0] for t, k in zip(truth_walls, way)}

    def agreement(way):
        return sum(a is not None and b is not None for a, b, _ in pair_openings(truth_openings, found_openings, mapped(way)))

    way = align_walls([w[1] for w in truth_walls], [w[1] for w in found_walls], agreement)
    return [(t, found_walls[k]) for t, k in zip(truth_walls, way)], pair_openings(truth_openings, found_openings, mapped(way))


def match_plans(rooms: DataFrame, parts: DataFrame) -> DataFrame:
    """(site, what, t_room, truth, found, t_value, f_value): walls and openings of rooms that are paired, with null where one has no partner.

    rooms: (site, t, p) of the assignment; parts: (site, side, room, what, id, wall, kind, off, value), side being truth or found, what wall or
    opening, value a wall's length or an opening's width. Openings of true rooms without a partner are all missed. A site is one problem.
    """
    columns = ["what", "t_room", "truth", "found", "t_value", "f_value"]

    def run(key, pairs: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        for r in items.sort_values("id").itertuples(index=False):
            row = (r.id, r.value) if r.what == "wall" else (r.id, r.wall, r.kind, None if pd.isna(r.off) else r.off, r.value)
            held.setdefault((r.side, r.room, r.what), []).append(row)
        get = lambda side, room, what: held.get((side, room, what), [])
        out, paired = [], dict(zip(pairs["t"], pairs["p"]))
        for t in sorted({room for side, room, _ in held if side == "truth"}):
            if t not in paired:
                out += [("opening", t, o[0], None, o[4], None) for o in get("truth", t, "opening")]
                continue
            p = paired[t]
            walls, openings = match_room(get("truth", t, "wall"), get("found", p, "wall"), get("truth", t, "opening"), get("found", p, "opening"))
            out += [("wall", t, a[0], b[0], a[1], b[1]) for a, b in walls]
            out += [("opening", t, a and a[0], b and b[0], a and a[4], b and b[4]) for a, b, _ in openings]
        done = pd.DataFrame([(*key, *row) for row in out], columns=["site", *columns])
        return done.astype({"truth": "Int64", "found": "Int64", "t_value": "Float64", "f_value": "Float64"})

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    schema = f"site {kinds['site']}, what string, t_room {kinds['room']}, truth long, found long, t_value double, f_value double"
    return rooms.select("site", "t", "p").groupBy("site").cogroup(parts.groupBy("site")).applyInPandas(run, schema)


def _spread(x: np.ndarray, at: float) -> float:
    return 1.4826 * float(np.median(np.abs(x - at))) + 1e-6


def huber(values: np.ndarray, groups: np.ndarray | None = None, weights: np.ndarray | None = None, c: float = 2.5, rounds: int = 10) -> tuple[float, float, float]:
    """(location, standard error, spread): Huber's estimate with a MAD scale, which stays what it is around the median. Values of a group
    aren't independent: from three groups on the error is that of the group means, but not less than that of all values alone."""
    x = np.asarray(values, float)
    own = np.ones_like(x) if weights is None else np.asarray(weights, float)
    at = float(np.median(x))
    scale = c * _spread(x, at)
    for _ in range(rounds):
        w = own * np.minimum(1.0, scale / np.maximum(np.abs(x - at), 1e-9 * scale))
        last, at = at, float((w * x).sum() / w.sum())
        if abs(at - last) < 1e-7:
            break
    spread = _spread(x, at)
    if groups is None:
        return at, spread / np.sqrt(len(x)), spread
    means = pd.Series(x).groupby(np.asarray(groups)).mean().to_numpy()
    if len(means) < 3:
        return at, spread / np.sqrt(len(means)), spread
    return at, max(_spread(means, float(np.median(means))) / np.sqrt(len(means)), spread / np.sqrt(len(x))), spread


def robust_location(rows: DataFrame, key: str, value: str, group: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, error, spread = huber(pdf[value].to_numpy(), pdf[group].to_numpy())
        return pd.DataFrame([(pdf[key].iloc[0], round(at, 6), round(error, 6), round(spread, 6), len(pdf))], columns=[key, "location", "error", "spread", "n"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, value, group).groupBy(key).applyInPandas(run, f"{key} {kind}, location double, error double, spread double, n long")


def fit_plane(xyz: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
    """(unit normal, offset, rms): the direction of least weighted variance."""
    w = np.ones(len(xyz)) if w is None else w
    centre = (xyz * w[:, None]).sum(0) / w.sum()
    d = xyz - centre
    values, axes = np.linalg.eigh((d * w[:, None]).T @ d / w.sum())
    normal = axes[:, 0] if axes[np.argmax(np.abs(axes[:, 0])), 0] > 0 else -axes[:, 0]
    return normal, float(normal @ centre), float(np.sqrt(max(values[0], 0.0)))


def ransac_plane(xyz: np.ndarray, tolerance: float = 0.02, rounds: int = 200, seed: int = 0, axis=None, angle: float = 20.0):
    """Best plane of random triples (same seed, same plane), refitted to its inliers; None if no triple is allowed."""
    rng = np.random.default_rng(seed)
    best, count = None, 2
    for _ in range(rounds):
        a, b, c = xyz[rng.choice(len(xyz), 3, replace=False)]
        normal = np.cross(b - a, c - a)
        size = np.linalg.norm(normal)
        if size < 1e-9 or (axis is not None and abs(normal @ axis) / size < np.cos(np.radians(angle))):
            continue
        inside = np.abs((xyz - a) @ (normal / size)) <= tolerance
        if inside.sum() > count:
            best, count = inside, int(inside.sum())
    return None if best is None else (*fit_plane(xyz[best]), best)


def planes(points: DataFrame, key: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "z"])
        xyz = pdf[["x", "y", "z"]].to_numpy()
        normal, offset, rms = fit_plane(xyz)
        found = ransac_plane(xyz, 0.2) if len(xyz) > 3 else None
        return pd.DataFrame([(pdf[key].iloc[0], *np.round([*normal, offset, rms], 5), int(found[3].sum()) if found else 0)], columns=[key, "nx", "ny", "nz", "offset", "rms", "inliers"])

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, "x", "y", "z").groupBy(key).applyInPandas(run, f"{key} {kind}, nx double, ny double, nz double, offset double, rms double, inliers long")


def label(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Numbers the connected parts of a mask from 1, in reading order of their first cells; union-find."""
    h, w = mask.shape
    parent = np.arange(h * w)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    shifts = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    for dy, dx in shifts:
        ys, xs = np.nonzero(mask[: h - dy, max(0, -dx) : w - max(0, dx)])
        xs = xs + max(0, -dx)
        both = mask[ys + dy, xs + dx]
        for a, b in zip((ys * w + xs)[both], ((ys + dy) * w + xs + dx)[both]):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    out = np.zeros(h * w, int)
    cells = np.flatnonzero(mask.ravel())
    roots = np.array([find(c) for c in cells], int)
    out[cells] = np.searchsorted(np.unique(roots), roots) + 1 if len(cells) else 0
    return out.reshape(h, w)


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """By a disk."""
    h, w = mask.shape
    padded, out = np.pad(mask, radius), np.zeros_like(mask)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dy * dy + dx * dx <= radius * radius:
                out |= padded[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
    return out


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    return ~dilate(~np.pad(mask, radius), radius)[radius:-radius, radius:-radius] if radius else mask


def opened(mask: np.ndarray, radius: int) -> np.ndarray:
    return dilate(erode(mask, radius), radius)


def closed(mask: np.ndarray, radius: int) -> np.ndarray:
    r = radius
    return erode(dilate(np.pad(mask, r), r), r)[r:-r, r:-r] if r else mask


def fill_holes(mask: np.ndarray, largest: int | None = None) -> np.ndarray:
    """Fills parts of the background that don't touch the border (and have no more than `largest` cells)."""
    parts = label(~mask)
    border = set(np.unique(np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]])))
    size = np.bincount(parts.ravel())
    fill = [k for k in range(1, parts.max() + 1) if k not in border and (largest is None or size[k] <= largest)]
    return mask | np.isin(parts, fill)


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each cell to the nearest background cell, exact: one pass a column, then the least over each row's columns."""
    h, w = mask.shape
    big = float(h + w) ** 2
    g = np.where(mask, np.inf, 0.0)
    for y in range(1, h):
        g[y] = np.minimum(g[y], g[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        g[y] = np.minimum(g[y], g[y + 1] + 1)
    g = np.minimum(g * g, big)
    x = np.arange(w)
    return np.sqrt(np.stack([(g[y][None, :] + (x[:, None] - x[None, :]) ** 2).min(1) for y in range(h)])) if h else g


def watershed(height: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Grows markers over the mask from high to low; a cell goes to the neighbour that reached it first."""
    import heapq

    out, heap, k = np.where(mask, markers, 0), [], 0
    for y, x in np.argwhere(out > 0):
        heapq.heappush(heap, (-height[y, x], k, y, x))
        k += 1
    h, w = mask.shape
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for dy, dx in ((-1, 0), (0, -1), (0, 1), (1, 0)):
            a, b = y + dy, x + dx
            if 0 <= a < h and 0 <= b < w and mask[a, b] and not out[a, b]:
                out[a, b] = out[y, x]
                heapq.heappush(heap, (-height[a, b], k, a, b))
                k += 1
    return out


def interior(free: np.ndarray, floor: np.ndarray, walls: np.ndarray, size: float, rays: float = 2.0, streak: float = 0.08, least: float = 1.0, hole: float = 1.5) -> np.ndarray:
    """Floor of rooms: cells that rays cross or where the floor was seen, away from walls, without thin streaks, small islands and small holes."""
    inside = ((free >= rays) | (floor >= 1)) & ~dilate(walls, 1)
    inside = opened(inside, max(int(round(streak / size)), 1))
    parts = label(inside)
    big = np.bincount(parts.ravel()) >= max(int(least / size**2), 1)
    big[0] = False
    return fill_holes(big[parts], int(hole / size**2))


def h_maxima(height: np.ndarray, h: float) -> np.ndarray:
    """Cells of peaks that rise by `h` over the saddles around them: where the height, lowered by h and grown under itself, stays h below."""
    low, last = np.maximum(height - h, 0.0), None
    while last is None or not np.array_equal(low, last):
        last = low
        padded = np.pad(low, 1)
        grown = np.max([padded[1 + dy : 1 + dy + low.shape[0], 1 + dx : 1 + dx + low.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        low = np.minimum(grown, height)
    return height - low >= h - 1e-9


def _boundaries(rooms: np.ndarray, size: float) -> dict[tuple[int, int], float]:
    """Length of the boundary between each two rooms that touch."""
    a = np.concatenate([rooms[:, :-1].ravel(), rooms[:-1].ravel()])
    b = np.concatenate([rooms[:, 1:].ravel(), rooms[1:].ravel()])
    met = (a != b) & (a > 0) & (b > 0)
    pairs, n = np.unique(np.stack([np.minimum(a, b)[met], np.maximum(a, b)[met]], 1), axis=0, return_counts=True)
    return {tuple(p): k * size for p, k in zip(pairs.tolist(), n.tolist())}


def segment_rooms(interior: np.ndarray, size: float, marker: float = 0.35, least: float = 1.0, depth: float = 0.12, widest: float = 1.6) -> np.ndarray:
    """Rooms of a floor mask: peaks of the distance to walls start rooms, which grow into the rest; rooms that meet along more than a door's width are
    one; small rooms join the neighbour they share most with. Numbered by area, largest first."""
    away = distance_transform(interior) * size
    steps = np.round(away / size)
    starts = label(h_maxima(steps, max(round(depth / size), 1)) & (away >= marker), True)
    rooms = watershed(away, starts if starts.max() else label(interior), interior)
    while wide := [(n, pair) for pair, n in _boundaries(rooms, size).items() if n > widest]:
        _, (a, b) = max(wide)
        rooms[rooms == b] = a
    while True:
        area = np.bincount(rooms.ravel(), minlength=rooms.max() + 1) * size * size
        small = [k for k in range(1, len(area)) if 0 < area[k] < least]
        joined = False
        for k in sorted(small, key=lambda k: (area[k], k)):
            own = rooms == k
            beside = rooms[dilate(own, 1) & ~own]
            beside = beside[beside > 0]
            if len(beside):
                rooms[own] = np.bincount(beside).argmax()
                joined = True
                break
        if not joined:
            break
    area = np.bincount(rooms.ravel())
    order = sorted((k for k in range(1, len(area)) if area[k]), key=lambda k: (-area[k], k))
    rank = np.zeros(len(area), int)
    rank[order] = np.arange(1, len(order) + 1)
    return rank[rooms]


def rooms_of(cells: DataFrame, size: float) -> DataFrame:
    """(scene, ix, iz) of floor cells to (scene, room, cells, area)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ix, iz = pdf["ix"].to_numpy() - pdf["ix"].min() + 1, pdf["iz"].to_numpy() - pdf["iz"].min() + 1
        grid = np.zeros((iz.max() + 2, ix.max() + 2), bool)
        grid[iz, ix] = True
        n = np.bincount(segment_rooms(fill_holes(grid, 4), size, 0.35, 0.05).ravel())
        return pd.DataFrame({"scene": pdf["scene"].iloc[0], "room": np.arange(1, len(n)), "cells": n[1:], "area": np.round(n[1:] * size * size, 6)})

    return cells.select("scene", "ix", "iz").groupBy("scene").applyInPandas(run, "scene int, room int, cells long, area double")


def suppress(boxes: list[tuple[float, float, float]], share: float = 0.5) -> list[int]:
    """Greedy: strongest interval first (lo, hi, strength), dropping those that overlap a kept one by `share` of the shorter."""
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda i: (-boxes[i][2], i)):
        lo, hi, _ = boxes[i]
        if all(min(hi, boxes[j][1]) - max(lo, boxes[j][0]) < share * min(hi - lo, boxes[j][1] - boxes[j][0]) for j in kept):
            kept.append(i)
    return sorted(kept)


def suppressed(rows: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pdf.iloc[suppress(list(zip(pdf["lo"], pdf["hi"], pdf["strength"])), share)]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = [key, "id", "lo", "hi", "strength"]
    return rows.select(*columns).groupBy(key).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def cluster_offsets(offsets: np.ndarray, weights: np.ndarray, gap: float) -> np.ndarray:
    """Clusters values in order: one joins while it is within `gap` of the running weighted mean."""
    order = np.argsort(offsets, kind="stable")
    out, k, mean, total = np.zeros(len(offsets), int), -1, np.inf, 0.0
    for i in order:
        if k < 0 or offsets[i] - mean > gap:
            k, mean, total = k + 1, offsets[i], weights[i]
        else:
            total += weights[i]
            mean += (offsets[i] - mean) * weights[i] / total
        out[i] = k
    return out


def dedupe_sorted(values: list[float], tolerance: float) -> list[float]:
    """Values in order, without those within the tolerance of the last one kept."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > tolerance:
            out.append(v)
    return out


def wall_clusters(rows: DataFrame, key: str, gap: float) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["off", "id"])
        return pdf[[key, "id"]].assign(cluster=cluster_offsets(pdf["off"].to_numpy(), pdf["weight"].to_numpy(), gap))

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "id", "off", "weight").groupBy(key).applyInPandas(run, f"{key} {kind}, id long, cluster int")


def simplify_outline(points: np.ndarray, shortest: float) -> np.ndarray:
    """Drops jogs of a rectilinear outline: while a side is shorter than `shortest`, its two neighbours become one line at the longer one's offset."""
    p = [tuple(v) for v in points]
    while len(p) > 4:
        n = len(p)
        length = [np.hypot(p[(i + 1) % n][0] - p[i][0], p[(i + 1) % n][1] - p[i][1]) for i in range(n)]
        i = int(np.argmin(length))
        if length[i] >= shortest:
            break
        before, after = length[i - 1], length[(i + 1) % n]
        axis = 0 if abs(p[i][0] - p[(i + 1) % n][0]) > abs(p[i][1] - p[(i + 1) % n][1]) else 1
        level = p[i][axis] if before >= after else p[(i + 1) % n][axis]
        for k in ((i - 1) % n, i, (i + 1) % n, (i + 2) % n):
            if (k in ((i - 1) % n, i)) == (before < after):
                q = list(p[k])
                q[axis] = level
                p[k] = tuple(q)
        p = [v for j, v in enumerate(p) if j not in (i, (i + 1) % n)]
    return np.array(p)


def area_of(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex one (counter-clockwise both), side by side."""
    out = [tuple(p) for p in subject]
    for a, b in zip(window, np.roll(window, -1, axis=0)):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023,E731
        held, out = out, []
        for p, q in zip(held, held[1:] + held[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def monte_carlo_area(width: float, height: float, sigma: float, samples: int = 400, seed: int = 0) -> tuple[float, float]:
    """Spread of area and perimeter of a rectangle whose four sides move independently."""
    rng = np.random.default_rng(seed)
    s = rng.normal(0, sigma, (samples, 4))
    w, h = width + s[:, 0] + s[:, 1], height + s[:, 2] + s[:, 3]
    return float(np.std(w * h)), float(np.std(2 * (w + h)))


def area_spread(rooms: DataFrame, sigma: float) -> DataFrame:
    """Spread of the area and perimeter of each room (room, length, width)."""
    def run(batches):
        for pdf in batches:
            spread = [monte_carlo_area(w, h, sigma, seed=int(k)) for k, w, h in zip(pdf["room"], pdf["length"], pdf["width"])]
            yield pd.DataFrame({"room": pdf["room"], "area_sd": np.round([a for a, _ in spread], 6), "perimeter_sd": np.round([p for _, p in spread], 6)})

    return rooms.select("room", "length", "width").mapInPandas(run, "room int, area_sd double, perimeter_sd double")


def icp(source: np.ndarray, target: np.ndarray, normals: np.ndarray, reach: float = 0.5, rounds: int = 30) -> tuple[float, np.ndarray, float, float]:
    """(yaw, shift, share of points matched, rms): point to plane, turning about the vertical only, with Huber weights and a shrinking reach."""
    yaw, shift = 0.0, np.zeros(3)
    r, used = np.zeros(1), np.zeros(0, int)
    for k in range(rounds):
        c, s = np.cos(yaw), np.sin(yaw)
        moved = source @ np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]]) + shift
        limit = max(reach * 0.85**k, 0.05)
        gap = ((moved[:, None, :] - target[None, :, :]) ** 2).sum(2)
        near = gap.argmin(1)
        used = np.flatnonzero(gap[np.arange(len(moved)), near] <= limit * limit)
        if len(used) < 4:
            break
        n, d = normals[near[used]], moved[used] - target[near[used]]
        r = (d * n).sum(1)
        m = moved[used] - shift
        turn = n[:, 0] * m[:, 2] - n[:, 2] * m[:, 0]
        jacobian = np.column_stack([turn, n])
        scale = max(1.4826 * np.median(np.abs(r)), 1e-6)
        w = np.minimum(1.0, 1.345 * scale / np.maximum(np.abs(r), 1e-12))
        step = np.linalg.lstsq(jacobian.T @ (jacobian * w[:, None]) + 1e-9 * np.eye(4), -jacobian.T @ (w * r), rcond=None)[0]
        yaw, shift = yaw + step[0], shift + step[1:]
        if np.abs(step).max() < 1e-7:
            break
    return float(yaw), shift, len(used) / len(source), float(np.sqrt((r * r).mean()))


def _tridiagonal(diagonal: np.ndarray, upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves a symmetric block-tridiagonal system: blocks of the diagonal, blocks above it, right side by block."""
    n = len(diagonal)
    d, r = diagonal.copy(), right.copy()
    for k in range(1, n):
        f = np.linalg.solve(d[k - 1], upper[k - 1]).T
        d[k] -= f @ upper[k - 1]
        r[k] -= f @ r[k - 1]
    out = np.empty_like(r)
    for k in range(n - 1, -1, -1):
        out[k] = np.linalg.solve(d[k], r[k] - upper[k] @ out[k + 1] if k + 1 < n else r[k])
    return out


def pose_graph(n: int, edges: list[tuple[int, int, float, float, float, float]], rounds: int = 12, cauchy: float = 4.0) -> np.ndarray:
    """Positions (x, z, yaw) of n poses from relative ones (i, j, dx, dz, dyaw, sigma), the first fixed; Gauss-Newton with Cauchy weights.

    If edges join neighbours or start at the first pose, a round takes time in proportion to n; otherwise it's a dense solve.
    """
    p = np.zeros((n, 3))
    for i, j, dx, dz, da, _ in edges:
        if j == i + 1:
            c, s = np.cos(p[i, 2]), np.sin(p[i, 2])
            p[j] = p[i] + [c * dx - s * dz, s * dx + c * dz, da]
    linear = all(j == i + 1 or i == 0 for i, j, *_ in edges)
    for _ in range(rounds):
        diagonal, upper, g = np.zeros((n, 3, 3)), np.zeros((n, 3, 3)), np.zeros((n, 3))
        h = None if linear else np.zeros((3 * n, 3 * n))
        for i, j, dx, dz, da, sigma in edges:
            c, s = np.cos(p[i, 2]), np.sin(p[i, 2])
            d = p[j, :2] - p[i, :2]
            local = np.array([c * d[0] + s * d[1], -s * d[0] + c * d[1]])
            e = np.array([local[0] - dx, local[1] - dz, (p[j, 2] - p[i, 2] - da + np.pi) % (2 * np.pi) - np.pi]) / sigma
            ji = np.array([[-c, -s, local[1]], [s, -c, -local[0]], [0, 0, -1]]) / sigma
            jj = np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]]) / sigma
            w = 1.0 if j == i + 1 else 1 / (1 + (e @ e) / cauchy**2)
            diagonal[i] += w * ji.T @ ji
            diagonal[j] += w * jj.T @ jj
            g[i] += w * ji.T @ e
            g[j] += w * jj.T @ e
            if not linear:
                a, b = slice(3 * i, 3 * i + 3), slice(3 * j, 3 * j + 3)
                h[a, b] += w * ji.T @ jj
                h[b, a] += w * jj.T @ ji
            elif j == i + 1:
                upper[i] += w * ji.T @ jj
        step = np.zeros((n, 3))
        if linear:
            step[1:] = _tridiagonal(diagonal[1:] + 1e-9 * np.eye(3), upper[1:], -g[1:])
        else:
            for k in range(n):
                h[3 * k : 3 * k + 3, 3 * k : 3 * k + 3] += diagonal[k]
            step[1:] = np.linalg.solve(h[3:, 3:] + 1e-9 * np.eye(3 * n - 3), -g[1:].ravel()).reshape(n - 1, 3)
        p += step
        if np.abs(step).max() < 1e-9:
            break
    return p


def corrected_paths(poses: DataFrame) -> DataFrame:
    """Pose graph of each capture: all its poses, from steps and one loop that closes from the last pose to the first."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "pose"]).reset_index(drop=True)
        xz = pdf[["x", "z"]].to_numpy()
        n = len(pdf)
        steps = [(i, i + 1, *(xz[i + 1] - xz[i]), 0.0, 0.05) for i in range(n - 1)]
        loop = [(0, n - 1, *(xz[n - 1] - xz[0] + 0.02), 0.0, 0.05)] if n > 3 else []
        p = pose_graph(n, steps + loop) if n > 1 else np.zeros((1, 3))
        moved = p[:, :2] + xz[0] - xz
        return pd.DataFrame({"capture": pdf["capture"], "pose": pdf["pose"], "dx": np.round(moved[:, 0], 6), "dz": np.round(moved[:, 1], 6)})

    return poses.select("capture", "pose", "t", "x", "z").groupBy("capture").applyInPandas(run, "capture long, pose long, dx double, dz double")


def cover(views: dict[int, set[int]], times: int = 3) -> list[int]:
    """Views that see every part `times` times, taking the one that helps most, the least number on ties."""
    need: dict[int, int] = {}
    for parts in views.values():
        for p in parts:
            need[p] = min(times, need.get(p, 0) + 1)
    left, out = dict(views), []
    while left:
        gain, k = max((sum(need[p] > 0 for p in parts), -k) for k, parts in left.items())
        if not gain:
            break
        for p in left.pop(-k):
            need[p] = max(0, need[p] - 1)
        out.append(-k)
    return out


def covering_views(seen: DataFrame, key: str, times: int = 3) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        views = {int(v): set(g["part"]) for v, g in pdf.groupby("view")}
        picked = cover(views, times)
        return pd.DataFrame({key: pdf[key].iloc[0], "view": picked, "place": np.arange(1, len(picked) + 1)})

    kind = seen.schema[key].dataType.simpleString()
    return seen.select(key, "view", "part").groupBy(key).applyInPandas(run, f"{key} {kind}, view long, place int")


def stitch_doors(rooms: dict[int, np.ndarray], pairs: list[tuple[float, int, int, tuple, tuple]]) -> dict[int, tuple[int, float, float]]:
    """Places rooms by doors, best pair first: a room whose partner is placed turns by quarters until the doors face
    each other and moves until they meet. pairs: (score, room a, room b, door a, door b), a door being (x, y, nx, ny)."""
    turn = lambda k, x, y: ((x, y), (-y, x), (-x, -y), (y, -x))[k % 4]
    if not rooms:
        return {}
    placed = {min(rooms): (0, 0.0, 0.0)}
    while True:
        options = [(s, a, b, da, db) for s, a, b, da, db in pairs if (a in placed) != (b in placed)]
        if not options:
            return placed
        s, a, b, da, db = min(options)
        if b in placed:
            a, b, da, db = b, a, db, da
        k, tx, ty = placed[a]
        nx, ny = turn(k, da[2], da[3])
        px, py = turn(k, da[0], da[1])
        for q in range(4):
            mx, my = turn(q, db[2], db[3])
            if nx * mx + ny * my < -0.95:
                x, y = turn(q, db[0], db[1])
                placed[b] = (q, px + tx - x, py + ty - y)
                break
        pairs = [p for p in pairs if p != (s, a, b, da, db) and p != (s, b, a, db, da)]
