"""Kernels against exhaustive search, closed forms and properties."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mensura.operators import kernels as K
from mensura.operators import windows
from mensura.plans import catalogue
from mensura.plans.adapters import poses


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 2), st.integers(0, 10_000))
def test_hungarian_is_optimal(n, more, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (n, n + more)).astype(float)
    got = K.hungarian(cost)
    assert len(set(got)) == n and (got >= 0).all()
    best = min(sum(cost[i, p] for i, p in enumerate(perm)) for perm in itertools.permutations(range(n + more), n))
    assert cost[np.arange(n), got].sum() == best


def test_huber_resists_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(2.5, 0.01, 500), np.full(60, 9.0)])
    at, error, spread = K.huber(x)
    assert at == pytest.approx(2.5, abs=0.01) and error < 0.01 and spread == pytest.approx(0.012, abs=0.006)


def test_planes():
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 4, (300, 2))
    p = np.column_stack([xy, 1.5 + rng.normal(0, 0.002, 300)])
    normal, offset, rms = K.fit_plane(p)
    assert normal == pytest.approx([0, 0, 1], abs=1e-2) and offset == pytest.approx(1.5, abs=0.01) and rms < 0.004
    mixed = np.vstack([p, rng.uniform(0, 4, (150, 3))])
    assert K.ransac_plane(mixed)[1] == pytest.approx(1.5, abs=0.02)


def flood(mask, diagonal):
    out, n = np.zeros(mask.shape, int), 0
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for y, x in np.argwhere(mask):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        out[y, x] = n
        while todo:
            a, b = todo.pop()
            for dy, dx in near:
                c, d = a + dy, b + dx
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not out[c, d]:
                    out[c, d] = n
                    todo.append((c, d))
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.booleans())
def test_label_is_flood_fill(seed, diagonal):
    mask = np.random.default_rng(seed).random((7, 9)) < 0.5
    assert np.array_equal(K.label(mask, diagonal), flood(mask, diagonal))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_distance_transform(seed):
    mask = np.random.default_rng(seed).random((6, 8)) < 0.7
    mask[0, 0] = False
    zeros = np.argwhere(~mask)
    want = np.array([[min(np.hypot(y - a, x - b) for a, b in zeros) for x in range(8)] for y in range(6)])
    assert K.distance_transform(mask) == pytest.approx(want)


def test_morphology():
    m = np.zeros((11, 11), bool)
    m[3:8, 3:8] = True
    m[5, 5] = False
    assert K.fill_holes(m).sum() == 25 and not K.fill_holes(m, 0)[5, 5]
    assert K.closed(m, 1)[5, 5] and (K.erode(K.dilate(m, 1), 1) >= m).all()
    assert K.opened(K.fill_holes(m), 1).sum() >= 21


def test_rooms_of_a_flat():
    g = np.zeros((60, 100), bool)
    g[2:58, 2:48] = True
    g[2:40, 52:98] = True
    g[25:32, 46:54] = True
    rooms = K.segment_rooms(g, 0.05)
    assert set(np.unique(rooms)) == {0, 1, 2}
    assert rooms[30, 20] == 1 and rooms[20, 80] == 2 and (rooms[g] > 0).all()


def test_suppress_cluster_dedupe():
    assert K.suppress([(0, 1, 5), (0.2, 1.1, 9), (2, 3, 1), (2.9, 4, 0.5)]) == [1, 2, 3]
    assert list(K.cluster_offsets(np.array([0, 0.03, 1.0, 0.06, 1.02]), np.ones(5), 0.04)) == [0, 0, 1, 1, 2] or list(K.cluster_offsets(np.array([0, 0.03, 1.0, 0.06, 1.02]), np.ones(5), 0.05)) == [0, 0, 1, 0, 1]
    assert K.dedupe_sorted([0.3, 0, 0.05, 0.1, 0.31], 0.08) == [0, 0.1, 0.3]


def test_outline():
    p = np.array([(0, 0), (4, 0), (4, 1), (4.05, 1), (4.05, 3), (0, 3)], float)
    q = K.simplify_outline(p, 0.1)
    assert len(q) == 4 and K.area_of(q) == pytest.approx(12.1, abs=0.15)
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert K.area_of(K.clip(square + 1, square)) == pytest.approx(1.0) and len(K.clip(square + 5, square)) == 0


def test_monte_carlo():
    a, p = K.monte_carlo_area(4, 3, 0.01, 20_000)
    assert a == pytest.approx(0.01 * np.sqrt(2 * 9 + 2 * 16), rel=0.05) and p == pytest.approx(0.04, rel=0.05)
    assert K.monte_carlo_area(4, 3, 0.01) == K.monte_carlo_area(4, 3, 0.01)


def test_icp_recovers_a_small_motion():
    rng = np.random.default_rng(2)
    faces = [np.column_stack([rng.uniform(0, 4, 200), rng.uniform(0, 2.5, 200), np.zeros(200)]), np.column_stack([np.zeros(200), rng.uniform(0, 2.5, 200), rng.uniform(0, 3, 200)]), np.column_stack([rng.uniform(0, 4, 200), np.zeros(200), rng.uniform(0, 3, 200)])]
    normals = np.repeat(np.array([[0, 0, 1], [1, 0, 0], [0, 1, 0]], float), 200, 0)
    target = np.vstack(faces)
    yaw, shift = 0.03, np.array([0.05, -0.02, 0.04])
    c, s = np.cos(yaw), np.sin(yaw)
    source = (target - shift) @ np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]]).T
    got, moved, share, rms = K.icp(source, target, normals)
    assert got == pytest.approx(yaw, abs=3e-3) and moved == pytest.approx(shift, abs=1e-2) and share > 0.95 and rms < 0.01


def test_pose_graph_closes_a_loop():
    true = np.array([[0, 0, 0], [1, 0, np.pi / 2], [1, 1, np.pi], [0, 1, -np.pi / 2], [0, 0, 0]])
    rng = np.random.default_rng(3)

    def relative(i, j, noise=0.0):
        c, s = np.cos(true[i, 2]), np.sin(true[i, 2])
        d = true[j, :2] - true[i, :2]
        return (i, j, c * d[0] + s * d[1] + rng.normal(0, noise), -s * d[0] + c * d[1] + rng.normal(0, noise), (true[j, 2] - true[i, 2] + np.pi) % (2 * np.pi) - np.pi + rng.normal(0, noise), 0.05)

    steps = [relative(i, i + 1, 0.03) for i in range(4)]
    open_, closed = K.pose_graph(5, steps), K.pose_graph(5, [*steps, (*relative(0, 4)[:5], 0.005)])
    assert np.hypot(*closed[4, :2]) < np.hypot(*open_[4, :2]) and np.hypot(*closed[4, :2]) < 0.01


def dense_path(xz):
    """All poses of a capture, residuals by one matrix of numeric derivatives."""
    n = len(xz)
    pairs = [(i, i + 1) for i in range(n - 1)] + ([(0, n - 1)] if n > 3 else [])
    want = np.array([xz[j] - xz[i] + (0.02 if j != i + 1 else 0.0) for i, j in pairs])
    i, j = np.array(pairs).T

    def residuals(q):
        p = np.vstack([np.zeros(3), q.reshape(-1, 3)])
        c, s = np.cos(p[i, 2]), np.sin(p[i, 2])
        d = p[j, :2] - p[i, :2]
        return np.column_stack([c * d[:, 0] + s * d[:, 1] - want[:, 0], -s * d[:, 0] + c * d[:, 1] - want[:, 1], p[j, 2] - p[i, 2]]) / 0.05

    q = np.column_stack([xz[1:] - xz[0], np.zeros(n - 1)]).ravel()
    for _ in range(12):
        e = residuals(q)
        w = np.where(j == i + 1, 1.0, 1 / (1 + (e * e).sum(1) / 16))
        jac = np.column_stack([(residuals(q + h) - residuals(q - h)).ravel() / 2e-6 for h in 1e-6 * np.eye(len(q))])
        ws = np.repeat(w, 3)
        q = q - np.linalg.solve(jac.T @ (jac * ws[:, None]) + 1e-9 * np.eye(len(q)), jac.T @ (ws * e.ravel()))
    return np.vstack([np.zeros(2), q.reshape(-1, 3)[:, :2]]) + xz[0] - xz


def test_pose_graph_query_solves_whole_captures(spark, sf):
    got = {(r.capture, r.pose): (r.dx, r.dz) for r in catalogue.QUERIES["pose_graph"](spark, sf).collect()}
    paths = poses(spark, sf).select("capture", "pose", "t", "x", "z").toPandas().sort_values(["t", "pose"])
    assert len(got) == len(paths)
    sizes = paths.groupby("capture").size().sort_values()
    assert sizes.iloc[-1] > 40
    for capture in [*sizes.index[:2], *sizes.index[-3:]]:
        own = paths[paths["capture"] == capture]
        assert np.array([got[capture, k] for k in own["pose"]]) == pytest.approx(dense_path(own[["x", "z"]].to_numpy()), abs=5e-6)


def test_pose_graph_linear_is_the_dense_solve():
    rng = np.random.default_rng(5)
    steps = [(i, i + 1, *rng.normal(0, 1, 2), rng.normal(0, 0.1), 0.05) for i in range(60)]
    loop = (0, 60, 0.1, -0.2, 0.3, 0.05)
    same = K.pose_graph(61, [*steps, loop, (3, 9, 0.0, 0.0, 0.0, 1e9)])
    assert K.pose_graph(61, [*steps, loop]) == pytest.approx(same, abs=1e-6)


def test_cover_and_stitch():
    views = {1: {1, 2, 3}, 2: {3, 4}, 3: {1, 2}, 4: {4}}
    picked = K.cover(views, 1)
    assert picked == [1, 2]
    room = np.array([(0, 0), (3, 0), (3, 3), (0, 3)], float)
    placed = K.stitch_doors({1: room, 2: room}, [(0.1, 1, 2, (3, 1.5, 1, 0), (1.5, 0, 0, -1))])
    k, tx, ty = placed[2]
    x, y = [(1.5, 0), (0, 1.5), (-1.5, 0), (0, -1.5)][k]
    assert (x + tx, y + ty) == pytest.approx((3, 1.5))


def test_submaps_at_the_distance(spark):
    """Offsets of 0.8 and 0.6 that are a bit more as doubles: the distance, rounded at each step, isn't over 1."""
    rows = [(1, 0, 0.0, 41 / 50, 0.0, 0.0), (1, 1, 1.0, 81 / 50, 24 / 40, 0.0), (1, 2, 2.0, 82 / 50, 24 / 40, 0.0), (2, 0, 0.0, 81 / 50, 24 / 40, 0.0), (2, 1, 1.0, 41 / 50, 0.0, 0.0)]
    got = windows.submaps(spark.createDataFrame(rows, "capture long, pose long, t double, x double, z double, heading double")).collect()
    assert sorted((r.capture, r.pose, r.submap) for r in got) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (2, 0, 0), (2, 1, 0)]
