from itertools import combinations

import numpy as np
import pytest

from dieflow.functions import kernels as K
from dieflow.functions.geometry import hough_table, tables
from dieflow.operators import signatures

SHAPES = [(24, 24), (25, 27), (30, 30), (52, 47), (1, 9), (2, 2)]


def disc(rows, cols):
    t = tables(rows, cols)
    x, y = 2 * t["c"] - (cols - 1), (rows - 1) - 2 * t["r"]
    return (x * x * rows * rows + y * y * cols * cols <= rows * rows * cols * cols).astype(np.uint8).reshape(rows, cols)


def maps(rows, cols, n=5, seed=0):
    rng = np.random.default_rng(seed)
    out = np.repeat(disc(rows, cols)[None], n, axis=0)
    fail = rng.random(out.shape) < np.linspace(0, 0.6, n)[:, None, None]
    return np.where((out != 0) & fail, 2 + rng.integers(0, 4, out.shape), out).astype(np.uint8)


def test_one_die():
    f = K.features(np.ones((1, 1, 1), dtype=np.uint8))
    assert f["dies"][0] == 1 and f["zone_dies"][0, 0] == 1 and f["sector_dies"][0, 0] == 1


def test_full_fail_disc_has_ratios_of_one():
    s = K.signals(disc(30, 30)[None] * 2)
    assert s["center"][0] == s["edge"][0] == s["sector"][0] == 1


@pytest.mark.parametrize("shape", SHAPES)
def test_buckets_partition_dies(shape):
    f = K.features(maps(*shape))
    for name in ("zone", "sector", "ring"):
        assert (f[f"{name}_dies"].sum(axis=1) == f["dies"]).all() and (f[f"{name}_fails"].sum(axis=1) == f["fails"]).all()


def test_quarter_turn_moves_octants_by_two():
    m = maps(24, 24)
    a, b = K.features(m), K.features(np.rot90(m, axes=(1, 2)).copy())
    assert (a["zone_fails"] == b["zone_fails"]).all() and (a["ring_fails"] == b["ring_fails"]).all()
    moved = np.roll(a["sector_fails"], 2, axis=1)
    # Dies on an octant's edge may fall to its neighbour.
    assert np.abs(moved - b["sector_fails"]).max() <= 24 and (moved.sum(axis=1) == b["sector_fails"].sum(axis=1)).all()


def flood(m):
    rows, cols = m.shape
    lab = np.full(m.shape, -1)
    for i in range(rows * cols):
        r, c = divmod(i, cols)
        if m[r, c] < 2 or lab[r, c] >= 0:
            continue
        todo = [(r, c)]
        lab[r, c] = i
        while todo:
            a, b = todo.pop()
            for x in range(max(0, a - 1), min(rows, a + 2)):
                for y in range(max(0, b - 1), min(cols, b + 2)):
                    if m[x, y] >= 2 and lab[x, y] < 0:
                        lab[x, y] = i
                        todo.append((x, y))
    return lab


@pytest.mark.parametrize("shape", SHAPES)
def test_labels_equal_flood_fill(shape):
    m = maps(*shape, n=6, seed=3)
    assert (K.labels(m) == np.stack([flood(x) for x in m])).all()


def test_winding_clusters_and_borders():
    m = np.ones((3, 21, 21), dtype=np.uint8)
    m[0, ::2] = 2  # rows joined at alternate ends: one cluster
    m[0, 1::4, 20] = m[0, 3::4, 0] = 2
    m[1, :, [0, 20]] = 2  # ends of rows and of maps touch nothing beyond
    m[2, :, ::2] = 2  # columns that meet in the last row only
    m[2, 20] = 2
    assert (K.labels(m) == np.stack([flood(x) for x in m])).all()
    c = K.clusters(m)
    assert c["map"].tolist() == [0, 1, 1, 2] and c["first"].tolist() == [0, 0, 20, 0]
    for i, (of, first) in enumerate(zip(c["map"], c["first"])):
        y, x = np.nonzero(flood(m[of]) == first)
        own = {"size": len(y), "sum_r": y.sum(), "sum_c": x.sum(), "sum_rr": (y * y).sum(), "sum_cc": (x * x).sum(), "sum_rc": (x * y).sum(), "min_r": y.min(), "max_r": y.max(), "min_c": x.min(), "max_c": x.max()}
        assert {n: c[n][i] for n in own} == own


@pytest.mark.parametrize("shape", [(0, 5, 5), (2, 1, 1), (3, 4, 4)])
def test_no_clusters(shape):
    c = K.clusters(np.ones(shape, dtype=np.uint8))
    assert all(len(v) == 0 for v in c.values()) and (K.largest(c, shape[0])["clusters"] == 0).all()


def test_cluster_sizes_and_largest():
    m = np.ones((1, 8, 8), dtype=np.uint8)
    m[0, 0, 0] = m[0, 1, 1] = 2
    m[0, 4:6, 3:6] = 3
    c = K.clusters(m)
    assert c["size"].tolist() == [2, 6] and K.largest(c, 1)["first"][0] == 4 * 8 + 3
    s = K.shape(c)
    assert s["elongation"][1] == pytest.approx(1.5) and s["angle_deg"][1] == 0
    assert s["angle_deg"][0] == pytest.approx(135)


def test_hough_row_and_ties():
    m = disc(41, 41)[None].copy()
    m[0, 20, 5:36] = 2
    line = K.hough(m)
    assert (line["votes"][0], line["angle"][0]) == (31, 90)
    assert K.hough(disc(9, 9)[None])["votes"][0] == 0
    cos, sin = hough_table()
    assert cos[0] == sin[90] == 1 << 14 and cos[90] == 0 and cos[60] == 8192


def test_join_counts_by_hand():
    full = np.ones((1, 3, 3), dtype=np.uint8)
    j = K.join_counts(full)
    assert (j["joins"][0], j["join_pairs"][0], j["fail_joins"][0]) == (12, 22, 0)
    full[0, 1, 1] = 0
    j = K.join_counts(full)
    assert (j["dies"][0], j["joins"][0]) == (8, 8)


@pytest.mark.parametrize("grid,fails", [(np.ones((4, 4), np.uint8), 2), (np.ones((4, 4), np.uint8), 4), (disc(5, 5), 3)])
def test_join_z_equals_enumeration(grid, fails):
    dies = np.flatnonzero(grid)
    placed = np.array(list(combinations(range(len(dies)), fails)))
    m = np.repeat(grid.reshape(1, -1), len(placed), axis=0)
    m[np.arange(len(placed))[:, None], dies[placed]] = 2
    j = K.join_counts(m.reshape(-1, *grid.shape))
    bb = j["fail_joins"]
    assert K.join_z(j) == pytest.approx((bb - bb.mean()) / bb.std())


def test_join_z_edges():
    m = disc(9, 9)[None]
    assert K.join_z(K.join_counts(m))[0] == 0 and K.join_z(K.join_counts(m * 2))[0] == 0
    blob = disc(21, 21)[None].copy()
    blob[0, 8:13, 8:13] = 2
    assert K.join_z(K.join_counts(blob))[0] > 10


def test_relational_forms_equal_kernels(spark):
    rows = [(i, r, c, bytearray(m.tobytes())) for i, (r, c) in enumerate(SHAPES) for m in maps(r, c, n=2, seed=i)[1:]]
    w = spark.createDataFrame(rows, "wafer_id int, rows int, cols int, bins binary")
    die = signatures.dies(w)
    want = {r.wafer_id: r for r in signatures.signals(w, detail=True).collect()}
    for r in signatures.join_z(signatures.join_counts(die)).collect():
        k = want[r.wafer_id]
        assert (r.dies, r.fails, r.joins, r.join_pairs, r.fail_joins) == (k.dies, k.fails, k.joins, k.join_pairs, k.fail_joins)
        assert r.z == pytest.approx(k.z)
    assert sorted(signatures.join_counts_of_maps(w).collect()) == sorted(signatures.join_counts(die).collect())
    for r in signatures.hough_peaks(die).collect():
        k = want[r.wafer_id]
        assert (r.angle, r.rho, r.votes, r.line_dies) == (k.angle, k.rho, k.votes, k.line_dies)
    for r in signatures.count_features(die).collect():
        k = want[r.wafer_id]
        assert [r[f"sector_fails_{i}"] for i in range(8)] == k.sector_fails and [r[f"ring_dies_{i}"] for i in range(10)] == k.ring_dies
    assert signatures.signals(w.limit(0)).count() == 0
