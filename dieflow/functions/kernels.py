"""Spatial signatures of many maps of one shape at once, in NumPy.

Counts are integers and equal the relational forms exactly.  A batch is an
array of shape (maps, rows, cols) of bins: 0 off the wafer, 1 pass, 2 and over
a failing bin.
"""

from __future__ import annotations

import numpy as np

from dieflow.functions.geometry import ANGLES, RINGS, SECTORS, ZONES, tables

DIE = 1.0 / 12.0


def features(bins: np.ndarray) -> dict[str, np.ndarray]:
    """Dies and fails of each map, by zone, sector and ring."""
    m, rows, cols = bins.shape
    flat, t = bins.reshape(m, -1), tables(rows, cols)
    hot = np.zeros((rows * cols, ZONES + SECTORS + RINGS), dtype=np.float32)
    die = np.arange(rows * cols)
    hot[die, t["zone"]] = hot[die, ZONES + t["sector"]] = hot[die, ZONES + SECTORS + t["ring"]] = 1
    out = {}
    for name, mask in (("dies", flat != 0), ("fails", flat >= 2)):
        # A count is at most the grid's size, far below what a float32 holds exactly.
        by = (mask.astype(np.float32) @ hot).astype(np.int64)
        out |= {name: mask.sum(axis=1), f"zone_{name}": by[:, :ZONES], f"sector_{name}": by[:, ZONES:-RINGS], f"ring_{name}": by[:, -RINGS:]}
    return out


def join_counts(bins: np.ndarray) -> dict[str, np.ndarray]:
    """Neighbour joins: N dies, F fails, J joins, K pairs of joins that share a die, BB joins of two fails."""
    on, bad = bins != 0, bins >= 2
    degree = np.zeros(bins.shape, dtype=np.int64)
    joins = np.zeros(len(bins), dtype=np.int64)
    both = np.zeros(len(bins), dtype=np.int64)
    for here, there in ((np.s_[:, :-1, :], np.s_[:, 1:, :]), (np.s_[:, :, :-1], np.s_[:, :, 1:])):
        pair = on[here] & on[there]
        degree[here] += pair
        degree[there] += pair
        joins += pair.sum(axis=(1, 2))
        both += (bad[here] & bad[there]).sum(axis=(1, 2))
    return {"dies": on.sum(axis=(1, 2)), "fails": bad.sum(axis=(1, 2)), "joins": joins, "join_pairs": (degree * (degree - 1) // 2).sum(axis=(1, 2)), "fail_joins": both}


def join_z(j: dict[str, np.ndarray]) -> np.ndarray:
    """Standardised fail joins under random placement; 0 where fewer than two dies fail or nothing can vary."""
    n, f, jn, k = (j[x].astype(float) for x in ("dies", "fails", "joins", "join_pairs"))

    def drawn(count: int) -> np.ndarray:
        p = np.ones_like(n)
        for i in range(count):
            p = np.where(n - i <= 0, 0.0, p * (f - i) / np.where(n - i <= 0, 1.0, n - i))
        return np.where(p < 0, 0.0, p)

    p2, p3, p4 = drawn(2), drawn(3), drawn(4)
    mean = jn * p2
    var = jn * p2 + 2.0 * k * p3 + (jn * (jn - 1.0) - 2.0 * k) * p4 - mean * mean
    ok = (f >= 2) & (var > 1e-9)
    return np.where(ok, (j["fail_joins"] - mean) / np.sqrt(np.where(ok, var, 1.0)), 0.0)


def hough(bins: np.ndarray) -> dict[str, np.ndarray]:
    """The line with most fails: angle, rho, votes and on-wafer dies; ties go to the lower angle, then rho."""
    m, rows, cols = bins.shape
    t = tables(rows, cols)
    offset = int(t["offset"])
    width = 2 * offset + 1
    out = {k: np.zeros(m, dtype=np.int64) for k in ("angle", "rho", "votes", "line_dies")}
    flat = bins.reshape(m, -1)
    for i in range(m):
        fails = np.flatnonzero(flat[i] >= 2)
        if not len(fails):
            continue
        votes = np.bincount(t["votes"][fails].ravel(), minlength=ANGLES * width)
        best = int(votes.argmax())
        angle, rho = divmod(best, width)
        out["angle"][i], out["rho"][i], out["votes"][i] = angle, rho - offset, votes[best]
        out["line_dies"][i] = ((t["rho"][angle] == rho) & (flat[i] != 0)).sum()
    return out


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least vertex of each of n vertices' components, for edges (a, b)."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
        # Edges are lifted to the roots they now join; those within one are done.
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def _runs(bins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of failing dies within rows, in the order of maps and dies: map, row, first column, length, and the first run of the 8-connected cluster."""
    m, rows, cols = bins.shape
    width = cols + 1
    # A row before each map and a column after each row stay empty, so that neither runs nor neighbours cross.
    on = np.zeros((m, rows + 1, width), dtype=bool)
    on[:, 1:, :cols] = bins >= 2
    on = on.ravel()
    ends = np.flatnonzero(on[1:] != on[:-1]) + 1
    start, end = ends[::2], ends[1::2]
    # The runs that touch one from the row above follow one another.
    low = np.searchsorted(end, start - width - 1, side="right")
    touching = np.searchsorted(start, end - width, side="right") - low
    below = np.repeat(np.arange(len(start)), touching)
    above = np.arange(len(below)) + np.repeat(low - (np.cumsum(touching) - touching), touching)
    line, column = np.divmod(start, width)
    of, row = np.divmod(line, rows + 1)
    return of, row - 1, column, end - start, _roots(below, above, len(start))


def labels(bins: np.ndarray) -> np.ndarray:
    """The first die (row-major index) of each failing die's 8-connected cluster; -1 elsewhere."""
    _, row, column, length, root = _runs(bins)
    out = np.full(bins.shape, -1, dtype=np.int64)
    out[bins >= 2] = np.repeat((row * bins.shape[2] + column)[root], length)
    return out


def clusters(bins: np.ndarray) -> dict[str, np.ndarray]:
    """One row a cluster, in the order of maps and first dies: map, first, size, moments and bounding box."""
    _, rows, cols = bins.shape
    of, r, c, length, root = _runs(bins)
    own = root == np.arange(len(root))
    inverse, n = (np.cumsum(own) - 1)[root], int(own.sum())
    last = c + length - 1
    sum_c = length * (c + last) // 2
    sum_cc = (last * (last + 1) * (2 * last + 1) - (c - 1) * c * (2 * c - 1)) // 6
    out = {"map": of[own], "first": (r * cols + c)[own]}
    for name, x in (("size", length), ("sum_r", r * length), ("sum_c", sum_c), ("sum_rr", r * r * length), ("sum_cc", sum_cc), ("sum_rc", r * sum_c)):
        out[name] = np.bincount(inverse, x, minlength=n).astype(np.int64)
    for name, x, take, start in (("min_r", r, np.minimum, rows), ("max_r", r, np.maximum, -1), ("min_c", c, np.minimum, cols), ("max_c", last, np.maximum, -1)):
        out[name] = np.full(n, start)
        take.at(out[name], inverse, x)
    return out


def shape(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Centroid, principal variances, elongation and angle of clusters; a die is a unit square."""
    n = np.maximum(c["size"], 1).astype(float)
    row, col = c["sum_r"] / n, c["sum_c"] / n
    vrr, vcc, vrc = c["sum_rr"] / n - row * row + DIE, c["sum_cc"] / n - col * col + DIE, c["sum_rc"] / n - row * col
    mean, gap = 0.5 * (vrr + vcc), np.sqrt(0.25 * (vcc - vrr) * (vcc - vrr) + vrc * vrc)
    major, minor = mean + gap, np.maximum(mean - gap, DIE)
    angle = 0.5 * np.arctan2(-2.0 * vrc, vcc - vrr) * 180.0 / np.pi
    angle = np.where(angle < 0, angle + 180.0, angle)
    return {"row": row, "col": col, "major_var": major, "minor_var": minor, "elongation": np.sqrt(major / minor), "angle_deg": np.where(angle >= 180.0, 0.0, angle)}


def largest(c: dict[str, np.ndarray], maps: int) -> dict[str, np.ndarray]:
    """Number of clusters and the columns of the largest (the first of equals) of each map; zeros where there is none."""
    count = np.bincount(c["map"], minlength=maps)
    order = np.lexsort((c["first"], -c["size"], c["map"]))
    maps_of, at = np.unique(c["map"][order], return_index=True)
    out = {"clusters": count}
    for k, v in c.items():
        if k != "map":
            out[k] = np.zeros(maps, dtype=v.dtype)
            out[k][maps_of] = v[order[at]]
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b == 0, 0.0, a / np.where(b == 0, 1, b))


def signals(bins: np.ndarray) -> dict[str, np.ndarray]:
    """The 13 signals and the integers below them, of every map."""
    m, rows, cols = bins.shape
    f, j = features(bins), join_counts(bins)
    line, big = hough(bins), largest(clusters(bins), m)
    s = shape(big)
    density = _ratio(f["fails"], f["dies"])
    some = f["fails"] > 0

    def over(x: np.ndarray) -> np.ndarray:
        return np.where(some, x / np.where(some, density, 1.0), 0.0)

    zone = _ratio(f["zone_fails"], f["zone_dies"])
    ring = _ratio(f["ring_fails"], f["ring_dies"])
    inner = _ratio(f["ring_fails"][:, :2].sum(axis=1), f["ring_dies"][:, :2].sum(axis=1))
    x, y = (2 * s["col"] - (cols - 1)) / cols, ((rows - 1) - 2 * s["row"]) / rows
    return f | {"joins": j["joins"], "join_pairs": j["join_pairs"], "fail_joins": j["fail_joins"]} | line | big | {
        "density": density,
        "center": over(zone[:, 0]),
        "edge": over(zone[:, -1]),
        "sector": over(_ratio(f["sector_fails"], f["sector_dies"]).max(axis=1)),
        "inner": over(inner),
        "ring": over(ring[:, 2:7].max(axis=1)),
        "cluster_share": _ratio(big["size"], f["fails"]),
        "cluster_size": np.where(some, _ratio(big["size"], f["dies"]), 0.0),
        "cluster_rho": np.where(some, np.sqrt(x * x + y * y), 0.0),
        "elongation": np.where(some, s["elongation"], 0.0),
        "line": over(_ratio(line["votes"], line["line_dies"])),
        "line_length": np.where(some, _ratio(line["votes"], 2.0 * np.sqrt(f["dies"] / np.pi)), 0.0),
        "z": join_z(j),
    }
