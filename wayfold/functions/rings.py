"""Many rings at a time as flat arrays: corners x and y, and `at`, where each ring begins (and the last one ends).

The arithmetic is that of column expressions, corner by corner in the ring's order. Coordinates that are missing are NaN.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

Rings = tuple[np.ndarray, np.ndarray, np.ndarray]


def flat_rings(rings: pa.Array) -> Rings:
    """Rings of a list column of (x, y); one that is NULL has no corners."""
    corners = rings.flatten()
    sizes = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    x, y = (corners.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    gone = corners.is_null().to_numpy(zero_copy_only=False)
    return np.where(gone, np.nan, x), np.where(gone, np.nan, y), np.concatenate([[0], np.cumsum(sizes)]).astype("int64")


def nested_rings(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> pa.Array:
    corners = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), corners)


def picked(x: np.ndarray, y: np.ndarray, at: np.ndarray, rings: np.ndarray) -> Rings:
    """The rings of these numbers, which may repeat."""
    sizes = np.diff(at)[rings]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    corner = np.arange(ends[-1]) + np.repeat(at[rings] - ends[:-1], sizes)
    return x[corner], y[corner], ends


def _following(at: np.ndarray) -> np.ndarray:
    """For each corner the next one of its ring."""
    following = np.arange(1, at[-1] + 1)
    some = np.diff(at) > 0
    following[at[1:][some] - 1] = at[:-1][some]
    return following


def clip_half_plane(x: np.ndarray, y: np.ndarray, at: np.ndarray, a: float, b: float, c: np.ndarray) -> Rings:
    """The parts of convex rings where a x + b y <= c, which has a value for each ring; empty where nothing is left."""
    with np.errstate(all="ignore"):
        beyond = x * a + y * b - np.repeat(c, np.diff(at))
        then = _following(at)
        u = beyond / (beyond - beyond[then])
        kept, crossed = beyond <= 0, beyond * beyond[then] < 0
    ends = np.concatenate([[0], np.cumsum(kept.astype("int64") + crossed)])
    cx, cy = np.empty(ends[-1]), np.empty(ends[-1])
    cx[ends[:-1][kept]], cy[ends[:-1][kept]] = x[kept], y[kept]
    there = (ends[:-1] + kept)[crossed]
    p, q, u = np.flatnonzero(crossed), then[crossed], u[crossed]
    cx[there], cy[there] = x[p] + u * (x[q] - x[p]), y[p] + u * (y[q] - y[p])
    return cx, cy, ends[at]


def signed_areas(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Signed areas, added up in the order of the corners."""
    then = _following(at)
    with np.errstate(all="ignore"):
        parts = (x * y[then] - x[then] * y) / 2.0
    sizes, areas = np.diff(at), np.zeros(len(at) - 1)
    rings = np.flatnonzero(sizes > 0)
    nth = 0
    while len(rings):
        areas[rings] += parts[at[rings] + nth]
        nth += 1
        rings = rings[sizes[rings] > nth]
    return areas


def extents(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinate of each ring, NaN if it has none."""
    low, high = np.full(len(at) - 1, np.nan), np.full(len(at) - 1, np.nan)
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        low[some], high[some] = np.fmin.reduceat(values, at[some]), np.fmax.reduceat(values, at[some])
    return low, high


def walked(owner: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed edges of groups in the order of their rings, each from its least edge: edge numbers, where each ring begins, and which groups are simple.

    Simple: at every corner one edge begins and one ends. The edges of other groups are left out.
    """
    begins, ends = np.lexsort((y1, x1, owner)), np.lexsort((y2, x2, owner))
    simple = np.ones(groups, dtype=bool)
    met = (owner[begins] == owner[ends]) & (x1[begins] == x2[ends]) & (y1[begins] == y2[ends])
    simple[owner[begins][~met]] = False
    again = (np.diff(owner[begins]) == 0) & (np.diff(x1[begins]) == 0) & (np.diff(y1[begins]) == 0)
    simple[owner[begins][1:][again]] = False
    # From here on an edge's number is its place among the beginnings; groups are together there and among the ends.
    begins, ends = begins[simple[owner[begins]]], ends[simple[owner[ends]]]
    n = len(begins)
    place = np.zeros(len(owner), dtype="int64")
    place[begins] = np.arange(n)
    following = np.empty(n, dtype="int64")
    following[place[ends]] = np.arange(n)
    rounds = int(np.bincount(owner).max(initial=1)).bit_length()
    head, hop = np.arange(n), following
    for _ in range(rounds):
        head, hop = np.minimum(head, head[hop]), hop[hop]
    left, hop = np.append(np.ones(n, dtype="int64"), 0), np.append(np.where(following == head, n, following), n)
    for _ in range(rounds):
        left, hop = left + left[hop], hop[hop]
    order = np.lexsort((-left[:n], head))
    firsts = np.flatnonzero(np.diff(head[order], prepend=-1))
    return begins[order], np.append(firsts, n), simple
