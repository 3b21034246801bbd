"""Crossings of rays with long edges, in numpy: a helper of operators/containment.py for one strip of a polygon.

Points are ranked by height; the edges that span all heights of a dyadic range of ranks are sorted from left to right there, so a point finds by bisection
how many lie right of it. Edges that cross others within a range go down to its halves, at the latest to a single point. Edges within a small
distance of a point are tested one by one with the arithmetic of a plain scan, so results are those of the scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: pairs that are expanded at once
PAIRS = 1 << 21


def _expanded(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, position) of all positions in [start, stop) of each row, some at a time."""
    rows = np.flatnonzero(stop > start)
    lens = (stop - start)[rows]
    ends = np.cumsum(lens)
    a = 0
    while a < len(rows):
        done = ends[a] - lens[a]
        b = max(a + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        for low in range(0, int(ends[b - 1] - done), PAIRS):
            at = np.arange(low, min(low + PAIRS, int(ends[b - 1] - done))) + done
            k = np.searchsorted(ends, at, "right")
            yield rows[k], start[rows[k]] + at - (ends[k] - lens[k])
        a = b


def crossed(x: np.ndarray, z: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, hole: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(odd, on_edge, on_hole) of each point (x, z): whether the ray towards greater x crosses an odd number of edges, whether the point lies on an edge of the
    exterior or of a hole."""
    order = np.argsort(z, kind="stable")
    xs, zs = x[order], z[order]
    n = len(zs)
    count, on, on_hole = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    low, high = np.minimum(ay, by), np.maximum(ay, by)
    lo, hi = np.searchsorted(zs, low, "left"), np.searchsorted(zs, high, "left")
    near = 1e-9 * max(1.0, *(float(np.abs(v).max(initial=0)) for v in (xs, ax, bx, zs, ay, by)))

    def meet(e: np.ndarray, z: np.ndarray) -> np.ndarray:
        return ax[e] + (z - ay[e]) / (by[e] - ay[e]) * (bx[e] - ax[e])

    def touch(e: np.ndarray, p: np.ndarray) -> None:
        px, pz = xs[p], zs[p]
        cross = (pz - ay[e]) * (bx[e] - ax[e]) - (px - ax[e]) * (by[e] - ay[e])
        hit = (np.abs(cross) <= epsilon) & (px >= np.minimum(ax[e], bx[e]) - epsilon) & (px <= np.maximum(ax[e], bx[e]) + epsilon) & (pz >= low[e] - epsilon) & (pz <= high[e] + epsilon)
        on[p[hit & ~hole[e]]], on_hole[p[hit & hole[e]]] = True, True

    # flat edges touch points far from where the ray meets them, all edges those at the heights of their ends
    flat = high - low < 2 * epsilon / near
    first, last = np.searchsorted(zs, low - epsilon, "left"), np.searchsorted(zs, high + epsilon, "right")
    for start, stop in ((first, np.where(flat, last, lo)), (np.where(flat, last, hi), last)):
        for e, p in _expanded(start, stop):
            touch(e, p)

    none = np.zeros(0, np.int64)
    carried_node, carried_edge = none, none
    rank = np.arange(n)
    for level in range(max(n - 1, 0).bit_length(), -1, -1):
        l, r = (lo + (1 << level) - 1) >> level, hi >> level
        some = l < r
        left, right = np.flatnonzero(some & (l & 1 == 1)), np.flatnonzero(some & (r & 1 == 1))
        node, edge = np.concatenate([l[left], r[right] - 1, carried_node]), np.concatenate([left, right, carried_edge])
        carried_node, carried_edge = none, none
        if not len(node):
            continue
        bottom, top = meet(edge, zs[node << level]), meet(edge, zs[np.minimum(((node + 1) << level) - 1, n - 1)])
        o = np.lexsort((top, bottom, node))
        node, edge, bottom, top = node[o], edge[o], bottom[o], top[o]
        place = np.empty(len(o), np.int64)
        place[np.lexsort((bottom, top, node))] = np.arange(len(o))
        clean = (np.maximum.accumulate(place) == place) & (np.minimum.accumulate(place[::-1])[::-1] == place)
        if not clean.all():
            halves = np.concatenate([node[~clean] * 2, node[~clean] * 2 + 1])
            there = halves << (level - 1) < n
            carried_node, carried_edge = halves[there], np.tile(edge[~clean], 2)[there]
            node, edge = node[clean], edge[clean]
        at = rank >> level
        begin, end = np.searchsorted(node, at, "left"), np.searchsorted(node, at, "right")
        p = np.flatnonzero(begin < end)
        a, b = begin[p], end[p]
        while (open_ := a < b).any():  # the first edge that is not clearly left of the point
            mid = (a + b) >> 1
            right_of = np.zeros(len(p), bool)
            right_of[open_] = meet(edge[mid[open_]], zs[p[open_]]) > xs[p[open_]] - near
            a, b = np.where(open_ & ~right_of, mid + 1, a), np.where(open_ & right_of, mid, b)
        sure = a.copy()  # the first edge that is clearly right of it
        close = np.arange(len(p))
        while len(close):
            close = close[sure[close] < end[p[close]]]
            close = close[meet(edge[sure[close]], zs[p[close]]) <= xs[p[close]] + near]
            sure[close] += 1
        count[p] += end[p] - sure
        for k, i in _expanded(a, sure):
            np.add.at(count, p[k], xs[p[k]] < meet(edge[i], zs[p[k]]))
            touch(edge[i], p[k])
    out = []
    for v in (count % 2 == 1, on, on_hole):
        back = np.empty(n, bool)
        back[order] = v
        out.append(back)
    return tuple(out)
