"""Planar geometry. Rings and lines are arrays of struct<x, y>; the kernel that loops is numpy in Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: GRS80 and the Lambert-93 conic
_A, _F = 6378137.0, 1 / 298.257222101
_E = math.sqrt(2 * _F - _F * _F)
_LON0, _X0, _Y0 = math.radians(3.0), 700000.0, 6600000.0
_LAT0, _LAT1, _LAT2 = (math.radians(v) for v in (46.5, 49.0, 44.0))


def _t(lat: float) -> float:
    s = _E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (_E * math.sin(lat)) ** 2)


_N = (math.log(_m(_LAT1)) - math.log(_m(_LAT2))) / (math.log(_t(_LAT1)) - math.log(_t(_LAT2)))
_C = _m(_LAT1) / (_N * _t(_LAT1) ** _N)
_RHO0 = _A * _C * _t(_LAT0) ** _N


def to_lambert(lon: Column, lat: Column) -> Column:
    """struct<x, y> in metres of degrees of longitude and latitude."""
    phi = F.radians(lat)
    s = F.sin(phi) * _E
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), _E / 2)
    rho, turn = F.pow(t, _N) * (_A * _C), (F.radians(lon) - _LON0) * _N
    return F.struct((F.lit(_X0) + rho * F.sin(turn)).alias("x"), (F.lit(_Y0 + _RHO0) - rho * F.cos(turn)).alias("y"))


def from_lambert(x: Column, y: Column) -> Column:
    """struct<lon, lat> in degrees; six fixed-point steps."""
    dx, dy = x - _X0, F.lit(_RHO0) - (y - _Y0)
    t = F.pow(F.sqrt(dx * dx + dy * dy) / (_A * _C), 1 / _N)
    lat = F.lit(math.pi / 2) - F.atan(t) * 2
    for _ in range(6):
        s = F.sin(lat) * _E
        lat = F.lit(math.pi / 2) - F.atan(t * F.pow((1 - s) / (1 + s), _E / 2)) * 2
    return F.struct(F.degrees(F.atan2(dx, dy) / _N + _LON0).alias("lon"), F.degrees(lat).alias("lat"))


def edges(line: Column) -> Column:
    """array<struct<a, b>> of consecutive points."""
    rest = F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0)))
    return F.filter(F.zip_with(line, rest, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda e: e["b"].isNotNull())


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def length(line: Column) -> Column:
    return total(F.transform(edges(line), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def signed_area(ring: Column) -> Column:
    """Positive for a counter-clockwise closed ring."""
    return total(F.transform(edges(ring), lambda e: (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test against a closed ring."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def bbox(line: Column) -> Column:
    pick = lambda f, k: f(F.transform(line, lambda p: p[k]))
    return F.struct(pick(F.array_min, "x").alias("x0"), pick(F.array_min, "y").alias("y0"), pick(F.array_max, "x").alias("x1"), pick(F.array_max, "y").alias("y1"))


def bbox_area(r: Column) -> Column:
    return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])


def bbox_shared(a: Column, b: Column) -> Column:
    """The area that two boxes share."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1")


def bbox_iou(a: Column, b: Column) -> Column:
    both = bbox_shared(a, b)
    union = bbox_area(a) + bbox_area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def rounded(c: Column, digits: int) -> Column:
    """round() of doubles below 1e9 or so, by products instead of decimals but where the next digits are near a half; there, by round() itself."""
    up = c * F.lit(10.0**digits)
    whole = F.rint(up)
    return F.when(F.abs(up - whole) < 0.499999, whole / F.lit(10.0**digits)).otherwise(F.round(c, digits))


# the numpy kernel: points are (n, 2) arrays


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with an explicit stack."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        far = segment_distance(points[i + 1 : j], points[i : i + 1], points[j : j + 1])[:, 0]
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def segment_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each point to each segment a-b."""
    d = b - a
    long = (d * d).sum(axis=1)
    u = ((p[:, None] - a) * d).sum(axis=2) / np.where(long > 0, long, 1)
    near = a + np.clip(u, 0, 1)[..., None] * d
    return np.hypot(*np.moveaxis(p[:, None] - near, 2, 0))


def clip_ring(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A closed ring cut to a rectangle, one side after the other; empty if nothing is left."""
    pts = ring[:-1]
    for axis, sign, bound in ((0, 1, x0), (0, -1, x1), (1, 1, y0), (1, -1, y1)):
        if not len(pts):
            break
        depth = sign * (pts[:, axis] - bound)
        nxt, after = np.roll(pts, -1, axis=0), np.roll(depth, -1)
        out = []
        for p, q, d, e in zip(pts, nxt, depth, after):
            if d >= 0:
                out.append(p)
            if (d >= 0) != (e >= 0):
                out.append(p + (q - p) * d / (d - e))
        pts = np.array(out)
    return np.vstack([pts, pts[:1]]) if len(pts) >= 3 else np.zeros((0, 2))


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """Symmetric distance of two lines, sampled at vertices and segment midpoints."""
    sample = lambda l: np.vstack([l, (l[1:] + l[:-1]) / 2])
    one = lambda p, q: segment_distance(sample(p), q[:-1], q[1:]).min(axis=1).max()
    return float(max(one(a, b), one(b, a)))


def points(value) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in value], dtype=np.float64).reshape(-1, 2)


LINE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
_LINE_TYPE = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


@F.arrow_udf(LINE)
def simplified(lines: pa.Array, tolerance: pa.Array) -> pa.Array:
    out = [None if v is None else [{"x": x, "y": y} for x, y in simplify(points(v), t).tolist()] for v, t in zip(lines.to_pylist(), tolerance.to_pylist())]
    return pa.array(out, _LINE_TYPE)


@F.arrow_udf(LINE)
def clipped(rings: pa.Array, boxes: pa.Array) -> pa.Array:
    out = [None if v is None or b is None else [{"x": x, "y": y} for x, y in clip_ring(points(v), b["x0"], b["y0"], b["x1"], b["y1"]).tolist()] for v, b in zip(rings.to_pylist(), boxes.to_pylist())]
    return pa.array(out, _LINE_TYPE)


@F.arrow_udf(T.DoubleType())
def line_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([hausdorff(points(x), points(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

