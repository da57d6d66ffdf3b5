"""Geometry as plain columns: points are structs (x, y) or two columns, lines are arrays of points, polygons arrays of rings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6371000.0
LINE = "array<struct<x:double,y:double>>"


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH) -> Column:
    """Great-circle distance in metres; null if a coordinate is null. The cosine is held within [-1, 1]."""
    dlon, dlat = F.radians(lon2) - F.radians(lon1), F.radians(lat2) - F.radians(lat1)
    cosine = F.cos(dlat) - F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (F.lit(1.0) - F.cos(dlon))
    return F.when(lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull(), F.lit(float(radius)) * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def distance(planar: bool):
    return euclidean if planar else haversine


def metres_to_degrees(metres: Column, latitude: Column) -> Column:
    return metres / (F.lit(111320.0) * F.cos(F.radians(latitude)))


def line_length(line: Column, planar: bool = False) -> Column:
    """Summed distance between consecutive points."""
    d, n = distance(planar), F.size(line)
    steps = F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, q: d(p["x"], p["y"], q["x"], q["y"]))
    return F.when(n >= 2, F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)).when(line.isNotNull(), F.lit(0.0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def array_mean(points: Column, field: str, f=lambda c: c) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, p: a + f(p[field])) / F.size(points)


def centre(points: Column, planar: bool = False) -> Column:
    """Mean of points: of longitudes on the circle (so that 179 and -179 give 180), of latitudes plainly."""
    if planar:
        return point(array_mean(points, "x"), array_mean(points, "y"))
    lon = F.degrees(F.atan2(array_mean(points, "x", lambda c: F.sin(F.radians(c))), array_mean(points, "x", lambda c: F.cos(F.radians(c)))))
    return point(lon, array_mean(points, "y"))


# -- numpy kernels for what expressions can't say ---------------------------------------------------------------------


def np_haversine(lon1, lat1, lon2, lat2, radius: float = EARTH):
    lon1, lat1, lon2, lat2 = map(np.radians, (lon1, lat1, lon2, lat2))
    return radius * np.arccos(np.clip(np.cos(lat2 - lat1) - np.cos(lat1) * np.cos(lat2) * (1 - np.cos(lon2 - lon1)), -1, 1))


def pairwise(a: np.ndarray, b: np.ndarray, planar: bool) -> np.ndarray:
    if planar:
        return np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    return np_haversine(a[:, None, 0], a[:, None, 1], b[None, :, 0], b[None, :, 1])


def _table(n: int, m: int, cost, step) -> np.ndarray:
    """A dynamic programme over many pairs of lines at once, all of n and of m points; cost(i, j) has the distances of their points i and j.
    step(best of the three cells before, cost) gives a cell; the result is the last cell of each pair."""
    row: list[np.ndarray] = []
    for i in range(n):
        above, row = row, []
        for j in range(m):
            d, best = cost(i, j), None
            for before in (*above[j : j + 1], *row[-1:], *(above[j - 1 : j] if j else [])):
                best = before if best is None else np.minimum(best, before)
            row.append(d if best is None else step(best, d))
    return row[-1]


def _join(kind: str):
    return np.add if kind == "dtw" else np.maximum


def line_distances(a: list[np.ndarray], b: list[np.ndarray], kind: str) -> np.ndarray:
    """Dynamic time warping (dtw) or discrete Frechet distance (frechet) of a[k] and b[k], with Euclidean point distances. Pairs of
    equal numbers of points are worked on together."""
    out, shapes = np.empty(len(a)), np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for n, m in np.unique(shapes, axis=0).tolist():
        same = np.flatnonzero((shapes[:, 0] == n) & (shapes[:, 1] == m))
        most = max(1, 4_000_000 // max(1, n + m))
        for lo in range(0, len(same), most):
            some = same[lo : lo + most].tolist()
            if n and m:
                x, y = np.stack([a[k] for k in some]), np.stack([b[k] for k in some])
                out[some] = _table(n, m, lambda i, j, x=x, y=y: np.hypot(x[:, i, 0] - y[:, j, 0], x[:, i, 1] - y[:, j, 1]), _join(kind))
            else:
                out[some] = np.nan
    return out


def shapes(sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lines, given by their numbers of points and all their coordinates, by number of points: (their places, all different lines as
    (lines, points, 2), which of these each is)."""
    at, out = np.cumsum(sizes) - sizes, []
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        k = at[own][:, None] + np.arange(n)
        flat = np.concatenate([x[k], y[k]], 1)
        different, which = np.unique(flat, axis=0, return_inverse=True) if n else (np.empty((1, 0)), np.zeros(len(own), np.int64))
        out.append((own, np.stack([different[:, :n], different[:, n:]], 2), which.reshape(-1)))
    return out


def line_matrix(a: list, b: list, kind: str) -> np.ndarray:
    """The distances (see line_distances) of all lines of a and all of b, which shapes() has sorted out: equal lines are measured once."""
    out = np.full((sum(len(own) for own, _, _ in a), sum(len(own) for own, _, _ in b)), np.nan)
    for own_a, p, which_a in a:
        for own_b, q, which_b in b:
            n, m = p.shape[1], q.shape[1]
            if not n or not m:
                continue
            d, most = np.empty((len(p), len(q))), max(1, 500_000 // (m * len(q)))
            for lo in range(0, len(p), most):
                r = p[lo : lo + most]
                d[lo : lo + most] = _table(n, m, lambda i, j, r=r, q=q: np.hypot(r[:, i, 0][:, None] - q[:, j, 0], r[:, i, 1][:, None] - q[:, j, 1]), _join(kind))
            out[np.ix_(own_a, own_b)] = d[np.ix_(which_a, which_b)]
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chain, counter-clockwise, without the closing point."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) <= 2:
        return np.array(pts)

    def half(seq):
        out = []
        for p in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def buffered_hull(points: np.ndarray, radius: float, corners: int = 64) -> np.ndarray:
    """Closed ring around all points at a distance: the hull of circles about the hull's corners."""
    angle = 2 * math.pi * np.arange(corners) / corners
    circle = radius * np.stack([np.cos(angle), np.sin(angle)], 1)
    ring = hull((hull(points)[:, None, :] + circle).reshape(-1, 2))
    return np.vstack([ring, ring[:1]])


def inside(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of points: inside the rings (even-odd, so holes count), and on their boundary."""
    odd, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
            cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            between = (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))
            edge |= (cross == 0) & between
            if y1 != y2:
                odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd & ~edge, edge


def line_in_areas(line: np.ndarray, polygons: list[list[np.ndarray]]) -> tuple[bool, bool]:
    """(some part of the line is in an area's interior, some part is outside of all areas): the line is cut at all their boundaries."""
    cuts = []
    for p, q in zip(line[:-1], line[1:], strict=True):
        t = [0.0, 1.0]
        for ring in (r for rings in polygons for r in rings):
            a, b = ring[:-1], ring[1:]
            d, e = q - p, b - a
            den = d[0] * e[:, 1] - d[1] * e[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                s = ((a[:, 0] - p[0]) * e[:, 1] - (a[:, 1] - p[1]) * e[:, 0]) / den
                u = ((a[:, 0] - p[0]) * d[1] - (a[:, 1] - p[1]) * d[0]) / den
            t += s[(den != 0) & (s > 0) & (s < 1) & (u >= 0) & (u <= 1)].tolist()
        t = np.unique(t)
        mid = ((t[1:] + t[:-1]) / 2)[np.diff(t) > 1e-12]  # a border that two areas share is cut once
        cuts.append(p + mid[:, None] * (q - p))
    if not cuts:
        return False, False
    pts = np.concatenate(cuts)
    some, held = np.zeros(len(pts), bool), np.zeros(len(pts), bool)
    for rings in polygons:
        within, edge = inside(pts[:, 0], pts[:, 1], rings)
        some |= within
        held |= within | edge
    return bool(some.any()), bool((~held).any())
