"""Polygons of several parts with holes: reading, measuring, validity, and clipping by a sweep over edges.

A shape is an array of polygons, each an array of closed rings (the outer one, then its holes) of
``lon, lat`` points.  Areas, perimeters and counts are Column expressions.  Validity and clipping
take one pass over the edges in order of their left ends, with the edges at hand in a list; a point is inside
where an odd number of edges lies below it, so that parts and holes need no case of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = "array<array<array<struct<lon:double,lat:double>>>>"
_POINT = "array<double>"


def from_geojson(kind: Column, coordinates: Column) -> Column:
    """The shape of a geometry's type and its coordinates as JSON text; null unless it is a Polygon or MultiPolygon."""
    rings = F.from_json(coordinates, f"array<array<{_POINT}>>")
    polygon = F.when(rings.isNotNull(), F.array(rings))
    many = F.from_json(coordinates, f"array<array<array<{_POINT}>>>")
    read = F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", many)
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    return F.transform(read, lambda rings: F.transform(rings, lambda r: F.transform(r, point)))


def to_geojson(parts: Column) -> Column:
    """The geometry as JSON text, a Polygon if it has one part."""
    point = lambda p: F.array(p["lon"], p["lat"])
    coordinates = F.transform(parts, lambda rings: F.transform(rings, lambda r: F.transform(r, point)))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(coordinates, F.lit(0)).alias("coordinates")))
    return F.when(F.size(parts) == 1, one).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))))


def of_ring(ring: Column) -> Column:
    return F.when(ring.isNotNull(), F.array(F.array(ring)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def measured(parts: Column, ring_measure) -> Column:
    """Outer rings less holes, of a measure of one ring; null without a part."""
    one = lambda rings: F.coalesce(ring_measure(F.get(rings, F.lit(0))), F.lit(0.0)) - F.when(F.size(rings) > 1, _sum(F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), ring_measure))).otherwise(0.0)
    return F.when(F.size(parts) > 0, _sum(F.transform(parts, one)))


def summed(parts: Column, ring_measure) -> Column:
    """The sum of a measure over all rings, holes as well; null without a part."""
    return F.when(F.size(parts) > 0, _sum(F.transform(F.flatten(parts), ring_measure)))


def vertices(parts: Column) -> Column:
    """Points of the outer rings."""
    return F.aggregate(parts, F.lit(0), lambda n, rings: n + F.coalesce(F.size(F.get(rings, F.lit(0))), F.lit(0)))


def plain_ring(ring: Column) -> Column:
    """True for a closed convex quadrangle, whose corners all turn the same way."""
    p = lambda i: F.get(ring, F.lit(i))
    turn = lambda a, b, c: (p(b)["lon"] - p(a)["lon"]) * (p(c)["lat"] - p(a)["lat"]) - (p(b)["lat"] - p(a)["lat"]) * (p(c)["lon"] - p(a)["lon"])
    four = [turn(0, 1, 2), turn(1, 2, 3), turn(2, 3, 0), turn(3, 0, 1)]
    one_way = (F.least(*four) > 0) | (F.greatest(*four) < 0)
    closed = (F.size(ring) == 5) & (p(0)["lon"] == p(4)["lon"]) & (p(0)["lat"] == p(4)["lat"])
    return F.coalesce(closed & one_way, F.lit(False))


def plainly_valid(parts: Column) -> Column:
    """True for a shape of one plain ring: no sweep is needed."""
    return F.coalesce((F.size(parts) == 1) & (F.size(F.get(parts, F.lit(0))) == 1), F.lit(False)) & plain_ring(F.get(F.get(parts, F.lit(0)), F.lit(0)))


def _points(ring) -> np.ndarray:
    return np.array([(p["lon"], p["lat"]) for p in ring], float).reshape(-1, 2)


def points(parts) -> list[list[np.ndarray]]:
    return [[_points(r) for r in rings] for rings in parts]


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def meeting(p, q, r, s) -> int:
    """Of two segments: 0 apart, 1 they touch in one point, 2 they cross or share a stretch."""
    d1, d2, d3, d4 = _turn(r, s, p), _turn(r, s, q), _turn(p, q, r), _turn(p, q, s)
    if d1 == d2 == d3 == d4 == 0:  # on one line
        k = 0 if abs(q[0] - p[0]) + abs(s[0] - r[0]) >= abs(q[1] - p[1]) + abs(s[1] - r[1]) else 1
        shared = min(max(p[k], q[k]), max(r[k], s[k])) - max(min(p[k], q[k]), min(r[k], s[k]))
        return 2 if shared > 0 else 1 if shared == 0 else 0
    if (d1 > 0) != (d2 > 0) and (d3 > 0) != (d4 > 0) and d1 and d2 and d3 and d4:
        return 2
    if (d1 == 0 or d2 == 0 or (d1 > 0) != (d2 > 0)) and (d3 == 0 or d4 == 0 or (d3 > 0) != (d4 > 0)):
        return 1
    return 0


def inside(at: np.ndarray, rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which points lie inside the rings by the even-odd rule, and which on one of them (those are not inside)."""
    odd, on = np.zeros(len(at), bool), np.zeros(len(at), bool)
    for r in rings:
        a, b = r[:-1], r[1:]
        step = max(1, (1 << 20) // max(1, len(a)))
        for k in range(0, len(at), step):
            x, y = at[k : k + step, :1], at[k : k + step, 1:]
            turn = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
            between = (np.minimum(a[:, 0], b[:, 0]) <= x) & (x <= np.maximum(a[:, 0], b[:, 0])) & (np.minimum(a[:, 1], b[:, 1]) <= y) & (y <= np.maximum(a[:, 1], b[:, 1]))
            on[k : k + step] |= ((turn == 0) & between).any(axis=1)
            spans = (a[:, 0] <= x) != (b[:, 0] <= x)
            below = spans & ((turn > 0) == (b[:, 0] > a[:, 0]))
            odd[k : k + step] ^= below.sum(axis=1) % 2 == 1
    return odd & ~on, on


def _swept(edges: list[tuple]):
    """Pairs of edges whose extents along x and y meet, by a sweep from left to right.  An edge: left x, right x, low y, high y, ..."""
    active: list[tuple] = []
    for e in sorted(edges, key=lambda e: e[0]):
        active = [f for f in active if f[1] >= e[0]]
        for f in active:
            if f[2] <= e[3] and e[2] <= f[3]:
                yield f, e
        active.append(e)


def _edge(a, b, *more) -> tuple:
    return (min(a[0], b[0]), max(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1]), tuple(a), tuple(b), *more)


def invalid_reason(parts: list[list[np.ndarray]]) -> str | None:
    """Null for a valid shape; not_closed, degenerate, self_intersection, hole_outside or nested (a part or hole inside another)."""
    rings = [r for part in parts for r in part]
    if not rings or any(not part for part in parts):
        return "degenerate"
    if any(len(r) < 4 or (r[0] != r[-1]).any() for r in rings):
        return "not_closed"
    for r in rings:
        q = r - r[0]
        if abs(q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]).sum() <= 1e-11 * (q * q).max():  # all on one line
            return "degenerate"
    edges = []
    for i, r in enumerate(rings):
        moved = r[np.concatenate([[True], (r[1:] != r[:-1]).any(axis=1)])]  # repeated points are one
        edges += [_edge(a, b, i, k, len(moved) - 1) for k, (a, b) in enumerate(zip(moved, moved[1:], strict=False))]
    for f, e in _swept(edges):
        how = meeting(f[4], f[5], e[4], e[5])
        follow = f[6] == e[6] and (f[7] - e[7]) % f[8] in (1, f[8] - 1)
        if how == 2 or (how == 1 and f[6] == e[6] and not follow):
            return "self_intersection"
    for part in parts:
        for k, hole in enumerate(part[1:], 1):
            within, on = inside(hole[:-1], [part[0]])
            if not (within | on).all():
                return "hole_outside"
            if any(inside(hole[:-1], [other])[0].any() for j, other in enumerate(part[1:], 1) if j != k):
                return "nested"
    for k, part in enumerate(parts):
        if any(inside(part[0][:-1], other)[0].any() for j, other in enumerate(parts) if j != k):
            return "nested"
    return None


@F.arrow_udf(T.StringType())
def _validity(shapes: pa.Array) -> pa.Array:
    return pa.array([None if s is None else invalid_reason(points(s)) for s in shapes.to_pylist()], pa.string())


def validity(parts: Column) -> Column:
    """Null for a valid shape, else why not; plain quadrangles are judged without leaving the JVM's expressions."""
    return _validity(F.when(~plainly_valid(parts), parts))


def _slanted(parts: list[list[np.ndarray]]) -> list[tuple]:
    """Edges from left to right; upright ones bound no slab."""
    out = []
    for part in parts:
        for r in part:
            out += [_edge(a, b, 0) if a[0] < b[0] else _edge(b, a, 0) for a, b in zip(r.tolist(), r[1:].tolist(), strict=False) if a[0] != b[0]]
    return out


def shared_area(p: list[list[np.ndarray]], q: list[list[np.ndarray]]) -> float:
    """Planar area inside both shapes: between all ends and crossings no edges meet, so each slab is a row of trapezoids."""
    a, b = ([(*e[:6], k) for e in _slanted(x)] for k, x in enumerate((p, q)))
    if not a or not b:
        return 0.0
    low, high = max(min(e[0] for e in x) for x in (a, b)), min(max(e[1] for e in x) for x in (a, b))
    edges = [e for e in (*a, *b) if e[1] > low and e[0] < high]
    cuts = {low, high, *(x for e in edges for x in e[:2] if low < x < high)}
    for f, e in _swept(edges):
        if f[6] != e[6]:
            den = (f[5][0] - f[4][0]) * (e[5][1] - e[4][1]) - (f[5][1] - f[4][1]) * (e[5][0] - e[4][0])
            if den:
                t = ((e[4][0] - f[4][0]) * (e[5][1] - e[4][1]) - (e[4][1] - f[4][1]) * (e[5][0] - e[4][0])) / den
                x = f[4][0] + t * (f[5][0] - f[4][0])
                if 0 <= t <= 1 and low < x < high:
                    cuts.add(x)
    cuts, waiting, active, total = sorted(cuts), sorted(edges, key=lambda e: -e[0]), [], 0.0
    for x1, x2 in zip(cuts, cuts[1:], strict=False):
        mid = (x1 + x2) / 2
        while waiting and waiting[-1][0] <= x1:
            active.append(waiting.pop())
        active = [e for e in active if e[1] >= x2]
        at = ([], [])
        for e in active:
            (xa, ya), (xb, yb) = e[4], e[5]
            at[e[6]].append(ya + (yb - ya) * (mid - xa) / (xb - xa))
        ys, zs = sorted(at[0]), sorted(at[1])
        i = j = 0
        while i + 1 < len(ys) and j + 1 < len(zs):  # both are intervals in order
            total += max(0.0, min(ys[i + 1], zs[j + 1]) - max(ys[i], zs[j])) * (x2 - x1)
            if ys[i + 1] < zs[j + 1]:
                i += 2
            else:
                j += 2
    return total


def planar_area(parts: list[list[np.ndarray]]) -> float:
    own = lambda r: abs(((r[:-1, 0] - r[0, 0]) * (r[1:, 1] - r[0, 1]) - (r[1:, 0] - r[0, 0]) * (r[:-1, 1] - r[0, 1])).sum()) / 2
    return sum(own(part[0]) - sum(map(own, part[1:])) for part in parts)


def strip_area(p: list[list[np.ndarray]], q: list[list[np.ndarray]], reach: float = 0.5, step: float = 0.5) -> float:
    """Area of the strip within ``reach`` outside ``p`` that lies within ``reach`` of ``q``, along all of p's boundary."""
    ends = np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for part in q for r in part])
    box = ends[:, :2].min(0) - 2 * reach, ends[:, :2].max(0) + 2 * reach
    c, d = ends[:, :2], ends[:, 2:] - ends[:, :2]
    square = np.maximum((d * d).sum(1), 1e-300)
    total = 0.0
    for part in p:
        for r in part:
            a, way = r[:-1], r[1:] - r[:-1]
            length = np.hypot(way[:, 0], way[:, 1])
            n = np.maximum(1, np.ceil(length / step)).astype(np.int64)
            of = np.repeat(np.arange(len(a)), n)
            t = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + 0.5) / n[of]
            at = a[of] + t[:, None] * way[of]
            near = ((at >= box[0]) & (at <= box[1])).all(1)
            at, share = at[near], (length / n)[of[near]]
            for k in range(0, len(at), 4096):
                x = at[k : k + 4096, None, :] - c
                u = np.clip((x * d).sum(2) / square, 0, 1)[:, :, None] * d
                gap = np.sqrt(((x - u) ** 2).sum(2).min(1))
                total += float((share[k : k + 4096] * np.clip(2 * reach - gap, 0, reach)).sum())
    return total
