"""Rings, polygons and their tests as Columns or NumPy; coordinates are integers of 1e-7 degrees."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest side of a polygon's list of edges that is built into a plan as an expression; longer ones go through NumPy.
EXPRESSION_EDGES = 64
Point = tuple[int, int]
Ring = tuple[Point, ...]


def signed_area(ring: Ring) -> int:
    """Twice the area, positive if counter-clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def oriented(ring: Ring, outer: bool) -> Ring:
    """Outer rings counter-clockwise, inner ones clockwise."""
    return ring if (signed_area(ring) > 0) == outer else ring[::-1]


def closed(ring: list[Point]) -> Ring:
    """With the first point once more at the end."""
    return tuple(ring) if ring and ring[0] == ring[-1] else (*ring, *ring[:1])


@dataclass(frozen=True)
class Region:
    """A box, or polygons inside of it: each a list of rings, the outer one first."""

    box: tuple[int, int, int, int]
    polygons: tuple[tuple[Ring, ...], ...] = ()

    @staticmethod
    def of_box(a: Point, b: Point) -> Region:
        """From two corners in any order."""
        return Region((min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])))

    @staticmethod
    def of_polygons(polygons: list[list[list[Point]]]) -> Region:
        """Rings are closed and turned: edges keep their direction, which decides for points on them."""
        rings = tuple(tuple(oriented(closed(r), i == 0) for i, r in enumerate(p)) for p in polygons)
        if not rings or any(len(r) < 4 for p in rings for r in p):
            raise ValueError("A polygon needs rings of three points or more")
        xs, ys = zip(*[point for p in rings for r in p for point in r], strict=True)
        return Region((min(xs), min(ys), max(xs), max(ys)), rings)

    def edges(self) -> list[tuple[int, int, int, int]]:
        """The directed edges (x1, y1, x2, y2) of all rings; those of no length left out."""
        return [(*a, *b) for p in self.polygons for r in p for a, b in zip(r, r[1:], strict=False) if a != b]

    def contains(self, lon: Column, lat: Column) -> Column:
        """Whether a point is inside or on the edge of the box; then whether a ray from it crosses the rings an odd
        number of times. Corners are inside; whether an edge is depends on its direction."""
        a, b, x, y = self.box
        inside = lon.between(a, x) & lat.between(b, y)
        edges = self.edges()
        if not edges:
            return inside
        if len(edges) > EXPRESSION_EDGES:
            return inside & contains_udf(edges)(lon, lat)
        return inside & _crossings(edges, lon.cast("bigint"), lat.cast("bigint"))


def _crossings(edges, lon: Column, lat: Column) -> Column:
    corner, odd = F.lit(False), F.lit(0)
    for x1, y1, x2, y2 in edges:
        corner = corner | ((lon == x1) & (lat == y1))
        left = (lon - F.lit(x2).cast("bigint")) * F.lit(y1 - y2).cast("bigint") < F.lit(x1 - x2).cast("bigint") * (lat - F.lit(y2).cast("bigint"))
        crosses = ((lat < y2) != (lat < y1)) & ((F.lit(y1 > y2)) == left)
        odd = odd + F.when(crosses, 1).otherwise(0)
    return corner | (odd % 2 == 1)


def contains_points(edges: list[tuple[int, int, int, int]], lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """The same test on arrays, in blocks of points; products of differences stay within 64 bits."""
    e = np.array(edges, dtype=np.int64).reshape(-1, 4)
    out = np.zeros(len(lon), dtype=bool)
    step = max(1, 4_000_000 // max(1, len(e)))
    for at in range(0, len(lon), step):
        x, y = lon[at : at + step, None].astype(np.int64), lat[at : at + step, None].astype(np.int64)
        corner = ((e[:, 0] == x) & (e[:, 1] == y)).any(axis=1)
        left = (x - e[:, 2]) * (e[:, 1] - e[:, 3]) < (e[:, 0] - e[:, 2]) * (y - e[:, 3])
        crosses = ((e[:, 3] > y) != (e[:, 1] > y)) & ((e[:, 1] > e[:, 3]) == left)
        out[at : at + step] = corner | (crosses.sum(axis=1) % 2 == 1)
    return out


def contains_udf(edges: list[tuple[int, int, int, int]]):
    """The test as an Arrow-batched function of two integer columns; null for null."""

    @F.pandas_udf("boolean")
    def test(lon: pd.Series, lat: pd.Series) -> pd.Series:
        ok = lon.notna() & lat.notna()
        found = pd.Series([None] * len(lon), dtype=object)
        found[ok] = contains_points(edges, lon[ok].to_numpy(dtype=np.int64), lat[ok].to_numpy(dtype=np.int64))
        return found

    return test


def decimal(e7: Column, least_digits: int = 0) -> Column:
    """Degrees of an integer coordinate without needless zeros; at least so many digits after the point."""
    sign = F.when(e7 < 0, "-").otherwise("")
    size = F.abs(e7.cast("bigint"))
    whole = F.floor(size / 10_000_000).cast("string")
    part = F.rtrim(F.lpad((size % 10_000_000).cast("string"), 7, "0"), F.lit("0"))
    if least_digits:
        part = F.rpad(part, F.greatest(F.length(part), F.lit(least_digits)), F.lit("0"))
        return F.concat(sign, whole, F.lit("."), part)
    return F.concat(sign, whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))


def point_list(points: Column, left: str, between: str, right: str, joined: str, least_digits: int = 0) -> Column:
    """Text of an array of structs with lon_e7 and lat_e7."""
    each = F.transform(points, lambda p: F.concat(F.lit(left), decimal(p["lon_e7"], least_digits), F.lit(between), decimal(p["lat_e7"], least_digits), F.lit(right)))
    return F.array_join(each, joined)


def ring_area(points: Column) -> Column:
    """Twice the signed area of a ring of structs with lon_e7 and lat_e7, as a double."""
    n = F.size(points)
    x = lambda i: F.get(points, i)["lon_e7"].cast("double")
    y = lambda i: F.get(points, i)["lat_e7"].cast("double")
    terms = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: x(i) * y(i + 1) - x(i + 1) * y(i))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def counter_clockwise(points: Column) -> Column:
    return F.when(ring_area(points) < 0, F.reverse(points)).otherwise(points)


# Well-known binary: little-endian, with the SRID in every part.
_SRID = 4326
_FLAG = 0x20000000


def _head(kind: int) -> bytes:
    return struct.pack("<BII", 1, kind | _FLAG, _SRID)


def ewkb_column(kind: pa.Array, points: pa.Array, area: pa.Array) -> pa.Array:
    """Hex by row of a Point, LineString (``points``) or MultiPolygon (``area``: polygons of rings); integer coordinates.

    All coordinates of a batch are turned at once; rows cut their stretch of the text.
    """
    point, line, multi, polygon = (_head(n).hex().upper() for n in (1, 2, 6, 3))
    count = lambda n: struct.pack("<I", n).hex().upper()
    pairs, ends = _hex_pairs(points)
    per_row = _sizes(area)
    rings = area.flatten()
    per_polygon = _sizes(rings)
    corners, corner_ends = _hex_pairs(rings.flatten())
    ring = at = 0  # of the next polygon, and the next polygon
    out = []
    for i, k in enumerate(kind.to_pylist()):
        if k == "MultiPolygon":
            parts = [multi, count(per_row[i])]
            for n in per_polygon[at : at + per_row[i]]:
                parts += [polygon, count(n)]
                for r in range(ring, ring + n):
                    parts += [count(corner_ends[r + 1] - corner_ends[r]), corners[32 * corner_ends[r] : 32 * corner_ends[r + 1]]]
                ring += n
            out.append("".join(parts))
        else:
            shape = pairs[32 * ends[i] : 32 * ends[i + 1]]
            out.append(point + shape if k == "Point" else line + count(ends[i + 1] - ends[i]) + shape)
        at += per_row[i]
    return pa.array(out, pa.string())


def _sizes(lists: pa.Array) -> list[int]:
    return pc.fill_null(pc.list_value_length(lists), 0).to_pylist()


def _hex_pairs(lists: pa.Array) -> tuple[str, list[int]]:
    """All points of lists of them as doubles in hex, 32 digits each, and how many points end with each list."""
    flat = lists.flatten()
    xy = np.empty((len(flat), 2), dtype="<f8")
    for n, name in enumerate(("lon_e7", "lat_e7")):
        xy[:, n] = np.asarray(flat.field(name).cast(pa.float64())) / 1e7
    return xy.tobytes().hex().upper(), np.cumsum([0, *_sizes(lists)]).tolist()


def assemble(ways: list[list[tuple[int, int, int]]]) -> list[list[list[Point]]] | None:
    """Polygons of the ways of a relation, or None if some ring stays open.

    ways: points (node id, lon, lat). Segments that are there twice cancel out. Ends are joined
    to rings at shared nodes; rings inside an even number of others are outer ones, and
    an inner ring belongs to the smallest outer one around it. Roles don't matter.
    """
    segments: dict[tuple[int, int], int] = {}
    where: dict[int, Point] = {}
    for way in ways:
        for node, lon, lat in way:
            where[node] = (lon, lat)
        for (a, *_), (b, *_) in zip(way, way[1:], strict=False):
            if a != b:
                segments[min(a, b), max(a, b)] = segments.get((min(a, b), max(a, b)), 0) + 1
    beside: dict[int, list[int]] = {}
    for (a, b), n in segments.items():
        if n % 2:
            beside.setdefault(a, []).append(b)
            beside.setdefault(b, []).append(a)
    if not beside or any(len(x) % 2 for x in beside.values()):
        return None
    rings: list[Ring] = []
    while beside:
        start = min(beside)
        path, seen = [start], {start: 0}
        while True:
            here = path[-1]
            step = min(beside[here])
            for a, b in ((here, step), (step, here)):
                beside[a].remove(b)
                if not beside[a]:
                    del beside[a]
            path.append(step)
            if step in seen:  # a ring is closed; what led to it stays open
                at = seen[step]
                rings.append(tuple(where[n] for n in path[at:]))
                for n in path[at + 1 : -1]:
                    seen.pop(n, None)
                path = path[: at + 1]
                if len(path) == 1:
                    break
            else:
                seen[step] = len(path) - 1
    rings = [r for r in rings if len(r) >= 4]
    if not rings:
        return None
    area = [abs(signed_area(r)) for r in rings]
    around = []
    for i, ring in enumerate(rings):
        holders = []
        for j, other in enumerate(rings):
            if i != j and area[j] > area[i]:
                edges = [(*a, *b) for a, b in zip(other, other[1:], strict=False)]
                points = np.array([p for p in ring[:-1] if p not in set(other)] or [((ring[0][0] + ring[1][0]) // 2, (ring[0][1] + ring[1][1]) // 2)])
                if contains_points(edges, points[:1, 0], points[:1, 1])[0]:
                    holders.append(j)
        around.append(holders)
    outer = [i for i in range(len(rings)) if len(around[i]) % 2 == 0]
    place = {i: [list(oriented(rings[i], True))] for i in outer}
    for i in range(len(rings)):
        if i not in outer:
            holders = [j for j in around[i] if j in outer]
            if holders:
                place[min(holders, key=lambda j: area[j])].append(list(oriented(rings[i], False)))
            else:  # rings that cross each other may hold one that no outer one does
                place[i] = [list(oriented(rings[i], True))]
    return [_from_least(p) for _, p in sorted(((min(rings[i]), p) for i, p in place.items()), key=lambda x: x[0])]


def _from_least(polygon: list[list[Point]]) -> list[list[Point]]:
    """Each ring begun at its least point."""
    out = []
    for ring in polygon:
        open_ = ring[:-1]
        at = open_.index(min(open_))
        out.append([*open_[at:], *open_[:at], open_[at]])
    return out
