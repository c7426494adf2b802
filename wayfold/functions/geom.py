"""Plane and globe geometry as column expressions.

Points are two columns, boxes four (xmin, xmax, ymin, ymax), rings are arrays of (x, y) structs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6373.0
MEAN_EARTH_KM = 6371.009

# WGS84 ellipsoid and the universal transverse Mercator grid.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0

_N = WGS84_F / (2.0 - WGS84_F)
_RECTIFYING = WGS84_A / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)
# Krüger series coefficients to third order in the third flattening (sub-millimetre inside a zone).
_ALPHA = (
    _N / 2.0 - 2.0 * _N**2 / 3.0 + 5.0 * _N**3 / 16.0,
    13.0 * _N**2 / 48.0 - 3.0 * _N**3 / 5.0,
    61.0 * _N**3 / 240.0,
)
_BETA = (
    _N / 2.0 - 2.0 * _N**2 / 3.0 + 37.0 * _N**3 / 96.0,
    _N**2 / 48.0 + _N**3 / 15.0,
    17.0 * _N**3 / 480.0,
)
_DELTA = (
    2.0 * _N - 2.0 * _N**2 / 3.0 - 2.0 * _N**3,
    7.0 * _N**2 / 3.0 - 8.0 * _N**3 / 5.0,
    56.0 * _N**3 / 15.0,
)


def utm_zone(lat: Column, lon: Column) -> Column:
    """Zone number, NULL outside the latitudes the grid covers."""
    return F.when(lat.between(-80, 84), (F.floor((lon + 180.0) / 6.0) + 1).cast("int"))


def utm_epsg(lat: Column, lon: Column) -> Column:
    """EPSG code of the zone: 326xx in the north, 327xx in the south, NULL outside -80..84."""
    return utm_zone(lat, lon) + F.when(lat >= 0, 32600).otherwise(32700)


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing (metres) of a geographic point in the given zone."""
    phi = F.radians(lat)
    lam = F.radians(lon - (zone * 6 - 183))
    e = 2.0 * math.sqrt(_N) / (1.0 + _N)
    conformal = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi = F.atan2(conformal, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1.0 + conformal * conformal))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        north = north + a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    offset = F.when(lat >= 0, 0.0).otherwise(UTM_FALSE_NORTHING_SOUTH)
    return (
        UTM_FALSE_EASTING + UTM_SCALE * _RECTIFYING * east,
        offset + UTM_SCALE * _RECTIFYING * north,
    )


def from_utm(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude (degrees) of a grid point."""
    offset = F.when(south, UTM_FALSE_NORTHING_SOUTH).otherwise(0.0)
    xi = (northing - offset) / (UTM_SCALE * _RECTIFYING)
    eta = (easting - UTM_FALSE_EASTING) / (UTM_SCALE * _RECTIFYING)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - b * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
        eta1 = eta1 - b * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2.0 * j * chi)
    lon = F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + (zone * 6 - 183)
    return lon, F.degrees(lat)


def dist_euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def dist_haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius_km: float = EARTH_KM) -> Column:
    """Great-circle kilometres, on a sphere of 6373 km unless another is given."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    half = F.pow(F.sin(dlat / 2.0), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2.0), 2.0)
    return radius_km * 2.0 * F.asin(F.sqrt(half))


def dist_point_box(x: Column, y: Column, xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """Distance to the nearest point of a box, 0 inside."""
    dx = F.greatest(xmin - x, F.lit(0.0), x - xmax)
    dy = F.greatest(ymin - y, F.lit(0.0), y - ymax)
    return F.sqrt(dx * dx + dy * dy)


def box_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area shared by two boxes given as (xmin, xmax, ymin, ymax)."""
    width = F.least(a[1], b[1]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[2], b[2])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a ring, closed if it is open."""
    return F.transform(
        ring, lambda v, i: F.struct(v.alias("a"), F.element_at(ring, (i + 1) % F.size(ring) + 1).alias("b"))
    )


def shoelace(ring: Column) -> Column:
    """Signed ring area (positive when counter-clockwise)."""
    return F.aggregate(
        ring_edges(ring), F.lit(0.0), lambda s, e: s + (e.a.x * e.b.y - e.b.x * e.a.y) / 2.0
    )


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid of a ring."""
    cross = lambda e: e.a.x * e.b.y - e.b.x * e.a.y
    area6 = shoelace(ring) * 6.0
    cx = F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + (e.a.x + e.b.x) * cross(e)) / area6
    cy = F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + (e.a.y + e.b.y) * cross(e)) / area6
    return cx, cy


def ring_is_valid(ring: Column) -> Column:
    """At least three distinct vertices and a non-zero area."""
    return (F.size(F.array_distinct(ring)) >= 3) & (F.abs(shoelace(ring)) > 0)


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Crossing-number test (half-open on edges)."""

    def crosses(e: Column) -> Column:
        straddles = (e.a.y > y) != (e.b.y > y)
        at = e.a.x + (y - e.a.y) / (e.b.y - e.a.y) * (e.b.x - e.a.x)
        return F.when(straddles & (x < at), 1).otherwise(0)

    return F.aggregate(ring_edges(ring), F.lit(0), lambda s, e: s + crosses(e)) % 2 == 1


def nearest_on_edges(x: Column, y: Column, edges: Column) -> Column:
    """(d, x, y): distance to the nearest of some edges (a, b) and the spot on it; NULL if there are none."""

    def to_segment(e: Column) -> Column:
        dx, dy = e.b.x - e.a.x, e.b.y - e.a.y
        length2 = dx * dx + dy * dy
        t = F.when(
            length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e.a.x) * dx + (y - e.a.y) * dy) / length2))
        ).otherwise(0.0)
        px, py = e.a.x + t * dx, e.a.y + t * dy
        return F.struct(dist_euclid(x, y, px, py).alias("d"), px.alias("x"), py.alias("y"))

    return F.array_min(F.transform(edges, to_segment))


def dist_point_edges(x: Column, y: Column, edges: Column) -> Column:
    """Distance from a point to the nearest of some edges (a, b); NULL if there are none."""
    return nearest_on_edges(x, y, edges).d


def dist_point_ring(x: Column, y: Column, ring: Column) -> Column:
    """Distance from a point to the nearest edge of a ring (not 0 inside)."""
    return dist_point_edges(x, y, ring_edges(ring))


def box_ring(xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax))


def circle_ring(lat: Column, lon: Column, radius_km: Column, segments: int = 36) -> Column:
    """Closed great-circle ring of `segments` + 1 (lat, lon) points, clockwise from north."""
    angular = radius_km / F.lit(MEAN_EARTH_KM)
    phi, lam = F.radians(lat), F.radians(lon)

    def at(i: Column) -> Column:
        bearing = F.radians(i * F.lit(360.0 / segments))
        lat2 = F.asin(F.sin(phi) * F.cos(angular) + F.cos(phi) * F.sin(angular) * F.cos(bearing))
        lon2 = lam + F.atan2(
            F.sin(bearing) * F.sin(angular) * F.cos(phi), F.cos(angular) - F.sin(phi) * F.sin(lat2)
        )
        return F.struct(F.degrees(lat2).alias("lat"), F.degrees(lon2).alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(segments)), at)


def segment_hits_box(
    x1: Column, y1: Column, x2: Column, y2: Column, xmin: Column, xmax: Column, ymin: Column, ymax: Column
) -> Column:
    """Slab test: does the segment touch the closed box?"""

    def slab(p: Column, q: Column, low: Column, high: Column) -> tuple[Column, Column]:
        d = q - p
        inside = (p >= low) & (p <= high)
        enter = F.when(d == 0, F.when(inside, F.lit(0.0)).otherwise(2.0)).otherwise(
            F.least(F.try_divide(low - p, d), F.try_divide(high - p, d))
        )
        leave = F.when(d == 0, F.when(inside, F.lit(1.0)).otherwise(-1.0)).otherwise(
            F.greatest(F.try_divide(low - p, d), F.try_divide(high - p, d))
        )
        return enter, leave

    ex, lx = slab(x1, x2, xmin, xmax)
    ey, ly = slab(y1, y2, ymin, ymax)
    return F.greatest(ex, ey, F.lit(0.0)) <= F.least(lx, ly, F.lit(1.0))


def bound(value: Column, body) -> Column:
    """`body(value)` with the value computed once: a lambda has no memory for what it repeats."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ring(x1: Column, y1: Column, x2: Column, y2: Column, half: float) -> Column:
    """Ring of the points within `half` across a segment, as far beyond its ends (square caps); corners are NULL where the ends are one point."""
    length = dist_euclid(x1, y1, x2, y2)
    ux, uy = F.try_divide(x2 - x1, length) * half, F.try_divide(y2 - y1, length) * half
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(
        corner(x1 - ux + uy, y1 - uy - ux), corner(x2 + ux + uy, y2 + uy - ux), corner(x2 + ux - uy, y2 + uy + ux), corner(x1 - ux - uy, y1 - uy + ux)
    )


def z_order(x: Column, y: Column, size: float) -> Column:
    """Position along a Z-shaped curve through cells of `size`: near places mostly have near positions. Beyond 2^31 cells positions repeat."""

    def spread(c: Column) -> Column:
        bits = F.floor(c / size).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
        return bits

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))
