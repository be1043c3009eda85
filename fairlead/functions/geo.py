"""Boxes, rings and distances to segments as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead.functions.units import num

Ring = list[tuple[float, float]]  # (lat, lon)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float], margin: float = 0.0) -> Column:
    """Inside lon_min, lat_min, lon_max, lat_max, edges included, shrunk by ``margin`` degrees."""
    west, south, east, north = box
    return lat.between(south + margin, north - margin) & lon.between(west + margin, east - margin)


def ring_edges(ring: Ring) -> Column:
    """A ring as an array of its edges, from each vertex to the one before it."""
    pairs = zip(ring, [ring[-1], *ring[:-1]], strict=True)
    return F.array(*[F.struct(*[F.lit(float(x)).alias(k) for x, k in zip((*a, *b), ("yi", "xi", "yj", "xj"), strict=True)]) for a, b in pairs])


def crosses(lat: Column, lon: Column, e: Column) -> Column:
    """Whether a ray to the east of the point meets the edge; false for an edge along the ray."""
    spans = (e["yi"] > lat) != (e["yj"] > lat)
    rise = F.when(spans, e["yj"] - e["yi"])
    return spans & (lon < (e["xj"] - e["xi"]) * (lat - e["yi"]) / rise + e["xi"])


def in_ring(lat: Column, lon: Column, edges: Column) -> Column:
    """Even-odd test against the edges of a ring."""
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != F.coalesce(crosses(lat, lon, e), F.lit(False)))


def in_any_ring(lat: Column, lon: Column, rings: list[Ring]) -> Column:
    """Whether any ring holds the point; rings whose box does not are not walked."""
    hit = F.lit(False)
    for r in rings:
        lats, lons = [p[0] for p in r], [p[1] for p in r]
        near = in_box(lat, lon, (min(lons), min(lats), max(lons), max(lats)))
        hit = hit | F.when(near, in_ring(lat, lon, ring_edges(r))).otherwise(F.lit(False))
    return hit


def in_any_box(lat: Column, lon: Column, boxes: list[tuple[float, float, float, float]]) -> Column:
    hit = F.lit(False)
    for b in boxes:
        hit = hit | in_box(lat, lon, b)
    return hit


def segment_distance_nm(lat: Column, lon: Column, e: Column, ref_lat: float) -> Column:
    """Distance to the nearest point of an edge, on the plane around ``ref_lat``."""
    k = 60.0 * F.cos(F.radians(num(ref_lat)))
    px, py, ax, ay = lon * k, lat * 60.0, e["xi"] * k, e["yi"] * 60.0
    dx, dy = e["xj"] * k - ax, e["yj"] * 60.0 - ay
    length = dx * dx + dy * dy
    along = ((px - ax) * dx + (py - ay) * dy) / F.when(length == 0, 1e-9).otherwise(length)
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(px - (ax + dx * u), py - (ay + dy * u))


def land_distance_nm(lat: Column, lon: Column, rings: list[Ring], ref_lat: float = 42.3) -> Column:
    edges = F.concat(*[ring_edges(r) for r in rings])
    return F.array_min(F.transform(edges, lambda e: segment_distance_nm(lat, lon, e, ref_lat)))


def shelf_depth_m(lat: Column, lon: Column, to_land_nm: Column) -> Column:
    """Depth that grows with the distance to land, at least 12 m, up to a cap by region."""
    cap = (
        F.when((lat > 41.15) & (lat < 41.55) & (lon > 8.80) & (lon < 9.80), 110.0)
        .when((lat > 42.4) & (lon > 9.4), 480.0).when((lat <= 42.4) & (lon > 9.6), 1250.0).otherwise(2600.0))
    return F.least(cap, F.greatest(F.lit(12.0), F.pow(to_land_nm, 1.25) * 95.0))


def parse_dms(text: Column) -> Column:
    """Decimal degrees of text such as 43°33'00"N; null where it has another form."""
    form = r"^\s*(\d+)\D+(\d+)\D+(\d+(?:\.\d+)?)\D*([NSEW])\s*$"
    part = lambda i: F.regexp_extract(text, form, i)
    value = lambda i: F.nullif(part(i), F.lit("")).cast("double")
    degrees = value(1) + value(2) / 60.0 + value(3) / 3600.0
    return F.when(part(4).isin("S", "W"), -degrees).otherwise(degrees)
