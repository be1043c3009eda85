"""Rings cut to a box (S20): rings that miss it go, rings inside stay, others lose a half-plane in each of four passes.

A ring is an array of (lat, lon) points in one row, closed from its last point to its first.  A pass keeps the points on the
right side of one edge of the box and puts a point wherever the ring crosses it.  A ring that leaves the box and comes back
stays one ring, joined along the box's edge; areas and even-odd tests inside are those of its pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.operators.cut import computed

Box = tuple[float, float, float, float]  # lon_min, lat_min, lon_max, lat_max


def _half_plane(points: Column, axis: str, limit: float, upper: bool) -> Column:
    """``points`` without what lies beyond ``limit`` of ``axis``."""
    other = "lat" if axis == "lon" else "lon"
    keeps = lambda p: p[axis] <= limit if upper else p[axis] >= limit
    n = F.size(points)

    def step(p: Column, i: Column) -> Column:
        q = F.get(points, F.pmod(i - 1, n))  # the point before
        share = (F.lit(limit) - q[axis]) / (p[axis] - q[axis])
        made = {axis: F.lit(limit), other: q[other] + (p[other] - q[other]) * share}
        crossing = F.struct(made["lat"].alias("lat"), made["lon"].alias("lon"))
        none = F.slice(points, 1, 0)
        return F.when(keeps(p), F.when(keeps(q), F.array(p)).otherwise(F.array(crossing, p))).otherwise(F.when(keeps(q), F.array(crossing)).otherwise(none))

    return F.flatten(F.transform(points, step))


def clip_rings(rings: DataFrame, box: Box) -> DataFrame:
    """``rings(..., points array<struct<lat double, lon double>>)`` cut to ``box``; those of which nothing or only a line is left go.

    Rings with a null or empty array go.  Points on the box's edge belong to it.
    """
    west, south, east, north = box
    side = lambda pick, axis: pick(F.transform("points", lambda p: p[axis]))
    ends = {"_w": side(F.array_min, "lon"), "_e": side(F.array_max, "lon"), "_s": side(F.array_min, "lat"), "_n": side(F.array_max, "lat")}
    c = F.col
    near = computed(rings.where("size(points) > 2"), ends).where((c("_w") <= east) & (c("_e") >= west) & (c("_s") <= north) & (c("_n") >= south))
    within = (c("_w") >= west) & (c("_e") <= east) & (c("_s") >= south) & (c("_n") <= north)
    marked = computed(near, {"_within": within}).drop(*ends)
    for axis, limit, upper in (("lon", west, False), ("lon", east, True), ("lat", south, False), ("lat", north, True)):
        cut_off = F.when(c("_within"), c("points")).otherwise(_half_plane(c("points"), axis, float(limit), upper))
        marked = computed(marked, {"_points": cut_off}).drop("points").withColumnRenamed("_points", "points")
    return marked.where(ring_area(c("points")) > 0).drop("_within").select(rings.columns)


def ring_area(points: Column) -> Column:
    """Area of a ring in square degrees."""
    n = F.size(points)
    parts = F.transform(points, lambda p, i: F.get(points, F.pmod(i - 1, n))["lon"] * p["lat"] - p["lon"] * F.get(points, F.pmod(i - 1, n))["lat"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)) / 2.0


def shapes(rings: DataFrame) -> DataFrame:
    """``rings(ring, points)`` -> the same with one row for each different ``points``, that of the smallest ring."""
    return rings.groupBy("points").agg(F.min("ring").alias("ring")).select("ring", "points")


def ring_edges(rings: DataFrame, *keep: str) -> DataFrame:
    """``rings(ring, points)`` as rows of edges, as ``spatial.edge_table`` has them: from each point to the one before it."""
    rows = rings.where("size(points) > 2").select("ring", *keep, "points", F.posexplode("points").alias("i", "p"))
    q = F.get("points", F.pmod(F.col("i") - 1, F.size("points")))
    return rows.select("ring", *keep, F.col("p.lat").alias("yi"), F.col("p.lon").alias("xi"), q["lat"].alias("yj"), q["lon"].alias("xj"))
