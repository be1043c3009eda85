"""Land, no-go areas and depth for tables of points."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.functions import geo
from fairlead.functions.units import distance_nm
from fairlead.operators.clipping import ring_edges, shapes
from fairlead.operators.cut import cut

#: Degrees of the tiles by which points and rings meet.
TILE = 0.25


@dataclass(frozen=True)
class Waters:
    """Rings of land and of no-go areas, and boxes of no-go areas, small enough to stand in an expression."""

    land: list[geo.Ring]
    nogo_boxes: list[tuple[float, float, float, float]] = field(default_factory=list)
    nogo_rings: list[geo.Ring] = field(default_factory=list)
    ref_lat: float = 42.3

    def is_land(self, lat: Column, lon: Column) -> Column:
        return geo.in_any_ring(lat, lon, self.land)

    def is_nogo(self, lat: Column, lon: Column) -> Column:
        return geo.in_any_box(lat, lon, self.nogo_boxes) | geo.in_any_ring(lat, lon, self.nogo_rings)

    def is_navigable(self, lat: Column, lon: Column) -> Column:
        return ~(self.is_land(lat, lon) | self.is_nogo(lat, lon))

    def depth_m(self, lat: Column, lon: Column) -> Column:
        return geo.shelf_depth_m(lat, lon, geo.land_distance_nm(lat, lon, self.land, self.ref_lat))

    def described(self, points: DataFrame, lat: str = "lat_deg", lon: str = "lon_deg", depth: bool = True) -> DataFrame:
        """``points`` with is_navigable and, if asked for, depth_m; waters kept as tables (``sources.geography.Chart``) have the same."""
        at = F.col(lat), F.col(lon)
        return points.withColumns({"is_navigable": self.is_navigable(*at), **({"depth_m": self.depth_m(*at)} if depth else {})})


def edge_table(spark: SparkSession, rings: dict[int, geo.Ring]) -> DataFrame:
    """ring, yi, xi, yj, xj: the edges of every ring."""
    rows = [(i, *map(float, (*a, *b))) for i, r in rings.items() for a, b in zip(r, [r[-1], *r[:-1]], strict=True)]
    return spark.createDataFrame(rows, "ring int, yi double, xi double, yj double, xj double")


def tiles(lat: Column, lon: Column) -> dict[str, Column]:
    return {"_ty": F.floor(lat / TILE).cast("int"), "_tx": F.floor(lon / TILE).cast("int")}


def strips(edges: DataFrame) -> DataFrame:
    """``edges(ring, yi, xi, yj, xj)`` -> ring, height, strip, yi, xi, yj, xj: each edge in every strip of latitude that it reaches.

    A ring's strips are twice as high as its edges are on average, so there are at most three rows an edge or so, and
    a point meets about as many edges as its parallel crosses, however long the ring is.  Level edges are crossed by no parallel.
    """
    rise = F.abs(F.col("yi") - F.col("yj"))
    heights = edges.groupBy("ring").agg(F.greatest(2.0 * F.avg(rise), (F.max("yi") - F.min("yi")) / 1e6, F.lit(1e-9)).alias("height"))
    tall = edges.where("yi <> yj").join(heights, "ring")
    at = lambda pick: F.floor(pick("yi", "yj") / F.col("height"))
    return tall.withColumn("strip", F.explode(F.sequence(at(F.least), at(F.greatest))))


def ring_tiles(edges: DataFrame) -> DataFrame:
    """ring, height, _ty, _tx: the tiles that the box of each ring of ``strips`` reaches."""
    box = edges.groupBy("ring", "height").agg(*[f(c1, c2).alias(n) for n, f, c1, c2 in (
        ("s", lambda a, b: F.min(F.least(a, b)), "yi", "yj"), ("n", lambda a, b: F.max(F.greatest(a, b)), "yi", "yj"),
        ("w", lambda a, b: F.min(F.least(a, b)), "xi", "xj"), ("e", lambda a, b: F.max(F.greatest(a, b)), "xi", "xj"))])
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / TILE).cast("int"), F.floor(F.col(b) / TILE).cast("int")))
    return box.withColumn("_ty", span("s", "n")).withColumn("_tx", span("w", "e")).select("ring", "height", "_ty", "_tx")


def rings_at(points: DataFrame, edges: DataFrame, key: str | list[str] = "point_id") -> DataFrame:
    """``points(<key>, lat_deg, lon_deg)`` and ``edges`` from ``edge_table`` -> (key, ring) of every ring that holds a point."""
    cut_up = strips(edges)
    return rings_by_strip(points, cut_up, ring_tiles(cut_up), key)


def rings_of_places(points: DataFrame, rings: DataFrame, key: str) -> DataFrame:
    """As ``rings_at`` for ``rings(ring, points)``, each different place tested once against each different shape.

    What is tested grows with the places and shapes; only the rows returned are one for each point and ring.  Both tables of what was found are written first, so that small ones go to the points and these stay where they are.
    """
    place, different = ["lat_deg", "lon_deg"], cut(shapes(rings))
    held = rings_at(points.select(*place).distinct(), ring_edges(different), place).withColumnRenamed("ring", "_shape")
    same = rings.join(different.withColumnRenamed("ring", "_shape"), "points").select("_shape", "ring")
    return points.select(key, *place).join(cut(held), place).join(cut(same), "_shape").select(key, "ring")


def rings_by_strip(points: DataFrame, cut_up: DataFrame, near: DataFrame, key: str | list[str] = "point_id") -> DataFrame:
    """As ``rings_at``, for coastlines too large for an expression: ``cut_up`` is from ``strips`` and ``near`` from ``ring_tiles``.

    Points meet a ring only in the tiles of its box, and of its edges those in their own strip of latitude, two
    equi-joins; the crossings are counted for each point and ring.
    """
    key = [key] if isinstance(key, str) else key
    at = {"_lat": F.col("lat_deg"), "_lon": F.col("lon_deg")}
    placed = points.select(*key, *[c.alias(k) for k, c in at.items()]).withColumns(tiles(F.col("_lat"), F.col("_lon"))).join(near, ["_ty", "_tx"])
    placed = placed.withColumn("strip", F.floor(F.col("_lat") / F.col("height"))).drop("height", "_ty", "_tx")
    met = placed.join(cut_up, ["ring", "strip"]).where(F.coalesce(geo.crosses(F.col("_lat"), F.col("_lon"), F.struct("yi", "xi", "yj", "xj")), F.lit(False)))
    return met.groupBy(*key, "ring").agg(F.count("*").alias("n")).where("n % 2 = 1").select(*key, "ring")


def rasterise(grid: DataFrame, waters: Waters) -> DataFrame:
    """Grid cells (iy, ix, lat_deg, lon_deg) with is_land of their centres."""
    return grid.withColumn("is_land", waters.is_land(F.col("lat_deg"), F.col("lon_deg")))


def mask_land(grid: DataFrame, fields: list[str], waters: Waters) -> DataFrame:
    """Fields are NaN on land at every time."""
    land = waters.is_land(F.col("lat_deg"), F.col("lon_deg"))
    marked = grid.withColumn("_land", land)
    return marked.withColumns({f: F.when(F.col("_land"), F.lit(float("nan"))).otherwise(F.col(f)) for f in fields}).drop("_land")


def water_fraction(places: DataFrame, dlat: float, dlon: float, waters: Waters, n: int = 9) -> DataFrame:
    """``places(iy, ix, lat_deg, lon_deg)`` with the share of n x n points of the cell that are water."""
    part = lambda c: F.expr(f"{c} / {float(n - 1)} - 0.5")
    side = F.sequence(F.lit(0), F.lit(n - 1))
    spots = places.withColumn("_sy", F.explode(side)).withColumn("_sx", F.explode(side))
    lat, lon = F.col("lat_deg") + part("_sy") * abs(dlat), F.col("lon_deg") + part("_sx") * abs(dlon)
    wet = spots.select("iy", "ix", "lat_deg", "lon_deg", (~waters.is_land(lat, lon)).cast("double").alias("wet"))
    return wet.groupBy("iy", "ix", "lat_deg", "lon_deg").agg(F.avg("wet").alias("water"))


def fill_sources(grid: DataFrame, water: DataFrame, value: str, ref_lat: float, least_water: float = 0.5, most_nm: float = 60.0) -> DataFrame:
    """iy, ix, jy, jx, nm: for each watery cell that is missing at all times the nearest cell with values.

    Cells within ``most_nm`` of each other meet in tiles of that size, an equi-join; ties go to the smaller (jy, jx).
    Validity is judged at time 0.
    """
    state = grid.groupBy("iy", "ix").agg(
        F.first("lat_deg").alias("lat_deg"), F.first("lon_deg").alias("lon_deg"),
        F.bool_or((F.col("it") == 0) & ~F.isnan(value)).alias("valid"), F.bool_and(F.isnan(value)).alias("empty"))
    size = most_nm / 60.0
    wide = size / max(math.cos(math.radians(ref_lat)), 1e-3)  # as the distance shrinks longitudes by the reference latitude's cosine
    valid = state.where("valid").select(F.col("iy").alias("jy"), F.col("ix").alias("jx"), F.col("lat_deg").alias("jlat"), F.col("lon_deg").alias("jlon"),
                                        F.floor(F.col("lat_deg") / size).alias("_ty"), F.floor(F.col("lon_deg") / wide).alias("_tx"))
    need = state.where("empty and not valid").join(water.where(F.col("water") >= least_water).select("iy", "ix"), ["iy", "ix"])
    around = lambda c, s: F.explode(F.sequence(F.floor(F.col(c) / s) - 1, F.floor(F.col(c) / s) + 1))
    need = need.withColumn("_ty", around("lat_deg", size)).withColumn("_tx", around("lon_deg", wide))
    nm = distance_nm(F.col("lat_deg"), F.col("lon_deg"), F.col("jlat"), F.col("jlon"), ref_lat)
    near = need.join(valid, ["_ty", "_tx"]).withColumn("nm", nm).where(F.col("nm") <= most_nm)
    best = near.groupBy("iy", "ix").agg(F.min(F.struct("nm", "jy", "jx")).alias("b"))
    return best.select("iy", "ix", "b.jy", "b.jx", "b.nm")


def coastal_fill(grid: DataFrame, water: DataFrame, fields: list[str], ref_lat: float, **limits: float) -> DataFrame:
    """``grid(it, iy, ix, lat_deg, lon_deg, fields)`` with each filled cell's whole series copied from its source."""
    sources = fill_sources(grid, water, fields[0], ref_lat, **limits)
    given = grid.select("it", F.col("iy").alias("jy"), F.col("ix").alias("jx"), *[F.col(f).alias(f"_{f}") for f in fields])
    copied = sources.join(given, ["jy", "jx"]).select("it", "iy", "ix", F.lit(True).alias("filled"), *[f"_{f}" for f in fields])
    out = grid.join(copied, ["it", "iy", "ix"], "left")
    out = out.withColumns({f: F.when(F.col("filled"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields})
    return out.withColumn("filled", F.coalesce("filled", F.lit(False))).drop(*[f"_{f}" for f in fields])


def ports_within(ports: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """``ports(pos, port_name, port_number, latitude, longitude)`` in degrees, minutes, seconds -> slug, lat_deg, lon_deg.

    Ports whose position cannot be read go.  Of equal slugs the first by ``pos`` keeps it, others add their number.
    """
    read = ports.withColumns({"lat_deg": geo.parse_dms(F.col("latitude")), "lon_deg": geo.parse_dms(F.col("longitude"))})
    inside = read.where(geo.in_box(F.col("lat_deg"), F.col("lon_deg"), box))
    slug = F.trim(F.regexp_replace(F.lower(F.trim("port_name")), "[^a-z0-9]+", "_"), F.lit("_"))
    named = inside.withColumn("slug", slug).withColumn("_n", F.row_number().over(Window.partitionBy("slug").orderBy("pos")))
    return named.select(
        F.when(F.col("_n") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", F.col("port_number").cast("string"))).alias("slug"),
        "lat_deg", "lon_deg")
