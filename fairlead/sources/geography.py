"""Coastlines, zones and depth grids from files, and the checks between them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.grid import fraction, nearest_index
from fairlead.operators.cut import cut
from fairlead.operators.interp import Axes, cells, sample
from fairlead.operators.spatial import ring_tiles, rings_by_strip, strips
from fairlead.sources.gridfile import grid_entries, grid_shapes, read_slices

_POINTS = "array<array<double>>"
#: Lines of latitude of a depth grid that a task reads.
LINES = 64


def read_rings(spark: SparkSession, coastlines: list[str] = (), zones: list[str] = ()) -> DataFrame:
    """kind ("land" or "zone"), ring, yi, xi, yj, xj: the edges of all rings of coastline files and of no-go and separation zone files.

    Coastlines list ``polygons`` and zones ``zones`` with a ``polygon`` each, of (latitude, longitude) pairs.
    """
    parts = []
    for kind, paths, schema, ring in (
            ("land", coastlines, f"polygons array<{_POINTS}>", "polygons"), ("zone", zones, f"zones array<struct<polygon: {_POINTS}>>", "zones.polygon")):
        if paths:
            found = spark.read.schema(schema).json(list(paths), multiLine=True).withColumn("file", F.input_file_name())
            parts.append(found.select(F.lit(kind).alias("kind"), "file", F.posexplode(ring).alias("n", "points")))
    if not parts:
        return spark.createDataFrame([], "kind string, ring long, yi double, xi double, yj double, xj double")
    rings = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    edges = rings.select("kind", F.xxhash64("kind", "file", "n").alias("ring"), "points", F.explode(F.sequence(F.lit(0), F.size("points") - 1)).alias("i"))
    a, b = F.get("points", F.col("i")), F.get("points", F.pmod(F.col("i") - 1, F.size("points")))  # to the vertex before, the last for the first
    return edges.select("kind", "ring", a[0].alias("yi"), a[1].alias("xi"), b[0].alias("yj"), b[1].alias("xj"))


def read_depths(spark: SparkSession, path: str) -> tuple[DataFrame, Axes, bool]:
    """(iy, ix, elevation_m, is_land), axes and whether the file has a land raster, of one npz grid: one row a cell, LINES lines of latitude a task.

    The driver reads the axes only.  Without a raster is_land is null.
    """
    at, raster = grid_entries(path, 0), "land_mask" in grid_shapes(path)
    axes = Axes((float(at["lat0"]), float(at["dlat"]), int(at["nlat"])), (float(at["lon0"]), float(at["dlon"]), int(at["nlon"])))

    def lines(batches):
        import pandas as pd

        for pdf in batches:
            for block in pdf["id"]:
                heights = read_slices(path, "elevation_m", block * LINES, LINES).astype(float)
                iy, ix = np.indices(heights.shape)
                land = read_slices(path, "land_mask", block * LINES, LINES).astype(bool).ravel() if raster else [None] * heights.size
                yield pd.DataFrame({"iy": iy.ravel() + block * LINES, "ix": ix.ravel(), "elevation_m": heights.ravel(), "is_land": land})

    blocks = -(-axes.lat[2] // LINES)
    rows = spark.range(0, blocks, 1, blocks).mapInPandas(lines, "iy int, ix int, elevation_m double, is_land boolean")
    return rows, axes, raster


def covered(axes: Axes) -> tuple[float, float, float, float]:
    """lon_min, lat_min, lon_max, lat_max of a grid: half a step beyond its outer lines."""
    ends = []
    for first, step, n in (axes.lon, axes.lat):
        a, b = first - step / 2, first + step * (n - 1) + step / 2
        ends.append((min(a, b), max(a, b)))
    (west, east), (south, north) = ends
    return west, south, east, north


def in_bounds(lat: Column, lon: Column, axes: Axes) -> Column:
    """Whether the grid covers a point, edges included."""
    return geo.in_box(lat, lon, covered(axes))


def check_box(axes: Axes, box: tuple[float, float, float, float]) -> None:
    """ValueError unless the grid covers a pack's box to within half a step on every side."""
    half = (abs(axes.lon[1]) / 2, abs(axes.lat[1]) / 2) * 2
    if any(abs(a - b) > h for a, b, h in zip(covered(axes), box, half, strict=True)):
        raise ValueError(f"box {tuple(box)} is not what the grid covers: {tuple(round(x, 4) for x in covered(axes))}")


@dataclass(frozen=True)
class Chart:
    """Waters kept as tables, of any size: what legs, lattices and plans ask of ``spatial.Waters`` they may ask of a chart.

    Land is that of the nearest cell of the raster, or of the coastline where the grid has none; zones and boxes, these with
    their edges, are no-go areas; depth is interpolated, 0 on heights.  A point outside the grid fails.
    """

    edges: DataFrame  # kind, and the columns of ``spatial.strips``
    near: DataFrame  # kind, and the columns of ``spatial.ring_tiles``
    cells: DataFrame  # corners of elevation_m and the land raster of each cell
    axes: Axes
    raster: bool
    ref_lat: float
    nogo_boxes: tuple[tuple[float, float, float, float], ...] = ()

    @classmethod
    def of(cls, edges: DataFrame, depths: DataFrame, axes: Axes, raster: bool, ref_lat: float = 42.3, nogo_boxes: tuple = ()) -> Chart:
        """``edges`` from ``read_rings`` and ``depths`` from ``read_depths``, prepared once for all later questions."""
        kinds = edges.select("kind", "ring").distinct()
        cut_up = cut(strips(edges))
        near = cut(ring_tiles(cut_up).join(kinds, "ring"))
        grid = cells(depths.withColumn("it", F.lit(0)), ["elevation_m"], axes).join(depths.select("iy", "ix", "is_land"), ["iy", "ix"])
        return cls(cut_up, near, cut(grid), axes, raster, ref_lat, tuple(nogo_boxes))

    @classmethod
    def read(cls, spark: SparkSession, coastlines: list[str], zones: list[str], depths: str, box: tuple[float, float, float, float] | None = None,
             ref_lat: float = 42.3) -> Chart:
        """The chart of a pack's files; with ``box`` the grid must cover it and no more, to within half a step."""
        table, axes, raster = read_depths(spark, depths)
        if box is not None:
            check_box(axes, box)
        return cls.of(read_rings(spark, coastlines, zones), table, axes, raster, ref_lat)

    def _inside(self, points: DataFrame, kind: str, key: list[str]) -> DataFrame:
        of = lambda t: t.where(F.col("kind") == kind).drop("kind")
        return rings_by_strip(points, of(self.edges), of(self.near), key).select(*key).distinct()

    def features(self, points: DataFrame) -> DataFrame:
        """lat_deg, lon_deg, is_land, is_nogo, is_navigable, depth_m of every distinct place of ``points(lat_deg, lon_deg, ...)``.

        Places meet rings by tiles and strips, and cells by equi-joins, so no side needs to be small.
        """
        key, at = ["lat_deg", "lon_deg"], (F.col("lat_deg"), F.col("lon_deg"))
        own = points.select(*key).distinct()
        outside = F.raise_error(F.concat(F.lit("no geography covers "), at[0].cast("string"), F.lit(", "), at[1].cast("string"))).cast("double")
        held = own.withColumn("t_h", F.when(in_bounds(*at, self.axes), 0.0).otherwise(outside))
        deep = sample(held, self.cells, self.axes, masked=[], plain=["elevation_m"])
        deep = deep.where(F.col("t_h") == 0.0).drop("t_h")
        if self.raster:
            nearest = {"iy": nearest_index(fraction(at[0], *self.axes.lat), self.axes.lat[2]), "ix": nearest_index(fraction(at[1], *self.axes.lon), self.axes.lon[2])}
            deep = deep.withColumns(nearest).join(self.cells.select("iy", "ix", F.col("is_land").alias("_land")), ["iy", "ix"], "left").drop("iy", "ix")
        else:
            deep = deep.join(self._inside(own, "land", key).withColumn("_land", F.lit(True)), key, "left")
        found = deep.join(self._inside(own, "zone", key).withColumn("_zone", F.lit(True)), key, "left").select(
            *key, F.coalesce("_land", F.lit(False)).alias("is_land"), (F.coalesce("_zone", F.lit(False)) | geo.in_any_box(*at, self.nogo_boxes)).alias("is_nogo"),
            F.greatest(F.lit(0.0), -F.col("elevation_m")).alias("depth_m"))
        return found.withColumn("is_navigable", ~(F.col("is_land") | F.col("is_nogo")))

    def described(self, points: DataFrame, lat: str = "lat_deg", lon: str = "lon_deg", depth: bool = True) -> DataFrame:
        """``points`` with is_navigable and, if asked for, depth_m, worked out once for each distinct place."""
        found = self.features(points.select(F.col(lat).alias("lat_deg"), F.col(lon).alias("lon_deg")))
        wanted = ["is_navigable", *(["depth_m"] if depth else [])]
        return points.join(found.select(F.col("lat_deg").alias(lat), F.col("lon_deg").alias(lon), *wanted), [lat, lon])


def describe(points: DataFrame, edges: DataFrame, depths: DataFrame, axes: Axes, raster: bool) -> DataFrame:
    """``points(lat_deg, lon_deg, ...)`` with is_land, is_nogo, depth_m and is_navigable of a chart made for them."""
    return points.join(Chart.of(edges, depths, axes, raster).features(points), ["lat_deg", "lon_deg"])
