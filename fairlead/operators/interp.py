"""Sampling of gridded fields by equi-joins on a table of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.grid import CORNERS, bilinear, bilinear_masked, fraction, weights
from fairlead.functions.units import null_if_nan, speed_and_origin

#: Fields of a weather grid; the wind is not masked, so a missing corner makes it missing.
MASKED = ["hs_m", "period_peak_s", "period_mean_s", "current_u_ms", "current_v_ms", "wave_u", "wave_v"]
PLAIN = ["wind_u_ms", "wind_v_ms"]


class Axes:
    """First value, step and number of grid lines of latitude, longitude and time."""

    def __init__(self, lat: tuple[float, float, int], lon: tuple[float, float, int], hours: tuple[float, float, int] = (0.0, 1.0, 1)) -> None:
        self.lat, self.lon, self.hours = lat, lon, hours


def wave_vectors(grid: DataFrame) -> DataFrame:
    """The wave direction as a unit vector, which can be interpolated."""
    to = F.radians(F.col("wave_from_deg") + 180.0)
    return grid.withColumns({"wave_u": F.sin(to), "wave_v": F.cos(to)})


def cells(grid: DataFrame, fields: list[str], axes: Axes) -> DataFrame:
    """``grid(it, iy, ix, fields)`` -> one row for each cell and time with a field's four corners in columns f_00 .. f_11.

    Three equi-joins of the grid with itself; the last line of an axis is its own neighbour.  Written once for each
    grid, it is read by every later sample.
    """
    ny, nx = axes.lat[2], axes.lon[2]
    base = grid.select("it", "iy", "ix", *[F.col(f).alias(f"{f}_00") for f in fields]).withColumns(
        {"iy1": F.least(F.col("iy") + 1, F.lit(ny - 1)), "ix1": F.least(F.col("ix") + 1, F.lit(nx - 1))})
    for name, y, x in (("10", "iy1", "ix"), ("01", "iy", "ix1"), ("11", "iy1", "ix1")):
        side = grid.select("it", F.col("iy").alias("_y"), F.col("ix").alias("_x"), *[F.col(f).alias(f"{f}_{name}") for f in fields])
        side = side.withColumnRenamed("it", "_t")
        base = base.join(side, (base["it"] == side["_t"]) & (base[y] == side["_y"]) & (base[x] == side["_x"])).drop("_t", "_y", "_x")
    return base.drop("iy1", "ix1")


def sample(points: DataFrame, table: DataFrame, axes: Axes, lat: str = "lat_deg", lon: str = "lon_deg", t: str = "t_h",
           masked: list[str] = MASKED, plain: list[str] = PLAIN) -> DataFrame:
    """``points`` with the fields of ``table`` (from ``cells``) at their place and time; points outside take the edge.

    Two equi-joins with the cell table, one for each time, or one if the grid has a single time; a value missing at
    either time is missing.
    """
    t0, step, nt = axes.hours
    placed = points.withColumns({
        "_fy": fraction(F.col(lat), *axes.lat), "_fx": fraction(F.col(lon), *axes.lon), "_ft": fraction(F.col(t), t0, step, nt)})
    placed = placed.withColumns({
        "_iy": F.floor("_fy").cast("int"), "_ix": F.floor("_fx").cast("int"), "_t0": F.floor("_ft").cast("int")})
    placed = placed.withColumn("_t1", F.least(F.col("_t0") + 1, F.lit(nt - 1)))
    at = weights(F.col("_fy"), F.col("_fx"))
    out, times = placed, ("0", "1") if nt > 1 else ("0",)
    for k in times:
        own = table.select(
            F.col("it").alias(f"_it{k}"), F.col("iy").alias(f"_iy{k}"), F.col("ix").alias(f"_ix{k}"),
            *[F.col(f"{f}_{c}").alias(f"_{f}_{c}_{k}") for f in [*masked, *plain] for c in CORNERS])
        out = out.join(own, (F.col(f"_t{k}") == F.col(f"_it{k}")) & (F.col("_iy") == F.col(f"_iy{k}")) & (F.col("_ix") == F.col(f"_ix{k}")), "left")

    def value(f: str) -> Column:
        both = []
        for k in times:
            corner = {c: F.col(f"_{f}_{c}_{k}") for c in CORNERS}
            both.append((bilinear_masked if f in masked else bilinear)(corner, at))
        if nt == 1:
            return both[0]
        w = F.col("_ft") - F.col("_t0")
        return both[0] * (1.0 - w) + both[1] * w

    out = out.select(*points.columns, *[value(f).alias(f) for f in [*masked, *plain]])
    if "wave_u" in masked:
        u, v = F.col("wave_u"), F.col("wave_v")
        out = out.withColumn("wave_from_deg", F.when(F.isnan(u) | F.isnan(v), F.lit(float("nan"))).otherwise(speed_and_origin(u, v)[1]))
        out = out.drop("wave_u", "wave_v")
    return out


def annotate(track: DataFrame, table: DataFrame, axes: Axes, reference_s: float) -> DataFrame:
    """Track points with the weather at their time; every point stays."""
    timed = track.withColumn("t_h", (F.col("t_epoch_s") - reference_s) / 3600.0)
    return sample(timed, table, axes)


def target_grid(spark, lat: tuple[float, float, int], lon: tuple[float, float, int], hours: list[float]) -> DataFrame:
    """Every place of a grid at every hour: it, iy, ix, lat_deg, lon_deg, t_h."""
    n = lat[2] * lon[2]
    i = F.col("id")
    times = F.array(*[F.lit(float(h)) for h in hours])
    return spark.range(n * len(hours)).select(
        F.floor(i / n).cast("int").alias("it"), (F.floor(i / lon[2]) % lat[2]).cast("int").alias("iy"), (i % lon[2]).cast("int").alias("ix"),
    ).withColumns({
        "lat_deg": lat[0] + F.col("iy") * lat[1], "lon_deg": lon[0] + F.col("ix") * lon[1], "t_h": times[F.col("it")]})


def display_field(spark, table: DataFrame, axes: Axes, box: tuple[float, float, float, float], hour: float, rows: int = 30, columns: int = 32) -> DataFrame:
    """One row for each latitude of a display raster over ``box`` at the hour nearest to ``hour``: arrays, null where missing."""
    west, south, east, north = box
    grid = target_grid(spark, (south, (north - south) / (rows - 1), rows), (west, (east - west) / (columns - 1), columns), [float(round(hour))])
    found = sample(grid, table, axes)
    value = F.sort_array(F.collect_list(F.struct("ix", null_if_nan(F.col("hs_m")).alias("hs"), null_if_nan(F.col("wave_from_deg")).alias("dir"))))
    return found.groupBy("iy").agg(F.first("lat_deg").alias("lat_deg"), value.alias("v")).select(
        "iy", "lat_deg", F.transform("v", lambda x: x["hs"]).alias("hs_m"), F.transform("v", lambda x: x["dir"]).alias("wave_from_deg"))


def hold_nearest(hours: DataFrame, first_s: float, last_s: float, most_h: float = 6.0) -> DataFrame:
    """Times of ``hours(t_epoch_s)`` brought into [first_s, last_s]; a time more than ``most_h`` hours outside fails."""
    t = F.col("t_epoch_s")
    gap = F.greatest(F.lit(first_s) - t, t - F.lit(last_s)) / 3600.0
    fail = F.raise_error(F.lit("currents end more than the permitted hours from the forecast")).cast("double")
    return hours.withColumn("query_s", F.when(gap > most_h, fail).otherwise(F.greatest(F.lit(first_s), F.least(F.lit(last_s), t))))


def merge_currents(weather: DataFrame, at: Axes, currents: DataFrame, axes: Axes, start_s: float, first_s: float, most_h: float = 6.0) -> DataFrame:
    """``weather(it, iy, ix, t_h, ...)`` with current_u_ms and current_v_ms of another grid at its places and times.

    ``start_s`` is the epoch of the weather's hour 0, and ``first_s`` that of hour 0 of the currents, ``currents(it, iy, ix,
    current_u_ms, current_v_ms)``.  Times just outside take the nearest within ``most_h`` hours; places outside are NaN, and
    so are those with a NaN corner, as a plain interpolation has it.
    """
    t0, step, n = axes.hours
    timed = hold_nearest(weather.withColumn("t_epoch_s", start_s + F.col("t_h") * 3600.0), first_s + t0 * 3600.0, first_s + (t0 + step * (n - 1)) * 3600.0, most_h)
    fields = ["current_u_ms", "current_v_ms"]
    spots = timed.drop(*fields).withColumns({
        "_lat": at.lat[0] + F.col("iy") * at.lat[1], "_lon": at.lon[0] + F.col("ix") * at.lon[1], "_t": (F.col("query_s") - first_s) / 3600.0})
    found = sample(spots, cells(currents, fields, axes), axes, "_lat", "_lon", "_t", masked=[], plain=fields)
    within = lambda x, first, step, n: x.between(*sorted((first, first + step * (n - 1))))
    inside = within(F.col("_lat"), *axes.lat) & within(F.col("_lon"), *axes.lon)
    return found.withColumns({f: F.when(inside, F.col(f)).otherwise(F.lit(float("nan"))) for f in fields}).drop("_lat", "_lon", "_t", "query_s", "t_epoch_s")


def regrid(spark, table: DataFrame, axes: Axes, lat: tuple[float, float, int], lon: tuple[float, float, int], hours: list[float]) -> DataFrame:
    """A field on other axes (I9, I10): it, iy, ix, lat_deg, lon_deg, t_h and the fields."""
    return sample(target_grid(spark, lat, lon, hours), table, axes)


def sorted_axes(grid: DataFrame, lat: str = "lat_deg", lon: str = "lon_deg", t: str = "t_h") -> DataFrame:
    """``grid`` with it, iy, ix: the places of its rows along ascending axes (T6), whatever order the source has them in.

    An axis has few values; each is ranked once and joined back.
    """
    out = grid
    for name, c in (("it", t), ("iy", lat), ("ix", lon)):
        values = grid.select(c).distinct().agg(F.array_sort(F.collect_set(c)).alias("v")).select(F.posexplode("v").alias(name, c))
        out = out.join(F.broadcast(values), c)  # one row for each value of an axis
    return out
