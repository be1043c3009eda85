"""Domain tables made from the driver's tables, and the same as SQL text for the oracle.

Telemetry comes from ``events``: a user is a vessel, an event a sample.  Speeds, courses, fuel and waves are arithmetic
on the keys, so both engines make the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Gaps between the events of a user are hours long, so runs are given a day.
GAP_S = 86400.0

TELEMETRY = """tele AS (
  SELECT user_id AS vessel_id, event_id, epoch_us(ts) AS t_us, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS t_s,
    10e0 + (user_id % 7) * 0.25e0 + (event_id % 9) * 0.1e0 AS stw_ms,
    CAST((user_id * 37 + event_id % 12) % 360 AS DOUBLE) AS heading_deg,
    CAST(1 + (user_id + epoch_us(ts) // 864000000000) % 2 AS INTEGER) AS active_engines,
    80e0 + event_id % 40 AS fuel_kg_per_h, (event_id % 40) / 10e0 AS hs_m, 4e0 + (event_id % 80) / 10e0 AS period_peak_s,
    CAST((event_id * 53) % 360 AS DOUBLE) AS wave_from_deg,
    41e0 + ((event_id * 7919) % 2500) / 1000e0 AS lat_deg, 7e0 + ((event_id * 104729) % 3000) / 1000e0 AS lon_deg
  FROM events)"""

PLACES = """places AS (
  SELECT s_suppkey AS place_id, 41e0 + ((s_suppkey * 7919) % 2500) / 1000e0 AS lat_deg,
    7e0 + ((s_suppkey * 104729) % 3000) / 1000e0 AS lon_deg FROM supplier)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))
    return rows.select(
        u.alias("vessel_id"), "event_id", "t_us", (F.col("t_us").cast("double") / 1e6).alias("t_s"),
        (10.0 + (u % 7) * 0.25 + (e % 9) * 0.1).alias("stw_ms"), ((u * 37 + e % 12) % 360).cast("double").alias("heading_deg"),
        (1 + (u + F.floor(F.col("t_us") / 864000000000)) % 2).cast("int").alias("active_engines"), (80.0 + e % 40).alias("fuel_kg_per_h"),
        ((e % 40) / 10.0).alias("hs_m"), (4.0 + (e % 80) / 10.0).alias("period_peak_s"), ((e * 53) % 360).cast("double").alias("wave_from_deg"),
        (41.0 + ((e * 7919) % 2500) / 1000.0).alias("lat_deg"), (7.0 + ((e * 104729) % 3000) / 1000.0).alias("lon_deg"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("place_id"), (41.0 + ((k * 7919) % 2500) / 1000.0).alias("lat_deg"), (7.0 + ((k * 104729) % 3000) / 1000.0).alias("lon_deg"))


#: Three islands of our own for the queries, and two boxes; a coastline is an input of the operators.
ISLANDS = [
    [(42.9, 9.3), (42.6, 8.7), (42.0, 8.6), (41.5, 8.9), (41.4, 9.2), (42.2, 9.6)],
    [(41.2, 9.1), (41.0, 9.6), (40.8, 9.5), (40.8, 8.2), (41.0, 8.3)],
    [(43.1, 9.8), (43.0, 9.9), (42.95, 9.8)],
]
BOXES = [(8.5, 42.3, 8.65, 42.42), (9.21, 41.29, 9.31, 41.36)]  # lon_min, lat_min, lon_max, lat_max

#: A small grid with a corner of missing values: 9 lines of latitude, 11 of longitude, 4 times.
GRID_LAT, GRID_LON, GRID_T = (41.0, 0.3, 9), (7.0, 0.3, 11), (0.0, 6.0, 4)


def grid(spark: SparkSession) -> DataFrame:
    from fairlead.operators.interp import target_grid

    it, iy, ix = F.col("it"), F.col("iy"), F.col("ix")
    nan = F.lit(float("nan"))
    gone = (iy + ix) % 7 == 0
    rows = target_grid(spark, GRID_LAT, GRID_LON, [GRID_T[0] + GRID_T[1] * i for i in range(GRID_T[2])])
    return rows.withColumns({
        "hs_m": F.when(gone, nan).otherwise(0.5 + iy * 0.1 + ix * 0.05 + it * 0.2), "period_peak_s": F.when(gone, nan).otherwise(5.0 + iy * 0.2 + it * 0.1),
        "period_mean_s": F.when(gone, nan).otherwise(4.0 + iy * 0.2), "wave_from_deg": F.when(gone, nan).otherwise((iy * 20 + ix * 11 + it * 30) % 360 * 1.0),
        "wind_u_ms": 3.0 - ix * 0.4, "wind_v_ms": 1.0 + iy * 0.3 - it * 0.5, "current_u_ms": F.when(gone, nan).otherwise(0.02 * ix),
        "current_v_ms": F.when(gone, nan).otherwise(0.01 * iy)})


def _gone(x: str) -> str:
    return f"CASE WHEN (iy + ix) % 7 = 0 THEN 'NaN'::DOUBLE ELSE {x} END"


GRID = f"""axis AS (SELECT t.i AS it, y.i AS iy, x.i AS ix FROM range(4) t(i), range(9) y(i), range(11) x(i)),
line AS (SELECT *, radians(CAST((iy * 20 + ix * 11 + it * 30) % 360 AS DOUBLE) + 180e0) AS wave_to FROM axis),
grid AS (SELECT it, iy, ix, 41e0 + iy * 0.3e0 AS lat_deg, 7e0 + ix * 0.3e0 AS lon_deg, it * 6e0 AS t_h,
    {_gone("0.5e0 + iy * 0.1e0 + ix * 0.05e0 + it * 0.2e0")} AS hs_m, {_gone("5e0 + iy * 0.2e0 + it * 0.1e0")} AS period_peak_s,
    {_gone("4e0 + iy * 0.2e0")} AS period_mean_s, {_gone("0.02e0 * ix")} AS current_u_ms, {_gone("0.01e0 * iy")} AS current_v_ms,
    {_gone("sin(wave_to)")} AS wave_u, {_gone("cos(wave_to)")} AS wave_v,
    3e0 - ix * 0.4e0 AS wind_u_ms, 1e0 + iy * 0.3e0 - it * 0.5e0 AS wind_v_ms FROM line)"""

#: Rings of up to this many vertices, each from as many customers with keys in a row.
RING_POINTS = 60

VERTICES = f"""vertex AS (
  SELECT c_custkey // {RING_POINTS} AS ring, c_custkey % {RING_POINTS} AS k,
    41.2e0 + (c_custkey // {RING_POINTS} % 5) * 0.5e0 + (0.1e0 + (c_custkey * 7919 % 200) / 1000e0) * sin(c_custkey % {RING_POINTS} * 2e0 * pi() / {RING_POINTS}) AS lat,
    7.3e0 + (c_custkey // {5 * RING_POINTS} % 5) * 0.6e0 + (0.1e0 + (c_custkey * 7919 % 200) / 1000e0) * cos(c_custkey % {RING_POINTS} * 2e0 * pi() / {RING_POINTS}) AS lon
  FROM customer),
  ring_edge AS (SELECT ring, lat AS yi, lon AS xi, coalesce(lag(lat) OVER w, last_value(lat) OVER f) AS yj, coalesce(lag(lon) OVER w, last_value(lon) OVER f) AS xj FROM vertex
    WINDOW w AS (PARTITION BY ring ORDER BY k), f AS (PARTITION BY ring ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) QUALIFY count(*) OVER f > 2)"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ring, points: star-shaped rings from the customers."""
    k = F.col("c_custkey")
    turn, reach = (k % RING_POINTS) * 2.0 * F.pi() / RING_POINTS, 0.1 + (k * 7919 % 200) / 1000.0
    ring = F.floor(k / RING_POINTS)
    lat = 41.2 + (ring % 5) * 0.5 + reach * F.sin(turn)
    lon = 7.3 + (F.floor(k / (5 * RING_POINTS)) % 5) * 0.6 + reach * F.cos(turn)
    rows = table(spark, sf_dir, "customer").select(ring.alias("ring"), F.struct((k % RING_POINTS).alias("k"), lat.alias("lat"), lon.alias("lon")).alias("v"))
    whole = rows.groupBy("ring").agg(F.array_sort(F.collect_list("v")).alias("v"))  # RING_POINTS at most
    return whole.select("ring", F.transform("v", lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon"))).alias("points"))


#: A grid of depths around them: its lines of latitude and longitude, and its heights.
DEPTH_LAT, DEPTH_LON = (40.5, 0.25, 17), (6.5, 0.25, 19)
DEPTHS = "depth AS (SELECT y.i AS iy, x.i AS ix, CAST((y.i * 13 + x.i * 29) % 40 AS DOUBLE) - 30e0 AS elevation FROM range(17) y(i), range(19) x(i))"


def depths(spark: SparkSession) -> DataFrame:
    from fairlead.operators.interp import target_grid

    grid = target_grid(spark, DEPTH_LAT, DEPTH_LON, [0.0]).select("iy", "ix")
    return grid.withColumns({"elevation_m": ((F.col("iy") * 13 + F.col("ix") * 29) % 40).cast("double") - 30.0, "is_land": F.lit(None).cast("boolean")})
