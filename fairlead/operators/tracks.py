"""Tables of track points: distances, courses, alterations, boxes, totals, thinning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.functions.units import bearing, distance_nm, exact_bearing, signed_turn

BAND, BAND_LON, TURN_DEG = (41.3, 43.0), 9.0, 8.0


def with_legs(points: DataFrame, by: str, seq: str, ref_lat: float = 42.3) -> DataFrame:
    """Points with leg_nm and course_deg of the leg that ends there; null at the first."""
    order = Window.partitionBy(by).orderBy(seq)
    lat, lon = F.lag("lat_deg").over(order), F.lag("lon_deg").over(order)
    return points.withColumns({
        "leg_nm": distance_nm(lat, lon, F.col("lat_deg"), F.col("lon_deg"), ref_lat),
        "course_deg": bearing(lat, lon, F.col("lat_deg"), F.col("lon_deg"), ref_lat)})


def track_distance(points: DataFrame, by: str, seq: str, ref_lat: float = 42.3) -> DataFrame:
    return with_legs(points, by, seq, ref_lat).groupBy(by).agg(
        F.coalesce(F.sum("leg_nm"), F.lit(0.0)).alias("distance_nm"), F.count("*").alias("n_points"))


def alterations(points: DataFrame, by: str, seq: str, ref_lat: float = 42.3, least_deg: float = TURN_DEG) -> DataFrame:
    """Where the course changes by more than ``least_deg``: the point, the courses before and after, the turn.

    Courses are correctly rounded, as a way straight back is a turn of 180 or -180 by their last bits.
    """
    order = Window.partitionBy(by).orderBy(seq)
    ahead = [F.lead(c).over(order).alias(f"_{c}") for c in ("lat_deg", "lon_deg")]
    behind = [F.lag(c).over(order).alias(f"_was_{c}") for c in ("lat_deg", "lon_deg")]
    here, was, to = ((F.col(f"{x}lat_deg"), F.col(f"{x}lon_deg")) for x in ("", "_was_", "_"))
    legs = with_legs(points, by, seq, ref_lat).select("*", *ahead, *behind).withColumns({
        "course_deg": exact_bearing(*was, *here, ref_lat), "next_course_deg": exact_bearing(*here, *to, ref_lat)})
    legs = legs.drop("_lat_deg", "_lon_deg", "_was_lat_deg", "_was_lon_deg")
    return legs.withColumn("turn_deg", signed_turn(F.col("course_deg"), F.col("next_course_deg"))).where(F.abs("turn_deg") > least_deg)


def covering_box(points: DataFrame, by: str, margin: float = 0.25) -> DataFrame:
    """Box and time range of each track; a spread over 180 degrees, as across the antimeridian, fails when it is read."""
    box = points.groupBy(by).agg(
        F.min("lon_deg").alias("w"), F.max("lon_deg").alias("e"), (F.min("lat_deg") - margin).alias("lat_min"),
        (F.max("lat_deg") + margin).alias("lat_max"), F.min("t_epoch_s").alias("t_min_s"), F.max("t_epoch_s").alias("t_max_s"))
    fail = F.raise_error(F.lit("a track spreads over 180 degrees of longitude")).cast("double")
    west = F.when(F.col("e") - F.col("w") > 180.0, fail).otherwise(F.col("w") - margin)
    return box.select(by, west.alias("lon_min"), "lat_min", (F.col("e") + margin).alias("lon_max"), "lat_max", "t_min_s", "t_max_s")


def signature(points: DataFrame, by: str) -> DataFrame:
    """W or E of BAND_LON by the mean longitude within a band of latitudes; null for a track without a point there."""
    mean = F.avg(F.when(F.col("lat_deg").between(*BAND), F.col("lon_deg")))
    return points.groupBy(by).agg(mean.alias("mean_lon")).select(
        by, F.when(F.col("mean_lon") < BAND_LON, "W").when(F.col("mean_lon").isNotNull(), "E").alias("side"))


def running_eta(legs: DataFrame, by: str, seq: str, t0: Column) -> DataFrame:
    """``legs(<by>, <seq>, duration_h)`` with eta_h, the arrival at the end of each."""
    return legs.withColumn("eta_h", t0 + F.sum("duration_h").over(Window.partitionBy(by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))


def thin(points: DataFrame, by: str, seq: str, tolerance_nm: float = 0.0, ref_lat: float = 42.3) -> DataFrame:
    """Tracks without the points that a straight shortcut passes within ``tolerance_nm``, from left to right.

    Whether a point goes depends on which before it went, so each track is walked in order by a small function.
    """
    import math

    shrink = math.cos(math.radians(ref_lat))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq, kind="stable")
        xy = [(lon * 60.0 * shrink, lat * 60.0) for lat, lon in zip(pdf["lat_deg"], pdf["lon_deg"], strict=True)]
        keep = [0]
        for i in range(1, len(xy) - 1):
            (ax, ay), (px, py), (bx, by_) = xy[keep[-1]], xy[i], xy[i + 1]
            length = math.hypot(bx - ax, by_ - ay)
            off = abs((bx - ax) * (ay - py) - (ax - px) * (by_ - ay)) / length if length else math.hypot(px - ax, py - ay)
            if off > tolerance_nm + 1e-9:
                keep.append(i)
        return pdf.iloc[sorted({*keep, len(xy) - 1})]

    return points.groupBy(by).applyInPandas(walk, points.schema)

