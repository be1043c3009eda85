"""Unit conversions, directions and flat-earth geometry as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# One constant for each place that uses its own.
KN_TO_MS = 0.514444
IMPORT_KN_TO_MS = 0.5144444444444445
SEGMENT_MS_TO_KN = 1.943844
NM_TO_M = 1852.0
NM_PER_DEGREE = 60.0


def num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def kn_to_ms(x: Column) -> Column:
    return x * F.lit(KN_TO_MS)


def ms_to_kn(x: Column) -> Column:
    return x / F.lit(KN_TO_MS)


def nm_to_m(x: Column) -> Column:
    return x * F.lit(NM_TO_M)


def m_to_nm(x: Column) -> Column:
    return x / F.lit(NM_TO_M)


def wrap_longitude(x: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def wrap_bearing(x: Column) -> Column:
    """Bearing in [0, 360); a sum that rounds up to 360 is 0."""
    y = F.pmod(x, F.lit(360.0))
    return F.when(y >= 360.0, 0.0).otherwise(y)


def _of_degrees(x: Column, jvm: Column, f) -> Column:
    """``jvm``, but of whole degrees ``f`` as correctly rounded; the JVM's sine and cosine may be off in the last bit."""
    table = F.array(*[F.lit(f(math.radians(i))) for i in range(360)])
    return F.when((x >= 0) & (x < 360) & (x == F.floor(x)), F.get(table, x.cast("int"))).otherwise(jvm)


def sine(deg: Column) -> Column:
    return _of_degrees(deg, F.sin(F.radians(deg)), math.sin)


def cosine(deg: Column) -> Column:
    return _of_degrees(deg, F.cos(F.radians(deg)), math.cos)


def exact_atan2(y: Column, x: Column) -> Column:
    """As ``F.atan2`` but correctly rounded, which the JVM's is not for one pair in six or so."""

    def angles(y: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([math.atan2(a, b) for a, b in zip(y.tolist(), x.tolist(), strict=True)], dtype="float64")

    found = F.pandas_udf(angles, "double")(y, x)  # missing values come back as null
    return F.when(F.isnan(y) | F.isnan(x), float("nan")).otherwise(found)


def components(speed: Column, from_deg: Column) -> tuple[Column, Column]:
    """East and north parts of a flow that comes from ``from_deg``."""
    to = F.radians(from_deg + 180.0)
    return speed * F.sin(to), speed * F.cos(to)


def speed_and_origin(u: Column, v: Column) -> tuple[Column, Column]:
    return F.hypot(u, v), wrap_bearing(F.degrees(F.atan2(u, v)) + 180.0)


def distance_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column, ref_lat: Column | float) -> Column:
    shrink = F.cos(F.radians(num(ref_lat)))
    return F.hypot((lon2 - lon1) * NM_PER_DEGREE * shrink, (lat2 - lat1) * NM_PER_DEGREE)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column, ref_lat: Column | float) -> Column:
    shrink = F.cos(F.radians(num(ref_lat)))
    return wrap_bearing(F.degrees(F.atan2((lon2 - lon1) * shrink, lat2 - lat1)))


def exact_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column, ref_lat: Column | float) -> Column:
    """As ``bearing``, for differences of bearings that tell half a turn to the left from one to the right."""
    shrink = F.cos(F.radians(num(ref_lat)))
    return wrap_bearing(F.degrees(exact_atan2((lon2 - lon1) * shrink, lat2 - lat1)))


def between(a: Column, b: Column, share: Column | float) -> Column:
    return a + (b - a) * share


def current_triangle(stw: Column, track_deg: Column, u: Column, v: Column) -> dict[str, Column]:
    """ground_speed and course_to_steer that hold a track in a current; ``exceeded`` where none does, both then null."""
    b = F.radians(track_deg)
    along, across = u * F.sin(b) + v * F.cos(b), u * F.cos(b) - v * F.sin(b)
    rest = stw * stw - across * across
    ahead = F.when(rest >= 0, F.sqrt(F.greatest(rest, F.lit(0.0))))
    east = ahead * F.sin(b) - across * F.cos(b)
    north = ahead * F.cos(b) + across * F.sin(b)
    return {
        "ground_speed": ahead + along, "course_to_steer": wrap_bearing(F.degrees(F.atan2(east, north))), "exceeded": rest < 0,
    }


def angle_between(a: Column, b: Column) -> Column:
    """Smallest angle between two directions, in [0, 180]."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def signed_turn(before: Column, after: Column) -> Column:
    return F.pmod(after - before + 540.0, F.lit(360.0)) - 180.0


def coming_from(direction: Column, is_to: Column) -> Column:
    """Direction in the coming-from convention; ``is_to`` marks those given as going-to."""
    return wrap_bearing(F.when(is_to, direction + 180.0).otherwise(direction))


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
